"""The given test tables seen as this domain's tables.

Column expressions are plain SQL that both Spark and DuckDB read alike, so the
inputs of a query and of its oracle are the same by construction; everything above
them is written twice and independently.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AMOUNT = "CAST(l_extendedprice AS DECIMAL(10,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"
QTY = "CAST(l_quantity AS INT)"
SEX = ("CASE WHEN l_linenumber = 7 THEN 'M' WHEN o_custkey % 4 = 0 THEN 'F' WHEN o_custkey % 4 = 1 "
       "THEN 'M' WHEN o_custkey % 4 = 2 THEN 'C' WHEN o_custkey % 8 = 3 THEN '' END")
NATION = ("CASE o_custkey % 6 WHEN 0 THEN 'Hong Kong' WHEN 1 THEN 'Mainland China' WHEN 2 THEN 'Macau' "
          "WHEN 3 THEN 'Taiwanese' WHEN 4 THEN 'Korean' END")
AGE = "'0' || CAST(1 + (o_custkey + l_linenumber) % 7 AS STRING)"
STAFF = "CASE WHEN o_custkey % 20 = 3 THEN 1 ELSE 0 END"
PART_BRAND = "CASE {0} % 4 WHEN 2 THEN 'BP' WHEN 3 THEN 'JBZZZ' ELSE 'BA' END"
ITEM_CAT = ("CASE WHEN p_partkey % 40 = 0 THEN NULL WHEN p_type = 'STANDARD' THEN 'BA01' WHEN p_type = "
            "'ECONOMY' THEN 'BP01' WHEN p_type = 'MEDIUM' THEN 'BA13' WHEN p_type = 'SMALL' THEN 'BP10' "
            "WHEN p_type = 'LARGE' THEN 'BA02' ELSE 'BP02' END")
SUB_CAT = "'SC' || CAST(p_size % 10 AS STRING)"
MAINCAT = ("CASE {0} % 7 WHEN 0 THEN 'Skin' WHEN 1 THEN 'Body' WHEN 2 THEN 'Hair' WHEN 3 THEN 'gift' "
           "WHEN 4 THEN 'Dummy' WHEN 5 THEN 'ZZ' ELSE 'Men' END")


@dataclass(frozen=True)
class View:
    """Columns over a join of given tables; ``copies`` repeats rows, numbered ``copy``."""

    columns: dict[str, str]
    base: str
    joins: tuple[tuple[str, str], ...] = ()
    copies: int = 1
    where: str = "TRUE"
    extra: dict[str, str] = field(default_factory=dict)

    def sql(self) -> str:
        cols = ",\n ".join(f"{e} AS {n}" for n, e in self.columns.items())
        joins = "".join(f" JOIN {t} ON {on}" for t, on in self.joins)
        return (f"SELECT {cols}\nFROM {self.base}{joins} "
                f"CROSS JOIN range({self.copies}) AS r(copy)\nWHERE {self.where}")

    def frame(self, spark: SparkSession, sf_dir: str, last: str | None = None) -> DataFrame:
        """``last``: the table joined last. Lines that meet their order last lie together by order, so what is
        reduced by member or order combines before it moves; with a filter of days orders are better joined first."""
        df = spark.read.parquet(f"{sf_dir}/{self.base}.parquet")
        for table, on in sorted(self.joins, key=lambda join: join[0] == last):
            df = df.join(spark.read.parquet(f"{sf_dir}/{table}.parquet"), F.expr(on))
        if self.copies > 1:
            numbers = F.array(*[F.lit(i) for i in range(self.copies)])
            df = df.withColumn("copy", F.explode(numbers)).filter(F.expr(self.where))
        return df.select([F.expr(e).alias(n) for n, e in self.columns.items()])


LINE_JOIN = (("orders", "l_orderkey = o_orderkey"),)

SALES = View({
    "region_key": "CASE o_custkey % 5 WHEN 2 THEN 'MO' WHEN 3 THEN 'TW' WHEN 4 THEN 'CN' ELSE 'HK' END",
    "shop_code": "CASE WHEN l_orderkey % 7 = 0 THEN 'BAEHKG02' ELSE ' S' || CAST(o_custkey % 10 AS STRING) || ' ' END",
    "invoice_no": "CAST(l_orderkey AS STRING)",
    "item_code": "CAST(l_partkey AS STRING)",
    "sales_date": "o_orderdate",
    "sold_qty": f"CASE WHEN l_orderkey % 5 = 0 THEN {QTY} % 3 - 1 WHEN l_returnflag = 'R' THEN -{QTY} ELSE {QTY} END",
    "net_amt_hkd": f"CASE WHEN l_returnflag = 'R' THEN -1 * ({AMOUNT}) ELSE {AMOUNT} END",
    "net_amt": "CASE WHEN l_partkey % 30 = 0 THEN CAST(0 AS DECIMAL(18,2)) ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END",
    "item_list_price": "CAST(l_extendedprice AS DECIMAL(18,2))",
    "shop_brand": "CASE WHEN o_custkey % 7 < 3 THEN 'BA' WHEN o_custkey % 7 < 6 THEN 'BP' ELSE 'HB' END",
    "vip_no": "CASE WHEN o_custkey % 11 = 5 THEN NULL ELSE CAST(o_custkey AS STRING) END",
    "prod_brand": f"CASE WHEN l_linenumber = 7 THEN 'ZZ' ELSE {PART_BRAND.format('l_partkey')} END",
    "sale_lady_id": "CASE l_linenumber WHEN 6 THEN 'sxd' WHEN 5 THEN NULL ELSE 'L' || CAST(l_suppkey % 10 AS STRING) END",
    "cashier_id": "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'BAEXC' WHEN '2' THEN 'BAEXC' WHEN '5' THEN '30241' ELSE 'CASHIER' END",
    "customer_nat": "'N' || CAST(o_custkey % 25 AS STRING)",
    "cust_nat_cat": NATION,
    "customer_sex": SEX,
    "customer_age_group": AGE,
    "void_flag": "CASE WHEN o_orderstatus = 'P' AND l_linenumber = 1 THEN 'V' END",
    "valid_tx_flag": "CASE WHEN l_tax > 0.075 THEN 0 ELSE 1 END",
    "sales_staff_flag": STAFF,
    "invoice_remark": "CASE WHEN l_linenumber = 2 THEN ' gift ' END",
    "sales_type": "CASE WHEN l_linestatus = 'F' AND l_returnflag = 'N' THEN 'Service' ELSE 'Product' END",
}, "lineitem", LINE_JOIN, copies=2, where="copy = 0 OR l_orderkey % 3 = 0")

MEMBERS = View({
    "vip_no": "CAST(c_custkey AS STRING)",
    "vip_main_no": "CASE copy WHEN 0 THEN 'M' || CAST(c_custkey - c_custkey % 3 AS STRING) WHEN 1 THEN 'A' || CAST(c_custkey AS STRING) END",
    "vip_type": "CASE c_custkey % 3 WHEN 0 THEN 'GOLD' WHEN 1 THEN 'SILVER' ELSE 'BASE' END",
    "vip_issue_date": "DATE '2015-01-01' + CAST(c_custkey % 1000 AS INT)",
    "vip_sex": "CASE WHEN c_mktsegment = 'MACHINERY' THEN 'M' ELSE 'F' END",
    "vip_nation": "'N' || CAST(c_nationkey AS STRING)",
    "vip_agegrp": "'0' || CAST(1 + c_custkey % 7 AS STRING)",
    "region_key": "CASE c_custkey % 5 WHEN 2 THEN 'MO' WHEN 3 THEN 'TW' WHEN 4 THEN 'CN' ELSE 'HK' END",
    "vip_staff_flag": "CASE WHEN c_custkey % 20 = 3 THEN 1 ELSE 0 END",
    "vip_ba_first_pur_date": "DATE '2016-01-01' + CAST(c_custkey % 500 AS INT)",
    "vip_ba_vip_type": "CASE WHEN c_acctbal > 5000 THEN 'A' ELSE 'B' END",
    "vip_bp_first_pur_date": "DATE '2017-01-01' + CAST(c_custkey % 500 AS INT)",
    "vip_bp_vip_type": "CASE WHEN c_acctbal > 5000 THEN 'P' ELSE 'Q' END",
}, "customer", copies=3,
    where="copy = 0 OR (copy = 1 AND c_custkey % 4 = 0) OR (copy = 2 AND c_custkey % 5 = 0)")

SKUS = View({
    "item_code": "CAST(p_partkey AS STRING)",
    "item_desc": "p_name || CASE WHEN copy = 0 THEN '' WHEN copy = 2 AND p_partkey % 12 = 0 THEN ' v3' ELSE ' v2' END",
    "item_desc_c": "'c' || CAST(copy AS STRING)",
    "item_cat": ITEM_CAT,
    "item_sub_cat": SUB_CAT,
    "item_product_line": "'PL' || CAST(p_size AS STRING)",
    "item_product_line_desc": "p_brand",
    "brand_code": PART_BRAND.format("p_partkey"),
    "maincat_key": "CAST(p_size % 30 AS STRING)",
    "retail_price_hk": "CAST(p_retailprice AS DECIMAL(18,2)) - 890",
    "retail_price_tw": "(CAST(p_retailprice AS DECIMAL(18,2)) - 890) * 4",
    "last_modified_date": "CASE copy WHEN 0 THEN TIMESTAMP '2020-01-01 08:00:00' WHEN 1 THEN TIMESTAMP '2021-06-01 09:00:00' ELSE TIMESTAMP '2021-06-01 18:00:00' END",
}, "part", copies=3,
    where="copy = 0 OR (copy = 1 AND p_partkey % 3 = 0) OR (copy = 2 AND p_partkey % 6 = 0)")

LOCATIONS = View({
    "shop_code": "CASE WHEN s_suppkey = 9 THEN 'BAEHKG02' ELSE 'S' || CAST(s_suppkey AS STRING) END",
    "shop_desc": "CASE WHEN copy = 2 AND s_suppkey % 8 = 0 THEN s_name || ' moved' WHEN copy = 0 THEN s_name || ' old' ELSE s_name END",
    "city_district": "CASE (s_nationkey + s_suppkey) % 8 WHEN 0 THEN 'TW-Taipei' WHEN 1 THEN 'TW-Taichung' WHEN 2 THEN 'TW-Tainan' WHEN 3 THEN 'TW-Other' WHEN 4 THEN 'HK-Taipei' WHEN 5 THEN 'TW-Hsinchu' WHEN 6 THEN 'tw-taipei' END",
    "shop_brand": "CASE s_suppkey % 6 WHEN 0 THEN 'BA' WHEN 1 THEN 'BP' WHEN 2 THEN 'HB' WHEN 3 THEN 'JB' WHEN 4 THEN 'AU' ELSE 'XX' END",
    "modified_date": "CASE WHEN s_suppkey % 17 = 16 THEN NULL WHEN copy = 0 THEN TIMESTAMP '2019-01-01 00:00:00' WHEN copy = 1 THEN TIMESTAMP '2022-03-01 10:00:00' ELSE TIMESTAMP '2022-03-01 15:00:00' END",
}, "supplier", copies=3, where="copy < 2 OR s_suppkey % 4 = 0")

MAIN_CATEGORIES = View({
    "maincat_key": "CAST(n_nationkey AS STRING)",
    "maincat_code": "'MC' || CAST(n_nationkey AS STRING)",
    "maincat_desc": MAINCAT.format("n_nationkey"),
}, "nation", copies=2)

SUBCATEGORIES = View({
    "item_brand_key": "CASE WHEN p_partkey % 2 = 0 THEN 'BA' ELSE 'BP' END",
    "item_cat": ITEM_CAT,
    "item_sub_cat": SUB_CAT,
    "item_subcat_desc": "CASE p_size % 10 WHEN 0 THEN 'FACE-CLEANSING' WHEN 1 THEN 'Shampoo' WHEN 2 THEN 'Conditioner' ELSE 'Sub ' || CAST(p_size % 10 AS STRING) END",
    "load_date": "DATE '2023-01-01' + CAST(p_partkey % 13 AS INT)",
}, "part")

CONTACTS = View({
    "vip_main_no": "CAST(user_id AS STRING)",
    "vip_opt_in": "CAST(event_id % 2 AS INT)",
    "vip_no_sms": "CAST(event_id % 3 AS INT)",
    "vip_no_phone": "CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(event_id % 5 AS INT) END",
    "vip_no_edm": "CAST(event_id % 7 AS INT)",
    "vip_last_modified_date": "CASE WHEN event_id % 40 = 0 THEN NULL ELSE CAST(ts AS DATE) END",
    "vip_type_start_date": "DATE '2020-01-01' + CAST(event_id % 5 AS INT)",
    "vip_card_issue_date": "CASE WHEN event_id % 6 = 0 THEN NULL ELSE DATE '2019-01-01' + CAST(event_id % 7 AS INT) END",
    "vip_brand_code": "CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'BA' ELSE 'BP' END",
    "region_key": "CASE WHEN value > 10 THEN 'HK' ELSE 'MO' END",
}, "events")

# Valid transactions as the segment, report and persona jobs read them.
_TX = {
    "vip_main_no": "CAST(o_custkey AS STRING)",
    "order_date": "CAST(o_orderdate AS DATE)",
    "invoice_no": "CAST(l_orderkey AS STRING)",
    "shop_code": "CASE WHEN l_linenumber = 7 THEN NULL ELSE 'S' || CAST(l_suppkey AS STRING) END",
    "net_amt_hkd": AMOUNT,
    "sold_qty": f"CASE WHEN l_returnflag = 'R' THEN -{QTY} ELSE {QTY} END",
    "customer_sex": SEX,
    "cust_nat_cat": NATION,
    "customer_age_group": AGE,
    "sales_staff_flag": STAFF,
}
_ITEM = {
    "item_code": "CAST(l_partkey AS STRING)",
    "prod_brand": PART_BRAND.format("l_partkey"),
    "item_product_line_desc": "CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN 'N/A' ELSE p_brand END",
    "item_subcat_desc": "CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN 'dummy' ELSE p_type END",
    "maincat_desc": "CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE " + MAINCAT.format("p_size") + " END",
}
_SHOP = {"region_key": "r_name", "shop_desc": "s_name"}
_PART_JOIN = (("part", "l_partkey = p_partkey"),)
_SHOP_JOIN = (("supplier", "l_suppkey = s_suppkey"), ("nation", "s_nationkey = n_nationkey"),
              ("region", "n_regionkey = r_regionkey"))

TX = View(_TX, "lineitem", LINE_JOIN)
TX_ITEM = View({**_TX, **_ITEM}, "lineitem", LINE_JOIN + _PART_JOIN)
TX_SHOP = View({**_TX, **_SHOP}, "lineitem", LINE_JOIN + _SHOP_JOIN)

TX_ALL = View({**_TX, **_ITEM, **_SHOP}, "lineitem", LINE_JOIN + _PART_JOIN + _SHOP_JOIN)

PERSONAS = View({
    "vip_main_no": "CAST(c_custkey AS STRING)",
    "persona": "CAST(c_custkey % 6 AS INT)",
}, "customer")
EVENT_DAYS = View({"user_id": "user_id", "event_id": "event_id", "day": "CAST(ts AS DATE)",
                   "value": "value"}, "events")

SOURCES = {"sales": SALES, "members": MEMBERS, "skus": SKUS, "locations": LOCATIONS,
           "main_categories": MAIN_CATEGORIES, "subcategories": SUBCATEGORIES}
VIEWS = {**SOURCES, "contacts": CONTACTS, "tx": TX, "tx_item": TX_ITEM, "tx_shop": TX_SHOP, "tx_all": TX_ALL,
         "personas": PERSONAS, "event_days": EVENT_DAYS}


def sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: view.frame(spark, sf_dir) for name, view in SOURCES.items()}
