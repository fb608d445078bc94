"""Sales mart: raw tables to valid transactions, demographics, first/last purchase."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.config import CHANNEL_RULES, MEMBER, SALES_BRANDS, ChannelRule, Period
from clientele.functions.dates import yyyymm
from clientele.operators import clean, dimensions, mart
from clientele.operators.skew import drop_keys, lookup_join
from clientele.sources import io
from clientele.sources.staging import job, staged, staged_counted

BRAND_MEMBER_COLUMNS = {
    "BA": ("vip_ba_first_pur_date", "vip_ba_vip_type"),
    "BP": ("vip_bp_first_pur_date", "vip_bp_vip_type"),
}
FIRST_PURCHASE_COLUMNS = {"BA": "first_pur_ba", "BP": "first_pur_bp"}


def sales_history(tables: Mapping[str, DataFrame], brands: Iterable[str] = SALES_BRANDS,
                  amount_type: str = "decimal(10,0)") -> DataFrame:
    """Clean distinct lines of the brands over all time, with main member numbers."""
    lines = clean.trim_strings(clean.project_sales(tables["sales"], amount_type))
    return _resolved(lines, list(brands), tables)


def _resolved(lines: DataFrame, brands: list[str], tables: Mapping[str, DataFrame], profile: DataFrame | None = None) -> DataFrame:
    if profile is None:
        profile = lines.filter(F.col("shop_brand").isin(*brands))
    return clean.dedup_resolve(lines, brands, clean.member_key_map(tables["members"]), profile)


def enriched_lines(tables: Mapping[str, DataFrame], period: Period,
                   brands: Iterable[str] = SALES_BRANDS, amount_type: str = "decimal(10,0)",
                   shop_names: Mapping[str, str] | None = None) -> DataFrame:
    """Clean distinct lines of the window with members and all attributes.

    The keys of the lines are staged, since every join searches them for heavy ones.
    """
    brands = list(brands)
    lines = clean.between_dates(clean.trim_strings(clean.project_sales(tables["sales"], amount_type)), period.first, period.last)
    keys = staged(lines.filter(F.col("shop_brand").isin(*brands)).select("vip_no", "item_code", "prod_brand", "shop_code"))
    return mart.enrich_sales(
        _resolved(lines, brands, tables, keys),
        dimensions.enrich_sku(dimensions.clean_skus(tables["skus"]), tables["main_categories"]),
        dimensions.clean_subcategories(tables["subcategories"]),
        dimensions.clean_locations(tables["locations"], shop_names),
        profile=keys)


def valid_lines(tables: Mapping[str, DataFrame], period: Period,
                brands: Iterable[str] = SALES_BRANDS, amount_type: str = "decimal(10,0)",
                shop_names: Mapping[str, str] | None = None) -> DataFrame:
    """Enriched lines of the window without net-zero orders.

    The enriched lines are staged: order totals then read two columns of them
    instead of running the joins again.
    """
    enriched, rows = staged_counted(enriched_lines(tables, period, brands, amount_type, shop_names))
    return mart.drop_net_zero_orders(enriched, rows=rows)


def first_purchases(tables: Mapping[str, DataFrame], brand: str) -> DataFrame:
    """First purchase dates: the given table, else the earliest order over all time.

    An earliest date needs no distinct lines and no member per line: dates are
    reduced per card first, and the cards then mapped to members.
    """
    if "first_purchases" in tables:
        return tables["first_purchases"].select(
            MEMBER, F.col(FIRST_PURCHASE_COLUMNS[brand]).alias("first_transaction_date"))
    cards = (clean.trim_strings(clean.project_sales(tables["sales"]))
             .filter(F.col("shop_brand") == brand)
             .groupBy("vip_no", "shop_brand").agg(F.min("order_date").alias("order_date")))
    members = clean.resolve_member(cards, clean.member_key_map(tables["members"]), unique=True)
    return mart.first_purchase(members).select(
        MEMBER, F.col("first_purchase").alias("first_transaction_date"))


@dataclass(frozen=True)
class Mart:
    transaction: DataFrame
    demographic: DataFrame
    first_last: DataFrame


def channel_lines(tables: Mapping[str, DataFrame], period: Period, brands: Iterable[str], rules: Mapping[str, ChannelRule],
                  amount_type: str = "decimal(10,0)", shop_names: Mapping[str, str] | None = None) -> DataFrame:
    """``union_channels`` of ``valid_lines``, with only the lines that may be in a channel enriched.

    All lines decide which orders are net-zero, but of lines that fail a rule already by themselves nothing else is kept, and
    their orders' totals need no more of the lookups than how many records a line meets.
    """
    brands = list(brands)
    lines = clean.between_dates(clean.trim_strings(clean.project_sales(tables["sales"], amount_type)), period.first, period.last)
    hopeful = F.coalesce(mart.any_channel(rules, products=False), F.lit(False))
    kept = (clean.dedup_sales(lines, brands).filter(F.col("sales_main_key").isNotNull()).withColumn("_hopeful", hopeful)
            .select("_hopeful", *[c if c in mart.ORDER_COLUMNS else F.when(F.col("_hopeful"), F.col(c)).alias(c) for c in lines.columns]))
    kept = staged(kept)
    lookups = (staged(dimensions.enrich_sku(dimensions.clean_skus(tables["skus"]), tables["main_categories"])),
               staged(dimensions.clean_subcategories(tables["subcategories"])),
               staged(dimensions.clean_locations(tables["locations"], shop_names)))
    gone = mart.net_zero_keys(mart.fanned_out(kept, *lookups, brands), "sales_main_key", F.col("sold_qty") * F.col("times"))
    sold = staged(drop_keys(kept.filter("_hopeful").drop("_hopeful"), gone, "sales_main_key"))
    resolved = clean.resolve_member(sold, clean.member_key_map(tables["members"]))
    return mart.union_channels(mart.enrich_sales(resolved, *lookups, profile=sold), rules)


def _valid(tables: Mapping[str, DataFrame], period: Period, brand: str,
           rules: Mapping[str, ChannelRule] | None = None, amount_type: str = "decimal(10,0)",
           shop_names: Mapping[str, str] | None = None) -> DataFrame:
    return channel_lines(tables, period, [brand], CHANNEL_RULES[brand] if rules is None else rules, amount_type, shop_names)


def build_mart(tables: Mapping[str, DataFrame], period: Period, brand: str,
               rules: Mapping[str, ChannelRule] | None = None,
               amount_type: str = "decimal(10,0)",
               shop_names: Mapping[str, str] | None = None) -> Mart:
    """The three tables of one brand."""
    valid = _valid(tables, period, brand, rules, amount_type, shop_names)
    return Mart(valid, clean.demographics(tables["members"], BRAND_MEMBER_COLUMNS[brand]),
                mart.first_last(valid, first_purchases(tables, brand)))


def order_ledger(sales: DataFrame) -> DataFrame:
    """(order, month) of raw lines: in which months an order has lines. Lines without an order or a date are in none."""
    return (clean.trim_strings(clean.project_sales(sales)).filter(F.col("sales_main_key").isNotNull() & F.col("order_date").isNotNull())
            .select("sales_main_key", yyyymm(F.col("order_date")).alias("yyyymm")).distinct())


def update_valid(stored: DataFrame, tables: Mapping[str, DataFrame], new_sales: DataFrame, ledger: DataFrame,
                 period: Period, brand: str, **options) -> DataFrame:
    """The valid transactions after ``new_sales``, from those stored before.

    Every rule of the mart looks at one line or at the lines of one order, so only the orders with new lines change. Their
    older lines are looked for in the months that the ledger of ``tables["sales"]`` has of them, and these orders
    are built anew; all others stay as they are stored. Lines of other brands, or outside the period, change nothing and
    are not moved. Equals a full build as long as the other tables are those of the stored mart.
    """
    def own(sales: DataFrame) -> DataFrame:
        day = F.col("sales_date").try_cast("date")
        return sales.filter((F.trim(F.col("shop_brand").cast("string")) == brand) & day.between(F.lit(period.first), F.lit(period.last)))
    new_sales = own(new_sales)
    ledger = ledger.filter(F.col("yyyymm").between(f"{period.first:%Y%m}", f"{period.last:%Y%m}"))
    keys = clean.trim_strings(clean.project_sales(new_sales)).select("sales_main_key")
    changed, orders = staged_counted(keys.filter(F.col("sales_main_key").isNotNull()).distinct())
    if not orders:
        return stored
    months = [r["yyyymm"] for r in lookup_join(ledger, changed, "sales_main_key", "left_semi", unique=True)
              .select("yyyymm").distinct().collect()]  # one row a month
    before = own(tables["sales"]).filter(yyyymm(F.col("sales_date").try_cast("date")).isin(*months) if months else F.lit(False))
    key = F.trim(F.concat("shop_code", F.lit("-"), "invoice_no"))
    lines = before.unionByName(new_sales).withColumn("_order", key)
    lines = lookup_join(lines, changed.withColumnRenamed("sales_main_key", "_order"), "_order", "left_semi")
    built = _valid({**tables, "sales": lines.drop("_order")}, period, brand, **options)
    return lookup_join(stored, changed, "sales_main_key", "left_anti").select(*stored.columns).unionByName(built)


def _write_mart(spark: SparkSession, valid: DataFrame, tables: Mapping[str, DataFrame], base: str, brand: str, suffix: str) -> None:
    """All parts of a new version, then the pointer to it; first/last is read off the written transactions."""
    version = io.new_version(base)
    io.write_part(valid, version, "transaction")
    io.write_part(clean.demographics(tables["members"], BRAND_MEMBER_COLUMNS[brand]), version, "demographic")
    stored = io.read_part(spark, version, "transaction")
    io.write_part(mart.first_last(stored, first_purchases(tables, brand)), version, "first_last_transaction")
    io.publish(spark, version, base, suffix)


@job
def run_mart(spark: SparkSession, refs: Mapping[str, str], base: str, period: Period, brand: str,
             suffix: str = "", **options) -> None:
    """Write the mart of one brand as a new version, visible when it is whole."""
    tables = io.read_sources(spark, refs)
    _write_mart(spark, _valid(tables, period, brand, **options), tables, base, brand, suffix)


@job
def run_mart_update(spark: SparkSession, refs: Mapping[str, str], new_sales: str, base: str, period: Period, brand: str,
                    suffix: str = "", **options) -> None:
    """The next version of a mart: ``refs`` are the sources it was made of, ``new_sales`` the lines that came since."""
    tables = io.read_sources(spark, refs)
    new = io.read_table(spark, new_sales)
    stored = io.read_transactions(spark, base, suffix)
    valid = update_valid(stored, tables, new, order_ledger(tables["sales"]), period, brand, **options)
    _write_mart(spark, valid, {**tables, "sales": tables["sales"].unionByName(new)}, base, brand, suffix)
