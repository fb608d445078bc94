"""From raw point-of-sale rows to a clean, typed, member-keyed sales history."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.config import MEMBER
from clientele.operators.skew import distinct_lookup_join, lookup_join

TEXT_COLUMNS = (
    "region_key", "shop_code", "invoice_no", "item_code", "shop_brand", "vip_no",
    "prod_brand", "sale_lady_id", "cashier_id", "customer_nat", "cust_nat_cat",
    "customer_sex", "customer_age_group", "void_flag", "invoice_remark", "sales_type",
)
AMOUNT_COLUMNS = ("net_amt_hkd", "net_amt", "item_list_price")
FLAG_COLUMNS = ("valid_tx_flag", "sales_staff_flag")


def member_key_map(vip: DataFrame) -> DataFrame:
    """One row per card: the smallest non-null main member number."""
    return (vip.filter(F.col(MEMBER).isNotNull())
            .groupBy("vip_no").agg(F.min(MEMBER).alias(MEMBER)))


def project_sales(raw: DataFrame, amount_type: str = "decimal(10,0)") -> DataFrame:
    """The sales columns with types; malformed values become NULL.

    The default amount type rounds money half up to whole units.
    """
    return raw.select(
        *[F.col(c).cast("string").alias(c) for c in TEXT_COLUMNS],
        F.col("sales_date").try_cast("date").alias("order_date"),
        F.col("sold_qty").try_cast("int").alias("sold_qty"),
        *[F.col(c).try_cast(amount_type).alias(c) for c in AMOUNT_COLUMNS],
        *[F.col(c).try_cast("int").alias(c) for c in FLAG_COLUMNS],
        # NULL when either part is; built before trimming, so inner blanks stay.
        F.concat("shop_code", F.lit("-"), "invoice_no").alias("sales_main_key"),
    )


def trim_strings(df: DataFrame) -> DataFrame:
    """Trim text columns only; dates and numbers keep their types."""
    return df.select([F.trim(name).alias(name) if kind == "string" else F.col(name)
                      for name, kind in df.dtypes])


def dedup_sales(df: DataFrame, brands: Iterable[str]) -> DataFrame:
    """Brand rows without full-row copies (the source repeats lines)."""
    return df.filter(F.col("shop_brand").isin(*brands)).distinct()


def resolve_member(sales: DataFrame, key_map: DataFrame,
                   profile: DataFrame | None = None, unique: bool = False) -> DataFrame:
    """Main member number of the card, else the card number itself; ``unique``: one row per card."""
    main = key_map.select("vip_no", F.col(MEMBER).alias("_main"))
    return (lookup_join(sales, main, "vip_no", "left", profile=profile, unique=unique)
            .withColumn(MEMBER, F.coalesce("_main", "vip_no")).drop("_main"))


def dedup_resolve(df: DataFrame, brands: Iterable[str], key_map: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """``dedup_sales``, then ``resolve_member``, with one move of the lines where no card is heavy."""
    main = key_map.select("vip_no", F.col(MEMBER).alias("_main"))
    return (distinct_lookup_join(df.filter(F.col("shop_brand").isin(*brands)), main, "vip_no", profile=profile)
            .select(*df.columns, F.coalesce("_main", "vip_no").alias(MEMBER)))


def between_dates(df: DataFrame, first: date, last: date, day: str = "order_date") -> DataFrame:
    """Both ends included."""
    if not (isinstance(first, date) and isinstance(last, date)):
        raise TypeError("dates expected")
    return df.filter(F.col(day).between(F.lit(first), F.lit(last)))


def demographics(vip: DataFrame, brand_columns: Iterable[str]) -> DataFrame:
    """Distinct member snapshot with the columns of one brand."""
    shared = (MEMBER, "vip_type", "vip_issue_date", "vip_sex", "vip_nation",
              "vip_agegrp", "region_key", "vip_staff_flag")
    return vip.filter(F.col(MEMBER).isNotNull()).select(*shared, *brand_columns).distinct()
