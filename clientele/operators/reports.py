"""Segment and persona report tables.

``tags`` is (member, customer_tag, ...), one row per member. Sales are reduced per
member before they meet the tags, so a member with very many lines weighs no more
than any other in the join. Every pivot has an explicit list of columns; a tag
absent from the data is a NULL column, an unlisted tag is left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from clientele.config import ACTIVE_TAGS, CUSTOMER_TAGS, MEMBER, NATIONALITIES, UNKNOWN_SEX
from clientele.functions.dates import yyyymm
from clientele.functions.labels import (
    age_label, known_category, known_sex, one_of, tenure_band,
)
from clientele.operators.skew import spread_join
from clientele.sources.staging import staged_counted

TAG = "customer_tag"


# -- generic pivots ---------------------------------------------------------------

def sum_pivot(df: DataFrame, by: str, measure: str, tags: Iterable[str] = CUSTOMER_TAGS) -> DataFrame:
    return df.groupBy(by).pivot(TAG, list(tags)).agg(F.sum(measure))


def _tag_counts(df: DataFrame, by: str, key: str) -> DataFrame:
    return df.groupBy(TAG, by).agg(F.countDistinct(key).alias("_n"))


def count_pivot(df: DataFrame, by: str, key: str = MEMBER,
                tags: Iterable[str] = CUSTOMER_TAGS) -> DataFrame:
    """Distinct keys by group and tag; a key seen in two groups counts in both."""
    return _tag_counts(df, by, key).groupBy(by).pivot(TAG, list(tags)).agg(F.sum("_n"))


def percent_pivot(df: DataFrame, by: str, key: str = MEMBER,
                  tags: Iterable[str] = CUSTOMER_TAGS) -> DataFrame:
    """Distinct keys as percent of their tag's total over all groups, 2 decimals."""
    share = F.round(F.col("_n") / F.sum("_n").over(Window.partitionBy(TAG)) * 100, 2)
    return (_tag_counts(df, by, key).select(by, TAG, share.alias("_share"))
            .groupBy(by).pivot(TAG, list(tags)).agg(F.sum("_share")))


def column_share(table: DataFrame, label: str, columns: Iterable[str], digits: int = 1) -> DataFrame:
    """Each cell as percent of its column total, ordered by label; numbers, not text."""
    columns = list(columns)
    total = table.agg(F.struct(*[F.sum(f"`{c}`").alias(c) for c in columns]).alias("t")).scalar()
    cells = [F.round(F.try_divide(F.col(f"`{c}`").cast("double"), total[c].cast("double")) * 100,
                     digits).alias(c) for c in columns]
    return table.select(label, *cells).orderBy(label)


# -- tagged facts -----------------------------------------------------------------

def member_tags(tags: DataFrame) -> DataFrame:
    return tags.select(MEMBER, TAG)


def tagged_members(tags: DataFrame, demographic: DataFrame) -> DataFrame:
    """Tags with demographics; members without any keep NULLs.

    Many cards may share a main member number, so heavy ones are split here too.
    """
    return spread_join(demographic, tags, MEMBER, "keep_dims")


def tagged_sales(tags: DataFrame, tx: DataFrame) -> DataFrame:
    """Tags with every sales line; members without lines keep NULL sales columns.

    The lines are stored, since they are searched for heavy members before they are joined.
    """
    lines, rows = staged_counted(tx)
    return spread_join(lines, tags, MEMBER, "keep_dims", rows=rows)


def tagged_amounts(tags: DataFrame, tx: DataFrame, by: str, measure: str) -> DataFrame:
    """What ``sum_pivot`` needs of ``tagged_sales``: sums per member and group, reduced before they meet the tags."""
    return _attach(tx.groupBy(MEMBER, by).agg(F.sum(measure).alias(measure)), tags, keep_idle=True)


def tagged_keys(tags: DataFrame, tx: DataFrame, by: str, key: str = MEMBER) -> DataFrame:
    """What ``count_pivot`` and ``percent_pivot`` need of ``tagged_sales``: distinct keys per member and group."""
    if key == MEMBER:
        return _attach(tx.select(MEMBER, by).distinct(), tags, keep_idle=True)
    # A member may have any number of other keys.
    keys, rows = staged_counted(tx.select(MEMBER, by, key).distinct())
    return spread_join(keys, member_tags(tags), MEMBER, "keep_dims", rows=rows)


def _attach(rows: DataFrame, tags: DataFrame, keep_idle: bool = False) -> DataFrame:
    """Tags on rows already reduced per member."""
    return member_tags(tags).join(rows, MEMBER, "left" if keep_idle else "inner")


def in_window(tx: DataFrame, window: tuple[date, date] | None) -> DataFrame:
    return tx if window is None else tx.filter(F.col("order_date").between(*map(F.lit, window)))


# -- member profiles --------------------------------------------------------------

def member_attribute(tx: DataFrame, tags: DataFrame, attribute: Column, name: str,
                     default: str | None = None) -> DataFrame:
    """One value per tagged member: an aggregate over the member's lines."""
    values = _attach(tx.groupBy(MEMBER).agg(attribute.alias(name)), tags, keep_idle=True)
    return values if default is None else values.fillna(default, [name])


def gender_profile(tx: DataFrame, tags: DataFrame, names: Iterable[str] = CUSTOMER_TAGS) -> DataFrame:
    sex = member_attribute(tx, tags, F.min(known_sex(F.col("customer_sex"))), "sex", UNKNOWN_SEX)
    return count_pivot(sex, "sex", MEMBER, names)


def tenure_profile(tags: DataFrame, names: Iterable[str] = CUSTOMER_TAGS) -> DataFrame:
    bands = tags.withColumn("tenure_band", tenure_band(F.col("tenure")))
    return count_pivot(bands, "tenure_band", MEMBER, names)


def nationality_profile(tx: DataFrame, tags: DataFrame, values: Iterable[str] = NATIONALITIES,
                        names: Iterable[str] = CUSTOMER_TAGS) -> DataFrame:
    nation = member_attribute(tx, tags, F.min(one_of(F.col("cust_nat_cat"), values)),
                              "nationality", "Others")
    return count_pivot(nation, "nationality", MEMBER, names)


def region_profile(tx: DataFrame, tags: DataFrame, collapse: bool = True,
                   names: Iterable[str] = CUSTOMER_TAGS) -> DataFrame:
    """Members by shop region: their first region, or every region they bought in."""
    if collapse:
        rows = member_attribute(tx, tags, F.min("region_key"), "region_key")
    else:
        rows = _attach(tx.select(MEMBER, "region_key").distinct(), tags, keep_idle=True)
    return count_pivot(rows, "region_key", MEMBER, names)


def age_profile(tx: DataFrame, tags: DataFrame, agg: str = "max",
                names: Iterable[str] = CUSTOMER_TAGS) -> DataFrame:
    """Members by age label of their greatest (or smallest) age code."""
    pick = {"max": F.max, "min": F.min}[agg]
    codes = count_pivot(member_attribute(tx, tags, pick("customer_age_group"), "code"),
                        "code", MEMBER, names)
    return (codes.groupBy(age_label(F.col("code")).alias("age"))
            .agg(*[F.sum(f"`{n}`").alias(n) for n in names]))


def tag_counts(tags: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    return tags.groupBy(TAG, *by).agg(F.countDistinct(MEMBER).alias("members"))


def attribute_conflicts(df: DataFrame, key: str, attribute: Column) -> DataFrame:
    """Keys with more than one value of the attribute."""
    return (df.groupBy(key).agg(F.countDistinct(attribute).alias("n_values"))
            .filter(F.col("n_values") > 1))


# -- sales reports ----------------------------------------------------------------

def sales_kpis(tx: DataFrame, tags: DataFrame, window: tuple[date, date] | None = None,
               names: Iterable[str] = ACTIVE_TAGS) -> DataFrame:
    """Amount, quantity and orders (rows) by tag (columns), from one reduction by member and invoice."""
    orders, rows = staged_counted(in_window(tx, window).groupBy(MEMBER, "invoice_no").agg(
        F.sum("net_amt_hkd").alias("amount"), F.sum("sold_qty").alias("quantity")))
    kpis = (spread_join(orders, member_tags(tags), MEMBER, "inner", rows=rows).groupBy(TAG)
            .agg(F.sum("amount").cast("double").alias("amount"), F.sum("quantity").cast("double").alias("quantity"),
                 F.nullif(F.countDistinct("invoice_no"), F.lit(0)).cast("double").alias("orders")))
    return (kpis.unpivot(TAG, ["amount", "quantity", "orders"], "kpi", "value")
            .groupBy("kpi").pivot(TAG, list(names)).agg(F.sum("value")))


def visits(tx: DataFrame, tags: DataFrame, window: tuple[date, date] | None = None,
           names: Iterable[str] = ACTIVE_TAGS) -> DataFrame:
    """Distinct (member, day, shop) by tag; lines without a shop are no visit.

    Counted per member before tags are attached.
    """
    per_member = (in_window(tx, window).groupBy(MEMBER)
                  .agg(F.countDistinct("order_date", "shop_code").alias("visit")))
    rows = _attach(per_member, tags).withColumn("measure", F.lit("visits"))
    return sum_pivot(rows, "measure", "visit", names)


def category_pivot(tx: DataFrame, tags: DataFrame, by: str, measure: str = "net_amt_hkd",
                   agg: str = "sum", window: tuple[date, date] | None = None,
                   names: Iterable[str] = CUSTOMER_TAGS, known: bool = True) -> DataFrame:
    """Sums of a measure, or distinct buyers, by category and tag.

    Labels are given before grouping, so raw values sharing a label add up.
    """
    label = known_category(F.col(by)) if known else F.col(by)
    lines = in_window(tx, window).select(MEMBER, label.alias(by), measure)
    if agg == "sum":
        per_member = lines.groupBy(MEMBER, by).agg(F.sum(measure).alias("_value"))
        return sum_pivot(_attach(per_member, tags), by, "_value", names)
    if agg == "buyers":
        return count_pivot(_attach(lines.select(MEMBER, by).distinct(), tags), by, MEMBER, names)
    raise ValueError("agg must be 'sum' or 'buyers'")


def members_bought(tx: DataFrame, tags: DataFrame, names: Iterable[str] = CUSTOMER_TAGS) -> DataFrame:
    """One row: distinct members with a line, by tag."""
    buyers = _attach(tx.select(MEMBER).distinct(), tags).withColumn("measure", F.lit("members"))
    return count_pivot(buyers, "measure", MEMBER, names)


def category_buyers(tx: DataFrame, tags: DataFrame, by: str,
                    window: tuple[date, date] | None = None) -> DataFrame:
    """Distinct buyers per category and tag, one row each."""
    pairs = in_window(tx, window).select(MEMBER, known_category(F.col(by)).alias(by)).distinct()
    return _attach(pairs, tags).groupBy(by, TAG).agg(F.countDistinct(MEMBER).alias("members"))


def store_penetration(tx: DataFrame, tags: DataFrame, window: tuple[date, date] | None = None,
                      names: Iterable[str] = CUSTOMER_TAGS) -> DataFrame:
    pairs = in_window(tx, window).select(MEMBER, "shop_desc").distinct()
    return count_pivot(_attach(pairs, tags), "shop_desc", MEMBER, names)


def month_penetration(tx: DataFrame, tags: DataFrame,
                      names: Iterable[str] = CUSTOMER_TAGS) -> DataFrame:
    """Buyers by month, whole history; members without sales stand under NULL."""
    pairs = tx.select(MEMBER, yyyymm(F.col("order_date")).alias("yyyymm")).distinct()
    return count_pivot(_attach(pairs, tags, keep_idle=True), "yyyymm", MEMBER, names)


# -- checks -----------------------------------------------------------------------

def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def min_date(tx: DataFrame, condition: Column | None = None) -> DataFrame:
    return (tx if condition is None else tx.filter(condition)).agg(
        F.min("order_date").alias("min_order_date"))


def reconcile_count(other: DataFrame, condition: Column) -> DataFrame:
    """Distinct members of an outside table under a condition."""
    return other.filter(condition).agg(F.countDistinct(MEMBER).alias("members"))


# -- persona tables ---------------------------------------------------------------

def persona_counts(personas: DataFrame) -> DataFrame:
    """Rows and members by persona with a total marked by ``is_total``.

    Members without a persona name are a row of their own, not a second total.
    """
    return personas.rollup("persona").agg(
        F.count(F.lit(1)).alias("count"), F.countDistinct(MEMBER).alias("no_of_vip"),
        F.grouping("persona").cast("int").alias("is_total"))


def persona_counts_wide(personas: DataFrame, names: Mapping[int, str] | Iterable[str]) -> DataFrame:
    """The same as one row: a column per name (blanks as _) and Total."""
    names = list(names.values()) if isinstance(names, Mapping) else list(names)
    cell, total = F.col("is_total") == 0, F.col("is_total") == 1
    return persona_counts(personas).agg(
        *[F.sum(F.when(cell & (F.col("persona") == n), F.col("count"))).alias(n.replace(" ", "_"))
          for n in names],
        F.sum(F.when(total, F.col("count"))).alias("Total"),
    ).select(F.lit("no. of customer").alias("Persona"), "*")
