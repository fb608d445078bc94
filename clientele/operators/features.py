"""Member features for clustering."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.config import (
    DUMMY_BRANDS, DUMMY_CATEGORIES, MEMBER, NATIONALITIES, UNKNOWN_SEX, WalletSpec,
)
from clientele.functions.dates import whole_years
from clientele.functions.labels import age_label, known_sex, one_of, tenure_band


def column(name: str) -> Column:
    """A column whose name may hold blanks or dots."""
    return F.col(f"`{name}`")


def clean_for_features(tx: DataFrame) -> DataFrame:
    """Lines of known members, real brands and real categories; NULLs go."""
    return tx.filter((F.col(MEMBER) != "")
                     & ~F.col("prod_brand").isin(*DUMMY_BRANDS)
                     & ~F.col("item_subcat_desc").isin(*DUMMY_CATEGORIES)
                     & ~F.col("maincat_desc").isin(*DUMMY_CATEGORIES))


def collect_by_member(tx: DataFrame, col: str) -> DataFrame:
    """A member's values in order, each with the times it occurs.

    Equal values are counted before they are gathered, so an array is as long as
    the member's distinct categories, never as long as its lines.
    """
    counted = (tx.filter(F.col(col).isNotNull()).groupBy(MEMBER, col)
               .agg(F.count(F.lit(1)).alias("times")))
    return counted.groupBy(MEMBER).agg(
        F.array_sort(F.collect_list(F.struct(F.col(col).alias("value"), "times"))).alias(col))


def demographic_features(tx: DataFrame, firsts: DataFrame, today: date) -> DataFrame:
    """Sex, nationality, tenure band and age label per member.

    Age is the label of the greatest known code, not the greatest label.
    """
    known_age = F.when(age_label(F.col("customer_age_group")).isNotNull(), F.col("customer_age_group"))
    people = tx.groupBy(MEMBER).agg(
        F.min(known_sex(F.col("customer_sex"), blank_is_unknown=True)).alias("customer_sex"),
        F.min(one_of(F.col("cust_nat_cat"), NATIONALITIES)).alias("cust_nat_cat"),
        F.max(known_age).alias("_code"))
    bands = firsts.select(
        MEMBER, tenure_band(whole_years(F.col("first_transaction_date"), today)).alias("tenure")).distinct()
    return people.join(bands, MEMBER, "left").select(
        MEMBER, "customer_sex", "cust_nat_cat",
        F.coalesce("tenure", tenure_band(F.lit(None).cast("double"))).alias("tenure"),
        age_label(F.col("_code")).alias("age"))


def sum_by_member(tx: DataFrame, col: str) -> DataFrame:
    return tx.groupBy(MEMBER).agg(F.sum(col).alias(col))


def count_by_member(tx: DataFrame, col: str) -> DataFrame:
    return tx.groupBy(MEMBER).agg(F.countDistinct(col).alias(col))


def member_totals(tx: DataFrame) -> DataFrame:
    """Amount, quantity and distinct orders in one pass."""
    return tx.groupBy(MEMBER).agg(
        F.sum("net_amt_hkd").alias("net_amt_hkd"), F.sum("sold_qty").alias("sold_qty"),
        F.countDistinct("invoice_no").alias("invoice_no"))


def wallet_features(tx: DataFrame, specs: Iterable[WalletSpec]) -> DataFrame:
    """Percent of a member's spend in each group of every dimension.

    One aggregation for all dimensions, since all share the member's total as
    denominator (over all values, listed or not). A zero total gives NULL.
    """
    cells, names = [], []
    for spec in specs:
        for name, values in spec.groups.items():
            names.append(f"{name}{spec.suffix}")
            hit = F.col(spec.by).isin(*values)
            cells.append(F.coalesce(F.sum(F.when(hit, F.col("net_amt_hkd"))), F.lit(0))
                         .cast("double").alias(f"_{len(cells)}"))
    total = F.coalesce(F.sum("net_amt_hkd"), F.lit(0)).cast("double").alias("_total")
    return tx.groupBy(MEMBER).agg(total, *cells).select(
        MEMBER, *[(F.try_divide(F.col(f"_{i}"), F.col("_total")) * 100).alias(n)
                  for i, n in enumerate(names)])


def share_of_wallet(tx: DataFrame, by: str, values: Sequence[str], suffix: str) -> DataFrame:
    """One percentage column per listed value."""
    return wallet_features(tx, [WalletSpec(by, suffix, {v: (v,) for v in values})])


def group_features(shares: DataFrame, spec: WalletSpec) -> DataFrame:
    """Sum single-value share columns into the groups of a spec."""
    return shares.select(MEMBER, *[
        reduce(lambda a, b: a + b, [column(f"{v}{spec.suffix}") for v in values])
        .alias(f"{name}{spec.suffix}") for name, values in spec.groups.items()])


def assemble_features(tables: Sequence[DataFrame], tagging: DataFrame | None = None) -> DataFrame:
    """Members present in every table, in the given column order; NULL becomes 0."""
    out = reduce(lambda a, b: a.join(b, MEMBER), tables)
    if tagging is not None:
        out = out.join(tagging, MEMBER, "left")
    return out.fillna(0)


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != MEMBER]


def zero_shares(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of zeros per feature, all features in one pass."""
    zeros = [F.avg((column(c) == 0).cast("double")).alias(f"_{i}") for i, c in enumerate(cols)]
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"_{i}").alias("zero_share"))
            for i, c in enumerate(cols)]
    return df.agg(*zeros).select(F.inline(F.array(*rows)))


def drop_zero_columns(df: DataFrame, threshold: float = 1.0,
                      extra: Iterable[str] = ()) -> DataFrame:
    """Without features whose share of zeros reaches the threshold, nor ``extra``.

    Collects one row per feature.
    """
    shares = zero_shares(df, feature_columns(df)).filter(F.col("zero_share") >= threshold)
    return df.drop(*[r.feature for r in shares.collect()], *extra)


def exclude_members(df: DataFrame, ids: Iterable[str]) -> DataFrame:
    return df.filter(~F.col(MEMBER).isin(*ids))


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: mean and population deviation of each feature; can be stored."""
    return df.agg(*[F.struct(F.avg(column(c)).alias("mean"), F.stddev_pop(column(c)).alias("std"))
                    .alias(c) for c in cols])


def standardize(df: DataFrame, cols: Sequence[str], scaler: DataFrame | None = None) -> DataFrame:
    """(x - mean) / deviation; constant features, NULL and NaN become 0.

    Pass the training scaler to score new members on the training scale; without
    one the scale is fitted on ``df``.
    """
    scaler = fit_scaler(df, cols) if scaler is None else scaler
    stats = scaler.select(F.struct(*[column(c) for c in cols])).scalar()
    scaled = []
    for c in cols:
        mean, std = stats[c]["mean"], stats[c]["std"]
        z = F.when(std > 0, (column(c) - mean) / std).otherwise(F.lit(0.0))
        scaled.append(F.coalesce(F.nanvl(z, F.lit(0.0)), F.lit(0.0)).alias(c))
    return df.select(MEMBER, *scaled)
