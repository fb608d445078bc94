"""Value segmentation of one brand and region, and its yearly reclassification."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.config import MEMBER, SEGMENT_CUTS, Period, SegmentCuts
from clientele.functions.labels import bucket
from clientele.operators import clv, segments, trend
from clientele.sources import io
from clientele.sources.staging import job, staged


def member_values(tx: DataFrame, firsts_lasts: DataFrame, period: Period, cuts: SegmentCuts,
                  region: str | None = None) -> DataFrame:
    """One row per member: status, values, trend, segment and tag.

    The same results as chaining the single operators of ``clv``, ``trend`` and
    ``segments``, for ``firsts_lasts`` with one row per member, but total, trailing
    year and monthly series come from a single aggregation of monthly revenue, so
    the sales are read and shuffled once.
    """
    return values_of_months(clv.monthly_revenue(tx, region), firsts_lasts, period, cuts)


def two_years(tx: DataFrame, this: Period, last: Period, cuts: SegmentCuts, region: str | None = None,
              firsts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``member_values`` of two periods from one read of the sales.

    Per member and month partial sums are stored once, and both windows are read off them. The periods
    must be whole months. First purchases are the earliest sales unless given.
    """
    months = staged(clv.member_months(tx, region))
    if firsts is None:
        firsts = months.groupBy(MEMBER).agg(F.min("first_day").alias("first_transaction_date"))
    out = []
    for period in (this, last):
        if period.first.day != 1 or (period.last + timedelta(days=1)).day != 1:
            raise ValueError("a period must be whole months")
        rows = months.filter(F.col("yyyymm").between(f"{period.first:%Y%m}", f"{period.last:%Y%m}"))
        lasts = rows.groupBy(MEMBER).agg(F.max("last_day").alias("last_transaction_date"))
        both = lasts.join(firsts.select(MEMBER, "first_transaction_date").distinct(), MEMBER, "left")
        out.append(values_of_months(rows.filter("lines > 0").select(MEMBER, "yyyymm", "rev"), both, period, cuts))
    return out[0], out[1]


def values_of_months(monthly: DataFrame, firsts_lasts: DataFrame, period: Period, cuts: SegmentCuts) -> DataFrame:
    """``member_values`` from revenue by member and month."""
    months = period.trend_months
    recent = F.col("yyyymm") > period.p12m_after
    spend = clv.by_member(monthly).groupBy(MEMBER).agg(
        F.sum("rev").alias("total_clv"),
        F.sum(F.when(recent, F.col("rev"))).alias("_p12m"),
        F.count(F.when(recent, 1)).alias("_p12m_months"),
        *[a.alias(f"_y{i}") for i, a in enumerate(clv.cumulative_amounts(months))])

    status = clv.member_status(firsts_lasts, period).filter(F.col("new_joiner_flag").isNotNull())
    years, amount, tenure = float(period.mart_years), F.col("total_clv").cast("double"), F.col("tenure")
    existing = (F.col("new_joiner_flag") == clv.OLD) & (F.col("_p12m_months") > 0)
    rated = existing & (F.col("inactive_flag") == clv.ACTIVE)
    values = (
        status.join(spend, MEMBER)
        .withColumn("avg_annual_revenue",
                    F.when(tenure >= years, amount / F.lit(years)).otherwise(F.try_divide(amount, tenure)))
        .withColumn("p12m_clv", F.when(existing, F.col("_p12m"))))
    values = trend.adjust_slope(trend.fit_lines(values, [f"_y{i}" for i in range(len(months))]))
    values = values.withColumns({
        **{c: F.when(existing, F.col(c)) for c in ("slope", "intercept", "slope_final")},
        "slope_flag": F.when(existing, bucket(F.col("slope_final"), cuts.slope_high, cuts.slope_low)),
        "flag_total_clv": F.when(rated, bucket(F.col("avg_annual_revenue"), cuts.clv_high, cuts.clv_low)),
    })
    values = values.withColumn("value_segment", F.when(existing, segments.segment_rule(
        F.col("flag_total_clv"), F.col("slope_flag"), F.col("p12m_clv"), cuts.engaged, cuts.emerging)))
    tag = (F.when(F.col("new_joiner_flag") == clv.NEW, clv.NEW)
           .when(F.col("inactive_flag").isin(clv.INACTIVE_P24, clv.INACTIVE_P12), F.col("inactive_flag"))
           .otherwise(F.col("value_segment")))
    return values.withColumn("customer_tag", tag).select(
        MEMBER, "first_transaction_date", "last_transaction_date", "tenure", "new_joiner_flag",
        "inactive_flag", "total_clv", "avg_annual_revenue", "p12m_clv", "slope", "intercept",
        "slope_final", "slope_flag", "flag_total_clv", "value_segment", "customer_tag")


def totals_of(values: DataFrame) -> DataFrame:
    return values.select(MEMBER, "first_transaction_date", "last_transaction_date", "tenure",
                         "new_joiner_flag", "inactive_flag", "total_clv", "avg_annual_revenue")


def segments_of(values: DataFrame) -> DataFrame:
    """Segment table: existing members with a trailing year; unrated ones have blanks."""
    rated = F.col("flag_total_clv").isNotNull()
    kept = [F.when(rated, F.col(c)).alias(c) for c in
            ("first_transaction_date", "avg_annual_revenue", "new_joiner_flag", "inactive_flag")]
    return values.filter(F.col("value_segment").isNotNull()).select(
        MEMBER, *kept, "p12m_clv", F.when(rated, F.col("tenure")).alias("tenure"), "value_segment")


def tags_of(values: DataFrame) -> DataFrame:
    return values.select(*totals_of(values).columns, "p12m_clv", "value_segment", "customer_tag")


@job
def run_segments(spark: SparkSession, mart_base: str, out_base: str, period: Period, brand: str,
                 region: str | None = None, suffix: str = "",
                 cuts: SegmentCuts | None = None) -> None:
    """Segments and totals of one brand and region, written as version 1."""
    tables = io.read_mart(spark, mart_base, suffix, (period.first, period.last))
    values = staged(member_values(
        tables["transaction"], tables["first_last_transaction"], period,
        SEGMENT_CUTS[brand, region] if cuts is None else cuts, region))
    io.write_segments(segments_of(values), out_base, "value_segment", brand, region, period.last)
    io.write_segments(totals_of(values), out_base, "total_clv", brand, region, period.last)


@job
def run_reclassify(spark: SparkSession, base: str, brand: str, region: str | None,
                   this_year: date, last_year: date, version: int = 2) -> str:
    """The final segments as a new version beside the ones they are made from."""
    now = io.read_segments(spark, base, "value_segment", brand, region, this_year)
    before = io.read_segments(spark, base, "value_segment", brand, region, last_year)
    return io.write_segments(segments.reclassify(now, before), base, "value_segment", brand,
                             region, this_year, version)
