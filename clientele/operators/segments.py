"""Value segments, their yearly movement and customer tags."""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientele.config import CUSTOMER_TAGS, MEMBER, SegmentCuts
from clientele.functions.labels import bucket
from clientele.operators.clv import ACTIVE, INACTIVE_P12, INACTIVE_P24, NEW, OLD
from clientele.sources.staging import staged

NO_LAST_YEAR = "New Joiner / Inactive P24M"


def clv_bucket(total: DataFrame, high: float, low: float) -> DataFrame:
    """H/M/L of the average annual revenue, existing active members only."""
    return (total.filter((F.col("new_joiner_flag") == OLD) & (F.col("inactive_flag") == ACTIVE))
            .select(MEMBER, "first_transaction_date", "avg_annual_revenue", "new_joiner_flag",
                    "inactive_flag", "tenure",
                    bucket(F.col("avg_annual_revenue"), high, low).alias("flag_total_clv"))
            .distinct())


def segment_rule(clv: Column, trend: Column, recent: Column, engaged: float,
                 emerging: float) -> Column:
    """Segment from the two buckets and the trailing-year value; first match wins.

    ========== ======= ===================== =========
    clv        trend   recent                segment
    ========== ======= ===================== =========
    L          any     any                   Low Value
    H          H, M    >= engaged            Engaged
    H          H, M    [emerging, engaged)   Emerging
    M          H, M    > emerging            Emerging
    M, H       L       any                   At Risk
    M          H       rest, also NULL       At Risk
    M          M       <= emerging           At Risk
    H          H, M    < emerging            At Risk
    otherwise                                (blank)
    ========== ======= ===================== =========
    """
    high, mid = clv == "H", clv == "M"
    rising = trend.isin("H", "M")
    return (F.when(clv == "L", "Low Value")
            .when(high & rising & (recent >= engaged), "Engaged")
            .when(high & rising & (recent >= emerging) & (recent < engaged), "Emerging")
            .when(mid & rising & (recent > emerging), "Emerging")
            .when((mid | high) & (trend == "L"), "At Risk")
            .when(mid & (trend == "H"), "At Risk")
            .when(mid & (trend == "M") & (recent <= emerging), "At Risk")
            .when(high & rising & (recent < emerging), "At Risk")
            .otherwise(""))


def value_segment(trend: DataFrame, clv: DataFrame, p12m: DataFrame,
                  cuts: SegmentCuts) -> DataFrame:
    """Segment of every member with a trend; no CLV bucket gives a blank segment."""
    return (trend.select(MEMBER, "slope_flag")
            .join(clv, MEMBER, "left")
            .join(p12m.select(MEMBER, "p12m_clv"), MEMBER, "left")
            .select(MEMBER, "first_transaction_date", "avg_annual_revenue", "new_joiner_flag",
                    "inactive_flag", "p12m_clv", "tenure",
                    segment_rule(F.col("flag_total_clv"), F.col("slope_flag"), F.col("p12m_clv"),
                                 cuts.engaged, cuts.emerging).alias("value_segment")))


def calibrate(df: DataFrame, cols: Iterable[str], probs: Iterable[float] = (0.7, 0.9)) -> DataFrame:
    """Percentile cut-offs, one row per column and probability: the value at rank ceil(p n).

    Exact at any size: values are counted, the counts dealt to ranges, and running counts
    kept within a range and over the ranges, of which there are few.
    """
    probs = list(probs)
    values = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v"))
                                          for c in cols]))).filter("v is not null")
    counts = staged(values.groupBy("measure", "v").agg(F.count(F.lit(1)).alias("n")).sort("measure", "v")
                    .withColumn("part", F.spark_partition_id()))
    parts = counts.groupBy("measure", "part").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("measure").orderBy("part")
    before = parts.select("measure", "part", (F.sum("n").over(order) - F.col("n")).alias("before"),
                          F.sum("n").over(Window.partitionBy("measure")).alias("total"))
    run = Window.partitionBy("measure", "part").orderBy("v")
    ranked = counts.withColumn("here", F.sum("n").over(run)).join(F.broadcast(before), ["measure", "part"])
    upto = F.col("before") + F.col("here")
    # Decimal shares, so that 0.7 of 30 is no more than 21.
    asked = F.inline(F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.lit(Decimal(str(p))).cast("decimal(12,10)").alias("share")) for p in probs]))
    return (ranked.select("measure", "v", "total", upto.alias("upto"), asked)
            .filter(F.col("upto") >= F.ceil(F.col("share") * F.col("total")))
            .groupBy("measure", "prob").agg(F.min("v").alias("cutoff")))


def segment_summary(segments: DataFrame) -> DataFrame:
    recent, yearly = F.col("p12m_clv"), F.col("avg_annual_revenue")
    return segments.groupBy("value_segment").agg(
        F.max(recent).alias("max_p12m_clv"), F.min(recent).alias("min_p12m_clv"),
        F.max(yearly).alias("max_avg_annual_revenue"), F.min(yearly).alias("min_avg_annual_revenue"),
        F.avg(yearly).alias("avg_avg_annual_revenue"), F.avg(recent).alias("avg_p12m_clv"),
        F.countDistinct(MEMBER).alias("members"))


def inactive_members(total: DataFrame, flag: str = INACTIVE_P24) -> DataFrame:
    return total.filter(F.col("inactive_flag") == flag)


def reclassify(this_year: DataFrame, last_year: DataFrame) -> DataFrame:
    """Falls from Engaged are at risk; a weak member who was weak already stays low."""
    before = last_year.select(MEMBER, F.col("value_segment").alias("_before"))
    now, then = F.col("value_segment"), F.coalesce(F.col("_before"), F.lit(NO_LAST_YEAR))
    return (this_year.join(before, MEMBER, "left")
            .withColumn("value_segment",
                        F.when((now == "Emerging") & (then == "Engaged"), "At Risk")
                        .when((now == "At Risk") & (then == "Low Value"), "Low Value")
                        .otherwise(now))
            .select(*this_year.columns))


def customer_tag(total: DataFrame, segments: DataFrame) -> DataFrame:
    """New Joiner, then Inactive P24, then Inactive P12, else the value segment."""
    tag = (F.when(F.col("new_joiner_flag") == NEW, NEW)
           .when(F.col("inactive_flag") == INACTIVE_P24, INACTIVE_P24)
           .when(F.col("inactive_flag") == INACTIVE_P12, INACTIVE_P12)
           .otherwise(F.col("value_segment")))
    return (total.join(segments.select(MEMBER, "p12m_clv", "value_segment"), MEMBER, "left")
            .withColumn("customer_tag", tag))


def compare_years(this_year: DataFrame, last_year: DataFrame) -> DataFrame:
    """Tag now and a year ago; absent a year ago counts as Inactive P24."""
    before = last_year.select(MEMBER, F.col("customer_tag").alias("_before"))
    return this_year.join(before, MEMBER, "left").select(
        MEMBER, "customer_tag",
        F.coalesce("_before", F.lit(INACTIVE_P24)).alias("customer_tag_last_year"))


def migration_matrix(comparison: DataFrame, tags: Iterable[str] = CUSTOMER_TAGS) -> DataFrame:
    """Distinct members by tag a year ago (rows) and now (columns)."""
    return (comparison.groupBy("customer_tag_last_year", "customer_tag")
            .agg(F.countDistinct(MEMBER).alias("members"))
            .groupBy("customer_tag_last_year").pivot("customer_tag", list(tags))
            .agg(F.sum("members")))
