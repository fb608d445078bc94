"""Lifetime value: monthly revenue, member status, total and trailing-year value."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.config import MEMBER, Period
from clientele.functions.dates import month_number, whole_years, yyyymm

OLD, NEW = "old member", "New Joiner"
ACTIVE, INACTIVE_P12, INACTIVE_P24 = "active_in_p12m", "Inactive P12", "Inactive P24"


def month_calendar(spark: SparkSession, first, last) -> DataFrame:
    """Every month of the window, one row each, from the window itself."""
    days = F.sequence(F.trunc(F.lit(first), "month"), F.lit(last), F.expr("interval 1 month"))
    return spark.range(1).select(F.explode(days).alias("day")).select(
        yyyymm(F.col("day")).alias("yyyymm"))


def monthly_revenue(tx: DataFrame, region: str | None = None) -> DataFrame:
    """Amount and distinct invoices per member and calendar month."""
    if region is not None:
        tx = tx.filter(F.col("region_key") == region)
    return (tx.groupBy(MEMBER, month_number(F.col("order_date")).alias("_month"))
            .agg(F.sum("net_amt_hkd").alias("rev"),
                 F.countDistinct("invoice_no").alias("tran_no"))
            .select(MEMBER, F.col("_month").cast("string").alias("yyyymm"), "rev", "tran_no"))


def member_months(tx: DataFrame, region: str | None = None) -> DataFrame:
    """What a segmentation keeps of the sales: per member and month the amount and lines of the region, and the first and last day of all lines.

    Sums of months are sums of the sales, so any window of whole months can be read off.
    """
    here = F.lit(True) if region is None else F.coalesce(F.col("region_key") == region, F.lit(False))
    return (tx.filter(F.col(MEMBER).isNotNull()).groupBy(MEMBER, month_number(F.col("order_date")).alias("_month"))
            .agg(F.sum(F.when(here, F.col("net_amt_hkd"))).alias("rev"), F.count_if(here).alias("lines"),
                 F.min("order_date").alias("first_day"), F.max("order_date").alias("last_day"))
            .withColumn("yyyymm", F.col("_month").cast("string")).drop("_month"))


def month_amounts(months: Iterable[str]) -> list[Column]:
    """Aggregates over monthly revenue: the amount of each month, 0 when absent."""
    return [F.coalesce(F.sum(F.when(F.col("yyyymm") == m, F.col("rev"))), F.lit(0)) for m in months]


def cumulative_amounts(months: Iterable[str]) -> list[Column]:
    """Aggregates over monthly revenue: the amount up to each month, as doubles."""
    months = list(months)
    return [F.coalesce(F.sum(F.when(F.col("yyyymm").between(months[0], m), F.col("rev"))), F.lit(0))
            .cast("double") for m in months]


def by_member(monthly: DataFrame) -> DataFrame:
    """Monthly rows with each member's months in one partition.

    A member has few months, so the rows are narrow and balanced; the wide
    per-month aggregates that follow then need no shuffle of their own.
    """
    return monthly.filter(F.col(MEMBER).isNotNull()).repartition(MEMBER)


def dense_monthly_grid(monthly: DataFrame, months: Iterable[str]) -> DataFrame:
    """Member x month rows without gaps.

    One aggregation lays a member's months side by side and unfolds them again;
    no product of members and months, no join back.
    """
    months = list(months)
    cells = [F.struct(F.lit(m).alias("yyyymm"), amount.alias("monthly_clv"))
             for m, amount in zip(months, month_amounts(months))]
    return (by_member(monthly).groupBy(MEMBER)
            .agg(F.array(*cells).alias("_cells")).select(MEMBER, F.inline("_cells")))


def member_status(firsts_lasts: DataFrame, period: Period) -> DataFrame:
    """Tenure in whole years, joiner flag and activity flag."""
    first, last = F.col("first_transaction_date"), F.col("last_transaction_date")
    two_years_ago = F.date_add(F.lit(period.last), -730)
    p12m_first = F.lit(period.p12m_first)
    return firsts_lasts.select(
        MEMBER, "first_transaction_date", "last_transaction_date",
        whole_years(first, period.last).alias("tenure"),
        F.when(first.between(p12m_first, F.lit(period.last)), NEW)
        .when(first < p12m_first, OLD).alias("new_joiner_flag"),
        F.when((last > two_years_ago) & (last < p12m_first), INACTIVE_P12)
        .when(last <= two_years_ago, INACTIVE_P24)
        .otherwise(ACTIVE).alias("inactive_flag"))


def total_clv(status: DataFrame, monthly: DataFrame, mart_years: int = 3) -> DataFrame:
    """Value over the mart window and its yearly average.

    Members with a joiner flag and some revenue. The divisor is the tenure, at
    most the years of the window; tenure 0 has no average.
    """
    totals = monthly.groupBy(MEMBER).agg(F.sum("rev").alias("total_clv"))
    amount, tenure = F.col("total_clv").cast("double"), F.col("tenure")
    return (status.filter(F.col("new_joiner_flag").isNotNull()).join(totals, MEMBER)
            .withColumn("avg_annual_revenue",
                        F.when(tenure >= mart_years, amount / F.lit(float(mart_years)))
                        .otherwise(F.try_divide(amount, tenure))))


def p12m_clv(total: DataFrame, monthly: DataFrame, period: Period) -> DataFrame:
    """Trailing-year value of existing members; members without such months are absent."""
    recent = (monthly.filter(F.col("yyyymm") > period.p12m_after)
              .groupBy(MEMBER).agg(F.sum("rev").alias("_recent")))
    return (total.filter(F.col("new_joiner_flag") == OLD).join(recent, MEMBER)
            .groupBy(MEMBER, "new_joiner_flag", "inactive_flag", "last_transaction_date")
            .agg(F.sum("_recent").alias("p12m_clv")))
