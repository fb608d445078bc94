"""Spend trend: cumulative series, Theil-Sen line, adjusted slope."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clientele.config import MEMBER
from clientele.functions.labels import bucket
from clientele.functions.stats import median_of, middle, sorted_slopes
from clientele.operators.clv import by_member, cumulative_amounts

# Slopes that a task holds at a time, where one member has no more.
SLOPES = 1 << 20


def cumulative_series(grid: DataFrame) -> DataFrame:
    """Running spend per member; a window holds one member's months and no more."""
    months = (Window.partitionBy(MEMBER).orderBy("yyyymm")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return grid.select("*", F.sum("monthly_clv").over(months).alias("cumsum"))


def series_to_array(cumulative: DataFrame) -> DataFrame:
    """One ordered array of doubles per member, whatever order the rows arrive in."""
    pairs = F.array_sort(F.collect_list(F.struct("yyyymm", F.col("cumsum").cast("double").alias("y"))))
    return (cumulative.groupBy(MEMBER).agg(pairs.alias("_pairs"))
            .select(MEMBER, F.col("_pairs.y").alias("series")))


def cumulative_arrays(monthly: DataFrame, months: Iterable[str]) -> DataFrame:
    """The same arrays straight from monthly revenue: one aggregation in all."""
    return (by_member(monthly).groupBy(MEMBER)
            .agg(F.array(*cumulative_amounts(months)).alias("series")))


def fit_lines(df: DataFrame, y: list[str]) -> DataFrame:
    """Adds the Theil-Sen ``slope`` and ``intercept`` of the points (0, y0) .. (n-1, yn-1).

    ``y`` names n double columns. The slope is the median of all pairwise slopes, the intercept the median of y
    less slope times the middle x. The sorted slopes stand in a column of their own,
    so generated code holds them once. Fewer than two points have no line: NULL.
    """
    n = len(y)
    if n < 2:
        missing = F.lit(None).cast("double")
        return df.withColumns({"slope": missing, "intercept": missing})
    return (df.withColumn("_slopes", sorted_slopes(y))
            .withColumn("slope", middle(F.col("_slopes"), n * (n - 1) // 2))
            .withColumn("intercept", median_of([F.col(c) for c in y]) - F.col("slope") * F.lit((n - 1) / 2.0))
            .drop("_slopes"))


def member_slopes(arrays: DataFrame, points: int) -> DataFrame:
    """Line of each member's array of ``points`` doubles."""
    y = [f"_y{i}" for i in range(points)]
    wide = arrays.select(MEMBER, *[F.get("series", F.lit(i)).alias(c) for i, c in enumerate(y)])
    return fit_lines(wide, y).select(MEMBER, "slope", "intercept")


def long_series(monthly: DataFrame, months: Iterable[str]) -> DataFrame:
    """``cumulative_arrays`` for many months: a member's own months are laid on the calendar, so the plan does not grow with it."""
    months = list(months)
    kind = dict(monthly.dtypes)["rev"]
    place = F.array_position(F.lit(months), F.col("yyyymm")).cast("int")
    own = (by_member(monthly).groupBy(MEMBER)
           .agg(F.map_from_entries(F.collect_list(F.when(place > 0, F.struct(place, F.col("rev"))))).alias("own")))
    amounts = F.transform(F.sequence(F.lit(1), F.lit(len(months))), lambda i: F.coalesce(F.try_element_at("own", i), F.lit(0).cast(kind)))
    upto = lambda i: F.aggregate(F.slice("amounts", 1, i), F.lit(0).cast(kind), lambda a, x: (a + x).cast(kind))
    return own.withColumn("amounts", amounts).select(
        MEMBER, F.transform(F.sequence(F.lit(1), F.lit(len(months))), lambda i: upto(i).cast("double")).alias("series"))


def _medians(values: np.ndarray) -> np.ndarray:
    """Median of each row."""
    low, high = (values.shape[1] - 1) // 2, values.shape[1] // 2
    ordered = np.partition(values, (low, high), axis=1)
    return ordered[:, high] if low == high else (ordered[:, low] + ordered[:, high]) / 2.0


def _lines(series: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and intercept of each row of points: all pairwise slopes, those of one distance at a time."""
    n = series.shape[1]
    slope = _medians(np.concatenate([(series[:, d:] - series[:, :-d]) / float(d) for d in range(1, n)], axis=1))
    return slope, _medians(series) - slope * ((n - 1) / 2.0)


def series_lines(arrays: DataFrame) -> DataFrame:
    """Line of each member's array, whatever its length; fewer than two points have none.

    The arrays hold no NULL. Slopes are made for as many members at a time as give ``SLOPES`` of them.
    """
    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            series = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(series), 0).to_numpy(zero_copy_only=False)
            found = np.zeros((2, len(sizes)))
            for n in np.unique(sizes[sizes > 1]):
                rows = np.flatnonzero(sizes == n)
                points = series.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                step = max(1, SLOPES // int(n * (n - 1) // 2))
                for start in range(0, len(rows), step):
                    found[:, rows[start:start + step]] = _lines(points[start:start + step])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(f, mask=sizes < 2) for f in found]], names=[MEMBER, "slope", "intercept"])
    kind = arrays.schema[MEMBER].dataType.simpleString()
    return arrays.select(MEMBER, "series").mapInArrow(fitted, f"`{MEMBER}` {kind}, slope double, intercept double")


def adjust_slope(slopes: DataFrame) -> DataFrame:
    """Rising or flat lines gain half the size of their intercept."""
    slope, intercept = F.col("slope"), F.col("intercept")
    return slopes.withColumn(
        "slope_final",
        F.when((slope >= 0) & (intercept != 0), slope + F.abs(intercept) / 2).otherwise(slope))


def spend_trend(monthly: DataFrame, months: Iterable[str], p12m: DataFrame,
                high: float, low: float) -> DataFrame:
    """Adjusted slope and H/M/L bucket of the members in ``p12m``."""
    months = list(months)
    arrays = cumulative_arrays(monthly, months).join(p12m.select(MEMBER), MEMBER, "left_semi")
    slopes = adjust_slope(member_slopes(arrays, len(months)))
    return slopes.withColumn("slope_flag", bucket(F.col("slope_final"), high, low))
