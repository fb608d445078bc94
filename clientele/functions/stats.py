"""Robust statistics as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def middle(ordered: Column, size: int) -> Column:
    """Median of an already sorted array of ``size`` values."""
    half = size // 2
    if size % 2:
        return F.get(ordered, F.lit(half))
    return (F.get(ordered, F.lit(half - 1)) + F.get(ordered, F.lit(half))) / F.lit(2.0)


def median_of(values: list[Column]) -> Column:
    """Exact median of a fixed, non-empty list of non-null columns."""
    return middle(F.sort_array(F.array(*values)), len(values))


def sorted_slopes(names: list[str]) -> Column:
    """Slopes of all lines through two of the points (0, y0) .. (n-1, yn-1), ascending.

    ``names`` are the double columns y0 .. yn-1. The number of points is known when
    the plan is built, so the n(n-1)/2 slopes of a row are plain arithmetic in
    generated code: no self-join and no Python worker (a lambda form of the same ran
    about three times slower). Written as one expression text, which spares the
    driver some thousand calls per plan.
    """
    slopes = [f"(`{b}` - `{a}`) / {j - i}D" for i, a in enumerate(names)
              for j, b in enumerate(names) if i < j]
    return F.expr(f"sort_array(array({', '.join(slopes)}))")
