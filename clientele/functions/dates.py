"""Date expressions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_number(day: Column) -> Column:
    """Year and month as one integer: the cheap grouping key."""
    return F.year(day) * 100 + F.month(day)


def yyyymm(day: Column) -> Column:
    return month_number(day).cast("string")


def whole_years(since: Column, until: date) -> Column:
    """Elapsed days over 365, rounded half up to a whole number (double)."""
    return F.round(F.datediff(F.lit(until), since) / F.lit(365.0), 0)
