"""Column expressions that turn values into labels."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from clientele.config import AGE_LABELS, UNKNOWN_SEX


def relabel(col: Column, labels: Mapping[str, str], keep_rest: bool = True) -> Column:
    """Replace listed values; the rest stays, or becomes NULL."""
    out = None
    for value, label in labels.items():
        hit = col == F.lit(value)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    if out is None:
        return col if keep_rest else F.lit(None).cast("string")
    return out.otherwise(col) if keep_rest else out


def bucket(col: Column, high: float, low: float) -> Column:
    """H above ``high``, M in the closed range [low, high], else (also NULL) L."""
    return F.when(col > high, "H").when(col.between(low, high), "M").otherwise("L")


def tenure_band(years: Column) -> Column:
    """Whole years of membership; NULL falls into the open last band."""
    return (F.when(years <= 1, "0-1").when(years <= 3, "1-3")
            .when(years <= 7, "3-7").otherwise("8+"))


def age_label(code: Column) -> Column:
    return relabel(code, AGE_LABELS, keep_rest=False)


def known_sex(col: Column, blank_is_unknown: bool = False) -> Column:
    col = F.coalesce(col, F.lit(UNKNOWN_SEX))
    return F.when(col == "", UNKNOWN_SEX).otherwise(col) if blank_is_unknown else col


def one_of(col: Column, values: Iterable[str], rest: str = "Others") -> Column:
    return F.when(col.isin(*values), col).otherwise(F.lit(rest))


def known_category(col: Column) -> Column:
    """NULL and N/A share one label, given before any grouping."""
    return F.when(col.isNull() | (col == "N/A"), "Unknown").otherwise(col)
