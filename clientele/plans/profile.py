"""The report tables of a segmentation run, all from one pass over the sales."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.config import CUSTOMER_TAGS, MEMBER, NATIONALITIES
from clientele.functions.dates import yyyymm
from clientele.functions.labels import known_category, known_sex, one_of
from clientele.operators import reports, segments
from clientele.sources.staging import staged

# What sales are reduced to, per member: each value of these columns. Months are of all dates, the others of the window.
SLICES = {"month": ("month",), "category": ("category",), "store": ("shop_desc",), "visit": ("day", "shop_code"), "order": ("invoice_no",)}
ATTRIBUTES = ("order_date", "customer_sex", "cust_nat_cat", "region_key", "customer_age_group")


def report_cells(tx: DataFrame, window: tuple[date, date], category: str = "item_product_line_desc",
                 nationalities=NATIONALITIES, age: str = "max", slices: Iterable[str] = tuple(SLICES), measured: bool = True) -> DataFrame:
    """Sales reduced to all slices at once: one read and one shuffle of partial sums for all reports.

    ``slice`` names the reduction; ``lines`` counts a cell's lines in the window, and amount and quantity are of these.
    A line outside the window is in the cell of its month only. Attributes are reduced over all dates, by month
    (``member_cells`` goes on from there). Cells that are not ``measured`` have neither attributes nor sums.
    """
    inside = F.coalesce(F.col("order_date").between(*map(F.lit, window)), F.lit(False))
    every = {"category": known_category(F.col(category)), "shop_desc": F.col("shop_desc"), "month": yyyymm(F.col("order_date")),
             "day": F.col("order_date"), "shop_code": F.col("shop_code"), "invoice_no": F.col("invoice_no")}
    labels = {c: every[c] for c in dict.fromkeys(c for name in slices for c in SLICES[name])}
    attributes = {"order_date": F.col("order_date"), "customer_sex": known_sex(F.col("customer_sex")),
                  "cust_nat_cat": one_of(F.col("cust_nat_cat"), nationalities), "region_key": F.col("region_key"),
                  "customer_age_group": F.col("customer_age_group")} if measured else {}
    measures = ["net_amt_hkd", "sold_qty"] if measured else []
    kinds = dict(tx.select(*[c.alias(n) for n, c in {**labels, **attributes}.items()]).dtypes)

    def cell(name: str):
        def held(columns, kept):
            return [(c if kept(n) else F.lit(None).cast(kinds[n])).alias(n) for n, c in columns.items()]
        return F.struct(F.lit(name).alias("slice"), *held(labels, SLICES[name].__contains__), *held(attributes, lambda _: name == "month"))
    dated = [cell(name) for name in slices if name != "month"]
    months = [cell("month")] if "month" in slices else []
    cells = F.when(inside, F.array(*months, *dated))
    cells = cells.otherwise(F.array(*months)) if months else cells
    rows = tx.select(MEMBER, inside.cast("int").alias("_in"), *[F.when(inside, F.col(m)).alias(m) for m in measures], F.inline(cells))
    pick = {"max": F.max, "min": F.min}[age]
    return rows.groupBy(MEMBER, "slice", *labels).agg(
        F.sum("_in").alias("lines"), *[(pick if n == "customer_age_group" else F.min)(n).alias(n) for n in attributes],
        *[F.sum(m).alias(m) for m in measures])


def member_cells(cells: DataFrame, age: str = "max") -> DataFrame:
    """Attributes per member, from those of the member's months."""
    pick = {"max": F.max, "min": F.min}[age]
    return cells.filter(F.col("slice") == "month").groupBy(MEMBER).agg(
        *[(pick if n == "customer_age_group" else F.min)(n).alias(n) for n in ATTRIBUTES])


def segment_reports(tx: DataFrame, tags: DataFrame, tags_last_year: DataFrame,
                    window: tuple[date, date], category: str = "item_product_line_desc",
                    nationalities=NATIONALITIES, age: str = "max") -> dict[str, DataFrame]:
    """Named report tables.

    The sales are read once: their cells are stored, and each report reads its slice of them. Pass stored
    ``tags`` (a written or staged segmentation), which the reports read one by one.
    """
    cells = staged(report_cells(tx, window, category, nationalities, age))
    every = {name: cells.filter(F.col("slice") == name) for name in SLICES}
    sold = {name: rows.filter("lines > 0") for name, rows in every.items()}
    people = (staged(member_cells(cells, age)), tags)
    categories = (sold["category"].withColumnRenamed("category", category), tags, category)
    return {
        "migration": segments.migration_matrix(segments.compare_years(tags, tags_last_year)),
        "tag_counts": reports.tag_counts(tags),
        "gender": reports.gender_profile(*people),
        "tenure": reports.tenure_profile(tags),
        "nationality": reports.nationality_profile(*people, nationalities),
        "region": reports.region_profile(*people),
        "age": reports.age_profile(*people, age),
        "kpis": reports.sales_kpis(sold["order"], tags),
        "visits": reports.visits(sold["visit"].withColumn("order_date", F.col("day")), tags),
        "category_amount": reports.category_pivot(*categories, "net_amt_hkd", "sum"),
        "category_quantity": reports.category_pivot(*categories, "sold_qty", "sum"),
        "category_buyers": reports.category_pivot(*categories, agg="buyers"),
        "stores": reports.store_penetration(sold["store"], tags, None, CUSTOMER_TAGS),
        "months": reports.month_penetration(every["month"], tags),
    }
