"""Contact list and the sales behind the persona reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.config import MEMBER, REPORT_MAINCAT_LABELS, REPORT_SUBCAT_LABELS
from clientele.functions.labels import relabel
from clientele.operators.skew import spread_join

PREFERENCES = ("vip_opt_in", "vip_no_sms", "vip_no_phone", "vip_no_edm")


def latest_preferences(vip: DataFrame, brand: str = "BA", region: str = "HK") -> DataFrame:
    """Contact preferences of each member's latest record.

    An unknown modification date counts as latest; then the greatest type start and
    card issue dates. Records equal in all dates are settled by the preferences
    themselves, so reruns agree. An aggregate, not a per-member sort.
    """
    modified = F.col("vip_last_modified_date")
    order = F.struct(modified.isNull().alias("unknown"), modified.alias("modified"),
                     "vip_type_start_date", "vip_card_issue_date", *PREFERENCES)
    return (vip.filter((F.col("vip_brand_code") == brand) & (F.col("region_key") == region))
            .groupBy(MEMBER).agg(F.max(order).alias("_top"))
            .select(MEMBER, *[f"_top.{p}" for p in PREFERENCES]))


def contact_list(personas: DataFrame, preferences: DataFrame, run_date: date) -> DataFrame:
    return personas.join(preferences, MEMBER, "left").select(
        F.lit(run_date).alias("date_of_run"), MEMBER, "persona", *PREFERENCES)


def clean_for_report(tx: DataFrame, brand: str = "BA") -> DataFrame:
    """Report labels; one brand, known main category (NULL goes), customers only."""
    return (tx.withColumn("maincat_desc_cleaned", relabel(F.col("maincat_desc"), REPORT_MAINCAT_LABELS))
            .withColumn("item_subcat_desc_cleaned",
                        relabel(F.col("item_subcat_desc"), REPORT_SUBCAT_LABELS))
            .withColumn("maincat_and_subcat",
                        F.concat("maincat_desc_cleaned", F.lit(" - "), "item_subcat_desc_cleaned"))
            .filter((F.col("prod_brand") == brand)
                    & (F.col("maincat_desc_cleaned") != "Unknown")
                    & (F.col("sales_staff_flag") == 0)))


def persona_tags(personas: DataFrame) -> DataFrame:
    """Personas in the shape the report operators take."""
    return personas.select(MEMBER, F.col("persona").alias("customer_tag"))


def tag_sales(tx: DataFrame, personas: DataFrame) -> DataFrame:
    """Lines of members with a persona row."""
    return spread_join(tx, personas.select(MEMBER, "persona"), MEMBER, "inner").withColumn(
        "customer_tag", F.col("persona"))
