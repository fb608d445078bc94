"""Shop, product and category tables cut to their latest records."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.config import (
    EXCLUDED_SUBCATEGORY_CATS, LOCATION_BRANDS, SUB_REGION_MARK, SUB_REGIONS,
    SUBCATEGORY_RENAMES,
)
from clientele.functions.labels import relabel
from clientele.operators.skew import lookup_join, spread_join
from clientele.sources.staging import staged_counted


def latest_per_key(df: DataFrame, keys: Iterable[str] | str, ts: str,
                   ties: str = "all", rows: int | None = None) -> DataFrame:
    """Rows carrying the greatest ``ts`` of their key.

    Rows with a NULL key or NULL ``ts`` vanish. ``ties="all"`` keeps every row of
    the greatest ``ts``; ``ties="one"`` keeps the greatest row by the remaining
    columns. ``rows`` is the size of ``df`` at most, where known. Both pre-aggregate before the shuffle instead of sorting a key's rows
    in one task.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    known = df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, ts]]))
    rest = [c for c in df.columns if c not in keys and c != ts]
    if ties == "one":
        return (known.groupBy(*keys).agg(F.max(F.struct(ts, *rest)).alias("_top"))
                .select(*keys, "_top.*").select(*df.columns))
    if ties != "all":
        raise ValueError("ties must be 'all' or 'one'")
    top = known.groupBy(*keys).agg(F.max(ts).alias("_latest"))
    return (spread_join(known, top, keys, "inner", rows=rows)
            .filter(F.col(ts) == F.col("_latest")).select(*df.columns))


def sub_region(district: Column, rules: Mapping[str, Iterable[str]] = SUB_REGIONS,
               mark: str = SUB_REGION_MARK) -> Column:
    """First region whose city occurs in a marked district; case matters."""
    label = F.lit("Others")
    for name, cities in reversed(list(rules.items())):
        hit = reduce(lambda a, b: a | b, [district.contains(city) for city in cities])
        label = F.when(district.contains(mark) & hit, name).otherwise(label)
    return label


def classify_location(locations: DataFrame, overrides: Mapping[str, str] | None = None,
                      rules: Mapping[str, Iterable[str]] = SUB_REGIONS) -> DataFrame:
    """Fixed names for listed shop codes, and the sub-region of the district."""
    desc = F.col("shop_desc")
    for code, name in (overrides or {}).items():
        desc = F.when(F.col("shop_code") == code, name).otherwise(desc)
    return locations.select("shop_code", desc.alias("shop_desc"),
                            sub_region(F.col("city_district"), rules).alias("sub_region")).distinct()


def clean_locations(raw: DataFrame, overrides: Mapping[str, str] | None = None,
                    brands: Iterable[str] = LOCATION_BRANDS) -> DataFrame:
    """Latest shop records by calendar day, named and classified."""
    shops = (raw.filter(F.col("shop_brand").isin(*brands))
             .select("shop_code", "shop_desc", "city_district",
                     F.to_date("modified_date").alias("modified_date")).distinct())
    shops, rows = staged_counted(shops)
    latest = latest_per_key(shops, "shop_code", "modified_date", rows=rows)
    return classify_location(latest, overrides)


def clean_skus(raw: DataFrame) -> DataFrame:
    """Latest product records by calendar day; same-day records all stay."""
    skus = raw.select(
        "item_code", "item_desc", "item_desc_c", "item_cat", "item_sub_cat",
        "item_product_line", "item_product_line_desc", "brand_code", "retail_price_hk",
        "retail_price_tw", "maincat_key",
        F.to_date("last_modified_date").alias("last_modified_date")).distinct()
    skus, rows = staged_counted(skus)
    return latest_per_key(skus, "item_code", "last_modified_date", rows=rows)


def enrich_sku(skus: DataFrame, main_categories: DataFrame) -> DataFrame:
    """Main category code and name of each product."""
    cats = main_categories.select("maincat_key", "maincat_code", "maincat_desc").distinct()
    return lookup_join(skus, cats, "maincat_key", "left")


def clean_subcategories(raw: DataFrame,
                        excluded: Iterable[str] = EXCLUDED_SUBCATEGORY_CATS) -> DataFrame:
    """Latest sub-category names per (brand, sub-category), unwanted categories out.

    The exclusion comes after the latest load is chosen: where an excluded
    category was loaded last, the sub-category disappears.
    """
    named = raw.select(
        "item_brand_key", "item_cat", "item_sub_cat",
        relabel(F.col("item_subcat_desc"), SUBCATEGORY_RENAMES).alias("item_subcat_desc"),
        "load_date").distinct()
    named, rows = staged_counted(named)
    return (latest_per_key(named, ["item_brand_key", "item_sub_cat"], "load_date", rows=rows)
            .filter(~F.col("item_cat").isin(*excluded))
            .select("item_sub_cat", "item_cat", "item_brand_key", "item_subcat_desc").distinct())
