"""The valid transaction table of a brand and what is read off it."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.config import MEMBER, ChannelRule
from clientele.operators.skew import drop_keys, lookup_join
from clientele.sources.staging import staged

TRANSACTION_COLUMNS = (
    "region_key", "sub_region", "shop_code", "invoice_no", "item_code", "order_date",
    "sold_qty", "net_amt_hkd", "net_amt", "item_list_price", "shop_brand", "prod_brand",
    "sale_lady_id", "cashier_id", "customer_nat", "cust_nat_cat", "customer_sex",
    "customer_age_group", "void_flag", "valid_tx_flag", "sales_staff_flag",
    "invoice_remark", "sales_main_key", "sales_type", MEMBER, "item_desc", "item_cat",
    "item_sub_cat", "brand_code", "retail_price_hk", "retail_price_tw",
    "item_product_line_desc", "maincat_desc", "item_subcat_desc", "shop_desc",
)


def _lookups(skus: DataFrame, subcategories: DataFrame, locations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Products, category names and shops, distinct on the columns that they contribute to lines."""
    products = skus.select(
        "item_code", F.col("brand_code").alias("prod_brand"), "brand_code", "item_desc",
        "item_cat", "item_sub_cat", "retail_price_hk", "retail_price_tw",
        "item_product_line_desc", "maincat_desc").distinct()
    names = subcategories.select(
        F.col("item_brand_key").alias("shop_brand"), "item_sub_cat", "item_cat",
        "item_subcat_desc").distinct()
    return products, names, locations.select("shop_code", "sub_region", "shop_desc").distinct()


def enrich_sales(sales: DataFrame, skus: DataFrame, subcategories: DataFrame,
                 locations: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Product, category and shop attributes of every line.

    ``sales`` holds distinct rows. Each lookup is made distinct on just the columns
    it contributes, so equal lines cannot arise and the fact table needs no second
    whole-row DISTINCT; same-day product records that differ still fan out.
    ``profile`` is a cheap frame with the raw key columns, for finding heavy keys.
    """
    products, names, shops = _lookups(skus, subcategories, locations)
    out = lookup_join(sales, products, ["item_code", "prod_brand"], "left", profile=profile)
    out = lookup_join(out, names, ["shop_brand", "item_sub_cat", "item_cat"], "left")
    out = lookup_join(out, shops, "shop_code", "left", profile=profile)
    return out.select(*TRANSACTION_COLUMNS)


# What decides how many enriched lines a line makes, and what they add to the total of their order.
ORDER_COLUMNS = ("sales_main_key", "sold_qty", "item_code", "prod_brand", "shop_brand", "shop_code")


def fanned_out(lines: DataFrame, skus: DataFrame, subcategories: DataFrame, locations: DataFrame,
               brands: Iterable[str]) -> DataFrame:
    """(order, quantity, times) of lines that are stored, keyed and of ``brands``: how many lines ``enrich_sales`` makes of each.

    Few products, names and shops have several records, and only these are looked up.
    """
    products, names, shops = _lookups(skus, subcategories, locations)
    names = (names.groupBy("shop_brand", "item_sub_cat", "item_cat").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    sold_by = products.select("item_code", "prod_brand", "item_sub_cat", "item_cat",
                              F.explode(F.array(*[F.lit(b) for b in brands])).alias("shop_brand"))
    items = (sold_by.join(names, ["shop_brand", "item_sub_cat", "item_cat"], "left")
             .groupBy("item_code", "prod_brand", "shop_brand").agg(F.sum(F.coalesce("_n", F.lit(1))).alias("_items")).filter("_items > 1"))
    places = shops.groupBy("shop_code").agg(F.count(F.lit(1)).alias("_shops")).filter("_shops > 1")
    out = lookup_join(lines.select(*ORDER_COLUMNS), items, ["item_code", "prod_brand", "shop_brand"], "left", profile=lines)
    out = lookup_join(out, places, "shop_code", "left", profile=lines)
    one = F.lit(1).cast("long")
    return out.select("sales_main_key", "sold_qty", (F.coalesce("_items", one) * F.coalesce("_shops", one)).alias("times"))


def net_zero_keys(lines: DataFrame, key: str, quantity: Column) -> DataFrame:
    """Orders whose quantities add to zero, or to nothing."""
    totals = lines.groupBy(key).agg(F.sum(quantity).alias("_total"))
    return staged(totals.filter(F.col("_total").isNull() | (F.col("_total") == 0)).select(key))


def drop_net_zero_orders(df: DataFrame, key: str = "sales_main_key",
                         qty: str = "sold_qty", rows: int | None = None) -> DataFrame:
    """Orders whose quantities add to zero, or to nothing, go; so do unkeyed lines.

    Full returns are few, so the orders to remove are joined, not those to keep, and only lines that may be
    theirs move. ``df`` should be stored; ``rows`` is its size at most, where known.
    """
    keyed = df.filter(F.col(key).isNotNull())
    return drop_keys(keyed, net_zero_keys(keyed, key, F.col(qty)), key, rows).select(*df.columns)


def channel_condition(rule: ChannelRule, products: bool = True) -> Column:
    """Lines of one channel; a NULL under test never passes. Without ``products``: what is known of lines before they meet these."""
    tests = [
        F.col("shop_brand") == rule.brand,
        *([F.col("retail_price_hk") > rule.price_above, ~F.col("item_cat").isin(*rule.excluded_categories)] if products else []),
        F.col("region_key").isin(*rule.regions),
        F.col("sold_qty") != 0,
        F.col("valid_tx_flag") == 1,
        F.col("void_flag").isNull(),
    ]
    if rule.customers_only:
        tests.append(F.col("sales_staff_flag") == 0)
    if rule.cashiers:
        tests.append(F.col("cashier_id").isin(*rule.cashiers))
    if rule.shops:
        tests.append(F.col("shop_code").isin(*rule.shops))
    if rule.excluded_sellers:
        tests.append(~F.col("sale_lady_id").isin(*rule.excluded_sellers))
    if rule.sales_type:
        tests.append(F.col("sales_type") == rule.sales_type)
    if rule.nonzero_local_amount:
        tests.append(F.col("net_amt") != 0)
    if rule.positive_amount:
        tests.append(F.col("net_amt_hkd") > 0)
    return reduce(lambda a, b: a & b, tests)


def apply_channel_rules(df: DataFrame, rules: Mapping[str, ChannelRule]) -> dict[str, DataFrame]:
    return {name: df.filter(channel_condition(rule)) for name, rule in rules.items()}


def any_channel(rules: Mapping[str, ChannelRule], products: bool = True) -> Column:
    return reduce(lambda a, b: a | b, [channel_condition(r, products) for r in rules.values()])


def union_channels(df: DataFrame, rules: Mapping[str, ChannelRule]) -> DataFrame:
    """Distinct lines of any channel: one pass with OR instead of a union of scans."""
    return df.filter(any_channel(rules)).distinct()


def first_purchase(history: DataFrame) -> DataFrame:
    """Earliest order date per member and brand."""
    return history.groupBy(MEMBER, "shop_brand").agg(F.min("order_date").alias("first_purchase"))


def first_last(valid: DataFrame, firsts: DataFrame) -> DataFrame:
    """Last order in the valid mart, first purchase from ``firsts``.

    ``firsts`` is (member, first_transaction_date). Members without one get NULL;
    several firsts give several rows. The fact table is reduced to one row per
    member before the join.
    """
    last = valid.groupBy(MEMBER).agg(F.max("order_date").alias("last_transaction_date"))
    return (last.join(firsts.select(MEMBER, "first_transaction_date").distinct(), MEMBER, "left")
            .select(MEMBER, "first_transaction_date", "last_transaction_date"))
