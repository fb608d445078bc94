from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from clientele.config import CHANNEL_RULES
from clientele.operators import clean, dimensions, mart

SALES = ("region_key string, shop_code string, invoice_no string, item_code string, sales_date string, "
         "sold_qty string, net_amt_hkd string, net_amt string, item_list_price string, shop_brand string, "
         "vip_no string, prod_brand string, sale_lady_id string, cashier_id string, customer_nat string, "
         "cust_nat_cat string, customer_sex string, customer_age_group string, void_flag string, "
         "valid_tx_flag string, sales_staff_flag string, invoice_remark string, sales_type string")


def raw_line(**over):
    line = dict(region_key="HK", shop_code="S1", invoice_no="I1", item_code="A", sales_date="2023-01-02",
                sold_qty="1", net_amt_hkd="12.5", net_amt="9", item_list_price="x", shop_brand="BA", vip_no="c1",
                prod_brand="BA", sale_lady_id="L", cashier_id="BAEXC", customer_nat=None, cust_nat_cat=None,
                customer_sex="F", customer_age_group="01", void_flag=None, valid_tx_flag="1",
                sales_staff_flag="0", invoice_remark=None, sales_type="Product")
    line.update(over)
    return tuple(line.values())


def test_key_map_and_fallback(spark, rows):  # F6
    vip = spark.createDataFrame([("c1", "M2"), ("c1", "M1"), ("c1", None), ("c2", None)],
                                "vip_no string, vip_main_no string")
    key_map = clean.member_key_map(vip)
    assert rows(key_map) == [("c1", "M1")]
    sales = spark.createDataFrame([("c1",), ("c9",), (None,)], "vip_no string")
    assert rows(clean.resolve_member(sales, key_map), "vip_no", "vip_main_no") == [
        (None, None), ("c1", "M1"), ("c9", "c9")]


def test_projection_types_rounding_and_malformed_values(spark):
    raw = spark.createDataFrame([raw_line(), raw_line(shop_code=None, sold_qty="many")], SALES)
    first, second = clean.project_sales(raw).collect()
    assert first.net_amt_hkd == Decimal(13) and first.item_list_price is None
    assert first.order_date == date(2023, 1, 2) and first.sales_main_key == "S1-I1"
    assert second.sales_main_key is None and second.sold_qty is None
    assert clean.project_sales(raw, "decimal(18,2)").first().net_amt_hkd == Decimal("12.50")


def test_trim_keeps_types_and_inner_blanks_of_the_key(spark):
    raw = spark.createDataFrame([raw_line(shop_code=" S1 ", invoice_no=" I1 ")], SALES)
    out = clean.trim_strings(clean.project_sales(raw))
    line = out.first()
    assert (line.shop_code, line.sales_main_key) == ("S1", "S1 - I1")
    assert dict(out.dtypes)["order_date"] == "date" and dict(out.dtypes)["sold_qty"] == "int"


def test_dedup_is_idempotent_and_by_brand(spark):
    raw = spark.createDataFrame([raw_line(), raw_line(), raw_line(vip_no="c2"), raw_line(shop_brand="HB")], SALES)
    once = clean.dedup_sales(clean.project_sales(raw), ["BA", "BP"])
    assert once.count() == 2 and clean.dedup_sales(once, ["BA", "BP"]).count() == 2


def test_between_dates_takes_dates_only(spark):
    df = spark.createDataFrame([(date(2023, 1, i),) for i in (1, 2, 3, 4)], "order_date date")
    assert clean.between_dates(df, date(2023, 1, 2), date(2023, 1, 3)).count() == 2
    with pytest.raises(TypeError):
        clean.between_dates(df, "20230102", "20230103")


def test_latest_per_key_ties_and_nulls(spark, rows):  # F1
    df = spark.createDataFrame(
        [("S1", date(2023, 1, 2), "a"), ("S1", date(2023, 1, 2), "b"), ("S1", date(2023, 1, 1), "c"),
         ("S2", None, "d"), (None, date(2023, 1, 5), "e")], "k string, ts date, v string")
    assert [r[2] for r in rows(dimensions.latest_per_key(df, "k", "ts"))] == ["a", "b"]
    assert [r[2] for r in rows(dimensions.latest_per_key(df, ["k"], "ts", "one"))] == ["b"]
    with pytest.raises(ValueError):
        dimensions.latest_per_key(df, "k", "ts", "some")


def test_locations_cut_to_the_day_and_named(spark, rows):
    raw = spark.createDataFrame(
        [("S1", "old", "TW-Taipei", "BA", datetime(2023, 1, 1, 9)),
         ("S1", "am", "TW-Taipei", "BA", datetime(2023, 1, 2, 9)),
         ("S1", "pm", "TW-Taipei", "BA", datetime(2023, 1, 2, 18)),
         ("S2", "x", None, "BP", datetime(2023, 1, 2)), ("S3", "y", "TW-Tainan", "ZZ", datetime(2023, 1, 2))],
        "shop_code string, shop_desc string, city_district string, shop_brand string, modified_date timestamp")
    assert rows(dimensions.clean_locations(raw, {"S2": "Named"})) == [
        ("S1", "am", "Northern TW"), ("S1", "pm", "Northern TW"), ("S2", "Named", "Others")]


def test_sub_region(spark):  # F30
    cases = {"TW-Taipei": "Northern TW", "TW-Taichung": "Central TW", "TW-Tainan": "Southern TW",
             "TW-Other": "Others", "HK-Taipei": "Others", "tw-Taipei": "Others", None: "Others",
             "TW-Kaohsiung": "Southern TW", "TW-Xinbei": "Northern TW"}
    df = spark.createDataFrame([(d,) for d in cases], "d string").withColumn("r", dimensions.sub_region(F.col("d")))
    assert {r.d: r.r for r in df.collect()} == cases


def test_excluded_category_loaded_last_hides_the_subcategory(spark, rows):  # F2
    raw = spark.createDataFrame(
        [("BA", "BA01", "X", "x", datetime(2023, 1, 1)), ("BA", "BA13", "X", "x", datetime(2023, 2, 1)),
         ("BA", "BA01", "Y", "FACE-CLEANSING", datetime(2023, 2, 1)), ("BA", None, "Z", "z", datetime(2023, 2, 1))],
        "item_brand_key string, item_cat string, item_sub_cat string, item_subcat_desc string, load_date timestamp")
    assert rows(dimensions.clean_subcategories(raw)) == [("Y", "BA01", "BA", "FACE CLEANSING")]


def test_net_zero_orders(spark, rows):  # F3
    df = spark.createDataFrame([("1", 1), ("1", -1), ("2", 2), ("2", -1), ("3", None), (None, 5)],
                               "sales_main_key string, sold_qty int")
    assert rows(mart.drop_net_zero_orders(df)) == [("2", -1), ("2", 2)]


LINE = ("shop_brand string, retail_price_hk int, region_key string, item_cat string, sold_qty int, "
        "valid_tx_flag int, void_flag string, sales_staff_flag int, cashier_id string, shop_code string, "
        "sale_lady_id string, sales_type string, net_amt int, net_amt_hkd int")


def bp_line(**over):
    line = dict(shop_brand="BP", retail_price_hk=60, region_key="HK", item_cat="BP01", sold_qty=1, valid_tx_flag=1,
                void_flag=None, sales_staff_flag=1, cashier_id="30241", shop_code="S", sale_lady_id="L",
                sales_type=None, net_amt=5, net_amt_hkd=5)
    line.update(over)
    return tuple(line.values())


def test_amount_floor_belongs_to_one_channel_only(spark):  # F4
    tw = dict(region_key="TW", cashier_id="CASHIER", sales_staff_flag=0)
    lines = [bp_line(net_amt_hkd=-5), bp_line(), bp_line(), bp_line(**tw), bp_line(net_amt_hkd=-5, **tw)]
    out = mart.union_channels(spark.createDataFrame(lines, LINE), CHANNEL_RULES["BP"]).collect()
    assert sorted((r.region_key, r.net_amt_hkd) for r in out) == [("HK", -5), ("HK", 5), ("TW", 5)]


@pytest.mark.parametrize("change", [
    dict(item_cat=None), dict(item_cat="BP13"), dict(sale_lady_id=None), dict(sale_lady_id="sxd"),
    dict(retail_price_hk=50), dict(retail_price_hk=None), dict(net_amt=0), dict(sold_qty=0), dict(void_flag="V"),
    dict(valid_tx_flag=0), dict(region_key="CN"), dict(cashier_id="X"), dict(shop_brand="BA")])
def test_each_test_of_a_rule_rejects(spark, change):  # F5
    rule = mart.channel_condition(CHANNEL_RULES["BP"]["hk"])
    assert spark.createDataFrame([bp_line()], LINE).filter(rule).count() == 1
    assert spark.createDataFrame([bp_line(**change)], LINE).filter(rule).count() == 0


def test_store_and_online_rules(spark):
    store = dict(shop_brand="BA", retail_price_hk=21, item_cat="BA01", sales_staff_flag=0, cashier_id="BAEXC",
                 sales_type="Product")
    lines = [bp_line(**store), bp_line(**{**store, "cashier_id": "X", "shop_code": "BAEHKG02"}),
             bp_line(**{**store, "cashier_id": "X"}), bp_line(**{**store, "sales_staff_flag": 1}),
             bp_line(**{**store, "sales_type": "Service"})]
    found = mart.apply_channel_rules(spark.createDataFrame(lines, LINE), CHANNEL_RULES["BA"])
    assert {name: df.count() for name, df in found.items()} == {"store": 1, "online": 1}


def test_first_and_last(spark, rows):
    valid = spark.createDataFrame([("m", date(2023, 1, 1)), ("m", date(2023, 3, 1)), ("n", date(2023, 2, 1))],
                                  "vip_main_no string, order_date date")
    firsts = spark.createDataFrame([("m", date(2020, 1, 1)), ("m", date(2020, 1, 1)), ("m", date(2019, 1, 1))],
                                   "vip_main_no string, first_transaction_date date")
    assert rows(mart.first_last(valid, firsts)) == [
        ("m", date(2019, 1, 1), date(2023, 3, 1)), ("m", date(2020, 1, 1), date(2023, 3, 1)),
        ("n", None, date(2023, 2, 1))]


def test_demographics_keep_differing_records(spark):
    cols = ("vip_main_no vip_type vip_issue_date vip_sex vip_nation vip_agegrp region_key vip_staff_flag "
            "vip_ba_first_pur_date vip_ba_vip_type").split()
    data = [("m", *"abcdefghi"), ("m", *"abcdefghi"), ("m", *"abcdefghj"), (None, *"abcdefghi")]
    vip = spark.createDataFrame(data, ", ".join(f"{c} string" for c in cols))
    assert clean.demographics(vip, cols[-2:]).count() == 2


def test_lines_count_as_often_as_they_are_enriched(spark, rows):
    skus = spark.createDataFrame(
        [("i", "BA", "first", "c", "s"), ("i", "BA", "second", "c", "s"), ("j", "BA", "only", "c", "t"), ("k", "BA", "other", None, None)],
        "item_code string, brand_code string, item_desc string, item_cat string, item_sub_cat string").withColumns(
        {c: F.lit(None).cast("string") for c in ("retail_price_hk", "retail_price_tw", "item_product_line_desc", "maincat_desc")})
    subcategories = spark.createDataFrame([("BA", "s", "c", "one"), ("BA", "s", "c", "two"), ("BP", "t", "c", "x")],
                                          "item_brand_key string, item_sub_cat string, item_cat string, item_subcat_desc string")
    locations = spark.createDataFrame([("S", "r", "old"), ("S", "r", "new"), ("T", "r", "t")], "shop_code string, sub_region string, shop_desc string")
    lines = spark.createDataFrame(
        [("1", 1, "i", "BA", "BA", "S"), ("2", 1, "i", "BA", "BP", "T"), ("3", 1, "j", "BA", "BA", "S"), ("4", 1, "k", "BA", "BA", None),
         ("5", 1, None, None, "BA", "T"), ("6", None, "i", "ZZ", "BA", "S")],
        "sales_main_key string, sold_qty int, item_code string, prod_brand string, shop_brand string, shop_code string")
    got = {r.sales_main_key: r.times for r in mart.fanned_out(lines, skus, subcategories, locations, ["BA", "BP"]).collect()}
    assert got == {"1": 8, "2": 2, "3": 2, "4": 1, "5": 1, "6": 2}


def test_heavy_keys_of_lines_are_searched_in_stored_keys(spark, monkeypatch):
    from clientele.operators import skew
    from verify.queries import QUERIES
    searched, plain = [], skew.heavy_keys
    monkeypatch.setattr(skew, "heavy_keys", lambda df, *args: searched.append(df) or plain(df, *args))
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 10)
    assert QUERIES["enrich_sales"](spark, "/root/testdata/sf0.001").count()
    keyed = [df.inputFiles() for df in searched if "vip_no" in df.columns]
    assert keyed and all("/staged/" in path for paths in keyed for path in paths)
