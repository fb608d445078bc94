from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from clientele.operators import contacts, reports
from clientele.plans import profile

TX = ("vip_main_no string, order_date date, shop_code string, shop_desc string, invoice_no string, "
      "net_amt_hkd decimal(18,2), sold_qty int, customer_sex string, customer_age_group string, "
      "cust_nat_cat string, region_key string, line string")
IN, OUT = date(2023, 1, 2), date(2019, 1, 2)
WINDOW = (date(2022, 10, 1), date(2023, 9, 30))


@pytest.fixture
def tags(spark):
    return spark.createDataFrame(
        [("a", "Engaged", 2.0), ("b", "Engaged", 9.0), ("c", "At Risk", None), ("idle", "At Risk", 1.0), ("e", "", 1.0)],
        "vip_main_no string, customer_tag string, tenure double")


@pytest.fixture
def tx(spark):
    def line(m, day, shop, inv, amt, qty, sex, age, nat, region, cat):
        return (m, day, shop, shop and f"Shop {shop}", inv, Decimal(amt), qty, sex, age, nat, region, cat)
    return spark.createDataFrame([
        line("a", IN, "S1", "i1", "10", 1, "M", "01", "Hong Kong", "HK", None),
        line("a", IN, "S1", "i1", "10", 1, "F", "05", "Macau", "MO", "N/A"),
        line("a", IN, None, "i2", "5", 1, None, None, None, "HK", "Tea"),
        line("b", OUT, "S2", "i3", "99", 9, "C", "07", "Korean", "TW", "Tea"),
        line("c", IN, None, "i4", "1", 2, "M", "02", "Taiwanese", "TW", "Tea"),
        line("e", IN, "S1", "i5", "7", 1, "M", "02", "Macau", "HK", "Tea"),
        line("stranger", IN, "S1", "i6", "7", 1, "M", "02", "Macau", "HK", "Tea"),
    ], TX)


def table(df, label):
    return {r[label]: {k: v for k, v in r.asDict().items() if k != label} for r in df.collect()}


def test_pivots_have_every_listed_tag_and_no_other(tx, tags):  # F24
    sales = reports.tagged_sales(tags, tx)
    out = reports.sum_pivot(sales, "region_key", "net_amt_hkd", ["Engaged", "Low Value"])
    assert out.columns == ["region_key", "Engaged", "Low Value"]
    got = table(out, "region_key")
    assert got["HK"] == {"Engaged": Decimal("15.00"), "Low Value": None}


def test_tagged_sales_keep_idle_members(tx, tags):
    sales = reports.tagged_sales(tags, tx)
    idle = sales.filter("vip_main_no = 'idle'").collect()
    assert len(idle) == 1 and idle[0].invoice_no is None
    assert sales.filter("vip_main_no = 'stranger'").count() == 0 and sales.count() == 7


def test_count_pivot_counts_members_in_each_group(tx, tags):
    got = table(reports.count_pivot(reports.tagged_sales(tags, tx), "region_key"), "region_key")
    assert (got["HK"]["Engaged"], got["MO"]["Engaged"], got["TW"]["Engaged"]) == (1, 1, 1)
    assert got[None]["At Risk"] == 1


def test_percent_pivot(spark):  # F19
    df = spark.createDataFrame([("x", "m1"), ("y", "m2"), ("y", "m3"), ("y", "m4")], "g string, vip_main_no string"
                               ).withColumn("customer_tag", F.lit("Engaged"))
    got = table(reports.percent_pivot(df, "g", tags=["Engaged"]), "g")
    assert got == {"x": {"Engaged": 25.0}, "y": {"Engaged": 75.0}}


def test_attribute_profiles(tx, tags):
    sex = table(reports.gender_profile(tx, tags), "sex")
    # a has M, F and unknown: C is smallest; idle has no lines: C
    assert sex["C"]["Engaged"] == 2 and sex["C"]["At Risk"] == 1 and sex["M"]["At Risk"] == 1
    nation = table(reports.nationality_profile(tx, tags), "nationality")
    assert nation["Hong Kong"]["Engaged"] == 1 and nation["Others"]["At Risk"] == 2
    four = table(reports.nationality_profile(tx, tags, ("Hong Kong", "Taiwanese")), "nationality")
    assert four["Taiwanese"]["At Risk"] == 1
    region = table(reports.region_profile(tx, tags), "region_key")
    assert region["HK"]["Engaged"] == 1 and region[None]["At Risk"] == 1
    every = table(reports.region_profile(tx, tags, collapse=False), "region_key")
    assert every["MO"]["Engaged"] == 1
    tenure = table(reports.tenure_profile(tags), "tenure_band")
    assert tenure["8+"]["Engaged"] == 1 and tenure["8+"]["At Risk"] == 1


def test_age_is_taken_by_code(tx, tags):  # F21
    assert table(reports.age_profile(tx, tags), "age")["41 - 50"]["Engaged"] == 1
    assert table(reports.age_profile(tx, tags, "min"), "age")["< 25"]["Engaged"] == 1
    assert table(reports.age_profile(tx, tags), "age")[None]["Engaged"] == 1  # code 07


def test_visits(tx, tags):  # F22
    got = reports.visits(tx, tags, WINDOW).first()
    assert (got["Engaged"], got["At Risk"]) == (1, 0)


def test_kpis_in_window(tx, tags):
    got = table(reports.sales_kpis(tx, tags, WINDOW), "kpi")
    assert got["amount"]["Engaged"] == 25.0 and got["quantity"]["Engaged"] == 3.0
    assert got["orders"]["Engaged"] == 2.0 and got["orders"]["Low Value"] is None


def test_categories_are_labelled_before_grouping(tx, tags):  # F23
    got = table(reports.category_pivot(tx, tags, "line", window=WINDOW), "line")
    assert got["Unknown"]["Engaged"] == Decimal("20.00") and got["Tea"]["At Risk"] == Decimal("1.00")
    buyers = table(reports.category_pivot(tx, tags, "line", agg="buyers", window=WINDOW), "line")
    assert buyers["Unknown"]["Engaged"] == 1
    assert {(r["line"], r.customer_tag): r.members for r in reports.category_buyers(tx, tags, "line").collect()
            }[("Tea", "Engaged")] == 2
    with pytest.raises(ValueError):
        reports.category_pivot(tx, tags, "line", agg="median")


def test_penetration(tx, tags):
    stores = table(reports.store_penetration(tx, tags, WINDOW), "shop_desc")
    assert stores["Shop S1"]["Engaged"] == 1 and "Shop S2" not in stores
    months = table(reports.month_penetration(tx, tags), "yyyymm")
    assert months["201901"]["Engaged"] == 1 and months[None]["At Risk"] == 1


def test_conflicts_are_about_values_not_repeats(tx):
    got = reports.attribute_conflicts(tx, "vip_main_no", F.col("customer_sex")).collect()
    assert [(r.vip_main_no, r.n_values) for r in got] == [("a", 2)]


def test_rollup_total_is_not_the_unnamed(spark):  # F28
    personas = spark.createDataFrame([("1", "A"), ("2", "A"), ("3", None)], "vip_main_no string, persona string")
    counted = {(r.persona, r.is_total): r["count"] for r in reports.persona_counts(personas).collect()}
    assert counted == {("A", 0): 2, (None, 0): 1, (None, 1): 3}
    wide = reports.persona_counts_wide(personas, ["A", "B b"]).first()
    assert (wide.A, wide.B_b, wide.Total) == (2, None, 3)


def test_column_share(spark):  # F29
    df = spark.createDataFrame([("c", 1, None), ("a", 1, 0), ("b", 2, 0)], "g string, x int, y int")
    out = reports.column_share(df, "g", ["x", "y"]).collect()
    assert [(r.g, r.x, r.y) for r in out] == [("a", 25.0, None), ("b", 50.0, None), ("c", 25.0, None)]


def test_unknown_modification_date_is_latest(spark):  # F27
    base = dict(vip_main_no="m", vip_opt_in=0, vip_no_sms=0, vip_no_phone=0, vip_no_edm=0,
                vip_last_modified_date=date(2023, 5, 1), vip_type_start_date=date(2020, 1, 1),
                vip_card_issue_date=None, vip_brand_code="BA", region_key="HK")
    lines = [base, {**base, "vip_last_modified_date": None, "vip_opt_in": 1},
             {**base, "vip_main_no": "n", "vip_card_issue_date": date(2020, 1, 1), "vip_no_sms": 1},
             {**base, "vip_main_no": "n"}, {**base, "vip_main_no": "x", "region_key": "TW"}]
    ddl = ("vip_main_no string, vip_opt_in int, vip_no_sms int, vip_no_phone int, vip_no_edm int, "
           "vip_last_modified_date date, vip_type_start_date date, vip_card_issue_date date, "
           "vip_brand_code string, region_key string")
    prefs = contacts.latest_preferences(spark.createDataFrame([tuple(r.values()) for r in lines], ddl))
    assert {r.vip_main_no: (r.vip_opt_in, r.vip_no_sms) for r in prefs.collect()} == {"m": (1, 0), "n": (0, 1)}
    personas = spark.createDataFrame([("m", "A"), ("z", None)], "vip_main_no string, persona string")
    listed = {r.vip_main_no: r for r in contacts.contact_list(personas, prefs, date(2024, 1, 1)).collect()}
    assert listed["m"].vip_opt_in == 1 and listed["z"].vip_opt_in is None
    assert listed["z"].date_of_run == date(2024, 1, 1)


def test_report_lines(spark):
    lines = [("m", "BA", "gift", "Dummy", 0), ("m", "BA", None, "x", 0), ("m", "BA", "ZZ", "x", 0),
             ("m", "BA", "Skin", None, 0), ("m", "BP", "Skin", "x", 0), ("m", "BA", "Skin", "x", 1)]
    df = spark.createDataFrame(lines, "vip_main_no string, prod_brand string, maincat_desc string, "
                                      "item_subcat_desc string, sales_staff_flag int")
    got = {(r.maincat_desc_cleaned, r.item_subcat_desc_cleaned, r.maincat_and_subcat)
           for r in contacts.clean_for_report(df).collect()}
    assert got == {("GIFT", "Unknown", "GIFT - Unknown"), ("Skin", None, None)}


def test_bitmaps_roll_up_without_counting_a_member_twice(spark):
    from clientele.operators import presence
    tags = spark.createDataFrame([(f"m{i}", "A" if i % 3 else None) for i in range(70_000)], "vip_main_no string, customer_tag string").repartition(3)
    rows = spark.createDataFrame([(f"m{i % 70_003}", f"c{i % 7}") for i in range(0, 90_000, 2)], "vip_main_no string, cell string").distinct()
    cells = presence.presence(rows, presence.numbered(tags), ["cell"])
    got = {(r.cell, r.customer_tag): r.members for r in presence.distinct_members(cells, {"cell": F.col("cell")}).collect()}
    both = rows.join(tags, "vip_main_no")
    assert got == {(r.cell, r.customer_tag): r.n for r in both.groupBy("cell", "customer_tag").agg(F.countDistinct("vip_main_no").alias("n")).collect()}
    total = {r.customer_tag: r.members for r in presence.distinct_members(cells, {"cell": F.lit("all")}).collect()}
    assert total == {r.customer_tag: r.n for r in both.groupBy("customer_tag").agg(F.countDistinct("vip_main_no").alias("n")).collect()}
    assert presence.distinct_members(cells.limit(0), {"cell": F.col("cell")}).count() == 0


def test_lines_outside_the_window_are_in_cells_of_months_only(tx):
    cells = profile.report_cells(tx, WINDOW, "line")
    got = {r["slice"]: r.n for r in cells.filter("lines = 0").groupBy("slice").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"month": 1}
    people = {r.vip_main_no: r for r in profile.member_cells(cells).collect()}
    assert (people["a"].customer_sex, people["a"].customer_age_group, people["b"].region_key) == ("C", "05", "TW")


def test_cells_of_asked_slices_read_no_other_columns(tx):
    cells = profile.report_cells(tx.select("vip_main_no", "order_date", "shop_desc", "line"), WINDOW, "line",
                                 slices=("month", "store", "category"), measured=False)
    assert {r["slice"]: r.n for r in cells.groupBy("slice").agg(F.count(F.lit(1)).alias("n")).collect()} == {
        "month": 5, "store": 5, "category": 5}
    assert cells.columns == ["vip_main_no", "slice", "month", "shop_desc", "category", "lines"]


def test_counted_cells_equal_their_bitmaps(spark):
    from clientele.operators import presence
    tags = spark.createDataFrame([(f"m{i}", "A" if i % 3 else None) for i in range(50)], "vip_main_no string, customer_tag string")
    rows = spark.createDataFrame([(f"m{i % 53}", f"s{i % 19}" if i % 19 else None) for i in range(400)], "vip_main_no string, cell string").distinct()
    counted = presence.cell_members(rows, tags, ["cell"])
    cells = presence.presence(rows, presence.numbered(tags), ["cell"])
    united = presence.distinct_members(cells, {"cell": F.col("cell")})
    assert sorted(map(str, counted.collect())) == sorted(map(str, united.collect())) and counted.count()


def test_pivots_of_reduced_lines_equal_those_of_all_lines(tx, tags):
    def same(a, b):
        return a.count() and not a.exceptAll(b).count() and not b.exceptAll(a).count()
    sales = reports.tagged_sales(tags, tx)
    assert same(reports.sum_pivot(reports.tagged_amounts(tags, tx, "region_key", "net_amt_hkd"), "region_key", "net_amt_hkd").selectExpr(
        "region_key", "cast(Engaged as double)", "cast(`At Risk` as double)"),
        reports.sum_pivot(sales, "region_key", "net_amt_hkd").selectExpr("region_key", "cast(Engaged as double)", "cast(`At Risk` as double)"))
    assert same(reports.percent_pivot(reports.tagged_keys(tags, tx, "region_key"), "region_key"), reports.percent_pivot(sales, "region_key"))
    assert same(reports.count_pivot(reports.tagged_keys(tags, tx, "region_key", "invoice_no"), "region_key", "invoice_no"),
                reports.count_pivot(sales, "region_key", "invoice_no"))


def test_lines_are_stored_before_they_are_searched_and_joined(tx, tags, monkeypatch):
    from clientele.operators import skew
    searched, plain = [], skew.heavy_keys
    monkeypatch.setattr(skew, "heavy_keys", lambda df, *args: searched.append(df) or plain(df, *args))
    monkeypatch.setattr(skew, "TASK_ROWS", 1)
    assert reports.tagged_sales(tags, tx).count() == 7
    assert searched and all("/staged/" in path for df in searched for path in df.inputFiles()) and searched[0].inputFiles()
