"""Whole jobs over small stored tables: mart, segments, reclassification, personas."""

import glob
from datetime import date

import pytest
from pyspark.sql import functions as F

from clientele.config import CHANNEL_RULES, Period, SegmentCuts, WalletSpec
from clientele.operators import mart
from clientele.plans import mart as mart_plan
from clientele.plans import personas as persona_plan
from clientele.plans import profile
from clientele.plans import segments as segment_plan
from clientele.sources import io, schemas
from clientele.sources.staging import job_scope, staged, staging_folder
from verify import tables

SF = "/root/testdata/sf0.001"
PERIOD = Period(date(1998, 8, 1), date(2000, 8, 1), date(2001, 7, 31))
LAST = Period(date(1997, 8, 1), date(1999, 8, 1), date(2000, 7, 31))
CUTS = SegmentCuts(1000, 300, 60000, 20000, 60000, 20000)
BRANDS = [f"Brand#{i}" for i in range(26)]
SPECS = (WalletSpec("item_sub_cat", "_sub", {"low": ("SC0", "SC1", "SC2", "SC3"), "high": ("SC4", "SC5", "SC6", "SC7")}),
         WalletSpec("item_product_line_desc", "_line", {"first": tuple(BRANDS[:9]), "second": tuple(BRANDS[9:18])}))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("mart")
    refs = {}
    for name, frame in tables.sources(spark, SF).items():
        refs[name] = f"{base}/{name}.parquet"
        frame.write.parquet(refs[name])
    for period, suffix in ((PERIOD, ""), (LAST, "_last_year")):
        mart_plan.run_mart(spark, refs, f"{base}/ba", period, "BA", suffix, amount_type="decimal(18,2)")
    return str(base), refs


def test_mart_is_written_by_month_and_read_by_window(spark, stored):
    base, _ = stored
    parts = io.read_mart(spark, f"{base}/ba")
    tx = parts["transaction"]
    assert list(tx.columns) == list(tables_columns()) and tx.count() > 20
    assert glob.glob(f"{base}/ba/version=*/transaction.parquet/order_month=*")
    window = (PERIOD.p12m_first, PERIOD.last)
    pruned = io.read_transactions(spark, f"{base}/ba", window=window)
    assert pruned.count() == tx.filter(F.col("order_date").between(*map(F.lit, window))).count()
    assert "PartitionFilters: [isnotnull(order_month" in pruned._jdf.queryExecution().toString()
    firsts = parts["first_last_transaction"]
    assert firsts.count() == tx.select("vip_main_no").distinct().count()
    assert firsts.filter("first_transaction_date > last_transaction_date").count() == 0


def tables_columns():
    from clientele.operators.mart import TRANSACTION_COLUMNS
    return TRANSACTION_COLUMNS


def test_given_first_purchases_take_precedence(spark, stored):
    _, refs = stored
    sources = io.read_sources(spark, refs)
    fixed = spark.createDataFrame([("M0", date(1990, 1, 1), None)], schemas.FIRST_PURCHASES)
    got = mart_plan.first_purchases({**sources, "first_purchases": fixed}, "BA").collect()
    assert [tuple(r) for r in got] == [("M0", date(1990, 1, 1))]


def test_first_purchases_by_card_equal_those_by_line(spark, stored, rows):
    from clientele.operators import mart
    _, refs = stored
    sources = io.read_sources(spark, refs)
    by_line = mart.first_purchase(mart_plan.sales_history(sources, ["BA"])).select("vip_main_no", "first_purchase")
    assert rows(mart_plan.first_purchases(sources, "BA")) == rows(by_line)


def test_segments_reclassified_into_a_new_version(spark, stored):
    base, _ = stored
    out = f"{base}/segments"
    segment_plan.run_segments(spark, f"{base}/ba", out, PERIOD, "BA", cuts=CUTS)
    segment_plan.run_segments(spark, f"{base}/ba", out, LAST, "BA", suffix="_last_year", cuts=CUTS)
    segment_plan.run_reclassify(spark, out, "BA", None, PERIOD.last, LAST.last)
    first = io.read_segments(spark, out, "value_segment", "BA", None, PERIOD.last)
    second = io.read_segments(spark, out, "value_segment", "BA", None, PERIOD.last, version=2)
    assert first.count() == second.count() > 0 and first.columns == second.columns
    with pytest.raises(Exception, match="(?i)exists"):
        segment_plan.run_reclassify(spark, out, "BA", None, PERIOD.last, LAST.last)
    totals = io.read_segments(spark, out, "total_clv", "BA", None, PERIOD.last)
    assert totals.count() >= first.count()


def test_reports_from_stored_tables(spark, stored):
    base, _ = stored
    tx = io.read_transactions(spark, f"{base}/ba")
    values = [staged(segment_plan.tags_of(segment_plan.member_values(
        io.read_transactions(spark, f"{base}/ba", s),
        io.read_mart(spark, f"{base}/ba", s)["first_last_transaction"], p, CUTS)))
        for s, p in (("", PERIOD), ("_last_year", LAST))]
    found = profile.segment_reports(tx, *values, (PERIOD.p12m_first, PERIOD.last))
    assert {name: df.count() > 0 for name, df in found.items()} == dict.fromkeys(found, True)
    # every member of this year is in one cell of the matrix or has no listed tag
    cells = [v for r in found["migration"].collect() for v in list(r)[1:] if v]
    assert sum(cells) == values[0].filter("customer_tag <> ''").count()


def staged_folders(spark):
    return set(glob.glob(f"{staging_folder(spark)}/staged/*"))


def test_a_write_that_fails_midway_leaves_the_mart_before(spark, stored, monkeypatch):
    base, refs = stored
    before, staged_before = io.read_mart(spark, f"{base}/ba"), staged_folders(spark)
    counts = {name: part.count() for name, part in before.items()}
    monkeypatch.setattr(mart_plan.mart, "first_last", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        mart_plan.run_mart(spark, refs, f"{base}/ba", LAST, "BA", amount_type="decimal(18,2)")
    assert {name: part.count() for name, part in io.read_mart(spark, f"{base}/ba").items()} == counts
    assert staged_folders(spark) == staged_before


def test_jobs_release_what_they_stage(spark, stored):
    base, _ = stored
    before = staged_folders(spark)
    segment_plan.run_segments(spark, f"{base}/ba", f"{base}/released", PERIOD, "BA", cuts=CUTS)
    persona_plan.run_training(spark, f"{base}/ba", f"{base}/released_model", (), (), k=2, n_init=1, n_factors=2, n_keep=3, specs=SPECS)
    persona_plan.run_scoring(spark, f"{base}/ba", f"{base}/released_model", f"{base}/released_scores", (), specs=SPECS)
    assert staged_folders(spark) == before
    with job_scope(spark):
        outer = staged(spark.range(3))
        with job_scope(spark):
            inner = staged(spark.range(5))
            assert inner.count() == 5
        assert len(staged_folders(spark) - before) == 1 and outer.count() == 3
    assert staged_folders(spark) == before
    staged(spark.range(1))
    assert len(staged_folders(spark) - before) == 1


def test_a_mart_grows_by_the_orders_that_changed(spark, stored, rows):
    base, refs = stored
    sales = spark.read.parquet(refs["sales"])
    late = F.coalesce((F.col("sales_date") >= F.lit(date(2001, 1, 1))) | (F.col("item_code").cast("int") % 5 == 1), F.lit(False))
    sales.filter(~late).write.parquet(f"{base}/early.parquet")
    sales.filter(late).write.parquet(f"{base}/late.parquet")
    options = {"amount_type": "decimal(18,2)"}
    mart_plan.run_mart(spark, {**refs, "sales": f"{base}/early.parquet"}, f"{base}/grown", PERIOD, "BA", **options)
    first = io.read_transactions(spark, f"{base}/grown")
    mart_plan.run_mart_update(spark, {**refs, "sales": f"{base}/early.parquet"}, f"{base}/late.parquet", f"{base}/grown", PERIOD, "BA", **options)
    whole, grown = io.read_mart(spark, f"{base}/ba"), io.read_mart(spark, f"{base}/grown")
    assert 0 < first.count() != grown["transaction"].count()
    for name, part in whole.items():
        assert rows(grown[name]) == rows(part)
    none = spark.createDataFrame([], sales.schema)
    tables_now = io.read_sources(spark, refs)
    same = mart_plan.update_valid(whole["transaction"], tables_now, none, mart_plan.order_ledger(sales), PERIOD, "BA", **options)
    assert rows(same) == rows(whole["transaction"])


def test_two_years_from_one_read_equal_each_alone(spark, stored, rows):
    base, _ = stored
    tx = io.read_transactions(spark, f"{base}/ba")
    firsts = tx.groupBy("vip_main_no").agg(F.min("order_date").alias("first_transaction_date"))
    from clientele.operators import clean, mart
    both = segment_plan.two_years(tx, PERIOD, LAST, CUTS)
    for got, period in zip(both, (PERIOD, LAST), strict=True):
        inside = clean.between_dates(tx, period.first, period.last)
        alone = segment_plan.member_values(inside, mart.first_last(inside, firsts), period, CUTS)
        assert rows(got) == rows(alone) and got.columns == alone.columns
        assert "version=" not in str(got.inputFiles())
    with pytest.raises(ValueError):
        segment_plan.two_years(tx, PERIOD, Period(date(1998, 8, 2), date(1999, 8, 1), date(2000, 7, 31)), CUTS)


def test_reports_read_the_sales_once(spark, stored):
    base, _ = stored
    tx, window = io.read_transactions(spark, f"{base}/ba"), (PERIOD.p12m_first, PERIOD.last)
    plan = profile.report_cells(tx, window)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    tags = staged(segment_plan.tags_of(segment_plan.member_values(tx, io.read_mart(spark, f"{base}/ba")["first_last_transaction"], PERIOD, CUTS)))
    found = profile.segment_reports(tx, tags, tags, window)
    assert all("version=" not in path for table in found.values() for path in table.inputFiles())
    from clientele.operators import reports
    assert found["kpis"].orderBy("kpi").collect() == reports.sales_kpis(tx, tags, window).orderBy("kpi").collect()
    assert found["visits"].collect() == reports.visits(tx, tags, window).collect()


def test_personas_trained_stored_and_scored(spark, stored):
    base, _ = stored
    model = f"{base}/model"
    chosen = persona_plan.run_training(spark, f"{base}/ba", model, (), (), k=2, n_init=1, n_factors=2, n_keep=3,
                                       specs=SPECS)
    assert 2 <= len(chosen) <= 3
    trained = spark.read.parquet(f"{model}/training_result")
    persona_plan.run_scoring(spark, f"{base}/ba", model, f"{base}/scored", (), specs=SPECS)
    scored = spark.read.parquet(f"{base}/scored")
    assert dict(scored.dtypes)["persona"] == "int"
    assert sorted(map(tuple, scored.collect())) == sorted(map(tuple, trained.collect()))

    io.write_features(persona_plan.feature_table(io.read_transactions(spark, f"{base}/ba"), (), (), SPECS), base, "sow")
    assert io.read_features(spark, base, ["sow"])[0].columns[1:] == ["low_sub", "high_sub", "first_line", "second_line"]

    tables.CONTACTS.frame(spark, SF).write.parquet(f"{base}/contacts.parquet")
    persona_plan.run_persona_export(spark, f"{base}/ba", f"{base}/scored", f"{base}/contacts.parquet",
                                    f"{base}/contact_list", date(2001, 8, 1))
    back = spark.read.option("header", True).csv(f"{base}/contact_list")
    assert back.columns[:3] == ["date_of_run", "vip_main_no", "persona"] and back.count() == scored.count()

    named = scored.withColumn("persona", F.when(F.col("persona") == 0, "A").otherwise("B"))
    found = persona_plan.persona_reports(io.read_transactions(spark, f"{base}/ba"), named,
                                         (PERIOD.first, PERIOD.last), {0: "A", 1: "B"})
    assert found["counts"].first().Total == scored.count()
    assert all(df.count() > 0 for df in found.values())


def test_schemas_match_the_views(spark):
    for ddl, view in ((schemas.SALES, tables.SALES), (schemas.MEMBERS, tables.MEMBERS), (schemas.SKUS, tables.SKUS),
                      (schemas.LOCATIONS, tables.LOCATIONS), (schemas.CONTACTS, tables.CONTACTS),
                      (schemas.MAIN_CATEGORIES, tables.MAIN_CATEGORIES),
                      (schemas.SUBCATEGORIES, tables.SUBCATEGORIES)):
        assert set(spark.createDataFrame([], ddl).columns) == set(view.columns)


def test_a_model_keeps_the_order_of_its_features(spark, stored):
    base, _ = stored
    model = f"{base}/ordered"
    chosen = persona_plan.run_training(spark, f"{base}/ba", model, ("low_sub",), (), k=2, n_init=1, n_factors=2,
                                       n_keep=3, specs=SPECS)
    _, _, cols, dropped = io.load_model(spark, model)
    assert cols == chosen and dropped == ["low_sub"] and "low_sub" not in cols
    # The same features made in another order give the same personas.
    persona_plan.run_scoring(spark, f"{base}/ba", model, f"{base}/reordered", (), specs=SPECS[::-1])
    got = spark.read.parquet(f"{base}/reordered").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, spark.read.parquet(f"{model}/training_result").collect()))
    with pytest.raises(ValueError):
        persona_plan.run_scoring(spark, f"{base}/ba", model, f"{base}/never", (), specs=SPECS[:1])


def test_lines_that_cannot_change_a_mart_are_not_moved(spark, stored):
    base, refs = stored
    sales, valid = spark.read.parquet(refs["sales"]), io.read_transactions(spark, f"{base}/ba")
    other = sales.filter((F.col("shop_brand") != "BA") | (F.col("sales_date") > F.lit(PERIOD.last)) | (F.col("sales_date") < F.lit(PERIOD.first)))
    assert other.count() > 0
    same = mart_plan.update_valid(valid, io.read_sources(spark, refs), other, mart_plan.order_ledger(sales), PERIOD, "BA")
    assert same is valid


@pytest.mark.parametrize("brands, rules", [(["BA"], CHANNEL_RULES["BA"]), (["BA", "BP"], CHANNEL_RULES["BP"])])
def test_only_lines_that_may_be_in_a_channel_are_enriched(spark, stored, monkeypatch, brands, rules):
    """All lines count for net-zero orders, but few are looked up; the channels are those of all enriched lines."""
    sources = io.read_sources(spark, stored[1])
    # Two records of every third product, so that totals by order depend on how often a line is repeated.
    again = sources["skus"].filter("cast(item_code as int) % 3 = 0").withColumn("item_desc", F.concat("item_desc", F.lit(" again")))
    sources = {**sources, "skus": sources["skus"].unionByName(again)}
    valid = staged(mart_plan.valid_lines(sources, PERIOD, brands, "decimal(18,2)"))
    whole = mart.union_channels(valid, rules)
    enriched, plain = [], mart.enrich_sales
    monkeypatch.setattr(mart, "enrich_sales", lambda sales, *args, **options: enriched.append(sales) or plain(sales, *args, **options))
    channels = mart_plan._valid(sources, PERIOD, brands[0], rules, "decimal(18,2)") if len(brands) == 1 else mart_plan.channel_lines(
        sources, PERIOD, brands, rules, "decimal(18,2)")
    assert whole.count() and channels.exceptAll(whole).count() == whole.exceptAll(channels).count() == 0
    assert whole.count() <= enriched[0].count() < valid.count() / 3
