import itertools
from datetime import date
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clientele.config import Period, SegmentCuts
from clientele.functions.labels import bucket, tenure_band
from clientele.operators import clv, mart, segments, trend
from clientele.plans import segments as plan

PERIOD = Period(date(2020, 10, 1), date(2022, 10, 1), date(2023, 9, 30))
CUTS = SegmentCuts(60, 20, 400, 150, 300, 100)


def test_window_months(spark, rows):  # F12
    assert PERIOD.trend_months[0] == "202210" and PERIOD.trend_months[-1] == "202309"
    assert len(PERIOD.trend_months) == 12 and PERIOD.p12m_after == "202209"
    calendar = clv.month_calendar(spark, PERIOD.p12m_first, PERIOD.last)
    assert [r[0] for r in rows(calendar)] == PERIOD.trend_months


@pytest.mark.parametrize("first, last, joiner, activity, tenure", [
    (date(2022, 10, 1), date(2023, 1, 1), "New Joiner", "active_in_p12m", 1.0),      # F7
    (date(2022, 9, 30), date(2022, 9, 30), "old member", "Inactive P12", 1.0),       # F8
    (date(2019, 1, 1), date(2021, 9, 30), "old member", "Inactive P24", 5.0),        # F9
    (date(2023, 4, 1), date(2023, 4, 1), "New Joiner", "active_in_p12m", 0.0),       # F10
    (date(2023, 3, 31), date(2023, 4, 1), "New Joiner", "active_in_p12m", 1.0),
    (date(2019, 1, 1), date(2021, 10, 1), "old member", "Inactive P12", 5.0),
    (None, date(2023, 4, 1), None, "active_in_p12m", None),                          # F11
    (date(2023, 10, 1), None, None, "active_in_p12m", 0.0),
])
def test_member_status(spark, first, last, joiner, activity, tenure):
    df = spark.createDataFrame([("m", first, last)],
                               "vip_main_no string, first_transaction_date date, last_transaction_date date")
    row = clv.member_status(df, PERIOD).first()
    assert (row.new_joiner_flag, row.inactive_flag, row.tenure) == (joiner, activity, tenure)


def test_total_and_average(spark):
    status = spark.createDataFrame(
        [("five", 5.0, "old member"), ("two", 2.0, "old member"), ("none", 0.0, "New Joiner"), ("gone", 1.0, None),
         ("broke", 1.0, "old member")], "vip_main_no string, tenure double, new_joiner_flag string")
    monthly = spark.createDataFrame([(m, "202301", Decimal(30)) for m in ("five", "two", "none", "gone")]
                                    + [("five", "202302", Decimal(60))],
                                    "vip_main_no string, yyyymm string, rev decimal(10,0)")
    got = {r.vip_main_no: (r.total_clv, r.avg_annual_revenue) for r in clv.total_clv(status, monthly).collect()}
    assert got == {"five": (90, 30.0), "two": (30, 15.0), "none": (30, None)}


def monthly_frame(spark, series):
    rows = [(m, month, Decimal(v)) for m, values in series.items()
            for month, v in zip(PERIOD.trend_months, values) if v]
    return spark.createDataFrame(rows, "vip_main_no string, yyyymm string, rev decimal(18,2)")


def test_grid_is_dense(spark):
    series = {"a": [0, 5] + [0] * 10, "b": [1] * 12}
    grid = clv.dense_monthly_grid(monthly_frame(spark, series), PERIOD.trend_months).collect()
    assert len(grid) == 24
    for member, values in series.items():
        mine = sorted((r.yyyymm, int(r.monthly_clv)) for r in grid if r.vip_main_no == member)
        assert mine == list(zip(PERIOD.trend_months, values))


def theil_sen(y):
    pairs = [(y[j] - y[i]) / (j - i) for i, j in itertools.combinations(range(len(y)), 2)]
    slope = float(np.median(pairs))
    return slope, float(np.median(y) - slope * (len(y) - 1) / 2)


@pytest.mark.parametrize("y, slope, intercept, final", [
    ([0, 0, 100, 100, 250, 250, 250, 400, 400, 400, 900, 900], 60, -80, 100),  # F13
    ([500] * 12, 0, 500, 250),                                                  # F14
    ([0] * 12, 0, 0, 0),
    (list(range(0, -120, -10)), -10, 0, -10),
])
def test_slopes(spark, y, slope, intercept, final):
    df = spark.createDataFrame([("m", [float(v) for v in y])], "vip_main_no string, series array<double>")
    row = trend.adjust_slope(trend.member_slopes(df, 12)).first()
    assert (row.slope, row.intercept, row.slope_final) == (slope, intercept, final)


@settings(max_examples=8, deadline=None)
@given(st.integers(2, 13).flatmap(lambda n: st.lists(
    st.lists(st.integers(-1000, 100000), min_size=n, max_size=n), min_size=1, max_size=20)),
    st.integers(-500, 500), st.integers(1, 9))
def test_slopes_against_brute_force_and_equivariance(spark, series, shift, scale):
    n = len(series[0])
    data = []
    for i, y in enumerate(series):
        data += [(f"{i}", [float(v) for v in y]), (f"{i}+", [float(v + shift) for v in y]),
                 (f"{i}*", [float(v * scale) for v in y])]
    df = spark.createDataFrame(data, "vip_main_no string, series array<double>")
    got = {r.vip_main_no: (r.slope, r.intercept) for r in trend.member_slopes(df, n).collect()}
    for i, y in enumerate(series):
        slope, intercept = got[f"{i}"]
        assert got[f"{i}"] == pytest.approx(theil_sen(y), abs=1e-6)
        assert got[f"{i}+"] == pytest.approx((slope, intercept + shift), abs=1e-6)
        assert got[f"{i}*"] == pytest.approx((slope * scale, intercept * scale), abs=1e-5)


def test_one_point_has_no_line(spark):
    df = spark.createDataFrame([("m", [1.0])], "vip_main_no string, series array<double>")
    assert tuple(trend.member_slopes(df, 1).first())[1:] == (None, None)


def test_series_from_grid_and_direct_agree(spark, rows):
    monthly = monthly_frame(spark, {"a": [0, 5, 7] + [0] * 9, "b": [3] * 12, "c": [0] * 11 + [-4]})
    grid = clv.dense_monthly_grid(monthly, PERIOD.trend_months).repartition(5, "yyyymm")
    stepwise = trend.series_to_array(trend.cumulative_series(grid))
    assert rows(stepwise) == rows(trend.cumulative_arrays(monthly, PERIOD.trend_months))


def test_bucket_edges(spark):  # F15
    df = spark.createDataFrame([(1500.01,), (1500.0,), (740.0,), (739.99,), (None,)], "v double")
    assert [r[0] for r in df.select(bucket(F.col("v"), 1500, 740)).collect()] == ["H", "M", "M", "L", "L"]


def test_tenure_bands(spark):  # F20
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 2.0, 3.0, 4.0, 7.0, 8.0, None)], "v double")
    assert [r[0] for r in df.select(tenure_band(F.col("v"))).collect()] == [
        "0-1", "0-1", "1-3", "1-3", "3-7", "3-7", "8+", "8+"]


def expected_segment(c, t, p):
    engaged, emerging = 200, 100
    if c == "L":
        return "Low Value"
    if c is None:
        return ""
    if t == "L":
        return "At Risk"
    if p is None:
        return "At Risk" if (c, t) == ("M", "H") else ""
    if c == "H":
        return "Engaged" if p >= engaged else "Emerging" if p >= emerging else "At Risk"
    return "Emerging" if p > emerging else "At Risk"


def test_all_cells_of_the_rule_table(spark):  # F16
    cells = list(itertools.product(["L", "M", "H", None], ["L", "M", "H"], [50, 100, 150, 200, 250, None]))
    assert len(cells) == 72
    df = spark.createDataFrame(cells, "c string, t string, p int").withColumn(
        "s", segments.segment_rule(F.col("c"), F.col("t"), F.col("p"), 200, 100))
    assert {(r.c, r.t, r.p): r.s for r in df.collect()} == {cell: expected_segment(*cell) for cell in cells}


def test_reclassify(spark, rows):  # F17
    cases = [("a", "Emerging", "Engaged"), ("b", "At Risk", "Low Value"), ("c", "Emerging", None),
             ("d", "Engaged", "Low Value")]
    this = spark.createDataFrame([c[:2] for c in cases], "vip_main_no string, value_segment string")
    last = spark.createDataFrame([(m, s) for m, _, s in cases if s], "vip_main_no string, value_segment string")
    assert [r[1] for r in rows(segments.reclassify(this, last))] == ["At Risk", "Low Value", "Emerging", "Engaged"]


def test_customer_tag_precedence(spark, rows):  # F18
    total = spark.createDataFrame(
        [("a", "New Joiner", "Inactive P12"), ("b", "old member", "Inactive P24"), ("c", "old member", "active_in_p12m"),
         ("d", "old member", "active_in_p12m")], "vip_main_no string, new_joiner_flag string, inactive_flag string")
    seg = spark.createDataFrame([("c", Decimal(5), "Engaged"), ("b", Decimal(5), "Low Value")],
                                "vip_main_no string, p12m_clv decimal(10,0), value_segment string")
    assert rows(segments.customer_tag(total, seg), "vip_main_no", "customer_tag") == [
        ("a", "New Joiner"), ("b", "Inactive P24"), ("c", "Engaged"), ("d", None)]


def test_years_compared_and_matrix_sums(spark):
    this = spark.createDataFrame([("a", "Engaged"), ("b", "At Risk"), ("c", None)], "vip_main_no string, customer_tag string")
    last = spark.createDataFrame([("a", "Emerging"), ("b", None)], "vip_main_no string, customer_tag string")
    compared = segments.compare_years(this, last)
    assert {r.vip_main_no: r.customer_tag_last_year for r in compared.collect()} == {
        "a": "Emerging", "b": "Inactive P24", "c": "Inactive P24"}
    matrix = {r[0]: r.asDict() for r in segments.migration_matrix(compared).collect()}
    assert matrix["Emerging"]["Engaged"] == 1 and matrix["Inactive P24"]["At Risk"] == 1
    assert matrix["Inactive P24"]["Engaged"] is None


def transactions(spark, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(str(m) if m else None, date(2020, 10, 1).fromordinal(date(2020, 10, 1).toordinal() + int(d)),
             str(i), "HK" if m % 2 else "TW", Decimal(int(a)))
            for i, (m, d, a) in enumerate(zip(rng.integers(0, 60, 900), rng.integers(0, 1095, 900),
                                              rng.integers(-20, 200, 900)))]
    return spark.createDataFrame(rows, "vip_main_no string, order_date date, invoice_no string, region_key string, "
                                       "net_amt_hkd decimal(10,0)")


@pytest.mark.parametrize("region", [None, "TW"])
def test_one_pass_equals_the_chain_of_operators(spark, rows, region):
    tx = transactions(spark)
    firsts = tx.groupBy("vip_main_no").agg(F.date_add(F.min("order_date"), -400).alias("first_transaction_date"))
    first_last = mart.first_last(tx, firsts)
    monthly = clv.monthly_revenue(tx, region)
    total = clv.total_clv(clv.member_status(first_last, PERIOD), monthly)
    recent = clv.p12m_clv(total, monthly, PERIOD)
    slopes = trend.spend_trend(monthly, PERIOD.trend_months, recent, CUTS.slope_high, CUTS.slope_low)
    chain = segments.value_segment(slopes, segments.clv_bucket(total, CUTS.clv_high, CUTS.clv_low), recent, CUTS)
    values = plan.member_values(tx, first_last, PERIOD, CUTS, region)
    assert rows(plan.segments_of(values)) == rows(chain) and chain.count() > 20
    cols = total.columns
    assert rows(plan.totals_of(values), *cols) == rows(total, *cols)
    tags = segments.customer_tag(total, chain)
    assert rows(plan.tags_of(values), "vip_main_no", "customer_tag") == rows(tags, "vip_main_no", "customer_tag")


def test_calibration_cutoffs(spark):
    df = spark.range(1, 101).selectExpr("CAST(id AS double) AS v")
    got = {r.prob: r.cutoff for r in segments.calibrate(df, ["v"], [0.7, 0.9]).collect()}
    assert got == {0.7: 70.0, 0.9: 90.0}


def test_lines_of_series_of_any_length(spark):
    import numpy as np
    from clientele.operators import trend
    rng = np.random.default_rng(8)
    series = [rng.normal(size=n).cumsum().tolist() for n in (2, 3, 12, 36, 37)] + [[5.0], [], [0.0] * 36]
    got = trend.series_lines(spark.createDataFrame([(str(i), s) for i, s in enumerate(series)], "vip_main_no string, series array<double>"))
    for row in got.collect():
        y = series[int(row.vip_main_no)]
        if len(y) < 2:
            assert row.slope is None and row.intercept is None
            continue
        slope = np.median([(y[j] - y[i]) / (j - i) for i in range(len(y)) for j in range(i + 1, len(y))])
        assert row.slope == pytest.approx(slope) and row.intercept == pytest.approx(np.median(y) - slope * (len(y) - 1) / 2)


def test_long_series_equal_the_wide_ones_and_their_plan_does_not_grow(spark, rows):
    from clientele.config import month_range
    from clientele.operators import trend
    monthly = spark.createDataFrame([(m, y, Decimal(n)) for m, y, n in (
        ("a", "202001", 5), ("a", "202003", -2), ("b", "201912", 9), ("c", "202002", 1), (None, "202002", 4))],
                                    "vip_main_no string, yyyymm string, rev decimal(18,2)")
    months = month_range(date(2020, 1, 1), date(2020, 4, 30))
    assert rows(trend.long_series(monthly, months)) == rows(trend.cumulative_arrays(monthly, months))
    size = lambda n: len(trend.series_lines(trend.long_series(monthly, month_range(date(2020, 1, 1), date(2020 + n, 12, 31))))
                         ._jdf.queryExecution().optimizedPlan().toString())
    assert size(9) < size(0) + 2000


def test_long_lines_are_fitted_in_parts_of_bounded_size(spark, rows, monkeypatch):
    sizes, lines = [], trend._lines
    series = [[float((7 * i * j) % 11) for j in range(n)] for i in range(20) for n in (0, 1, 2, 9)] + [None]
    table = spark.createDataFrame([(str(i), s) for i, s in enumerate(series)], "vip_main_no string, series array<double>")
    whole = rows(trend.series_lines(table))
    monkeypatch.setattr(trend, "SLOPES", 50)
    assert rows(trend.series_lines(table)) == whole and len(whole) == len(series)
    nine = np.array([s for s in series if s and len(s) == 9])
    for y, slope, intercept in zip(nine, *lines(nine), strict=True):
        every = [(b - a) / (j - i) for i, a in enumerate(y) for j, b in enumerate(y) if i < j]
        assert slope == np.median(every) and intercept == np.median(y) - slope * 4.0
