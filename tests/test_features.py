from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from clientele.config import WalletSpec
from clientele.operators import features, kmeans, personas
from clientele.operators.moments import factors, moments

TX = ("vip_main_no string, prod_brand string, item_subcat_desc string, maincat_desc string, line string, "
      "net_amt_hkd int, sold_qty int, invoice_no string")


@pytest.fixture
def tx(spark):
    return spark.createDataFrame(
        [("m", "BA", "A", "X", "L1", 30, 1, "i1"), ("m", "BA", "B", "X", "L2", 70, 2, "i1"),
         ("n", "BA", "A", "Y", "L1", 5, 1, "i2"), ("n", "BA", "B", "Y", None, -5, 1, "i3")], TX)


def test_share_of_wallet(tx):  # F25
    out = features.share_of_wallet(tx, "item_subcat_desc", ["A", "B"], "_s")
    assert {r.vip_main_no: (r.A_s, r.B_s) for r in out.collect()} == {"m": (30.0, 70.0), "n": (None, None)}


def test_shares_are_of_the_whole_spend(tx):
    spec = WalletSpec("line", "_l", {"One": ("L1",), "Both": ("L1", "L2"), "Gone": ("L9",)})
    row = features.wallet_features(tx.filter("vip_main_no = 'm'"), [spec]).first()
    assert (row.One_l, row.Both_l, row.Gone_l) == (30.0, 100.0, 0.0)
    single = features.share_of_wallet(tx.filter("vip_main_no = 'm'"), "line", ["L1", "L2", "L9"], "_l")
    assert features.group_features(single, spec).first().Both_l == 100.0


def test_input_filter(spark, tx):
    bad = [("", "BA", "A", "X"), (None, "BA", "A", "X"), ("m", "ZZ", "A", "X"), ("m", None, "A", "X"),
           ("m", "BA", None, "X"), ("m", "BA", "dummy", "X"), ("m", "BA", "A", "ZZZ"), ("m", "BA", "A", None)]
    extra = spark.createDataFrame([(*b, "L", 1, 1, "i") for b in bad], TX)
    assert features.clean_for_features(tx.union(extra)).count() == 4


def test_totals_and_lists(tx):
    totals = {r.vip_main_no: tuple(r)[1:] for r in features.member_totals(tx).collect()}
    assert totals["m"] == (100, 3, 1) and totals["n"] == (0, 2, 2)
    assert features.sum_by_member(tx, "sold_qty").count() == 2
    assert {r.vip_main_no: r.invoice_no for r in features.count_by_member(tx, "invoice_no").collect()} == {"m": 1, "n": 2}
    lists = {r.vip_main_no: [tuple(x) for x in r.maincat_desc]
             for r in features.collect_by_member(tx, "maincat_desc").collect()}
    assert lists == {"m": [("X", 2)], "n": [("Y", 2)]}


def test_demographic_features(spark):
    tx = spark.createDataFrame(
        [("m", "M", "Macau", "01"), ("m", "", "Korean", "05"), ("m", "M", None, "07"), ("n", "F", None, "07")],
        "vip_main_no string, customer_sex string, cust_nat_cat string, customer_age_group string")
    firsts = spark.createDataFrame([("m", date(2021, 1, 1))], "vip_main_no string, first_transaction_date date")
    got = {r.vip_main_no: tuple(r)[1:] for r in features.demographic_features(tx, firsts, date(2023, 1, 1)).collect()}
    assert got == {"m": ("C", "Macau", "1-3", "41 - 50"), "n": ("F", "Others", "8+", None)}  # F21


def test_assembly(spark):
    a = spark.createDataFrame([("m", 1.0), ("n", 2.0)], "vip_main_no string, a double")
    b = spark.createDataFrame([("m", None), ("o", 2.0)], "vip_main_no string, b double")
    tagging = spark.createDataFrame([("z", 1.0)], "vip_main_no string, t double")
    assert [tuple(r) for r in features.assemble_features([a, b], tagging).collect()] == [("m", 1.0, 0.0, 0.0)]


def test_zero_columns_and_outliers(spark):
    df = spark.createDataFrame([("m", 0.0, 0.0, 1.0), ("n", 0.0, 5.0, 1.0)],
                               "vip_main_no string, gone double, half double, `full one` double")
    assert {r.feature: r.zero_share for r in features.zero_shares(df, ["gone", "half", "full one"]).collect()} == {
        "gone": 1.0, "half": 0.5, "full one": 0.0}
    assert features.drop_zero_columns(df).columns == ["vip_main_no", "half", "full one"]
    assert features.drop_zero_columns(df, 0.5, ["full one"]).columns == ["vip_main_no"]
    assert features.exclude_members(df, ["m"]).count() == 1


def test_standardize(spark):  # F26
    df = spark.createDataFrame([("a", 1.0, 7.0), ("b", 2.0, 7.0), ("c", 3.0, 7.0)],
                               "vip_main_no string, `x y` double, k double")
    out = features.standardize(df, ["x y", "k"]).orderBy("vip_main_no").collect()
    assert [r["x y"] for r in out] == pytest.approx([-1.224745, 0, 1.224745], abs=1e-6)
    assert [r.k for r in out] == [0, 0, 0]


def test_training_scale_is_reused(spark):
    train = spark.createDataFrame([("a", 0.0), ("b", 10.0)], "vip_main_no string, x double")
    new = spark.createDataFrame([("c", 20.0)], "vip_main_no string, x double")
    scaler = features.fit_scaler(train, ["x"])
    assert features.standardize(new, ["x"], scaler).first().x == 3.0
    assert features.standardize(new, ["x"]).first().x == 0.0


def em_loadings(cov, k, steps=20000):
    """Textbook EM for factor analysis, as an independent optimiser."""
    d = len(cov)
    rng = np.random.default_rng(0)
    load, psi = rng.normal(size=(d, k)), np.ones(d)
    for _ in range(steps):
        inv = np.linalg.inv(load @ load.T + np.diag(psi))
        beta = load.T @ inv
        second = np.eye(k) - beta @ load + beta @ cov @ beta.T
        load = cov @ beta.T @ np.linalg.inv(second)
        psi = np.maximum(np.diag(cov - load @ beta @ cov), 1e-9)
    return load, psi


def test_factor_loadings_reach_the_likelihood_of_plain_em():
    rng = np.random.default_rng(3)
    data = rng.normal(size=(4000, 2)) @ rng.normal(size=(2, 6)) + rng.normal(size=(4000, 6))
    cov = np.corrcoef(data.T)

    def loss(load, psi):
        model = load @ load.T + np.diag(psi)
        return np.linalg.slogdet(model)[1] + np.trace(np.linalg.solve(model, cov))

    ours, theirs = factors(cov, 2), em_loadings(cov, 2, 4000)
    assert loss(ours.loadings, ours.noise) == pytest.approx(loss(*theirs), abs=1e-6)
    assert ours.communality + ours.noise == pytest.approx(np.ones(6))
    inner = (ours.loadings / ours.noise[:, None]).T @ ours.loadings
    assert np.abs(inner - np.diag(np.diag(inner))).max() < 1e-6 and inner[0, 0] >= inner[1, 1]


def test_as_many_factors_as_features_give_back_every_correlation():
    cov = np.corrcoef(np.random.default_rng(4).normal(size=(5, 60)) + np.linspace(0, 1, 60))
    with_constant = np.zeros((6, 6))
    with_constant[:5, :5] = cov
    found = factors(with_constant, 10)
    assert np.abs(found.implied - with_constant).max() < 1e-3
    assert found.weights[5] == 0 and found.noise[5] == 0
    assert factors(np.zeros((2, 2)), 3).weights.tolist() == [0, 0]


def test_moments_of_parts_add_up_and_equal_numpy(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(500, 3)) * [1, 50, 0] + [1e6, 0, 7]
    data[::3, 1] = 0
    df = spark.createDataFrame(data.tolist(), "a double, `b c` double, d double").repartition(7)
    got = moments(df, ["a", "b c", "d"])
    assert got.n == 500 and got.zero_shares["b c"] == (data[:, 1] == 0).mean()
    assert got.means == pytest.approx(data.mean(0)) and got.deviations == pytest.approx(data.std(0), rel=1e-6, abs=1e-9)
    assert got.correlation[0, 1] == pytest.approx(np.corrcoef(data[:, 0], data[:, 1])[0, 1], abs=1e-9)
    assert got.deviations[2] == 0 and got.correlation[2].tolist() == [0, 0, 0]
    assert (got + got).means == pytest.approx(got.means) and got.only(["d", "a"]).cols == ("d", "a")
    scaled = features.standardize(df.withColumn("vip_main_no", F.lit("m")), ["a", "b c"], got.scaler(df))
    assert moments(scaled, ["a", "b c"]).deviations == pytest.approx([1, 1])
    odd = moments(spark.createDataFrame([(None, float("nan")), (2.0, 4.0)], "x double, y double"), ["x", "y"])
    assert odd.means.tolist() == [1, 2] and odd.zeros.tolist() == [1, 1]
    assert moments(df.limit(0), ["a"]).n == 0


@pytest.fixture
def clustered(spark):
    rng = np.random.default_rng(1)
    points = [(f"{c}-{i}", float(c * 50 + rng.normal()), float(c * -30 + rng.normal()), 1.0)
              for c in range(3) for i in range(30)]
    return spark.createDataFrame(points, "vip_main_no string, x double, y double, k double")


def test_factor_selection_orders(clustered):
    scaled = features.standardize(clustered, ["x", "y", "k"])
    smallest = personas.factor_select(scaled, ["x", "y", "k"], n_factors=1, n_keep=2)
    assert smallest[0] == "k" and len(smallest) == 2
    assert "k" not in personas.factor_select(scaled, ["x", "y", "k"], 1, 2, ascending=False)


def test_clusters(clustered):
    cols = ["x", "y"]
    costs = {r.k: r.wcss for r in personas.kmeans_sweep(clustered, cols, [1, 2, 3], n_init=2).collect()}
    assert costs[1] > costs[2] > costs[3]
    xy = np.array([(r.x, r.y) for r in clustered.collect()])
    assert costs[1] == pytest.approx(((xy - xy.mean(0)) ** 2).sum())
    model = personas.kmeans_fit(clustered, cols, 3, n_init=2)
    found = personas.kmeans_predict(clustered, cols, model)
    groups = {}
    for r in found.collect():
        groups.setdefault(r.vip_main_no.split("-")[0], set()).add(r.persona)
    assert all(len(ids) == 1 for ids in groups.values()) and len(set.union(*groups.values())) == 3
    assert sorted(r.members for r in personas.persona_sizes(found).collect()) == [30, 30, 30]
    again = personas.nearest_centroid(clustered, cols, model.centres.tolist())
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, found.collect()))


def plain_lloyd(x, centres):
    """One model to its end."""
    while True:
        own = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        new = np.array([x[own == i].mean(0) if (own == i).any() else c for i, c in enumerate(centres)])
        if np.allclose(new, centres, atol=1e-12):
            return centres, ((x - centres[own]) ** 2).sum()
        centres = new


def test_all_models_advance_together_as_each_does_alone(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 3)) + rng.integers(0, 4, (300, 1)) * 3
    points = spark.createDataFrame(x.tolist(), "a double, b double, c double").repartition(5)
    starts = [x[:2], x[5:8], x[10:17], np.array([[99.0] * 3, *x[:1]])]
    passes, summed = [], kmeans._summed
    monkeypatch.setattr(kmeans, "_summed", lambda p, models: passes.append(len(models)) or summed(p, models))
    found = kmeans.lloyd(points, starts, tolerance=0.0)
    for start, model in zip(starts, found, strict=True):
        centres, cost = plain_lloyd(x, start)
        assert model.settled and model.centres == pytest.approx(centres) and model.cost == pytest.approx(cost)
    assert len(passes) == max(m.rounds for m in found) + 1 and passes[0] == 4 and passes[-1] >= 1
    assert found[3].centres[0].tolist() == [99.0] * 3  # never anyone's nearest
    stopped = kmeans.lloyd(points, starts[:1], max_rounds=1, tolerance=0.0)[0]
    assert not stopped.settled or stopped.rounds <= 1


def test_a_sweep_takes_few_passes_and_its_costs_are_true(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 4)) + rng.integers(0, 5, (400, 1)) * 2
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double, d double")
    passes = []
    for name in ("_summed", "_drawn"):
        inner = getattr(kmeans, name)
        monkeypatch.setattr(kmeans, name, lambda *a, inner=inner: passes.append(1) or inner(*a))
    found = kmeans.fit(df, ["a", "b", "c", "d"], range(1, 9), n_init=4)
    assert len(passes) <= 60
    for model in found.values():
        assert model.cost == pytest.approx(((x[:, None] - model.centres) ** 2).sum(2).min(1).sum())
        assert model.settled
    assert found[1].cost == pytest.approx(((x - x.mean(0)) ** 2).sum()) and found[8].cost < found[2].cost
    stated = df.agg(F.sum(personas.least_squares(["a", "b", "c", "d"], found[5].centres))).first()[0]
    assert stated == pytest.approx(found[5].cost)


def test_more_clusters_than_distinct_members(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (4.0,), (None,)], "x double")
    model = kmeans.fit(df, ["x"], [5], n_init=2)[5]
    assert model.cost == 0 and len(model.centres) == 5
    with pytest.raises(ValueError):
        kmeans.fit(df.limit(0), ["x"], [2], n_init=1)


def test_names(spark):
    df = spark.createDataFrame([("m", 0), ("n", 4), ("o", 9)], "vip_main_no string, persona int")
    assert [r.persona for r in personas.name_personas(df).orderBy("vip_main_no").collect()] == [
        "Haircare Enthusiasts", "Skincare Enthusiasts", None]


def test_costs_are_measured_once_and_sums_are_those_of_the_nearest(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 4, size=(3000, 3)).astype(float)
    points = spark.createDataFrame(x.tolist(), "a double, b double, c double").repartition(3)
    models = [x[:3], x[5:6], x[10:27], x[:3], np.array([[1.0] * 3, [1.0] * 3])]
    for centres, sums in zip(models, kmeans._summed(points, models), strict=True):
        own = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        for c in range(len(centres)):
            assert sums.members[c] == (own == c).sum() and sums.coordinates[c] == pytest.approx(x[own == c].sum(0))
            assert sums.norms[c] == pytest.approx((x[own == c] ** 2).sum())
    measured, costs = [], kmeans._costs
    monkeypatch.setattr(kmeans, "_costs", lambda p, models: measured.append(len(models)) or costs(p, models))
    assert [m.k for m in kmeans.lloyd(points, models)] == [len(m) for m in models] and measured == [5]


def test_feature_tables_come_from_one_reduction_of_the_lines(spark, monkeypatch):
    from verify.queries import QUERIES
    calls, plain = [], features.wallet_features
    monkeypatch.setattr(features, "wallet_features", lambda lines, specs: calls.append(specs) or plain(lines, specs))
    assert QUERIES["feature_sink"](spark, "/root/testdata/sf0.001").count() and len(calls) == 1
