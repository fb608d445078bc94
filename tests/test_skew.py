from collections import Counter

import pytest

from clientele.operators.skew import heavy_keys, lookup_join, spread_join


@pytest.fixture
def sides(spark):
    """A third of the facts under one key, some under none, and keys only one side has."""
    facts = [("hot", i) for i in range(400)] + [(None, i) for i in range(50)]
    facts += [(f"k{i % 200}", 1000 + i) for i in range(800)]
    dims = [("hot", "h1"), ("hot", "h2"), ("idle", "x"), (None, "n")] + [(f"k{i}", f"d{i}") for i in range(150)]
    return (spark.createDataFrame(facts, "k string, v int").repartition(7),
            spark.createDataFrame(dims, "k string, d string"))


@pytest.mark.parametrize("task_rows", [1, 100, 10_000])
@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_same_rows_as_a_plain_join(sides, how, task_rows):
    facts, dims = sides
    got = spread_join(facts, dims, "k", how, task_rows=task_rows)
    want = facts.join(dims, "k", how)
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


@pytest.mark.parametrize("task_rows", [1, 100, 10_000])
def test_keeping_dims_is_a_right_join(sides, task_rows):
    facts, dims = sides
    got = spread_join(facts, dims, "k", "keep_dims", task_rows=task_rows)
    want = dims.join(facts, "k", "left")
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(map(tuple, want.collect()))


def test_heavy_keys_are_those_over_the_budget_of_a_task(sides):
    facts, _ = sides
    assert [tuple(r) for r in heavy_keys(facts, ["k"], task_rows=100).collect()] == [("hot", 4)]
    assert heavy_keys(facts, ["k"], task_rows=10_000) is None


def test_the_list_of_heavy_keys_stays_short(sides, monkeypatch):
    from clientele.operators import skew
    facts, _ = sides
    monkeypatch.setattr(skew, "HEAVY_KEYS", 5)  # 1200 rows with a key: a budget of 240
    assert [tuple(r) for r in heavy_keys(facts, ["k"], task_rows=3).collect()] == [("hot", 2)]


def test_counting_reads_its_input_once(spark):
    scans = spark.sparkContext.accumulator(0)
    facts = spark.range(100).selectExpr("id % 3 AS k", "id")
    counted = facts.rdd.map(lambda r: (scans.add(1), r)[1]).toDF(facts.schema)
    assert heavy_keys(counted, ["k"], task_rows=10).count() == 3
    assert scans.value == 100


@pytest.mark.parametrize("summary, sent", [(1 << 18, 1 << 11), (40, 1 << 11), (1 << 18, 30), (10, 5), (2, 1)])
def test_summaries_that_lose_counts_still_find_every_heavy_key(sides, monkeypatch, summary, sent):
    from clientele.operators import skew
    monkeypatch.setattr(skew, "SUMMARY", summary)
    monkeypatch.setattr(skew, "SENT", sent)
    facts, _ = sides
    for task_rows in (3, 100):
        want = Counter({k: -(-n // task_rows) for k, n in Counter(r.k for r in facts.collect() if r.k).items() if n > task_rows})
        assert Counter(dict(map(tuple, heavy_keys(facts, ["k"], task_rows=task_rows).collect()))) == want


def test_keys_are_not_grouped_as_a_whole(sides):
    from clientele.operators import skew
    facts, _ = sides
    rows = skew._summaries(facts.filter("k is not null"), ["k"])
    assert "HashAggregate" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.filter("_hash is null").agg({"_all": "sum"}).first()[0] == 1200
    assert heavy_keys(facts.limit(0), ["k"], task_rows=1) is None


def test_unique_keys_are_not_counted(sides, monkeypatch):
    from clientele.operators import skew
    facts, dims = sides
    monkeypatch.setattr(skew, "heavy_keys", lambda *a: pytest.fail("counted"))
    assert spread_join(dims, facts, "k", "inner", unique=True).count() == facts.join(dims, "k").count()


def test_heavy_rows_are_spread_over_tasks(spark):
    facts = spark.range(4000).selectExpr("'hot' AS k", "id AS v")
    dims = spark.createDataFrame([("hot", 1)], "k string, d int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        joined = spread_join(facts, dims, "k", "inner", task_rows=60)
        sizes = joined.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 4000 and max(sizes) < 2000


def test_lookups_beyond_the_broadcast_size_give_the_same(sides):
    facts, dims = sides
    want = Counter(map(tuple, facts.join(dims, "k", "left").collect()))
    for limit in (10, 1000):
        assert Counter(map(tuple, lookup_join(facts, dims, "k", max_rows=limit).collect())) == want


def test_wrong_use_is_refused(sides):
    facts, dims = sides
    with pytest.raises(ValueError):
        spread_join(facts, dims, "k", "full")
    with pytest.raises(ValueError):
        spread_join(facts, dims, "k", "keep_dims", profile=facts)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_a_second_pass_is_spared_where_no_key_can_be_heavy(spark, monkeypatch):
    from clientele.operators import skew
    monkeypatch.setattr(skew, "SENT", 3)
    scans = spark.sparkContext.accumulator(0)
    facts = spark.range(100).selectExpr("id % 50 AS k", "id")
    counted = facts.rdd.map(lambda r: (scans.add(1), r)[1]).toDF(facts.schema)
    assert heavy_keys(counted, ["k"], task_rows=40) is None
    assert scans.value == 100


@pytest.mark.parametrize("places", [1, 100, 1 << 26])
def test_keys_are_dropped_as_by_an_anti_join(sides, places):
    from clientele.operators.skew import drop_keys
    facts, dims = sides
    for gone in (dims.select("k"), dims.select("k").limit(0)):
        got = drop_keys(facts, gone, "k", places=places)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, facts.join(gone, "k", "left_anti").collect()))


def test_only_rows_that_a_bit_map_cannot_rule_out_move(sides, monkeypatch):
    from clientele.operators import skew
    facts, dims = sides
    moved = []
    inner = skew.spread_join
    monkeypatch.setattr(skew, "spread_join", lambda f, *a, **o: moved.append(f.count()) or inner(f, *a, **o))
    assert skew.drop_keys(facts, dims.select("k").filter("k = 'k7'"), "k").count() == 1246
    assert moved == [4]


@pytest.mark.parametrize("task_rows", [1, 100, 10_000])
@pytest.mark.parametrize("max_rows", [10, 1000])
def test_distinct_rows_with_their_lookup(sides, task_rows, max_rows):
    from clientele.operators.skew import distinct_lookup_join
    facts, dims = sides
    got = distinct_lookup_join(facts.union(facts), dims, "k", max_rows=max_rows, task_rows=task_rows)
    want = facts.join(dims, "k", "left")
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_distinct_rows_move_once(spark, sides):
    from clientele.operators.skew import distinct_lookup_join
    facts, dims = sides
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert exchanges(distinct_lookup_join(facts, dims, "k", max_rows=10)) == 2
        assert exchanges(spread_join(facts.distinct(), dims, "k")) == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_narrow_lookup_may_have_more_rows(spark, sides, monkeypatch):
    from clientele.operators import skew
    facts, dims = sides
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 40)
    wide = dims.select("*", *[dims.d.alias(f"d{i}") for i in range(10)])
    for lookup, whole in ((dims, True), (wide, False)):
        plan = lookup_join(facts, lookup, "k")._jdf.queryExecution().optimizedPlan().toString()
        assert ("strategy=broadcast" in plan) == whole


def test_rows_without_a_key_are_spread_where_no_key_is_heavy(spark):
    facts = spark.range(4000).selectExpr("cast(null AS string) AS k", "id AS v")
    dims = spark.createDataFrame([("a", 1)], "k string, d int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        sizes = spread_join(facts, dims, "k").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 4000 and max(sizes) < 2000
