"""Registered queries beside their DuckDB equivalents on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as contract
from verify import queries as membership
from verify.compare import canonical

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


# One of each kind here; ``python -m verify.compare`` runs all of them.
SAMPLE = (
    "dedup_sales", "latest_per_key", "channel_union_second_brand", "first_last", "demographics", "month_calendar",
    "monthly_revenue_region", "cumulative_spend", "theil_sen", "member_status", "total_clv",
    "value_segment_one_pass", "calibrate", "reclassify", "migration_matrix", "tagged_sales", "percent_pivot",
    "age_profile", "sales_kpis", "visits", "category_pivot", "month_penetration", "demographic_features",
    "channel_union_one_brand", "demographics_second_brand", "first_last_given", "mart_first_last_sink", "kmeans_fit", "kmeans_steps", "saved_model_scoring",
    "one_pass_moments", "factor_weights", "persona_members",
    "feature_correlation", "stored_scaler", "feature_matrix", "standardize", "nearest_centroid", "contact_list", "persona_counts", "column_share",
)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(SF):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    return connection


def test_flagship(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and "value_segment" in df.columns


def test_every_query_has_an_oracle():
    assert set(membership.QUERIES) <= set(ORACLES)
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = Counter(tuple(canonical(r[c]) for c in cols) for r in df.collect())
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert mine == Counter(tuple(canonical(r[i]) for i in order) for r in result.fetchall())


@pytest.mark.parametrize("name", ["latest_per_key", "channel_union_second_brand", "tagged_sales", "sales_kpis",
                                  "tagged_members", "tag_sales"])
def test_same_rows_when_every_key_is_split(spark, duck, name, monkeypatch):
    from clientele.operators import skew
    monkeypatch.setattr(skew, "TASK_ROWS", 20)
    monkeypatch.setattr(skew, "BROADCAST_ROWS", -1)
    test_same_rows(spark, duck, name)
