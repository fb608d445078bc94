"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.sources.staging import staged


def _edges(df: DataFrame) -> DataFrame:
    return (df.select(F.least("v", "u").alias("u"), F.greatest("v", "u").alias("v"))
            .filter(F.col("u") < F.col("v")).distinct())


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """From undirected ``links(u, v)``: each linked ``id`` with the smallest id it reaches.

    Neighbours are never collected: each round needs the least neighbour of a node only,
    which is aggregated before the shuffle. Ends when the edges are stars.
    """
    edges = staged(_edges(links))
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = _edges(both.filter(F.col("u") > F.col("v")).join(least, "v")
                       .select("u", F.col("m").alias("v")))
        large = staged(large)
        lower = large.groupBy("v").agg(F.min("u").alias("m"))
        small = _edges(large.join(lower, "v").select("u", F.col("m").alias("v"))
                       .unionByName(lower.select(F.col("v").alias("u"), F.col("m").alias("v"))))
        edges = staged(small)
        before, state = state, _state(edges)
        if state == before:
            break
    root = edges.select(F.col("u").alias("id")).distinct().withColumn("component", F.col("id"))
    return edges.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(root)
