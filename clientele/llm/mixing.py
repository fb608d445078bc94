"""Mixing sources to target weights by repeating documents.

A source's rate is its target over its size. Each document is emitted floor(rate)
times, and once more with a probability equal to the fraction, decided by a hash of
the document and a seed. One of a fixed list of seeds is taken per source: the one whose
total comes nearest to the target, all of them summed in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientele.llm.common import column, packed, unpacked, word_count
from clientele.sources.staging import staged

PRIME = 2_147_483_647
SEEDS = 32
MULTIPLIERS = tuple(pow(48_271, k + 1, PRIME) for k in range(SEEDS))

WEIGHTS = (3, 1, 2)
BUDGET_PERCENT = 150
MOST_REPEATS = 2


def _draw(df: DataFrame, id_col: str, text_col: str) -> Column:
    """A number below PRIME from id and text."""
    name = F.concat_ws("|", column(df, id_col).cast("string"),
                       F.md5(F.coalesce(column(df, text_col), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long") % PRIME


def _extra(draw: Column, multiplier: Column, fraction: Column) -> Column:
    return (draw * multiplier % PRIME < fraction * PRIME).cast("long")


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   source_col: str = "source") -> DataFrame:
    return docs.select(column(docs, id_col).alias("doc_id"), column(docs, source_col).alias("source"),
                       word_count(column(docs, text_col)).alias("size"), _draw(docs, id_col, text_col).alias("draw"))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget_percent: int = BUDGET_PERCENT,
            most_repeats: int = MOST_REPEATS) -> DataFrame:
    """Per source: size and target.

    Sources in order of code points, NULL last, get the weights in turn and share
    ``budget_percent`` of all sizes. A target stops at ``most_repeats`` times the size; the
    excess goes to the others by weight. That is one level, found from running sums in
    order of cap per weight: a source below the level gets its cap, others weight times
    level. The windows run over one row per source.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), turn % len(weights) + 1)
    cap = most_repeats * F.col("source_size")
    order = [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest)
    return (total.withColumns({"weight": weight, "cap": cap})
            .withColumn("budget", F.sum("source_size").over(every) * budget_percent / 100)
            .withColumn("level", level)
            .withColumn("level", F.coalesce(
                F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(every),
                F.max("level").over(every)))
            .select("source", "source_size",
                    F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target")))


def plan(sizes: DataFrame, **options) -> DataFrame:
    """Per source: size, target, whole copies, fraction and the multiplier of its seed."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = staged(targets(sizes, **options).withColumn("rate", rate)
                  .withColumns({"whole": F.floor("rate"), "fraction": F.col("rate") - F.floor("rate")}))
    far = [F.abs(F.sum(F.col("size") * (F.col("whole") + _extra(F.col("draw"), F.lit(m), F.col("fraction"))))
                 - F.max("target")) for m in MULTIPLIERS]
    tried = (sizes.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
             .groupBy("s").agg(*[f.alias(f"far_{k}") for k, f in enumerate(far)]))
    nearest = F.array_min(F.array(*[F.struct(F.col(f"far_{k}").alias("far"), F.lit(k).alias("seed"), F.lit(m).cast("long").alias("multiplier"))
                                    for k, m in enumerate(MULTIPLIERS)]))
    return staged(goal.join(tried.select("s", nearest.getField("multiplier").alias("multiplier")),
                            F.col("source").eqNullSafe(F.col("s"))).drop("s"))


def _copies() -> Column:
    return F.col("whole") + _extra(F.col("draw"), F.col("multiplier"), F.col("fraction"))


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               **options) -> DataFrame:
    """Per document: size, its source's size and target, copies and words taken.

    NULL texts have size 0; NULL source is a source; rows equal in id and text are
    decided alike; an empty table gives an empty result.
    """
    sizes = staged(document_sizes(docs, id_col, text_col, source_col))
    goal = plan(sizes, **options).withColumnRenamed("source", "s")
    return (sizes.join(goal, F.col("source").eqNullSafe(F.col("s")))
            .select("doc_id", "source", "size", "source_size", "target", _copies().alias("copies"),
                    (F.col("size") * _copies()).cast("long").alias("taken")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, columns as they were."""
    sizes = staged(document_sizes(docs, id_col, text_col, source_col))
    goal = plan(sizes, **options).withColumnRenamed("source", "s")
    rows = packed(docs, column(docs, source_col).alias("source"), _draw(docs, id_col, text_col).alias("draw"))
    taken = (rows.join(goal, F.col("source").eqNullSafe(F.col("s")))
             .withColumn("copy", F.explode(F.when(_copies() > 0, F.sequence(F.lit(1).cast("long"), _copies()))
                                           .otherwise(F.array().cast("array<bigint>")))))
    return unpacked(taken, docs.columns)
