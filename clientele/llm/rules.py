"""Quality classifier: a sparse rule ensemble compiled to column expressions.

Small trees are grown on statistics of labelled texts; every path from a root to a node is
a rule, a conjunction of comparisons. A lasso logistic regression weighs the rules, most
get no weight, and the others become one Spark expression that scores any text.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.llm.common import SPACE_CHARS, column, row_key, words
from clientele.sources.staging import staged

FEATURES = ("n_words", "word_length", "symbol_rate", "upper_rate", "digit_rate", "bang_rate", "stop_rate", "distinct_rate",
            "non_ascii_rate", "dup_line_rate", "words_per_line", "longest_word")
# At most so many labelled rows are fitted, those of the smallest hashes.
SAMPLE = 20_000
TREES, DEPTH = 24, 3
PENALTY = 0.002
LEAST_WEIGHT = 1e-6

Rule = tuple[tuple[int, str, float], ...]


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics of every whole text, all numbers; 0 for NULL and empty texts."""
    text = F.coalesce(column(docs, text_col), F.lit(""))
    base = docs.select(row_key(docs, id_col, text_col).alias("key"), column(docs, id_col).alias("doc_id"), text.alias("text"), words(text).alias("words"),
                       F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACE_CHARS)) != "").alias("lines"))
    only = lambda kept: F.length(F.regexp_replace("text", kept, ""))
    counted = base.select(
        "key", "doc_id", F.size("words").alias("w"), F.size(F.array_distinct("words")).alias("d"), F.length(F.array_join("words", "")).alias("c"),
        F.size("lines").alias("l"), F.size(F.array_distinct("lines")).alias("dl"),
        only(r"[^#*$%&|<>]+").alias("symbols"), only("[^A-Z]+").alias("upper"), only("[^0-9]+").alias("digits"),
        only("[^!?]+").alias("bangs"), only("[^.,;:]+").alias("stops"), only(r"[\x00-\x7F]+").alias("wide"),
        F.coalesce(F.array_max(F.transform("words", F.length)), F.lit(0)).alias("longest"))
    share = lambda part, whole: F.when(F.col(whole) > 0, part / F.col(whole)).otherwise(0.0)
    return counted.select(
        "key", "doc_id", F.col("w").cast("double").alias("n_words"), share(F.col("c"), "w").alias("word_length"),
        share(F.col("symbols"), "w").alias("symbol_rate"), share(F.col("upper"), "c").alias("upper_rate"),
        share(F.col("digits"), "c").alias("digit_rate"), share(F.col("bangs"), "w").alias("bang_rate"),
        share(F.col("stops"), "w").alias("stop_rate"), share(F.col("d"), "w").alias("distinct_rate"),
        share(F.col("wide"), "c").alias("non_ascii_rate"), share(F.col("l") - F.col("dl"), "l").alias("dup_line_rate"),
        share(F.col("w"), "l").alias("words_per_line"), F.col("longest").cast("double").alias("longest_word"))


def tree_rules(description: str) -> set[Rule]:
    """The paths of a tree, given as ``toDebugString`` prints it, to all its nodes."""
    path: list[tuple[int, str, float]] = []
    found: set[Rule] = set()
    base = None
    for line in description.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+0-9.eE]+)\)", line)
        if m:
            base = len(m[1]) if base is None else base
            del path[len(m[1]) - base:]
            path.append((int(m[2]), m[3], float(m[4])))
            found.add(simplified(tuple(path)))
    return found


def simplified(rule: Rule) -> Rule:
    """One comparison per feature and side, in order."""
    tight: dict[tuple[int, str], float] = {}
    for feature, side, cut in rule:
        key = (feature, side)
        tight[key] = cut if key not in tight else (min if side == "<=" else max)(tight[key], cut)
    return tuple(sorted((f, s, c) for (f, s), c in tight.items()))


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for feature, side, cut in rule:
        value = F.col(FEATURES[feature])
        out = out & ((value <= cut) if side == "<=" else (value > cut))
    return out


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """The probability of label 1 from the columns FEATURES."""
        z = F.lit(self.intercept)
        for rule, weight in self.weights:
            z = z + F.when(holds(rule), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def fit_rules(labelled: DataFrame, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH,
              penalty: float = PENALTY, seed: int = 7) -> RuleModel:
    """From FEATURES, ``key`` and ``label`` (0.0 or 1.0).

    Fitted on ``sample`` rows at most, chosen by hash. With one class only, or no rows, the
    score is constant: the share of label 1 with one row of either class added.
    """
    rows = staged(labelled.orderBy(F.xxhash64("key"), "label", *FEATURES).limit(sample).select("label", *FEATURES))
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("ones")).first()
    odds = (counts["ones"] + 1) / (counts["n"] - counts["ones"] + 1)
    if counts["ones"] in (0, counts["n"]):
        return RuleModel(math.log(odds), ())
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("label", "features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(vectors)
    rules = sorted(set().union(*[tree_rules(tree.toDebugString) for tree in forest.trees]))
    if not rules:
        return RuleModel(math.log(odds), ())
    table = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="rules").transform(
        rows.select("label", *[holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])).select("label", "rules")
    lasso = LogisticRegression(featuresCol="rules", elasticNetParam=1.0, regParam=penalty, maxIter=100).fit(table)
    weights = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if abs(w) > LEAST_WEIGHT]
    return RuleModel(float(lasso.intercept), tuple(weights))


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
             **options) -> DataFrame:
    """Per document: held_out, score and predicted.

    Labels are learned only from rows whose crc32 of the id as text is not 1 modulo 3; those are
    held out. Ids, languages, sources and labels are never inputs of a score. NULL texts are
    scored as empty ones; NULL ids are not held out and have no label; NULL labels are left
    out; rows that repeat an id and text get equal scores; an empty table gives an empty result.
    """
    features = staged(text_features(docs, id_col, text_col))
    held_out = lambda c: F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))
    learn = labels.select(column(labels, "doc_id").alias("doc_id"), column(labels, label_col).cast("double").alias("label"))
    labelled = features.join(learn.filter(F.col("label").isNotNull() & ~held_out(F.col("doc_id"))), "doc_id")
    score = fit_rules(labelled, **options).score()
    return features.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"),
                           (score >= 0.5).cast("int").alias("predicted"))
