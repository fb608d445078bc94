"""Feature choice, clustering and persona names."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.config import MEMBER, PERSONA_NAMES
from clientele.operators import kmeans
from clientele.operators.features import column
from clientele.operators.moments import factors, moments


def feature_correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per pair of features, in the order given; 0 where a feature is constant."""
    corr = moments(df, cols).correlation
    return df.sparkSession.createDataFrame(
        [(cols[i], cols[j], float(corr[i, j])) for i in range(len(cols)) for j in range(i + 1, len(cols))],
        "feature string, other string, correlation double")


def factor_weights(df: DataFrame, cols: Sequence[str], n_factors: int = 10) -> DataFrame:
    """Per feature the sum of its absolute loadings, its communality and its noise.

    The d x d correlations over all members come from one pass; only they, of fixed size, reach the driver.
    """
    found = factors(moments(df, cols).correlation, n_factors)
    rows = [(c, float(w), float(h), float(p)) for c, w, h, p in zip(cols, found.weights, found.communality, found.noise)]
    return df.sparkSession.createDataFrame(rows, "feature string, weight double, communality double, noise double")


def ranked_features(correlation: np.ndarray, cols: Sequence[str], n_factors: int = 10, n_keep: int = 10,
                    ascending: bool = True) -> list[str]:
    """The ``n_keep`` features with the smallest (default) or largest weights; equal weights keep their order."""
    weights = factors(correlation, n_factors).weights
    order = np.argsort(np.round(weights if ascending else -weights, 9), kind="stable")
    return [cols[i] for i in order[:n_keep]]


def factor_select(df: DataFrame, cols: Sequence[str], n_factors: int = 10, n_keep: int = 10,
                  ascending: bool = True) -> list[str]:
    """``ranked_features`` of a table."""
    return ranked_features(moments(df, cols).correlation, cols, n_factors, n_keep, ascending)


def within_squares(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Squared distance to the overall mean: the cost of a single cluster."""
    spread = [F.var_pop(column(c)) * F.count(column(c)) for c in cols]
    return df.agg(sum(spread[1:], spread[0]).alias("wcss"))


def kmeans_sweep(df: DataFrame, cols: Sequence[str], ks: Iterable[int] = range(1, 21),
                 n_init: int = 10, seed: int = 1) -> DataFrame:
    """Within-cluster squares for each number of clusters, all fitted side by side."""
    found = kmeans.fit(df, cols, list(ks), n_init, seed)
    return df.sparkSession.createDataFrame([(k, m.cost) for k, m in found.items()], "k int, wcss double")


def kmeans_fit(df: DataFrame, cols: Sequence[str], k: int = 5, n_init: int = 5, seed: int = 1) -> kmeans.Clusters:
    return kmeans.fit(df, cols, [k], n_init, seed)[k]


def kmeans_predict(df: DataFrame, cols: Sequence[str], model: kmeans.Clusters) -> DataFrame:
    """(member, persona id): the id stays on the row throughout."""
    return nearest_centroid(df, cols, model.centres.tolist())


def least_squares(cols: Sequence[str], centres: Sequence[Sequence[float]]) -> Column:
    """The square of a member's distance to its nearest centre, as a column."""
    point = F.array(*[column(c).cast("double") for c in cols])
    square = lambda x, y: (x - y) * (x - y)
    return F.array_min(F.transform(F.lit([[float(x) for x in c] for c in centres]), lambda centre: F.aggregate(
        F.zip_with(point, centre, square), F.lit(0.0), lambda total, part: total + part)))


def nearest_centroid(df: DataFrame, cols: Sequence[str],
                     centroids: Sequence[Sequence[float]]) -> DataFrame:
    """(member, persona id) by least squared distance; the lower id wins a tie."""
    distances = []
    for i, centre in enumerate(centroids):
        terms = [(column(c) - F.lit(float(x))) * (column(c) - F.lit(float(x)))
                 for c, x in zip(cols, centre)]
        distances.append(F.struct(sum(terms[1:], terms[0]).alias("d"), F.lit(i).alias("persona")))
    return df.select(MEMBER, F.array_min(F.array(*distances))["persona"].alias("persona"))


def distances(df: DataFrame, cols: Sequence[str], centroids: Sequence[Sequence[float]]) -> DataFrame:
    """(member, d): the squared distances to all centres, in their order."""
    return df.select(MEMBER, F.array(*[
        sum(((column(c) - F.lit(float(x))) * (column(c) - F.lit(float(x))) for c, x in zip(cols, centre)), F.lit(0.0))
        for centre in centroids]).alias("d"))


def persona_sizes(personas: DataFrame) -> DataFrame:
    return personas.groupBy("persona").agg(F.count(F.lit(1)).alias("members"))


def name_personas(personas: DataFrame, names: Mapping[int, str] = PERSONA_NAMES) -> DataFrame:
    """Names for cluster ids; an id without a name becomes NULL."""
    label = F.lit(None).cast("string")
    for cluster, name in names.items():
        label = F.when(F.col("persona") == cluster, name).otherwise(label)
    return personas.select(MEMBER, label.alias("persona"))
