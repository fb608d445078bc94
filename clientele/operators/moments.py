"""First and second moments of all features from one pass, and what follows from them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.operators.features import column


@dataclass(frozen=True)
class Moments:
    """Counts, zeros, sums and cross products of features less ``shift``; sums of two tables add up."""

    cols: tuple[str, ...]
    shift: np.ndarray
    n: int
    zeros: np.ndarray
    sums: np.ndarray
    products: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        if self.cols != other.cols or not np.array_equal(self.shift, other.shift):
            raise ValueError("moments of other features, or with another shift")
        return Moments(self.cols, self.shift, self.n + other.n, self.zeros + other.zeros, self.sums + other.sums, self.products + other.products)

    def only(self, cols: Sequence[str]) -> Moments:
        """The same for some features, in the order given."""
        at = [self.cols.index(c) for c in cols]
        return Moments(tuple(cols), self.shift[at], self.n, self.zeros[at], self.sums[at], self.products[np.ix_(at, at)])

    @cached_property
    def zero_shares(self) -> dict[str, float]:
        return dict(zip(self.cols, (self.zeros / max(self.n, 1)).tolist()))

    @cached_property
    def means(self) -> np.ndarray:
        return self.shift + self.sums / max(self.n, 1)

    @cached_property
    def covariance(self) -> np.ndarray:
        """Of the whole population, not a sample of it."""
        centre = self.sums / max(self.n, 1)
        return self.products / max(self.n, 1) - np.outer(centre, centre)

    @cached_property
    def deviations(self) -> np.ndarray:
        """0 for a constant feature, also where rounding leaves a trace of variance."""
        variance = np.diag(self.covariance)
        trace = 1e-12 * np.diag(self.products) / max(self.n, 1)
        return np.where(variance > trace, np.sqrt(np.maximum(variance, 0)), 0.0)

    @cached_property
    def correlation(self) -> np.ndarray:
        """1 on the diagonal of varying features; rows and columns of constant ones are 0."""
        scale = np.where(self.deviations > 0, self.deviations, np.inf)
        return np.clip(self.covariance / np.outer(scale, scale), -1, 1)

    def scaler(self, df: DataFrame) -> DataFrame:
        """One row as ``features.fit_scaler`` makes it: mean and deviation of each feature."""
        row = [(float(m), float(s)) for m, s in zip(self.means, self.deviations)]
        return df.sparkSession.createDataFrame([row], ", ".join(f"`{c}` struct<mean:double,std:double>" for c in self.cols))


def moments(df: DataFrame, cols: Sequence[str]) -> Moments:
    """One pass over the members; NULL and NaN count as 0.

    Tasks multiply their batches and send d + 2 numbers for each feature; these sums add up in one small
    aggregation, and d x d numbers reach the driver. Features are taken less those of any one member, so that
    squares do not cancel far from 0.
    """
    d = len(cols)
    values = df.select(*[F.coalesce(F.nanvl(column(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(cols)])
    first = values.first()
    shift = np.array(list(first) if first else [0.0] * d)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, zeros, sums, products = 0, np.zeros(d), np.zeros(d), np.zeros((d, d))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n, zeros = n + len(x), zeros + (x == 0).sum(axis=0)
            x = x - shift
            sums, products = sums + x.sum(axis=0), products + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(zeros), pa.array(sums),
                                              *[pa.array(products[:, j]) for j in range(d)]],
                                             names=["feature", "n", "zeros", "sums", *[f"p{j}" for j in range(d)]])
    parts = ["zeros", "sums", *[f"p{j}" for j in range(d)]]
    rows = (values.mapInArrow(summed, "feature int, n long, " + ", ".join(f"{p} double" for p in parts))
            .groupBy("feature").agg(F.sum("n").alias("n"), *[F.sum(p).alias(p) for p in parts]).collect())
    n, table = 0, np.zeros((d, len(parts)))
    for row in rows:
        n, table[row["feature"]] = row["n"], [row[p] for p in parts]
    return Moments(tuple(cols), shift, n, table[:, 0], table[:, 1], table[:, 2:])


@dataclass(frozen=True)
class Factors:
    """Loadings (features x factors) and the variance of each feature that they leave as noise."""

    loadings: np.ndarray
    noise: np.ndarray
    steps: int

    @property
    def weights(self) -> np.ndarray:
        return np.abs(self.loadings).sum(axis=1)

    @property
    def communality(self) -> np.ndarray:
        return (self.loadings ** 2).sum(axis=1)

    @property
    def implied(self) -> np.ndarray:
        """The covariance that the factors and the noise give."""
        return self.loadings @ self.loadings.T + np.diag(self.noise)


def factors(covariance: np.ndarray, n_factors: int, max_steps: int = 50_000, tolerance: float = 1e-9) -> Factors:
    """Maximum likelihood by expectation and maximisation on a covariance, its sufficient statistic.

    Given loadings L and noise P, factors have the posterior precision 1 + L' P^-1 L (Woodbury: a matrix
    as large as the factors, never the inverse of the model's covariance), which gives their expected products with
    features and with each other; the new loadings regress the ones on the others, and the noise is what the regression
    leaves. Starts where factors and noise explain half of each feature. Loadings are turned so that L' P^-1 L is
    diagonal, the largest first, and a factor's first nonzero loading is positive. Constant features have no loadings.
    """
    variances = np.diag(covariance).copy()
    vary = np.flatnonzero(variances > 0)
    s = covariance[np.ix_(vary, vary)]
    floor = 1e-9 * np.diag(s)
    values, vectors = np.linalg.eigh(s)
    lead = np.argsort(-values, kind="stable")[:n_factors]
    load = vectors[:, lead] * np.sqrt(np.maximum(values[lead], 0) / 2)
    noise = np.maximum(np.diag(s) - (load ** 2).sum(axis=1), np.diag(s) / 2)
    steps, one = 0, np.eye(load.shape[1])
    for steps in range(1, max_steps + 1):
        posterior = np.linalg.inv(one + (load / noise[:, None]).T @ load)
        project = posterior @ (load / noise[:, None]).T
        with_features = project @ s
        with_each_other = posterior + with_features @ project.T
        new = np.linalg.solve(with_each_other, with_features).T
        left = np.maximum(np.diag(s) - (new * with_features.T).sum(axis=1), floor)
        step = max(np.abs(new - load).max(initial=0), np.abs(left - noise).max(initial=0))
        load, noise = new, left
        if step < tolerance:
            break
    size, turn = np.linalg.eigh((load / noise[:, None]).T @ load)
    load = load @ turn[:, np.argsort(-size, kind="stable")]
    lead_sign = np.sign(load[np.abs(load).argmax(axis=0), np.arange(load.shape[1])]) if len(vary) else np.ones(load.shape[1])
    loadings, rest = np.zeros((len(variances), load.shape[1])), np.zeros(len(variances))
    loadings[vary], rest[vary] = load * np.where(lead_sign == 0, 1, lead_sign), noise
    return Factors(loadings, rest, steps)
