"""K-means with all numbers of clusters and all starts side by side.

A pass over the members moves every model that has not settled one round: each task measures its
members against the centres of all models by matrix products and sends, per cluster, the
number and the coordinate sums of its members. Costs are measured once, at the last centres. So a pass costs one read and one small
aggregation however many models there are, and its result is as large as the models.

Starts come from candidates: a few passes draw members with a chance in proportion to the square
of their distance to the candidates so far, one pass counts the members nearest to each, and every
model picks its centres among these by the same rule with its own seed and settles on them first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.operators.features import column

# Members measured at a time in a task.
CHUNK = 2048
# Passes that draw candidates, and candidates a pass for each cluster of the largest model.
DRAWS = 5
PER_CLUSTER = 20
LOCAL_ROUNDS = 300


@dataclass(frozen=True)
class Clusters:
    """Centres in the order of their ids, the sum of squares at these centres, and how they were found."""

    centres: np.ndarray
    cost: float
    rounds: int
    settled: bool

    @property
    def k(self) -> int:
        return len(self.centres)


@dataclass
class _Sums:
    """Per cluster of a model: members, sums of their squares, coordinate sums."""

    members: np.ndarray
    norms: np.ndarray
    coordinates: np.ndarray


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.float64)


def _nearest(points: np.ndarray, centres: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Row of ``centres`` nearest to each point, for every model (a range of rows); the first of equals."""
    far = (centres ** 2).sum(axis=1) - 2.0 * (points @ centres.T)
    return np.stack([far[:, a:b].argmin(axis=1) + a for a, b in zip(edges, edges[1:])], axis=1)


def _side_by_side(models: Sequence[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The models in falling order of their size, and the first centres of all of them, then the second of all that have two, and so on."""
    order = np.argsort([-len(m) for m in models], kind="stable")
    return order, [np.stack([models[i][j] for i in order if len(models[i]) > j]) for j in range(len(models[order[0]]))]


def _gathered(x: np.ndarray, blocks: Sequence[np.ndarray], scaled: Sequence[np.ndarray]) -> list[np.ndarray]:
    """What the centres of each block gather of the members ``x``: coordinate sums, numbers and norms.

    All models are measured against one centre of theirs at a time; the first of equally near ones stays.
    """
    one = np.column_stack([x, np.ones(len(x))]).T
    near = scaled[0] @ one
    own = np.zeros(near.shape, np.int16)
    for j, block in enumerate(scaled[1:], 1):
        far = block @ one
        before, chosen = near[:len(far)], own[:len(far)]
        np.maximum(chosen, (far < before).astype(np.int16) * np.int16(j), out=chosen)
        np.minimum(before, far, out=before)
    measures = np.column_stack([x, np.ones(len(x)), (x ** 2).sum(axis=1)])
    return [(own[:len(block)] == j).astype(np.float64) @ measures for j, block in enumerate(blocks)]


def _summed(points: DataFrame, models: Sequence[np.ndarray]) -> list[_Sums]:
    """One pass: what each centre of each model gathers."""
    order, blocks = _side_by_side(models)
    dims, n = blocks[0].shape[1], sum(map(len, blocks))
    shared = points.sparkSession.sparkContext.broadcast(blocks)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shared.value
        scaled = [np.column_stack([-2.0 * b, (b ** 2).sum(axis=1)]) for b in blocks]
        centres, table = np.concatenate(blocks), np.zeros((n, dims + 2))
        for batch in batches:
            whole = _matrix(batch)
            for start in range(0, len(whole), CHUNK):
                x = whole[start:start + CHUNK]
                if len(blocks[0]) > 1:
                    table += np.concatenate(_gathered(x, blocks, scaled))
                else:
                    own = _nearest(x, centres, np.array([0, n]))[:, 0]
                    measures = [*x.T, np.ones(len(x)), (x ** 2).sum(axis=1)]
                    table += np.stack([np.bincount(own, m, n) for m in measures], axis=1)
        hit = np.flatnonzero(table[:, dims])
        yield pa.RecordBatch.from_arrays(
            [pa.array(hit, pa.int32()), *[pa.array(table[hit, j]) for j in range(dims + 2)]], names=["cluster", *totals])
    totals = [*[f"s{j}" for j in range(dims)], "members", "norms"]
    found = (points.mapInArrow(measured, "cluster int, " + ", ".join(f"{t} double" for t in totals))
             .groupBy("cluster").agg(*[F.sum(t).alias(t) for t in totals]).toArrow())
    shared.destroy()
    table = np.zeros((n, len(totals)))
    table[found["cluster"].to_numpy()] = np.column_stack([found[t].to_numpy() for t in totals])
    edges = np.cumsum([0, *map(len, blocks)])
    out: list[_Sums] = [None] * len(models)  # type: ignore[list-item]
    for rank, i in enumerate(order):
        mine = table[edges[:len(models[i])] + rank]
        out[i] = _Sums(mine[:, dims], mine[:, dims + 1], mine[:, :dims])
    return out


def _costs(points: DataFrame, models: Sequence[np.ndarray]) -> list[float]:
    """One pass: the sum of squares of each model, member by member."""
    centres, edges = np.concatenate(models), np.cumsum([0, *map(len, models)])
    shared = points.sparkSession.sparkContext.broadcast((centres, edges))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, edges = shared.value
        costs = np.zeros(len(edges) - 1)
        for batch in batches:
            whole = _matrix(batch)
            for start in range(0, len(whole), CHUNK):
                x = whole[start:start + CHUNK]
                costs += ((x[:, None, :] - centres[_nearest(x, centres, edges)]) ** 2).sum(axis=(0, 2))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(costs)), pa.int32()), pa.array(costs)], names=["model", "cost"])
    found = points.mapInArrow(measured, "model int, cost double").groupBy("model").agg(F.sum("cost").alias("cost")).toArrow()
    shared.destroy()
    out = np.zeros(len(models))
    out[found["model"].to_numpy()] = found["cost"].to_numpy()
    return out.tolist()


def _drawn(points: DataFrame, candidates: np.ndarray, n: int, seed: int) -> np.ndarray:
    """``n`` members, each round of drawing in proportion to their squares to the candidates (at first, evenly).

    A member's key is an exponential number over its weight, and the n least keys are such a draw; a task sends
    its n least.
    """
    dims = len(points.columns)
    shared = points.sparkSession.sparkContext.broadcast(candidates)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        centres = shared.value
        best = np.empty((0, dims + 1))
        for batch in batches:
            whole = _matrix(batch)
            for start in range(0, len(whole), CHUNK):
                x = whole[start:start + CHUNK]
                weight = np.ones(len(x))
                if len(centres):
                    own = _nearest(x, centres, np.array([0, len(centres)]))[:, 0]
                    weight = ((x - centres[own]) ** 2).sum(axis=1)
                draw = rng.exponential(size=len(x))
                some = weight > 0
                rows = np.column_stack([draw[some] / weight[some], x[some]])
                best = np.concatenate((best, rows))
                best = best[np.argsort(best[:, 0], kind="stable")[:n]]
        yield pa.RecordBatch.from_arrays([pa.array(best[:, j]) for j in range(dims + 1)], names=["key", *[f"x{j}" for j in range(dims)]])
    names = [f"x{j}" for j in range(dims)]
    rows = points.mapInArrow(keyed, "key double, " + ", ".join(f"{x} double" for x in names)).orderBy("key", *names).limit(n)
    found = np.array([list(r)[1:] for r in rows.collect()]).reshape(-1, dims)
    shared.destroy()
    return found


def _candidates(points: DataFrame, most: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct candidates and how many members are nearest to each."""
    found = np.empty((0, len(points.columns)))
    for i in range(DRAWS):
        found = np.concatenate((found, _drawn(points, found, PER_CLUSTER * most, seed + i)))
    found = np.unique(found, axis=0)
    if not len(found):
        raise ValueError("no members to cluster")
    return found, _summed(points, [found])[0].members


def _start(candidates: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k centres among weighted candidates, each drawn in proportion to weight times square to those before."""
    chosen, far = [], np.ones(len(candidates))
    for _ in range(k):
        chance = weights * far
        if chance.sum() <= 0:  # fewer candidates than centres: some stand twice, and the later stays empty
            chance = weights
        pick = candidates[rng.choice(len(candidates), p=chance / chance.sum())]
        square = ((candidates - pick) ** 2).sum(axis=1)
        far = square if not chosen else np.minimum(far, square)
        chosen.append(pick)
    centres = np.array(chosen)
    # Rounds among the candidates alone are free, and spare passes over the members.
    for _ in range(LOCAL_ROUNDS):
        own = _nearest(candidates, centres, np.array([0, k]))[:, 0]
        held = np.bincount(own, weights, minlength=k)
        moved = np.stack([np.bincount(own, weights * candidates[:, j], minlength=k) for j in range(candidates.shape[1])], axis=1)
        moved = np.where(held[:, None] > 0, moved / np.where(held > 0, held, 1)[:, None], centres)
        if np.allclose(moved, centres, rtol=0, atol=1e-12):
            break
        centres = moved
    return centres


def lloyd(points: DataFrame, starts: Sequence[np.ndarray], max_rounds: int = 300, tolerance: float = 1e-4) -> list[Clusters]:
    """All models from their starts until they settle; ``points`` has just the coordinates, without NULL.

    A model settles when no member changes its cluster, or when the squares of its centres' steps sum up to
    ``tolerance`` of the mean variance of a coordinate or less. Its cost is measured at its last centres. A
    cluster without members keeps its centre.
    """
    centres, n = [np.array(s, np.float64) for s in starts], len(starts)
    before: list[_Sums | None] = [None] * n
    done: dict[int, tuple[int, bool]] = {}  # rounds, settled
    limit, passes = None, 0
    while live := [i for i in range(n) if i not in done]:
        sums, passes = _summed(points, [centres[i] for i in live]), passes + 1
        for i, s in zip(live, sums):
            if limit is None:
                total = s.members.sum()
                mean = s.coordinates.sum(axis=0) / total
                limit = tolerance * (s.norms.sum() / total - (mean ** 2).sum()) / len(mean)
            last = before[i]
            same = last is not None and np.array_equal(last.members, s.members) and np.allclose(last.coordinates, s.coordinates, rtol=1e-12, atol=1e-9)
            if same or passes > max_rounds:
                done[i] = passes - 1, bool(same)
                continue
            moved = np.where(s.members[:, None] > 0, s.coordinates / np.maximum(s.members, 1)[:, None], centres[i])
            if ((moved - centres[i]) ** 2).sum() <= limit:
                done[i] = passes, True
            centres[i], before[i] = moved, s
    return [Clusters(c, cost, *done[i]) for i, (c, cost) in enumerate(zip(centres, _costs(points, centres)))]


def fit(df: DataFrame, cols: Sequence[str], ks: Sequence[int], n_init: int, seed: int = 1,
        max_rounds: int = 300, tolerance: float = 1e-4) -> dict[int, Clusters]:
    """For each number of clusters the best of ``n_init`` starts.

    NULL coordinates count as 0. Equal costs are settled by the earlier start.
    """
    points = df.select(*[F.coalesce(column(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(cols)])
    points = points.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        candidates, weights = _candidates(points, max(ks), seed)
        shapes = [(k, i) for k in ks for i in range(n_init)]
        found = lloyd(points, [_start(candidates, weights, k, np.random.default_rng([seed, k, i])) for k, i in shapes], max_rounds, tolerance)
    finally:
        points.unpersist()
    best: dict[int, Clusters] = {}
    for (k, _), model in zip(shapes, found):
        if k not in best or model.cost < best[k].cost:
            best[k] = model
    return best
