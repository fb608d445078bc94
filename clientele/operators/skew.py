"""Joins that stay balanced when one key holds a large part of the rows.

A shuffle join sends every row of a key to one task. Here the heavy keys are
found by mergeable summaries, counted exactly and split into pieces of at most a task's budget of rows;
only the matching rows of the other side are repeated. Results do not depend on
which keys are split.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.sources.staging import staged, staged_counted

# Rows of one key that a task may get.
TASK_ROWS = 1_000_000
# The budget grows to 1/HEAVY_KEYS of all rows, so fewer keys than that are heavy
# whatever the data, and their list can be broadcast: 5 million rows a task at 10^12.
HEAVY_KEYS = 200_000
# Keys that a task's summary holds, and those of them it sends.
SUMMARY = 1 << 18
SENT = 1 << 11
# Pieces of the rows without a key.
NULL_PIECES = 1 << 20
# Largest lookup of ten columns that is sent whole to every executor; a narrower one may have more rows.
BROADCAST_ROWS = 200_000
BROADCAST_WIDTH = 10

# Places of the bit map that rules rows out: 8 MB, in parts of 32 768 bits.
PLACES = 1 << 26

_ROWS, _PIECES, _SALT, _HIT, _HASH, _PART, _BITS = "_rows", "_pieces", "_salt", "_hit", "_hash", "_part", "_bits"


def _any_null(on: list[str]):
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in on])


def _no_salt(on: list[str]):
    """0 as a column: a literal would be folded out of the join's keys, and rows without a key meet in one task again."""
    return F.pmod(F.xxhash64(*on), F.lit(1)).cast("int")


def _summaries(df: DataFrame, on: list[str]) -> DataFrame:
    """Misra-Gries summaries of the keys, one a task: (key columns, h, n, rows); of h NULL, what the task may have lost of a key, and its rows.

    A task counts its batches exactly and adds them up; beyond ``SUMMARY`` keys all counters lose the largest
    one that has no room, and at the end it sends its ``SENT`` largest. Summaries add up, and so do their losses.
    """
    hashed = df.select(*on, F.xxhash64(*on).alias(_HASH))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, lost, rows, names = np.empty(0, np.int64), np.empty(0, np.int64), 0, 0, None

        def largest(n: int) -> int:
            return int(np.partition(counts, len(counts) - n - 1)[len(counts) - n - 1]) if len(counts) > n else 0
        for batch in batches:
            rows += batch.num_rows
            more, first, times = np.unique(batch.column(_HASH).to_numpy(zero_copy_only=False), return_index=True, return_counts=True)
            own = pa.Table.from_batches([batch.select(on)]).take(pa.array(first))
            named = own if names is None else pa.concat_tables([names, own])
            keys, kept, place = np.unique(np.concatenate((keys, more)), return_index=True, return_inverse=True)
            counts = np.bincount(place, np.concatenate((counts, times)), len(keys)).astype(np.int64)
            names = named.take(pa.array(kept))
            if cut := largest(SUMMARY):
                lost, counts = lost + cut, counts - cut
                left = counts > 0
                keys, counts, names = keys[left], counts[left], names.filter(pa.array(left))
        if names is None:
            return
        cut = largest(SENT)
        sent = counts > cut
        names = names.filter(pa.array(sent)).combine_chunks()
        columns = [pa.concat_arrays([*names.column(c).chunks, pa.nulls(1, names.column(c).type)]) for c in on]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array([*keys[sent].tolist(), None], pa.int64()), pa.array([*counts[sent].tolist(), lost + cut], pa.int64()),
             pa.array([0] * int(sent.sum()) + [rows], pa.int64())], names=[*on, _HASH, _ROWS, "_all"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hashed.schema.fields)
    return hashed.mapInArrow(counted, f"{schema}, {_ROWS} long, _all long")


def heavy_keys(df: DataFrame, on: list[str], task_rows: int | None = None) -> DataFrame | None:
    """Keys with more rows than a task should get, and into how many pieces they go.

    One pass makes summaries, whose counters are too small by no more than their losses, and sums up all rows on
    the way. Without a loss they are exact; else they name the few keys that can be heavy, and these, if any, are
    counted in a second pass. Keys are not grouped as a whole unless the losses reach the budget of a task. NULL keys
    are not listed; ``None`` if no key is heavy.
    """
    task_rows = TASK_ROWS if task_rows is None else task_rows
    known = df.filter(~_any_null(on))
    summary = staged(_summaries(known, on))
    seen = summary.filter(F.col(_HASH).isNull()).agg(F.sum("_all").alias("total"), F.sum(_ROWS).alias("lost")).first()
    total, lost = seen["total"] or 0, seen["lost"] or 0
    budget = max(task_rows, total // HEAVY_KEYS)
    if total <= budget:
        return None
    counts = (summary.filter(F.col(_HASH).isNotNull()).groupBy(_HASH)
              .agg(F.sum(_ROWS).alias(_ROWS), *[F.first(c).alias(c) for c in on]))
    if lost:
        rows = known.select(*on)
        if lost < budget:
            named, some = staged_counted(counts.filter(F.col(_ROWS) + lost > budget).select(_HASH))
            if not some:
                return None
            rows = rows.withColumn(_HASH, F.xxhash64(*on)).join(F.broadcast(named), _HASH, "left_semi")
        counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias(_ROWS))
    found, keys = staged_counted(counts.filter(F.col(_ROWS) > budget).select(*on, F.ceil(F.col(_ROWS) / budget).cast("int").alias(_PIECES)))
    return found if keys else None


def spread_join(facts: DataFrame, dims: DataFrame, on: list[str] | str, how: str = "left",
                profile: DataFrame | None = None, task_rows: int | None = None,
                rows: int | None = None, unique: bool = False, heavy: DataFrame | None = None) -> DataFrame:
    """Join many ``facts`` to few ``dims`` per key, heavy keys split.

    ``how``: left, inner, left_semi, left_anti keep their meaning with ``facts``
    on the left; ``keep_dims`` also keeps dims without facts (a right join).
    ``profile`` is any cheaper frame with the same key distribution (say the raw
    scan below ``facts``); not for ``keep_dims``, where the keys of ``facts``
    themselves are counted. ``rows`` is the number of facts at most, where known: too
    few for any heavy key saves the counting, and so do ``unique`` keys of ``facts``.
    Rows of ``facts`` should be distinct: copies share a salt. ``heavy`` are their heavy keys, where found before.
    """
    on = [on] if isinstance(on, str) else list(on)
    task_rows = TASK_ROWS if task_rows is None else task_rows
    if how not in ("left", "inner", "left_semi", "left_anti", "keep_dims"):
        raise ValueError(f"unsupported join type {how!r}")
    if how == "keep_dims" and profile is not None:
        raise ValueError("keep_dims counts the keys of facts itself")
    few = unique or heavy is not None or (rows is not None and rows <= task_rows)
    heavy = heavy if few else heavy_keys(facts if profile is None else profile, on, task_rows)
    if heavy is None and how == "keep_dims":
        return dims.join(facts, on, "left")
    if heavy is None and how in ("inner", "left_semi"):
        return facts.join(dims, on, how)

    # Lines without a key match nothing, yet a left join would gather them in one task.
    pieces = F.when(_any_null(on), F.lit(NULL_PIECES))
    if heavy is not None:
        heavy = F.broadcast(heavy)
        facts = facts.join(heavy, on, "left")
        pieces = F.coalesce(pieces, F.col(_PIECES))
    pieces = F.coalesce(pieces, F.lit(1))
    spread = F.pmod(F.xxhash64(*[c for c in facts.columns if c != _PIECES]), pieces).cast("int")
    left = facts.withColumn(_SALT, spread).drop(_PIECES)
    if heavy is None:
        right = dims.withColumn(_SALT, _no_salt(on))
    else:
        every = F.sequence(F.lit(0), F.coalesce(_PIECES, F.lit(1)) - 1)
        right = dims.join(heavy, on, "left").withColumn(_SALT, F.explode(every))

    keys = [*on, _SALT]
    if how != "keep_dims":
        return left.join(right.drop(_PIECES), keys, how).drop(_SALT)
    # A heavy key has facts, so its copies without a partner are salting leftovers.
    return (right.join(left.withColumn(_HIT, F.lit(True)), keys, "left")
            .filter(F.col(_HIT) | F.col(_PIECES).isNull())
            .drop(_SALT, _PIECES, _HIT))


def _sent_whole(dims: DataFrame, rows: int, max_rows: int | None) -> bool:
    if max_rows is not None:
        return rows <= max_rows
    return rows * min(len(dims.columns), BROADCAST_WIDTH) <= BROADCAST_ROWS * BROADCAST_WIDTH


def lookup_join(facts: DataFrame, dims: DataFrame, on: list[str] | str, how: str = "left",
                profile: DataFrame | None = None, max_rows: int | None = None,
                unique: bool = False) -> DataFrame:
    """Join a lookup: whole on every executor if its counted size allows, else split.

    The lookup is staged, and counted on the way.
    """
    on = [on] if isinstance(on, str) else list(on)
    dims, rows = staged_counted(dims)
    if _sent_whole(dims, rows, max_rows):
        return facts.join(F.broadcast(dims), on, how)
    return spread_join(facts, dims, on, how, profile=profile, unique=unique)


def distinct_lookup_join(facts: DataFrame, dims: DataFrame, on: list[str] | str, profile: DataFrame | None = None,
                         max_rows: int | None = None, task_rows: int | None = None) -> DataFrame:
    """Left join of the distinct ``facts`` to a lookup.

    If the lookup is too large for every executor and no key is heavy, the rows move once: dealt by key, equal rows
    meet, and so does their partner. Else copies are dropped first, then the join is split.
    """
    on = [on] if isinstance(on, str) else list(on)
    dims, rows = staged_counted(dims)
    if _sent_whole(dims, rows, max_rows):
        return facts.distinct().join(F.broadcast(dims), on, "left")
    heavy = heavy_keys(facts if profile is None else profile, on, task_rows)
    if heavy is not None:
        return spread_join(facts.distinct(), dims, on, "left", task_rows=task_rows, heavy=heavy)
    spread = F.when(_any_null(on), F.pmod(F.xxhash64(*facts.columns), F.lit(NULL_PIECES))).otherwise(0).cast("int")
    keys = [*on, _SALT]
    left = facts.withColumn(_SALT, spread).repartition(*keys).distinct()
    return left.join(dims.withColumn(_SALT, _no_salt(on)), keys, "left").drop(_SALT)


def drop_keys(facts: DataFrame, gone: DataFrame, on: str, rows: int | None = None, places: int | None = None) -> DataFrame:
    """Rows of ``facts`` whose key is not in ``gone``, that is a left anti join, for ``facts`` that are stored.

    A bit map of fixed size rules most rows out where they are; only those it cannot rule out move to the exact join.
    """
    places = PLACES if places is None else places
    place = F.pmod(F.xxhash64(on), F.lit(places))
    part, position = F.shiftright(place, 15).alias(_PART), place.bitwiseAND(F.lit(32767))
    bits = gone.select(part, position.alias(_HIT)).groupBy(_PART).agg(F.bitmap_construct_agg(_HIT).alias(_BITS))
    byte = F.conv(F.hex(F.substr(F.col(_BITS), (F.shiftright(position, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    hit = F.coalesce(F.getbit(byte, position.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    marked = facts.withColumn(_PART, part).join(F.broadcast(staged(bits)), _PART, "left").withColumn(_HIT, hit)
    clear = marked.filter(~F.col(_HIT)).select(*facts.columns)
    doubtful = marked.filter(F.col(_HIT)).select(*facts.columns)
    return clear.unionByName(spread_join(doubtful, gone, on, "left_anti", rows=rows))
