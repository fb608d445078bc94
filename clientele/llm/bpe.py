"""Byte-level BPE in two tiers.

A text is cut into pre-tokens by a pattern. Tier one looks each distinct pre-token up in a
minimal perfect hash over the vocabulary: one probe, and a comparison that makes it exact.
Tier two merges the others pair by pair: the pairs wait in a heap by rank, then place, and the
parts are linked, so a pre-token of n bytes takes n log n steps however long it is.

The vocabulary is a rank file of fixed size (one token a line: base64, blank, rank); the driver
reads it and sends it to all tasks. Texts are encoded whole, inside narrow tasks; nothing is shuffled.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from clientele.llm.common import column
from clientele.llm.hashing import mixed

# Characters that are cut into pre-tokens at a time; a text is never cut.
SLICE_CHARS = 1 << 21
# Pre-tokens whose ids a worker keeps, to spare time only.
KNOWN = 1 << 19
# Keys to a bucket of the perfect hash, on average.
BUCKET = 3


def byte_hashes(keys: Sequence[bytes], seed: int) -> np.ndarray:
    """A 64-bit hash of each key, all at once: its bytes in numbers of a base, mixed with its length."""
    lengths = np.fromiter(map(len, keys), np.int64, len(keys))
    out = lengths.astype(np.uint64) + np.uint64(2 * seed + 1)
    full = lengths > 0
    if full.any():
        raw = np.frombuffer(b"".join(keys), np.uint8)
        size = lengths[full]
        first = np.cumsum(size) - size
        base = np.full(int(size.max()), np.uint64(0x9E3779B97F4A7C15 + 2 * seed))
        powers = np.multiply.accumulate(base)
        terms = mixed(raw.astype(np.uint64) + np.uint64(seed << 8)) * powers[np.arange(len(raw)) - np.repeat(first, size)]
        out[full] += np.add.reduceat(terms, first)
    return mixed(out)


@dataclass(frozen=True)
class PerfectHash:
    """Numbers n keys from 0 to n - 1 without a gap: a key's place is its own hash plus its bucket's shift."""

    seed: int
    shifts: np.ndarray
    size: int

    @staticmethod
    def _parts(keys: Sequence[bytes], seed: int, buckets: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        h = byte_hashes(keys, seed)
        return (h % np.uint64(buckets)).astype(np.int64), (mixed(h + np.uint64(1)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, keys: Sequence[bytes]) -> PerfectHash:
        """Distinct keys. Large buckets choose their shifts first, those of one key take the places left."""
        size = len(keys)
        if len(set(keys)) != size:
            raise ValueError("keys repeat")
        for seed in range(10_000 if size else 0):
            buckets = -(-size // BUCKET)
            bucket, place = cls._parts(keys, seed, buckets, size)
            if len(np.unique(bucket * size + place)) < size:
                continue  # two keys of a bucket would always meet
            shifts = cls._shifts(bucket, place, buckets, size)
            if shifts is not None:
                return cls(seed, shifts, size)
        return cls(0, np.zeros(1, np.int64), 0)

    @staticmethod
    def _shifts(bucket: np.ndarray, place: np.ndarray, buckets: int, size: int) -> np.ndarray | None:
        held = np.bincount(bucket, minlength=buckets)
        members = np.split(place[np.argsort(bucket, kind="stable")], np.cumsum(held)[:-1])
        free, shifts = np.ones(size, bool), np.zeros(buckets, np.int64)
        order = np.argsort(-held, kind="stable")
        for b in order[:int((held > 1).sum())]:
            own, start, step = members[b], 0, 64
            while start < size:
                tried = np.arange(start, min(start + step, size))
                fits = free[(own[:, None] + tried) % size].all(axis=0)
                if fits.any():
                    break
                start, step = start + step, step * 4
            else:
                return None
            shifts[b] = tried[fits.argmax()]
            free[(own + shifts[b]) % size] = False
        single = order[int((held > 1).sum()):int((held > 0).sum())]
        alone = np.array([members[b][0] for b in single], np.int64)
        shifts[single] = (np.flatnonzero(free) - alone) % size
        return shifts

    def places(self, keys: Sequence[bytes]) -> np.ndarray:
        """The place of each key; any place for what is not a key."""
        if not self.size:
            return np.zeros(len(keys), np.int64)
        bucket, place = self._parts(keys, self.seed, len(self.shifts), self.size)
        return (place + self.shifts[bucket]) % self.size


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: the pair of least rank is joined, the leftmost of equals, until none is left.

    The part that starts at byte i ends where the next one starts, ``after[i]``, and has with that one
    the rank ``pair[i]``, -1 if they are no token or the part is gone. What waits in the heap is rank and start as
    one number; it has lapsed if the rank there is another by now.
    """
    n, rank_of = len(piece), ranks.get
    shift = n.bit_length()
    mask = (1 << shift) - 1
    after, before = list(range(1, n + 2)), list(range(-1, n))
    pair = [rank_of(piece[i:i + 2], -1) for i in range(n - 1)]
    pair.append(-1)
    waiting = [rank << shift | i for i, rank in enumerate(pair) if rank >= 0]
    heapify(waiting)
    while waiting:
        least = heappop(waiting)
        start = least & mask
        if pair[start] != least >> shift:
            continue
        middle = after[start]
        end = after[middle]
        after[start], before[end], pair[middle] = end, start, -1
        rank = rank_of(piece[start:after[end]], -1) if end < n else -1
        pair[start] = rank
        if rank >= 0:
            heappush(waiting, rank << shift | start)
        left = before[start]
        if left >= 0:
            rank = rank_of(piece[left:end], -1)
            pair[left] = rank
            if rank >= 0:
                heappush(waiting, rank << shift | left)
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at:after[at]]])
        at = after[at]
    return out


class Vocabulary:
    """Tokens with their ranks; every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        if len(set(ranks.values())) < len(ranks) or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("ranks repeat, or a byte has none")
        self.ranks, self.cut = ranks, regex.compile(pattern)
        keys = list(ranks)
        self.hash = PerfectHash.of(keys)
        self.keys, self.packed = [b""] * len(keys), [b""] * len(keys)
        for key, place in zip(keys, self.hash.places(keys).tolist(), strict=True):
            self.keys[place], self.packed[place] = key, array("i", [ranks[key]]).tobytes()
        by_id = [b""] * (max(ranks.values()) + 1)
        for key, rank in ranks.items():
            by_id[rank] = key
        self.flat = np.frombuffer(b"".join(by_id), np.uint8)
        self.sizes = np.array([len(t) for t in by_id], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.known: dict[str, bytes] = {}

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        return cls({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)

    def resolve(self, pieces: Sequence[str]) -> dict[str, bytes]:
        """Ids of distinct pre-tokens, packed as 32-bit numbers: from the perfect hash if whole, from the heap if not."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        keys, packed, ranks = self.keys, self.packed, self.ranks
        return {piece: packed[place] if keys[place] == b else array("i", merged(b, ranks)).tobytes()
                for piece, b, place in zip(pieces, raw, self.hash.places(raw).tolist(), strict=True)}

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Packed ids of texts; pre-tokens are resolved once, and anew after ``KNOWN`` others."""
        if len(self.known) > KNOWN:
            self.known.clear()
        cut, known = self.cut.findall, self.known
        pieces = [cut(t) if t else [] for t in texts]
        known.update(self.resolve([p for p in set(chain.from_iterable(pieces)) if p not in known]))
        return [b"".join(map(known.__getitem__, each)) for each in pieces]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids in a row, and how many each has; 0 and no bytes for numbers that are no token."""
        known = (ids >= 0) & (ids < len(self.starts))
        at = np.where(known, ids, 0)
        sizes = np.where(known, self.sizes[at], 0)
        ends = np.cumsum(sizes)
        inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
        return self.flat[np.repeat(self.starts[at], sizes) + inside], sizes


def slices(sizes: Sequence[int], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of about ``most`` in sum; what is larger is a range of its own."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row, whole texts, without special tokens.

    NULL and empty texts have no ids; rows that repeat give a row each; NULL ids stay; other
    columns are ignored, whatever their names; an empty table gives none. A very long text is one
    text to one task, in time near its length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, end in slices([len(t or "") for t in texts]):
                ids = shared.value.encode(texts[start:end])
                ends = np.cumsum([0, *(len(b) // 4 for b in ids)], dtype=np.int32)
                flat = np.frombuffer(b"".join(ids), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(start, end - start), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    ["doc_id", "ids"])
    rows = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).alias("text"))
    return rows.mapInArrow(encoded, f"doc_id {dict(rows.dtypes)['id']}, ids array<int>")


def decode(tokens: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, bytes) of every row; bytes are NULL if ids are NULL, hold a NULL or a number that is no token."""
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in slices(pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_pylist()):
                part = batch.slice(start, end - start)
                lists = part.column("ids")
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
                raw, sizes = shared.value.decode(pc.fill_null(lists.flatten(), -1).to_numpy())
                upto = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts)))]
                odd = np.concatenate(([0], np.cumsum(sizes == 0)))[np.concatenate(([0], np.cumsum(counts)))]
                bad = lists.is_null().to_numpy(zero_copy_only=False) | (np.diff(odd) > 0)
                whole = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(raw)])
                out = pc.if_else(pa.array(bad), pa.scalar(None, pa.binary()), whole)
                yield pa.RecordBatch.from_arrays([*part.columns, out], ["doc_id", "ids", "bytes"])
    rows = tokens.select(column(tokens, id_col).alias("id"), column(tokens, ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(decoded, f"doc_id {dict(rows.dtypes)['id']}, ids array<int>, bytes binary")
