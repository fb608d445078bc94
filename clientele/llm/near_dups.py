"""Near duplicates by a chosen-path set similarity join over shingle sets.

Texts with equal shingle sets form a class and count once. A class holds ``SKETCH``
minwise tokens. At the root of each tree it descends by one of them, so classes meet in a
node with a probability equal to their similarity. Nodes are compared exhaustively, in
blocks that fit a task: classes whose sketches can reach the threshold with a class of
another component are compared by their full sets, and only links that connect are
emitted. A node of over ``WIDE`` blocks is compared within random blocks only, which joins what is
alike; if it still holds several components it branches, by ``BRANCHES`` tokens chosen by the
path. What is large after ``DEPTH`` levels is compared block against block, so no pair is
given up. The number of trees follows from the recall asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.llm.common import bit_map, column, packed, possible, row_key, unpacked, without
from clientele.llm.graph import components
from clientele.llm.hashing import mixed, shingles
from clientele.sources.staging import staged

SKETCH = 64
BRANCHES = 2
DEPTH = 8
# A node is small up to so many classes, each counting once for so many tokens begun.
NODE = 1000
TOKENS = 4000
COLUMNS = 4096
# Up to so many blocks of that size, all pairs of blocks are compared.
WIDE = 8
MISS = 1e-6

_RNG = np.random.default_rng(20_240_229)
_MULTIPLIERS = _RNG.integers(1, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RNG.integers(0, 1 << 63, SKETCH, dtype=np.uint64)


def trees_for(similarity: float, miss: float = MISS, branches: int = BRANCHES) -> int:
    """Trees after which a pair at the threshold is missed with probability ``miss`` at most.

    q is the chance that a pair that shares a node shares no leaf below it.
    """
    q = 0.0
    for _ in range(DEPTH):
        q = (1 - similarity + similarity * q) ** branches
    return math.ceil(math.log(miss) / math.log(1 - similarity + similarity * q))


def minwise(tokens: np.ndarray) -> np.ndarray:
    """For each coordinate the least of the tokens' hashes, 32 bits of it."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for part in np.array_split(tokens, max(1, len(tokens) // 16_384)):
        hashed = (part[None, :] ^ _OFFSETS[:, None]) * _MULTIPLIERS[:, None]
        least = np.minimum(least, hashed.min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signature(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, in whatever order."""
    other = mixed(tokens ^ np.uint64(0xD6E8FEB86659FD93))
    return int(tokens.sum().view(np.int64)), int(other.sum().view(np.int64))


def sketch_texts(docs: DataFrame, shingle: int) -> DataFrame:
    """From (id, h, text), per row: number of shingles, signature, minwise tokens and the lowest byte of each."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary()]
    names = ["id", "h", "n", "sig_a", "sig_b", "mins", "low"]

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                tokens = shingles(text.as_py(), shingle)
                mins = minwise(tokens) if len(tokens) else None
                rows.append((len(tokens), *signature(tokens), mins, None if mins is None else mins.astype(np.uint8).tobytes()))
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), *made], names)
    return docs.mapInArrow(sketched, "id long, h long, n long, sig_a long, sig_b long, mins array<int>, low binary")


def token_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """From (cid, sig_a, sig_b, text): the full shingle set of the rows with that signature, packed."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                tokens = shingles(row["text"], shingle)
                if signature(tokens) == (row["sig_a"], row["sig_b"]):
                    rows.append((row["cid"], tokens.tobytes()))
            cids, tokens = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(tokens, pa.binary())], ["cid", "tokens"])
    return (texts.select("cid", "sig_a", "sig_b", "text").mapInArrow(sets, "cid long, tokens binary")
            .dropDuplicates(["cid"]))


def least_agreement(similarity: float, miss: float = 1e-9) -> int:
    """Equal coordinates below which a pair at the threshold is found with probability ``miss``."""
    below = 0.0
    for k in range(SKETCH + 1):
        below += math.comb(SKETCH, k) * similarity ** k * (1 - similarity) ** (SKETCH - k)
        if below > miss:
            return k
    return SKETCH


def common_tokens(tokens: list[np.ndarray]) -> np.ndarray:
    """How many tokens each two sets share, from blocks of columns of tokens that two sets have."""
    rows = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    _, column_of, times = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    kept = shared[column_of]
    rows, columns = rows[kept], number[column_of[kept]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    common = np.zeros((len(tokens), len(tokens)), np.float64)
    for start in range(0, int(shared.sum()), COLUMNS):
        at = slice(*np.searchsorted(columns, [start, start + COLUMNS]))
        block = np.zeros((len(tokens), COLUMNS), np.float32)
        block[rows[at], columns[at] - start] = 1
        common += block @ block.T
    return common.astype(np.int64)


def _units_of(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The units of a call one by one."""
    rows = rows.sort_values(["node", "block"], kind="stable")
    node, block = rows["node"].to_numpy(), rows["block"].to_numpy()
    edges = np.flatnonzero((node[1:] != node[:-1]) | (block[1:] != block[:-1])) + 1
    for start, end in zip([0, *edges], [*edges, len(rows)], strict=True):
        yield rows.iloc[start:end]


def _connect(numerator: int, denominator: int):
    """The links that connect components of a unit."""
    def linked(rows: pd.DataFrame) -> list[tuple[int, int]]:
        cids, sizes, group = (rows[c].to_numpy() for c in ("cid", "n", "component"))
        common = common_tokens([np.frombuffer(t, np.uint64) for t in rows["tokens"]])
        near = denominator * common >= numerator * (sizes[:, None] + sizes[None, :] - common)
        group, links = group.copy(), []
        for i in range(len(cids)):
            others = np.flatnonzero(near[i] & (group != group[i]))
            for other, first in zip(*np.unique(group[others], return_index=True), strict=True):
                links.append((cids[i], cids[others[first]]))
                group[group == other] = group[i]
        return links

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        links = [link for unit in _units_of(rows) for link in linked(unit)]
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")
    return compare


def _screen(similarity: float):
    """The rows of a unit that have a plausible partner in another component, by size and sketch."""
    least = least_agreement(similarity)

    def plausible(rows: pd.DataFrame) -> np.ndarray:
        # A byte of each token will do: tokens that only seem equal let more through.
        sketches = np.frombuffer(b"".join(rows["low"]), np.uint8).reshape(len(rows), -1)
        sizes, group, found = rows["n"].to_numpy(), rows["component"].to_numpy(), np.zeros(len(rows), bool)
        for i in range(len(rows) - 1):
            rest = slice(i + 1, None)
            equal = (sketches[rest] == sketches[i]).view(np.uint8).sum(axis=1, dtype=np.uint8)
            fits = ((equal >= least) & (group[rest] != group[i])
                    & (np.minimum(sizes[i], sizes[rest]) >= similarity * np.maximum(sizes[i], sizes[rest]) - 1e-9))
            found[i] |= fits.any()
            found[rest] |= fits
        return found

    def screened(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [unit.loc[plausible(unit), ["node", "block", "cid", "n", "component"]] for unit in _units_of(rows)]
        return pd.concat(parts)
    return screened


def classes_of(sketches: DataFrame) -> DataFrame:
    """One row per distinct set: a number, its smallest document, size and minwise tokens."""
    return (sketches.filter((F.col("n") > 0) & F.col("id").isNotNull()).groupBy("n", "sig_a", "sig_b")
            .agg(F.min("id").alias("id"), F.first("mins").alias("mins"), F.first("low").alias("low"))
            .withColumn("cid", F.monotonically_increasing_id()))


class _Join:
    """The state of one similarity join: classes, links and components found so far."""

    def __init__(self, texts: DataFrame, classes: DataFrame, shingle: int, ratio: tuple[int, int]):
        self.texts, self.classes, self.shingle, self.ratio = texts, classes, shingle, ratio
        self.links: DataFrame | None = None
        self.component: DataFrame | None = None

    def open_nodes(self, members: DataFrame) -> DataFrame:
        """Members (node, cid, n) of nodes that hold several components, with size and component."""
        if self.component is None:
            members = members.withColumn("component", F.col("cid"))
        else:
            members = members.join(self.component, "cid", "left").withColumn(
                "component", F.coalesce("component", "cid"))
        nodes = members.groupBy("node").agg(
            F.sum(F.ceil(F.col("n") / TOKENS)).alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
        return members.join(nodes.filter("low < high").select("node", "size"), "node")

    def compare(self, units: DataFrame) -> None:
        """Compare all units and take up the links found.

        Units are far more than tasks need, so many go to one call, as many as a few blocks weigh.
        """
        units = staged(units)
        weight = units.agg(F.coalesce(F.sum(F.ceil(F.col("n") / TOKENS)), F.lit(0))).first()[0]
        bucket = F.pmod(F.xxhash64("node", "block"), F.lit(1 + int(weight) // (3 * NODE)))
        chosen = staged(units.join(self.classes.select("cid", "low"), "cid").groupBy(bucket).applyInPandas(
            _screen(self.ratio[0] / self.ratio[1]), "node long, block string, cid long, n long, component long"))
        wanted = staged(chosen.select("cid").distinct().join(self.classes.select("cid", "id", "sig_a", "sig_b"), "cid"))
        key = F.struct("id")
        texts = possible(self.texts, key, staged(bit_map(wanted.select(key.alias("key"))))).filter("possible").drop("possible")
        full = token_sets(texts.join(wanted, "id"), self.shingle)
        found = staged(chosen.join(full, "cid").groupBy(bucket).applyInPandas(_connect(*self.ratio), "u long, v long"))
        self.links = found if self.links is None else self.links.unionByName(found)
        self.component = staged(components(self.links).select(F.col("id").alias("cid"), "component"))


def _units(nodes: DataFrame, salt: int, last: bool) -> DataFrame:
    """Nodes (node, cid, size, component) cut into units (node, block, cid, n, component) of about NODE classes.

    Up to WIDE blocks of a node each block meets each other, so every pair of the node meets.
    Blocks of a larger node are alone, to join what is alike before it branches; unless it is the ``last`` time.
    """
    blocks = F.ceil(F.col("size") / NODE).cast("int")
    own = F.pmod(F.xxhash64(F.lit(salt), "cid"), F.col("blocks")).cast("int")
    met = F.sequence(F.lit(0), F.col("blocks") - 1)
    met = met if last else F.when(F.col("blocks") <= WIDE, met).otherwise(F.array("own"))
    pair = F.concat_ws("-", F.least("own", "other"), F.greatest("own", "other"))
    return (nodes.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(met))
            .select("node", pair.alias("block"), "cid", "n", "component"))


def similar_classes(texts: DataFrame, classes: DataFrame, shingle: int, ratio: tuple[int, int],
                    miss: float = MISS) -> DataFrame | None:
    """The tree walk: component of every class that is linked to another (cid, component)."""
    join = _Join(texts, classes, shingle, ratio)
    roots = trees_for(ratio[0] / ratio[1], miss)
    if roots > SKETCH:
        raise ValueError(f"a similarity of {ratio[0]}/{ratio[1]} needs {roots} trees, a sketch has {SKETCH} tokens")
    members = classes.select("cid", "n", F.posexplode(F.slice("mins", 1, roots)).alias("tree", "token")).select(
        F.xxhash64("tree", "token").alias("node"), "cid", "n")
    for depth in range(DEPTH + 1):
        nodes = staged(join.open_nodes(members))
        if nodes.isEmpty():
            break
        join.compare(_units(nodes, depth, last=depth == DEPTH))
        left = staged(join.open_nodes(nodes.filter(F.col("size") > NODE * WIDE).select("node", "cid", "n")))
        if depth == DEPTH or left.isEmpty():
            break
        choice = [F.pmod(F.xxhash64(F.lit(b), "node"), F.lit(SKETCH)).cast("int") for b in range(BRANCHES)]
        children = F.explode(F.array(*[F.xxhash64("node", F.lit(b), F.col("mins")[c]) for b, c in enumerate(choice)]))
        members = left.join(classes.select("cid", "mins"), "cid").select(children.alias("node"), "cid", "n")
    return join.component


def near_duplicates(docs: DataFrame, shingle: int = 5, numerator: int = 4, denominator: int = 5,
                    id_col: str = "doc_id", text_col: str = "text", miss: float = MISS) -> DataFrame:
    """Per row: n_shingles, component_id (smallest id reachable) and kept.

    Documents are linked if the Jaccard similarity of their shingle sets is at least
    numerator / denominator; every link found is confirmed on full sets. Texts without
    a word, NULL ones and rows without an id are linked with nothing: their component is
    their own id, and they are kept. Ids should be unique: each row that repeats one is
    judged by its own text. Other columns are ignored; an empty table gives an empty result.
    """
    return _verdicts(docs, shingle, numerator, denominator, id_col, text_col, miss).drop("h")


def _verdicts(docs: DataFrame, shingle: int, numerator: int, denominator: int, id_col: str, text_col: str,
              miss: float = MISS) -> DataFrame:
    """``near_duplicates`` with the hash of each row's text."""
    texts = docs.select(column(docs, id_col).cast("long").alias("id"), column(docs, text_col).alias("text"))
    sketches = staged(sketch_texts(texts.select("id", F.xxhash64("text").alias("h"), "text"), shingle))
    classes = staged(classes_of(sketches))
    found = similar_classes(texts, classes, shingle, (numerator, denominator), miss)
    least = classes.select("n", "sig_a", "sig_b", "cid", F.col("id").alias("least"))
    if found is not None:
        named = least.join(found, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        lowest = named.groupBy("component").agg(F.min("least").alias("least"))
        least = named.drop("least").join(lowest, "component")
    verdict = sketches.drop("mins", "low").join(least.select("n", "sig_a", "sig_b", "least"), ["n", "sig_a", "sig_b"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("least", "id"))
    return verdict.select(F.col("id").alias("doc_id"), "h", F.col("n").alias("n_shingles"), component.alias("component_id"),
                          F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, shingle: int = 5, numerator: int = 4, denominator: int = 5,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the near duplicates of a smaller id; all columns as they were.

    A row goes by its id and text, so a text of its own under a repeated id stays. Of rows
    that are equal in both one stays, those without an id or a word all do.
    """
    verdicts = staged(_verdicts(docs, shingle, numerator, denominator, id_col, text_col))
    key = F.struct(F.col("doc_id").cast(dict(docs.dtypes)[id_col]).alias("id"), "h").alias("key")
    known = verdicts.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    gone = known.filter(~F.col("kept")).select(key)
    twice = staged(known.filter("kept").groupBy(key).count().filter("count > 1").select("key"))
    kept = without(docs, staged(gone.union(twice).distinct()), id_col, text_col)
    if twice.isEmpty():
        return kept
    again = packed(docs, row_key(docs, id_col, text_col).alias("key")).join(twice, "key", "left_semi")
    one = F.first("row").alias("row")
    return kept.unionByName(unpacked(again.groupBy("key").agg(one), docs.columns))
