"""Alignment of two tokenizers over the same bytes.

Tokens of A and B that end at the same byte close a group; their last two tokens are a link. The
tokens that end in a range of bytes make a fragment: an open head before the first common end, closed
groups, and an open tail behind the last one. Fragments are a monoid: composing two closes the
group of the left tail and the right head, or joins open ends, in whatever order neighbours meet. So a
document of any length is cut, its pieces are encoded by different tasks, and only open ends travel
up a tree of sixteens; closed groups stay where they are.

Texts are cut before a single blank between two other characters. No pre-token of A and no piece of B
holds such a blank behind something else (checked for B when it is loaded), so the pieces
have the tokens of the whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
import tokenizers
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm.bpe import merged, slices
from clientele.llm.common import column
from clientele.sources.staging import staged, staged_counted

# Texts of more characters are cut into pieces of about that many.
SEGMENT = 1 << 16
# Characters encoded at a time; encodings take many times the room of their texts.
BATCH_CHARS = 1 << 17
# Bytes of a fragment of a cut text, and how many bits of its first byte a round of the tree takes off.
CHUNK_BITS = 14
FAN_BITS = 4

_CUT = re.compile(r"(?<=[^\s▁]) (?=\S)")
BLANK = "▁"

Ids = list[int]


def _bytes_of_characters() -> dict[str, int]:
    """Byte-level vocabularies show a printable byte as itself, the others as characters from 256 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """Tokenizer A, from a ``tokenizers`` file of a byte-level vocabulary.

    The file lists which pairs merge. If each token, built by the ranks of tokens alone, comes from the very pair
    that is listed for it, then so does every merge in every text, and the faster library that goes by ranks gives
    the same ids (``ranked``; texts are cut by the pattern of byte-level files). Otherwise the file's own library encodes.
    """

    def __init__(self, definition: str) -> None:
        self.definition = definition
        made, of = json.loads(definition), _bytes_of_characters()
        vocab = made["model"]["vocab"]
        raw = {token: bytes(of[c] for c in token) if all(c in of for c in token) else token.encode() for token in vocab}
        self.tokens = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.tokens[i] = raw[token]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in made["model"]["merges"]]
        special = {t["content"] for t in made["added_tokens"]}
        self.ranks = {raw[token]: i for token, i in vocab.items() if token not in special}
        cut = made["pre_tokenizer"]
        plain = (cut["type"] == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]
                 and not made["normalizer"] and not made["model"].get("ignore_merges"))
        self.ranked = plain and self._built_as_listed([(raw[x], raw[y]) for x, y in pairs])

    def _built_as_listed(self, pairs: list[tuple[bytes, bytes]]) -> bool:
        ranks = dict(self.ranks)
        order = [ranks[x + y] for x, y in pairs]
        if order != sorted(set(order)) or len(pairs) + 256 != len(ranks) or any(bytes([b]) not in ranks for b in range(256)):
            return False
        for x, y in pairs:
            rank = ranks.pop(x + y)
            if merged(x + y, ranks) != [ranks[x], ranks[y]]:
                return False
            ranks[x + y] = rank
        return True

    @classmethod
    def read(cls, path: str) -> ByteLevel:
        with open(path, encoding="utf-8") as file:
            return cls(file.read())

    def encoder(self) -> Callable[[list[str]], list[Ids]]:
        if self.ranked:
            ranked = tiktoken.Encoding("A", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
            return lambda texts: [ranked.encode_ordinary(t) for t in texts]
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        made = tokenizers.Tokenizer.from_str(self.definition)
        made.encode_special_tokens = True  # their strings in texts are text
        return lambda texts: [e.ids for e in made.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """Tokenizer B, from a ``sentencepiece`` file; it puts a blank before each text by itself."""

    def __init__(self, model: bytes) -> None:
        self.model = model
        made = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [made.id_to_piece(i) for i in range(made.get_piece_size())]
        self.tokens = [bytes([int(name[3:5], 16)]) if made.is_byte(i) else name.replace(BLANK, " ").encode() for i, name in enumerate(names)]
        if any(BLANK in name.lstrip(BLANK) for name in names):
            raise ValueError("texts can't be cut: pieces hold blanks behind other characters")

    @classmethod
    def read(cls, path: str) -> Pieces:
        with open(path, "rb") as file:
            return cls(file.read())

    def encoder(self) -> Callable[[list[str]], list[Ids]]:
        made = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        return lambda texts: made.encode([t[1:] for t in texts], num_threads=1)


def possible_links(a: Sequence[bytes], b: Sequence[bytes]) -> np.ndarray:
    """Sorted numbers (id in A times size of B, plus id in B) of all links that can occur.

    Two tokens that end at the same byte of the same text end alike, so one is a suffix of the other. A
    token has as many suffixes as bytes: the vocabularies bound the list, whatever the corpus.
    """
    def by_bytes(tokens: Sequence[bytes]) -> dict[bytes, list[int]]:
        out: dict[bytes, list[int]] = {}
        for i, t in enumerate(tokens):
            if t:
                out.setdefault(t, []).append(i)
        return out
    in_a, in_b = by_bytes(a), by_bytes(b)
    found = {i * len(b) + j for t, ids in in_a.items() for k in range(len(t)) for j in in_b.get(t[k:], ()) for i in ids}
    found |= {i * len(b) + j for t, ids in in_b.items() for k in range(1, len(t)) for i in in_a.get(t[k:], ()) for j in ids}
    return np.sort(np.fromiter(found, np.int64, len(found)))


class Fragment(NamedTuple):
    """Open ends of a range of bytes; without a common end (not ``closed``) all tokens are its head."""

    closed: bool
    head: tuple[Ids, Ids] = ([], [])
    tail: tuple[Ids, Ids] = ([], [])


NONE = Fragment(False)


def compose(x: Fragment, y: Fragment) -> tuple[Fragment, tuple[Ids, Ids] | None]:
    """The fragment of both ranges, and the group that closes between them, if one does."""
    if not x.closed:
        return Fragment(y.closed, (x.head[0] + y.head[0], x.head[1] + y.head[1]), y.tail), None
    middle = x.tail[0] + y.head[0], x.tail[1] + y.head[1]
    if not y.closed:
        return Fragment(True, x.head, middle), None
    return Fragment(True, x.head, y.tail), middle if middle[0] or middle[1] else None


@dataclass(frozen=True)
class Aligner:
    """Both tokenizers and the links that can occur; small, and sent to all tasks."""

    a: ByteLevel
    b: Pieces
    links: np.ndarray

    @classmethod
    def of(cls, a: ByteLevel, b: Pieces) -> Aligner:
        return cls(a, b, possible_links(a.tokens, b.tokens))

    def ready(self) -> Callable[[list[str]], list[tuple[Ids, Ids] | None]]:
        """Texts that start with a blank to tokens of both; None if their bytes are not the text's."""
        encode_a, encode_b = self.a.encoder(), self.b.encoder()
        of_a, of_b = self.a.tokens.__getitem__, self.b.tokens.__getitem__

        def tokens(texts: list[str]) -> list[tuple[Ids, Ids] | None]:
            raw = (t.encode("utf-8", "surrogatepass") for t in texts)
            return [(x, y) if b"".join(map(of_a, x)) == r and b"".join(map(of_b, y)) == r else None
                    for x, y, r in zip(encode_a(texts), encode_b(texts), raw, strict=True)]
        return tokens

    def grouper(self) -> Callable[..., tuple[list[str], np.ndarray, np.ndarray]]:
        size_a, size_b = (np.array([len(t) for t in v.tokens], np.int64) for v in (self.a, self.b))
        n_a, width = len(self.a.tokens), len(self.b.tokens)
        names = [f"{i}{mark}" for mark, n in ((",", n_a), ("|", n_a), (",", width), (";", width)) for i in range(n)]
        name = names.__getitem__

        def groups(pairs: Sequence[tuple[Ids, Ids]]) -> tuple[list[str], np.ndarray, np.ndarray]:
            """Of token lists that end together: their groups written out, all links, and how many each list has."""
            ids_a, ids_b = (np.fromiter(chain.from_iterable(p[k] for p in pairs), np.int64, sum(len(p[k]) for p in pairs)) for k in (0, 1))
            ends_a, ends_b = np.cumsum(size_a[ids_a]), np.cumsum(size_b[ids_b])
            marked = np.zeros((2, int(ends_a[-1]) + 1 if len(ends_a) else 1), bool)
            marked[0, ends_a], marked[1, ends_b] = True, True
            last_a, last_b = marked[1, ends_a], marked[0, ends_b]
            links = np.searchsorted(self.links, ids_a[last_a] * width + ids_b[last_b])
            group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
            upto_a, upto_b = (np.concatenate(([0], np.flatnonzero(last) + 1)) for last in (last_a, last_b))
            written = np.empty(len(ids_a) + len(ids_b), np.int64)
            at_a = np.arange(len(ids_a)) + upto_b[group_a]
            at_b = np.arange(len(ids_b)) + upto_a[group_b + 1]
            written[at_a] = ids_a + n_a * last_a
            written[at_b] = 2 * n_a + ids_b + width * last_b
            ends = np.cumsum([0, *(len(x) + len(y) for x, y in pairs)])
            texts = ["".join(map(name, written[i:j].tolist()))[:-1] for i, j in zip(ends, ends[1:])]
            group_of = np.concatenate((group_a, [len(links)]))
            starts = group_of[np.cumsum([0, *(len(x) for x, _ in pairs)])]
            return texts, links.astype(np.int32), np.diff(starts)
        return groups

    def fragments(self, ids: tuple[Ids, Ids], start: int, length: int) -> Iterator[tuple[int, int, int, Fragment, tuple[Ids, Ids]]]:
        """(first byte, tokens of A, of B, open ends, tokens between the first and the last common end) by ranges of bytes.

        What ends at the start of the document ends there in both, so its first fragment has no head.
        """
        arrays = [np.array(x, np.int64) for x in ids]
        ends = [start + np.cumsum(np.array([len(t) for t in v.tokens], np.int64)[x]) for v, x in zip((self.a, self.b), arrays)]
        common = np.intersect1d(*ends, assume_unique=True)
        chunk = 1 << CHUNK_BITS
        edges = [start, *range(start - start % chunk + chunk, start + length, chunk), start + length]
        for low, high in zip(edges, edges[1:]):
            inside = common[(common > low) & (common <= high)]
            (a0, a1), (b0, b1) = (np.searchsorted(e, [low, high], "right").tolist() for e in ends)
            if a0 == a1 and b0 == b1:
                continue

            def part(first: int | None, last: int | None) -> tuple[Ids, Ids]:
                bounds = [np.searchsorted(e, [low if first is None else first, high if last is None else last], "right") for e in ends]
                return tuple(x[i:j].tolist() for x, (i, j) in zip(arrays, bounds))
            if not len(inside):
                open_ends = Fragment(True, tail=part(None, None)) if low == 0 else Fragment(False, head=part(None, None))
                yield low, a1 - a0, b1 - b0, open_ends, ([], [])
            else:
                head = None if low == 0 else inside[0]
                yield (low, a1 - a0, b1 - b0, Fragment(True, ([], []) if low == 0 else part(None, inside[0]), part(inside[-1], None)),
                       part(head, inside[-1]))


_LINKS = pa.list_(pa.int32())
_ALIGNED = [("n_a", pa.int64()), ("n_b", pa.int64()), ("groups", pa.string()), ("links", _LINKS)]
_ALIGNED_DDL = "n_a long, n_b long, groups string, links array<int>"


def _lists(flat: np.ndarray, counts: Sequence[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(flat, pa.int32()))


def _align_whole(rows: DataFrame, aligner) -> DataFrame:
    """From (doc_id, text): a row for each, texts of up to a segment."""
    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, groups = aligner.value.ready(), aligner.value.grouper()
        for batch in batches:
            for i, j in slices(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist(), BATCH_CHARS):
                texts, pairs = batch.column("text").slice(i, j - i).to_pylist(), [([], [])] * (j - i)
                full = [k for k, text in enumerate(texts) if text]
                for k, pair in zip(full, tokens([" " + texts[k] for k in full]), strict=True):
                    pairs[k] = pair or ([], [])
                written, links, counts = groups(pairs)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), *[pa.array([len(p[k]) for p in pairs], pa.int64()) for k in (0, 1)],
                     pa.array(written, pa.string()), _lists(links, counts)], ["doc_id", *[n for n, _ in _ALIGNED]])
    return rows.mapInArrow(aligned, f"doc_id {dict(rows.dtypes)['doc_id']}, {_ALIGNED_DDL}")


def cut_text(text: str, most: int) -> list[str]:
    """Pieces of blank and text, each starting with a blank: at the first fitting place from ``most`` characters on."""
    text, out, at = " " + text, [], 0
    while found := _CUT.search(text, at + most):
        out.append(text[at:found.start()])
        at = found.start()
    return [*out, text[at:]]


def _segments(rows: DataFrame) -> DataFrame:
    """From (row, text): row, first byte and text of each segment."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                pieces = cut_text(text, SEGMENT)
                starts = np.cumsum([0, *(len(p.encode("utf-8", "surrogatepass")) for p in pieces[:-1])])
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(pieces), pa.int64()), pa.array(starts, pa.int64()),
                                                  pa.array(pieces, pa.string())], ["row", "start", "text"])
    return rows.mapInArrow(cut, "row long, start long, text string")


_ENDS = [("closed", pa.bool_()), ("head_a", _LINKS), ("head_b", _LINKS), ("tail_a", _LINKS), ("tail_b", _LINKS)]
_ENDS_DDL = "closed boolean, head_a array<int>, head_b array<int>, tail_a array<int>, tail_b array<int>"
_FRAGMENT = [("row", pa.int64()), ("start", pa.int64()), ("valid", pa.bool_()), *_ALIGNED, *_ENDS]
_FRAGMENT_DDL = f"row long, start long, valid boolean, {_ALIGNED_DDL}, {_ENDS_DDL}"


def _fragments(segments: DataFrame, aligner) -> DataFrame:
    """Fragments of segments, each with its closed groups and open ends."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, groups = aligner.value.ready(), aligner.value.grouper()
        for batch in batches:
            for segment in batch.to_pylist():
                ids, rows = tokens([segment["text"]])[0], []
                if ids is None:
                    rows.append((segment["row"], segment["start"], False, 0, 0, "", [], False, [], [], [], []))
                else:
                    length = len(segment["text"].encode("utf-8", "surrogatepass"))
                    for start, n_a, n_b, ends, closed in aligner.value.fragments(ids, segment["start"], length):
                        written, links, _ = groups([closed])
                        rows.append((segment["row"], start, True, n_a, n_b, written[0], links.tolist(), ends.closed, *ends.head, *ends.tail))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_FRAGMENT)],
                                                 [n for n, _ in _FRAGMENT])
    return segments.mapInArrow(made, _FRAGMENT_DDL)


_JOINED = pa.list_(pa.struct([("start", pa.int64()), ("groups", pa.string()), ("links", _LINKS)]))


def _composed(nodes: DataFrame, aligner) -> DataFrame:
    """From (row, node, parts): the fragment of all parts, and the groups that close between them."""
    made = [("row", pa.int64()), ("node", pa.int64()), *_ENDS, ("joined", _JOINED)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = aligner.value.grouper()
        for batch in batches:
            rows = []
            for node in batch.to_pylist():
                whole, joined = NONE, []
                for p in node["parts"]:
                    whole, group = compose(whole, Fragment(p["closed"], (p["head_a"], p["head_b"]), (p["tail_a"], p["tail_b"])))
                    if group:
                        written, links, _ = groups([group])
                        joined.append({"start": p["start"], "groups": written[0], "links": links.tolist()})
                rows.append((node["row"], node["node"], whole.closed, *whole.head, *whole.tail, joined))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(made)], [n for n, _ in made])
    return nodes.mapInArrow(run, f"row long, node long, {_ENDS_DDL}, joined array<struct<start:bigint,groups:string,links:array<int>>>")


def _align_long(rows: DataFrame, aligner) -> DataFrame:
    """From (doc_id, text): rows of any length, a task for each segment and a tree over the open ends."""
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()))
    pieces = staged(_fragments(_segments(rows.select("row", "text")).repartition("row", "start"), aligner))
    sums = pieces.groupBy("row").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.every("valid").alias("valid"))
    part = ["start", *[n for n, _ in _ENDS]]
    # Rows that are not valid are left out here, whatever their other segments hold.
    valid = pieces.join(sums.filter("valid").select("row"), "row", "left_semi")
    bodies = valid.filter("groups != ''").select("row", "start", F.lit(1).alias("place"), "groups", "links")
    nodes, bits = valid.select("row", F.col("start").alias("node"), *part), CHUNK_BITS + FAN_BITS
    nodes, n = staged_counted(nodes)
    keys = nodes.select("row").distinct().count()
    while n > keys:
        grouped = (nodes.groupBy("row", F.shiftright("start", bits).alias("up"))
                   .agg(F.sort_array(F.collect_list(F.struct(*part))).alias("parts")).withColumnRenamed("up", "node"))
        done, n = staged_counted(_composed(grouped, aligner))
        bodies = bodies.unionByName(done.select("row", F.inline("joined")).withColumn("place", F.lit(0)))
        nodes, bits = done.withColumn("start", F.shiftleft("node", bits)).drop("joined"), bits + FAN_BITS
    body = F.sort_array(F.collect_list(F.struct("start", "place", "groups", "links")))
    texts = bodies.groupBy("row").agg(body.alias("body")).select(
        "row", F.array_join(F.transform("body", lambda x: x["groups"]), ";").alias("groups"),
        F.flatten(F.transform("body", lambda x: x["links"])).alias("links"))
    zero = F.lit(0).cast("long")
    return (rows.select("row", "doc_id").join(sums, "row").join(texts, "row", "left").select(
        "doc_id", F.when(F.col("valid"), F.col("n_a")).otherwise(zero).alias("n_a"), F.when(F.col("valid"), F.col("n_b")).otherwise(zero).alias("n_b"),
        F.coalesce("groups", F.lit("")).alias("groups"), F.coalesce("links", F.array().cast("array<int>")).alias("links")))


def align(docs: DataFrame, aligner: Aligner, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, groups, links) of every row: groups as ``a1,a2|b1;a3|b2,b3``, links as numbers.

    Blank and text are encoded whole, without special tokens. NULL and empty texts, and texts whose
    bytes a tokenizer doesn't give back, have no tokens. Rows that repeat give a row each, NULL ids
    stay, other columns are ignored, an empty table gives none. Texts over ``SEGMENT`` characters go
    through the tree; their groups meet again only as the row they are returned in.
    """
    shared = docs.sparkSession.sparkContext.broadcast(aligner)
    rows = docs.select(column(docs, id_col).alias("doc_id"), column(docs, text_col).alias("text"))
    long = F.coalesce(F.length("text") > SEGMENT, F.lit(False))
    done = _align_whole(rows.filter(~long), shared)
    if rows.filter(long).isEmpty():
        return done
    return done.unionByName(_align_long(rows.filter(long), shared))


def link_counts(aligned: DataFrame, aligner: Aligner) -> np.ndarray:
    """How often each possible link occurs; one number for each, so bounded by the vocabularies."""
    counts = np.zeros(len(aligner.links), np.int64)
    found = aligned.select(F.explode("links").alias("link")).groupBy("link").count().toArrow()
    counts[found["link"].to_numpy()] = found["count"].to_numpy()
    return counts


def with_link_scores(aligned: DataFrame, aligner: Aligner) -> DataFrame:
    """All columns but ``links``, and n_links, n_best, count_sum: links, those whose count is the
    highest that their token of B has in the table, and the sum of their counts.

    ``aligned`` is read twice, so it should be staged.
    """
    counts = link_counts(aligned, aligner)
    highest = np.zeros(len(aligner.b.tokens), np.int64)
    token = aligner.links % len(aligner.b.tokens)
    np.maximum.at(highest, token, counts)
    shared = aligned.sparkSession.sparkContext.broadcast((counts, counts == highest[token]))
    kept = [f for f in aligned.schema.fields if f.name != "links"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = shared.value
        for batch in batches:
            links = batch.column("links")
            flat = links.flatten().to_numpy(zero_copy_only=False)
            n = pc.list_value_length(links).to_numpy(zero_copy_only=False)
            ends = np.cumsum([0, *n])
            sums = [np.concatenate(([0], np.cumsum(x)))[ends] for x in (best[flat].astype(np.int64), counts[flat])]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(n, pa.int64()), *[pa.array(np.diff(s), pa.int64()) for s in sums]],
                                             [*[f.name for f in kept], "n_links", "n_best", "count_sum"])
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return aligned.mapInArrow(scored, f"{names}, n_links long, n_best long, count_sum long")
