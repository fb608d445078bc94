"""Benchmark decontamination by winnowing.

Of every window of 9 neighbouring 5-word hashes the least is a fingerprint (the last
one of equals), so any 13 words that two texts share hold a fingerprint of both at the
same place. Items shorter than 13 words are fingerprinted whole. Fingerprints are joined
with the words around them, and each hit is extended to the run of equal words, which
must reach 13 words or the whole item.

A bit map of fixed size, filled from the benchmark's fingerprints, goes to all tasks
and spares those of the corpus that cannot match; all others meet in the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm.common import column, row_key, without
from clientele.llm.hashing import LETTERS_AND_DIGITS, gram_hashes, word_hashes
from clientele.sources.staging import staged

SPAN = 13
GRAM = 5
WINDOW = SPAN - GRAM + 1
MAP_BITS = 23

_MARK = [("fingerprint", pa.int64()), ("length", pa.int32()), ("at", pa.int32()),
         ("before", pa.list_(pa.int64())), ("after", pa.list_(pa.int64()))]
_DDL = "fingerprint: bigint, length: int, at: int, before: array<bigint>, after: array<bigint>"


def fingerprints(grams: np.ndarray) -> np.ndarray:
    """Places of the least hash of each window, the last of equals."""
    if len(grams) < WINDOW:
        return np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)[:, ::-1]
    return np.unique(np.arange(len(windows)) + WINDOW - 1 - windows.argmin(axis=1))


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def _marks(words: np.ndarray, places: np.ndarray, grams: np.ndarray, short: bool) -> list[dict]:
    """Fingerprints with the words on both sides, as far as a run through them may count.

    Whole short items have a negative length, which keeps them apart from 5-word grams.
    """
    length, words = len(words) - len(grams) + 1, words.view(np.int64)
    reach = 0 if short else SPAN - length
    return [{"fingerprint": int(grams[p].view(np.int64)), "length": -length if short else length, "at": int(p),
             "before": words[max(0, p - reach):p][::-1].tolist(),
             "after": words[p + length:p + length + reach].tolist()} for p in places]


def _item_marks(items: DataFrame) -> DataFrame:
    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = word_hashes(text, LETTERS_AND_DIGITS)
                if len(words) >= SPAN:
                    grams = gram_hashes(words, GRAM)
                    found = _marks(words, fingerprints(grams), grams, short=False)
                else:
                    found = _marks(words, [0], gram_hashes(words, len(words)), short=True) if len(words) else []
                rows += [{"item": item} | m for m in found]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("item", pa.string()), *_MARK]))
    return items.mapInArrow(marked, f"item string, {_DDL}")


def bit_map(fingerprint_table: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Which slots the fingerprints take, and the lengths of short items.

    The map has 2**MAP_BITS bits whatever the number of fingerprints; it comes to the
    driver as words of 64 bits, of which there are 2**(MAP_BITS - 6) at most.
    """
    slot = F.shiftrightunsigned("fingerprint", 64 - MAP_BITS)
    words = (fingerprint_table.select(slot.alias("slot"))
             .groupBy(F.shiftright("slot", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).collect())
    bits = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    for row in words:
        bits[row["word"]] = np.uint64(row["bits"] & ((1 << 64) - 1))
    lengths = fingerprint_table.filter("length < 0").select("length").distinct().collect()
    return bits, sorted(-r["length"] for r in lengths)


def _doc_marks(docs: DataFrame, bits, lengths: list[int]) -> DataFrame:
    """From (id, h, text), per row: number of words and the fingerprints whose slot is taken."""
    marks_type = pa.list_(pa.struct(_MARK))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = bits.value

        def hit(grams: np.ndarray) -> np.ndarray:
            slots = _slots(grams)
            return (taken[slots >> 6] >> (slots & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        for batch in batches:
            counts, marks = [], []
            for text in batch.column("text"):
                words = word_hashes(text.as_py(), LETTERS_AND_DIGITS)
                grams, found = gram_hashes(words, GRAM), []
                if (possible := hit(grams)).any():
                    places = fingerprints(grams)
                    found = _marks(words, places[possible[places]], grams, short=False)
                for n in lengths:
                    whole = gram_hashes(words, n)
                    found += _marks(words, np.flatnonzero(hit(whole)), whole, short=True)
                counts.append(len(words))
                marks.append(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("h"), pa.array(counts, pa.int64()), pa.array(marks, marks_type)],
                ["id", "h", "n_words", "marks"])
    return docs.mapInArrow(marked, f"id {dict(docs.dtypes)['id']}, h long, n_words long, marks array<struct<{_DDL}>>")


def contamination(docs: DataFrame, benchmark: DataFrame, percent: int = 5, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: n_words, n_hit, items that occur in it, and whether it is contaminated.

    A word is hit inside any 13 words in a row, or any shorter whole item, that an item
    holds too. A document is contaminated if ``percent`` of its words are hit, and one at
    least. NULL and empty texts have no words; rows equal in id and text are one row of
    the result each, with equal values; items equal in text all count; items without an
    id are left out of ``items`` but hit words. Other columns are ignored; an empty table on
    either side gives no hits.
    """
    spark = docs.sparkSession
    tests = benchmark.select(column(benchmark, item_col).cast("string").alias("item"),
                             column(benchmark, item_text_col).alias("text"))
    marks = staged(_item_marks(tests))
    bits, lengths = bit_map(marks)
    key = row_key(docs, id_col, text_col)
    rows = docs.select(key.getField("id").alias("id"), key.getField("h").alias("h"), column(docs, text_col).alias("text"))
    seen = staged(_doc_marks(rows, spark.sparkContext.broadcast(bits), lengths))
    hits = (seen.filter(F.size("marks") > 0).dropDuplicates(["id", "h"])
            .select("id", "h", F.inline("marks"))
            .join(marks.select("item", "fingerprint", "length", F.col("before").alias("b"), F.col("after").alias("a")),
                  ["fingerprint", "length"]))

    def equal(x: str, y: str):
        """How many words agree before the first that does not."""
        same = F.transform(F.sequence(F.lit(1), F.least(F.size(x), F.size(y))), lambda i: F.element_at(x, i) == F.element_at(y, i))
        n = F.least(F.size(x), F.size(y))
        return F.when(n == 0, 0).otherwise(F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, n)).cast("int")
    size = F.abs("length")
    runs = (hits.withColumns({"left": equal("before", "b"), "right": equal("after", "a")})
            .filter((F.col("length") < 0) | (F.col("left") + size + F.col("right") >= SPAN))
            .select("id", "h", "item", (F.col("at") - F.col("left")).alias("start"),
                    (F.col("at") + size + F.col("right")).alias("end")))
    runs = staged(runs)
    key = F.struct("id", "h").alias("key")
    covered = (runs.select("id", "h", "start", "end").distinct()
               .select("id", "h", F.explode(F.sequence("start", F.col("end") - 1)).alias("word")).distinct()
               .groupBy("id", "h").agg(F.count(F.lit(1)).alias("n_hit")).select(key, "n_hit"))
    items = (runs.select("id", "h", "item").distinct().groupBy("id", "h")
             .agg(F.sort_array(F.collect_list("item")).alias("items")).select(key, "items"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    return (seen.select(key, "id", "n_words").join(covered, "key", "left").join(items, "key", "left")
            .select(F.col("id").alias("doc_id"), F.col("key.h").alias("text_hash"), "n_words", n_hit.alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                    ((n_hit > 0) & (100 * n_hit >= percent * F.col("n_words"))).alias("contaminated")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 5, id_col: str = "doc_id",
                      text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the contaminated ones; all columns as they were."""
    judged = contamination(docs, benchmark, percent, id_col, text_col, **options)
    bad = judged.filter("contaminated").select(F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("h")).alias("key"))
    return without(docs, staged(bad.distinct()), id_col, text_col)
