"""Line dedup: repeated runs of lines found in a suffix array over line ids.

Texts become sequences of line ids (a piece is a line with a word, with any blank lines
after it). Suffixes are ranked by distributed prefix doubling: rank k orders suffixes by
their first 2^k lines and is made from pairs (rank k-1 here, rank k-1 at 2^(k-1) lines
on) by a range sort of the distinct pairs. Suffixes of one rank form the interval of the
suffix array whose longest common prefix is 2^k lines at least; an interval for any
length m between 2^k and 2^(k+1) is named by the ranks k at its start and at m - 2^k.

A maximal repeated run counts if it holds ``min_words`` words. It is the union of the
shortest stretches of ``min_words`` words that start or end at its lines and lie within
it, so only intervals for those stretches are looked up, and ranks longer than the
longest of them are never made. Suffixes that are alone in their interval drop out
at once. In each interval the first place in order of (id, line) is the original, and
the lines of all others are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientele.llm.common import SPACE_CHARS, column, packed, row_key, unpacked
from clientele.sources.staging import staged

MIN_WORDS = 20
# A line end before a line with a word.
PIECE_END = r"\n(?=[\x20\x09\x0B-\x0D]*[^\x20\x09-\x0D])"

# Places are compared by id (NULL last), then text hash, then line.
PLACE = ("no_id", "id", "h", "line")


def pieces(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), PIECE_END)


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line with a word: place, words and a 128-bit id of the trimmed line."""
    key = row_key(docs, id_col, text_col)
    id_ = column(docs, id_col)
    no_id = F.lit("0").cast(docs.schema[id_col].dataType)
    spread = docs.select(id_.isNull().alias("no_id"), F.coalesce(id_, no_id).alias("id"),
                         key.getField("h").alias("h"), F.posexplode(pieces(column(docs, text_col))).alias("line", "piece"))
    text = F.trim(F.col("piece"), F.lit(SPACE_CHARS))
    return (spread.select(*PLACE, F.regexp_count("piece", F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
                          F.xxhash64(text).alias("a"), F.xxhash64(F.lit("line"), text).alias("b"))
            .filter(F.col("words") > 0))


def _ranked(pairs: DataFrame) -> DataFrame:
    """Ranks in sorted order, and first places, of the pairs (a, b) found at two places or more.

    Ids that grow along a range sort are the ranks; written at once, so they stay.
    """
    shared = (pairs.groupBy("a", "b")
              .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*PLACE)).alias("first"))
              .filter(F.col("n") > 1))
    return staged(shared.sort("a", "b").select("a", "b", "first", F.monotonically_increasing_id().alias("rank")))


def _place() -> Column:
    return F.struct(*PLACE)


def later_copies(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Stretches of lines that repeat an earlier place: (no_id, id, h, line, length), may overlap.

    ``lines`` must be stored, as it is read more than once.
    """
    ranks = _ranked(lines.select("a", "b", *PLACE))
    shared = lines.join(ranks, ["a", "b"]).select(*PLACE, "words", "rank", "first")
    shared = staged(shared)
    doc = ["no_id", "id", "h"]
    long_lines = (shared.filter((F.col("words") >= min_words) & (_place() > F.col("first")))
                  .select(*PLACE, F.lit(1).alias("length")))

    # Shorter lines need neighbours: blocks of adjacent shared lines of one document.
    by_doc = Window.partitionBy(*doc).orderBy("line")
    block = Window.partitionBy(*doc, "block").orderBy("line")
    # Rows equal in id and text are one document here: each line once.
    once = shared.select(*PLACE, "words", "rank").distinct()
    here = once.withColumn("block", F.col("line") - F.row_number().over(by_doc))

    def shortest(side: str) -> Column:
        """How many of the next lines, nearest first, make up min_words; else NULL."""
        zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"))
        step = lambda acc, x: F.when(acc.getField("sum") >= min_words, acc).otherwise(
            F.struct((acc.getField("sum") + x).alias("sum"), (acc.getField("n") + 1).alias("n")))
        done = lambda acc: F.when(acc.getField("sum") >= min_words, acc.getField("n"))
        return F.when(F.col("words") < min_words, F.aggregate(side, zero, step, done))

    # Every line has a word, so min_words lines always suffice.
    back = Window.partitionBy(*doc, "block").orderBy(F.col("line").desc())
    both = (here.withColumns({"next": F.collect_list("words").over(block.rowsBetween(0, min_words - 1)),
                              "previous": F.collect_list("words").over(back.rowsBetween(0, min_words - 1))})
            .withColumns({"length": shortest("next"), "length_back": shortest("previous")}))
    both = staged(both.select(*PLACE, "block", "rank", "length", "length_back"))
    starts = both.filter(F.col("length").isNotNull()).select(*PLACE, "length", F.lit(0).alias("side"))
    ends = both.filter(F.col("length_back").isNotNull()).select(
        *doc, (F.col("line") - F.col("length_back") + 1).alias("line"), F.col("length_back").alias("length"), F.lit(1).alias("side"))
    wanted = staged(starts.unionByName(ends))
    longest = wanted.agg(F.max("length").alias("m")).first()["m"]

    found = [long_lines]
    level, size = both.select(*PLACE, "block", "rank"), 1
    while longest is not None and size <= longest:
        far = F.collect_list(F.struct("line", "rank")).over(block.rowsBetween(0, size - 1))
        stretch = (level.withColumn("far", far)
                   .join(wanted.filter((F.col("length") >= size) & (F.col("length") < 2 * size)), [*doc, "line"])
                   .withColumn("second", F.get(F.filter(
                       "far", lambda x: x.getField("line") == F.col("line") + F.col("length") - size), F.lit(0)).getField("rank"))
                   .filter(F.col("second").isNotNull()))
        group = ["side", "length", F.col("rank").alias("a"), F.col("second").alias("b")]
        first = stretch.groupBy(*group).agg(F.min(_place()).alias("first"))
        found.append(stretch.select(*PLACE, *group).join(first, ["side", "length", "a", "b"])
                     .filter(_place() > F.col("first")).select(*PLACE, "length"))
        if 2 * size > longest:
            break
        # Adjacent suffixes may have dropped out, so the neighbour is found by its line.
        ahead = level.select(*doc, (F.col("line") - size).alias("line"), F.col("rank").alias("b"))
        pairs = level.withColumnRenamed("rank", "a").join(ahead, [*doc, "line"])
        level = staged(pairs.join(_ranked(pairs), ["a", "b"]).select(*PLACE, "block", "rank"))
        size *= 2
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def deleted_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Per document with a deletion: key and the sorted numbers of its deleted pieces."""
    lines = staged(line_table(docs, id_col, text_col))
    runs = later_copies(lines, min_words)
    return (runs.select("no_id", "id", "h", F.explode(F.sequence("line", F.col("line") + F.col("length") - 1)).alias("line"))
            .groupBy("no_id", "id", "h").agg(F.sort_array(F.collect_set("line")).alias("deleted"))
            .select(F.struct(F.when(~F.col("no_id"), F.col("id")).alias("id"), "h").alias("key"), "deleted"))


def _cleaned(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    deleted = staged(deleted_lines(docs, min_words, id_col, text_col))
    rows = packed(docs, row_key(docs, id_col, text_col).alias("key"))
    text = F.col("row").getField(text_col)
    kept = F.filter(pieces(text), lambda x, i: ~F.array_contains("deleted", i))
    # Texts are shuffled once at every size: how the plan grows doesn't hang on a broadcast limit.
    return rows.join(deleted.hint("shuffle_hash"), "key", "left").withColumn(
        "text", F.when(F.col("deleted").isNull(), text).otherwise(F.array_join(kept, "\n")))


def line_report(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One row per document: lines with a word, those deleted, their numbers, the text left.

    Lines are compared without white space around them. NULL texts stay NULL with no lines. Of equal
    texts the smallest id is the original, NULL ids come last; rows equal in id and text
    count once and are treated alike. An empty table gives an empty result.
    """
    done = _cleaned(docs, min_words, id_col, text_col)
    n = F.size(F.filter(pieces(F.col("row").getField(text_col)), lambda x: F.trim(x, F.lit(SPACE_CHARS)) != ""))
    none = F.array().cast("array<int>")
    return done.select(F.col("key.id").alias("doc_id"), n.cast("long").alias("n_lines"),
                       F.size(F.coalesce("deleted", none)).cast("long").alias("n_deleted"),
                       F.coalesce("deleted", none).alias("deleted"), "text")


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id",
                        text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with later copies deleted from the texts; a text that loses its last word goes.

    Other columns stay, but for ``length_col``, if there is one, which follows the text.
    """
    done = _cleaned(docs, min_words, id_col, text_col)
    gone = F.col("deleted").isNotNull() & (F.trim(F.col("text"), F.lit(SPACE_CHARS)) == "")
    new = {text_col: F.col("text")}
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        new[length_col] = F.when(F.col("deleted").isNull(), F.col("row").getField(length_col)).otherwise(
            F.length("text").cast(kind))
    return unpacked(done.filter(~gone), docs.columns, **new)
