"""Quality rules: thresholds that adapt to language and source.

Every document gets a few integer rates. Their distributions, and those of the sizes they
refer to, are kept as mergeable sketches: counts per bin, bins being exact below 32 and a
sixteenth of a power of two wide above, so any quantile is off by a sixteenth of its value
at most. Sketches add up, from (language, source) to language to everything, and do not
depend on the order in which rows arrive. Quartiles of a source shrink to those of its
language, and these to those of all documents, by their numbers of documents. A threshold
lies some times the distance of the lower quartile and the median away from the median, as
both stay in place while less than half of a source is junk. On top, a document may
deviate by a few single events (a symbol, a repeated line) in its own size, or in
the median size of its source if it is longer. Documents meet their thresholds by a join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientele.llm.common import SPACE_CHARS, column, row_key, unpacked, words
from clientele.operators.skew import lookup_join
from clientele.sources.staging import staged

# Characters that count as symbols, and the base rule.
SYMBOLS = "[#*$%&|<>]+"
MIN_WORDS = 10
GRAM = 5
MAX_REPEAT_PERCENT = 20


@dataclass(frozen=True)
class Rate:
    """Parts in ``times`` units of ``size``; the parts of one event; whether low rates are odd as well."""
    name: str
    times: int
    size: str
    event: int
    low: bool = False

    def of(self, parts: str) -> Column:
        return F.when(F.col(self.size) > 0, F.expr(f"{self.times} * {parts} div {self.size}")).otherwise(0)


LEVELS = ("own", "lang", "all")
RATES = (
    Rate("symbol_rate", 1000, "n_words", 1),
    Rate("dup_line_rate", 1000, "n_lines", 1),
    Rate("repeat_rate", 1000, "n_words", 2 * GRAM),  # a window and its repetition
    Rate("upper_rate", 1000, "word_chars", 1),       # capitals A-Z
    Rate("word_length", 100, "n_words", 10, low=True),  # characters; one odd word has ten more or less
)
SIZES = ("n_words", "n_lines", "word_chars")
# Distances of lower quartile and median, and single events, by which a document may deviate.
FENCE = 8
EVENTS = 5
# Documents by which the wider sketch weighs when quartiles shrink to it.
STRENGTH = 50
CUTS = [f"{r.name}_{side}" for r in RATES for side in ("low", "high")] + [f"{s}_typical" for s in SIZES]


def _repeated(grams: Column) -> Column:
    """Words covered by windows that occur twice or more, given the windows' hashes."""
    def positions(s):  # s: (hash, position) in order, so equal windows are neighbours
        last = F.size(s) - 1
        same = lambda i, j: s[i].getField("g") == s[j].getField("g")
        twin = lambda x, i: (F.when(i > 0, same(i - 1, i)).otherwise(False)
                             | F.when(i < last, same(i + 1, i)).otherwise(False))
        return F.sort_array(F.transform(F.filter(s, twin), lambda x: x.getField("i")))
    ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    # An array of one element binds the sorted list to a name, so it is built once.
    found = F.transform(F.array(ordered), positions).getItem(0)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    add = lambda acc, p: F.struct(
        (acc.getField("n") + p + GRAM - F.greatest(p, acc.getField("end"))).alias("n"),
        (p + GRAM).alias("end"))
    return F.aggregate(found, start, add, lambda acc: acc.getField("n")).cast("long")


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               lang_col: str = "lang", source_col: str = "source", whole_rows: bool = False) -> DataFrame:
    """Counts and rates of every whole text, with key, id, lang and source, and the rows themselves if asked for.

    NULL and empty texts have no words and rates of 0.
    """
    text = F.coalesce(column(docs, text_col), F.lit(""))
    rows = [F.struct(*[column(docs, c) for c in docs.columns]).alias("row")] if whole_rows else []
    base = docs.select(*rows, row_key(docs, id_col, text_col).alias("key"), column(docs, id_col).alias("doc_id"),
                       column(docs, lang_col).alias("lang"), column(docs, source_col).alias("source"),
                       text.alias("text"), words(text).alias("words"))
    n = F.size("words")
    gram = lambda i: F.xxhash64(*[F.col("words")[i + j] for j in range(GRAM)])
    carried = ["row"] if whole_rows else []
    kept = base.select(
        *carried, "key", "doc_id", "lang", "source", n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(SPACE_CHARS)) != "").alias("lines"),
        F.when(n >= GRAM, F.transform(F.sequence(F.lit(0), n - GRAM), gram))
        .otherwise(F.array().cast("array<bigint>")).alias("grams"))
    stats = kept.select(
        *carried, "key", "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_upper",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("grams")) < F.size("grams"), _repeated(F.col("grams")))
        .otherwise(0).cast("long").alias("n_repeat_words"))
    parts = ("n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "word_chars")
    return stats.withColumns({
        **{r.name: r.of(part) for r, part in zip(RATES, parts, strict=True)},
        "base_failed": (F.col("n_words") < MIN_WORDS)
        | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))})


def sketch(stats: DataFrame) -> DataFrame:
    """Counts per (lang, source, rate, bin) of documents that pass the base rule; sizes count as rates, too."""
    v = F.col("v")
    shift = F.length(F.bin(v)) - 5
    rates = F.array(*[F.struct(F.lit(name).alias("rate"), F.col(name).cast("long").alias("v"))
                      for name in (*[r.name for r in RATES], *SIZES)])
    return (stats.filter(~F.col("base_failed"))
            .select("lang", "source", F.inline(rates))
            .groupBy("lang", "source", "rate",
                     F.when(v < 32, v).otherwise(16 * shift + F.expr("shiftright(v, length(bin(v)) - 5)"))
                     .cast("int").alias("bin"))
            .agg(F.count(F.lit(1)).alias("n")))


def _upper_edge(bin_: Column) -> Column:
    return (F.when(bin_ < 32, bin_.cast("long"))
            .otherwise(F.expr("shiftleft(bin - 16 * (bin div 16 - 1) + 1L, cast(bin div 16 - 1 as int)) - 1")))


def thresholds(sketches: DataFrame, fence: int = FENCE, strength: int = STRENGTH) -> DataFrame:
    """Per (lang, source): for each rate ``<rate>_low`` and ``<rate>_high``, for each size ``<size>_typical``, its median.

    A source of n documents counts n times, its language ``strength`` times; likewise a
    language among all documents. So small groups follow the wider ones, without a switch.
    """
    own = sketches.withColumn("level", F.lit("own"))
    lang = (sketches.groupBy("lang", "rate", "bin").agg(F.sum("n").alias("n"))
            .withColumns({"level": F.lit("lang"), "source": F.lit(None).cast("string")}))
    every = (lang.groupBy("rate", "bin").agg(F.sum("n").alias("n"))
             .withColumns({"level": F.lit("all"), "lang": F.lit(None).cast("string"),
                           "source": F.lit(None).cast("string")}))
    group = Window.partitionBy("level", "lang", "source", "rate")
    run = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cumulated = (own.unionByName(lang).unionByName(every)
                 .withColumns({"below": F.sum("n").over(run), "total": F.sum("n").over(group),
                               "edge": _upper_edge(F.col("bin"))}))
    quartile = lambda k: F.min(F.when(4 * F.col("below") >= k * F.col("total"), F.col("edge")))
    found = cumulated.groupBy("level", "lang", "source", "rate", "total").agg(quartile(1).alias("q1"), quartile(2).alias("q2"))
    at = {x: found.filter(F.col("level") == x).select("lang", "source", "rate", *[F.col(c).alias(f"{x}_{c}") for c in ("total", "q1", "q2")])
          for x in LEVELS}

    def shrunk(level: str, wide: str, q: str) -> Column:
        return F.expr(f"({level}_total * {level}_{q} + {strength} * {wide}_{q}) div ({level}_total + {strength})")
    by_lang = (at["lang"].drop("source").join(F.broadcast(at["all"].drop("lang", "source")), "rate")
               .select(F.col("lang").alias("l"), F.col("rate").alias("r"), *[shrunk("lang", "all", q).alias(f"wide_{q}") for q in ("q1", "q2")]))
    groups = (at["own"].join(by_lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("rate") == F.col("r")))
              .select("lang", "source", "rate", *[shrunk("own", "wide", q).alias(q) for q in ("q1", "q2")]))
    spread = fence * (F.col("q2") - F.col("q1"))
    of = lambda name, value: F.max(F.when(F.col("rate") == name, value))
    sides = [side for r in RATES for side in (of(r.name, F.col("q2") - spread if r.low else F.lit(None).cast("long")).alias(f"{r.name}_low"),
                                              of(r.name, F.col("q2") + spread).alias(f"{r.name}_high"))]
    return groups.groupBy("lang", "source").agg(*sides, *[of(s, F.col("q2")).alias(f"{s}_typical") for s in SIZES])


def quality_verdicts(docs: DataFrame, fence: int = FENCE, strength: int = STRENGTH, **columns: str) -> DataFrame:
    """One row per document: counts, rates, ``base_failed`` and ``kept``.

    A document is kept if it passes the base rule and every rate lies within its
    thresholds. NULL and empty texts fail the base rule; very long texts are read whole; NULL language or source is a
    group of its own; rows equal in id and text get equal verdicts; other columns are
    ignored. An empty table gives an empty result.
    """
    return _judged(staged(text_stats(docs, **columns)), fence, strength)


def _judged(stats: DataFrame, fence: int, strength: int) -> DataFrame:
    """``stats`` with ``kept``; each row meets the thresholds of its group, no rows meet each other."""
    group = F.struct("lang", "source").alias("group")
    cuts = thresholds(sketch(stats), fence, strength).select(group, *CUTS)
    inside = ~F.col("base_failed")
    for r in RATES:
        step = F.expr(f"{EVENTS * r.times * r.event} div greatest(1, least({r.size}, {r.size}_typical))")
        inside &= F.col(r.name) <= F.col(f"{r.name}_high") + step
        if r.low:
            inside &= F.col(r.name) >= F.col(f"{r.name}_low") - step
    return (lookup_join(stats.withColumn("group", group), cuts, "group", profile=stats.select(group))
            .withColumn("kept", F.coalesce(inside, F.lit(False))).select(*stats.columns, "kept"))


def keep_good(docs: DataFrame, fence: int = FENCE, strength: int = STRENGTH, **columns: str) -> DataFrame:
    """``docs`` without the documents that the rules reject; all columns as they were."""
    judged = _judged(staged(text_stats(docs, whole_rows=True, **columns)), fence, strength)
    return unpacked(judged.filter("kept").select("row"), docs.columns)
