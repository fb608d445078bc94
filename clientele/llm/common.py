"""What the operators share: word patterns, row keys, readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.sources.staging import staged

# What separates words.
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
# Places of a bit map of keys.
MAP_BITS = 24


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """Words between white space; NULL has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def row_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Names a row by id and text, NULLs included; rows equal in both share it."""
    return F.struct(column(df, id_col).alias("id"), F.xxhash64(column(df, text_col)).alias("h"))


def column(df: DataFrame, name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, *more: Column) -> DataFrame:
    """The whole row as one column ``row``, so that no column name can clash."""
    return df.select(F.struct(*[column(df, c) for c in df.columns]).alias("row"), *more)


def unpacked(df: DataFrame, columns: list[str], **replaced: Column) -> DataFrame:
    """The columns of ``row`` again, some replaced."""
    return df.select(*[replaced[c].alias(c) if c in replaced
                       else F.col("row").getField(c).alias(c) for c in columns])


def _word(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << MAP_BITS)).cast("int")


def bit_map(keys: DataFrame) -> DataFrame:
    """Which of 2**MAP_BITS places the keys of ``keys(key)`` take: 64 places a row, so 2**(MAP_BITS - 6) rows at most."""
    place = keys.select(_word(F.col("key")).alias("place"))
    return (place.groupBy(F.shiftright("place", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, place & 63)")).alias("bits")))


def possible(rows: DataFrame, key: Column, table: DataFrame) -> DataFrame:
    """``rows`` with a column ``possible``: false where the key surely is not among those of the map.

    The map has a fixed size, so it is sent to all tasks whatever the number of keys; a full one
    only spares nothing.
    """
    place = _word(key)
    return (rows.withColumn("word", F.shiftright(place, 6)).withColumn("bit", place.bitwiseAND(63))
            .join(F.broadcast(table), "word", "left")
            .withColumn("possible", F.coalesce(F.expr("shiftrightunsigned(bits, bit) & 1L") == 1, F.lit(False)))
            .drop("word", "bit", "bits"))


def without(docs: DataFrame, rejected: DataFrame, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose key is not in ``rejected(key)``, which should be staged.

    Only rows that may be rejected, by a bit map, meet the keys in a join; the others stay where they are.
    """
    rows = possible(packed(docs, row_key(docs, id_col, text_col).alias("key")), F.col("key"), staged(bit_map(rejected)))
    doubtful = rows.filter("possible").join(rejected.select("key"), "key", "left_anti")
    return unpacked(rows.filter("not possible").select("row").unionByName(doubtful.select("row")), docs.columns)
