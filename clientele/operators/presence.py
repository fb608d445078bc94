"""Which members are in which cell, as exact bitmaps that roll up.

Members get numbers, and a cell holds a bitmap for each bucket of 32 768 numbers. Bitmaps of one bucket
unite by OR, and buckets have no member in common, so distinct members of any union of cells are a sum of
bit counts: no pairs of member and cell are shuffled again for a coarser report.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.config import MEMBER
from clientele.operators.reports import TAG
from clientele.sources.staging import staged


def numbered(tags: DataFrame) -> DataFrame:
    """(member, tag, bucket, position): tasks number their members one after the other, so buckets are full but the last of each task.

    Stored, so that a number stays a member's whatever is computed again. One row per member is expected.
    """
    number = F.monotonically_increasing_id()
    return staged(tags.select(MEMBER, TAG, number.alias("number"))).select(
        MEMBER, TAG, F.bitmap_bucket_number("number").alias("bucket"), F.bitmap_bit_position("number").alias("position"))


def presence(rows: DataFrame, members: DataFrame, by: Iterable[str]) -> DataFrame:
    """(by, tag, bucket, bitmap) from rows reduced to one per member and cell; members without a number are left out."""
    return (rows.join(members, MEMBER).groupBy(*by, TAG, "bucket")
            .agg(F.bitmap_construct_agg("position").alias("bitmap")))


def distinct_members(cells: DataFrame, by: dict[str, Column]) -> DataFrame:
    """Distinct members of unions of cells: columns named by ``by``, the tag, and ``members``."""
    united = (cells.select(*[c.alias(n) for n, c in by.items()], TAG, "bucket", "bitmap")
              .groupBy(*by, TAG, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap")))
    return united.groupBy(*by, TAG).agg(F.sum(F.bitmap_count("bitmap")).alias("members"))


def cell_members(rows: DataFrame, tags: DataFrame, by: Iterable[str]) -> DataFrame:
    """Members of cells that nothing is rolled up from, as ``distinct_members`` would have them.

    ``rows`` are reduced to one per member and cell, so they are counted. For cells with few members each: of these, each
    member would take a bitmap of its own, 4 KB for a bit.
    """
    return rows.join(tags.select(MEMBER, TAG), MEMBER).groupBy(*by, TAG).agg(F.count(F.lit(1)).alias("members"))
