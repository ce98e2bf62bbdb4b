"""Exact distinct counts that merge: numbers of ids as bitmaps by bucket, one long for each 64 numbers.

So a group takes no more than a number for each of its ids where these lie far apart, and a bit for each where they are dense.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers that ids of one hash may take, in a row.
BUCKET = 32_768


def number_ids(ids: DataFrame, column: str, expected: int | None = None) -> DataFrame:
    """Dense numbers for ids of any type: (column, number). Ids are dealt to buckets by hash and numbered within theirs.

    ``expected`` is the number of different ids; it is counted where it isn't given. A bucket gets ids for a quarter of its numbers, so that
    none overflows; one that did would go on in numbers of its own, past all others.
    """
    distinct = ids.select(column).where(F.col(column).isNotNull()).distinct()
    n = distinct.count() if expected is None else expected
    buckets = max(1, -(-4 * n // BUCKET))
    dealt = distinct.withColumn("_b", F.pmod(F.xxhash64(column), F.lit(buckets)))
    nth = F.row_number().over(Window.partitionBy("_b").orderBy(column)) - 1
    turn = F.floor(nth / BUCKET)
    return dealt.withColumn("number", ((F.col("_b") + turn * buckets) * BUCKET + F.pmod(nth, F.lit(BUCKET))).cast("long")).drop("_b")


def bucket(number: Column) -> Column:
    return F.shiftright(number.cast("long"), 6)


def bitmap(number: Column) -> Column:
    """The numbers of a group of one bucket; group by :func:`bucket` as well."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), number.cast("long").bitwiseAND(63).cast("int")))


def bitmaps(rows: DataFrame, keys: list[str | Column], number: str, *aggregates: Column) -> DataFrame:
    """Keys, bucket and bitmap of the numbers of each group, with further aggregates of its rows. Rows without a number go to bucket null."""
    return rows.groupBy(*keys, bucket(F.col(number)).alias("bucket")).agg(bitmap(F.col(number)).alias("bitmap"), *aggregates)


def merged(parts: DataFrame, keys: list[str | Column], *aggregates: Column) -> DataFrame:
    """Bitmaps of groups as bitmaps of groups of these: distinct over all of them, without the rows."""
    return parts.groupBy(*keys, "bucket").agg(F.bit_or("bitmap").alias("bitmap"), *aggregates)


def counted(parts: DataFrame, keys: list[str | Column], name: str, *aggregates: Column) -> DataFrame:
    """The number of different ids of each group of bitmaps that are already one for each bucket."""
    return parts.groupBy(*keys).agg(F.sum(F.when(F.col("bucket").isNotNull(), F.bit_count("bitmap")).otherwise(0)).cast("long").alias(name), *aggregates)
