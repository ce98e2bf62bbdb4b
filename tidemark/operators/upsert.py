"""Upserts without a changelog: versions of a key are rows, the latest one is the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The row of the greatest version of each key. A maximum of structs, so it is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    top = F.max(F.struct(*version, *[c for c in rest if c not in version])).alias("_row")
    return rows.groupBy(*keys).agg(top).select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def upsert_parquet(spark: SparkSession, batch: DataFrame, path: str, keys: list[str], version: list[str], batch_id: int, *by: str) -> None:
    """Writes a batch's latest rows as the directory ``kind=batch/batch=<id>``, in folders by the columns ``by``; a repeated batch overwrites itself.

    :func:`read_upserts` gives the table, and :func:`compact_upserts` keeps it from rereading every version.
    """
    latest_per_key(batch, keys, version).write.mode("overwrite").partitionBy(*by).parquet(f"{path}/kind=batch/batch={batch_id}")


def compact_upserts(spark: SparkSession, path: str, keys: list[str], version: list[str]) -> None:
    """Writes what all batches so far leave as ``kind=base/batch=<the last of them>``; from then on they are not read.

    A compaction that is run again replaces itself. What it replaces may be removed when no reader uses it any more.
    """
    rows = _unread(spark, path)
    last = rows.agg(F.max("batch")).first()[0]
    _latest(rows, keys, version).write.mode("overwrite").parquet(f"{path}/kind=base/batch={last}")


def _unread(spark: SparkSession, path: str) -> DataFrame:
    """The last base and the batches after it, by their directories alone."""
    rows = spark.read.option("basePath", path).parquet(path)
    base = rows.where("kind = 'base'").agg(F.max("batch")).first()[0]
    return rows if base is None else rows.where(((F.col("kind") == "base") & (F.col("batch") == base)) | ((F.col("kind") == "batch") & (F.col("batch") > base)))


def _latest(rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    return latest_per_key(rows.drop("kind"), keys, [*version, "batch"]).drop("batch")


def read_upserts(spark: SparkSession, path: str, keys: list[str], version: list[str], only: Column | None = None) -> DataFrame:
    """The table, or its rows that ``only`` holds for; of equal versions the later batch wins."""
    rows = _unread(spark, path)
    return _latest(rows if only is None else rows.where(only), keys, version)
