"""Dimensions that change: versions from a log of changes, and joins that see each fact's own time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Slices that one version is dealt to at most, however long it holds.
SLICES = 512


def versions(log: DataFrame, key: str, time: str, order: list[str] | None = None, deleted: str | None = None) -> DataFrame:
    """Changes (key, time, values) as versions with ``valid_from`` and ``valid_to`` (exclusive; null: still valid).

    Of changes of one time the last by ``order`` counts. Where ``deleted`` holds, a version ends and none begins.
    """
    by = Window.partitionBy(key).orderBy(time, *(order or []))
    until = F.lead(time).over(by)
    rows = log.withColumns({"valid_from": F.col(time), "valid_to": until}).where(F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from")))
    rows = rows.where(f"NOT coalesce({deleted}, false)").drop(deleted) if deleted else rows
    return rows.drop(time, *(order or []))


def as_of(facts: DataFrame, dimension: DataFrame, key: str, time: str, dimension_key: str, columns: list[str], how: str = "inner") -> DataFrame:
    """Each fact with ``columns`` of the version that is valid at its time; without one it goes (``inner``) or has nulls (``left``).

    Both meet by (key, slice of time), so the facts of a busy key spread over its slices. Slices divide the time between
    the first and the last fact, which is read first, into SLICES; a version is dealt to those that it touches.
    """
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    first, last = facts.agg(F.coalesce(F.min(seconds(time)), F.lit(0)), F.coalesce(F.max(seconds(time)), F.lit(0))).first()
    size = max(1, -(-(last - first + 1) // SLICES))
    slice_ = lambda c: F.floor((seconds(c) - first) / size)
    top = (last - first) // size
    from_, to = F.greatest(slice_("valid_from"), F.lit(0)), F.least(F.coalesce(slice_("valid_to"), F.lit(top)), F.lit(top))
    held = dimension.where(from_ <= to).select(F.col(dimension_key).alias("_k"), "valid_from", "valid_to", *columns, F.explode(F.sequence(from_, to)).alias("_s"))
    rows = facts.withColumn("_t", slice_(time))
    valid = (F.col(time) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(time) < F.col("valid_to")))
    return rows.join(held, (F.col(key) == F.col("_k")) & (F.col("_t") == F.col("_s")) & valid, how).drop("_t", "_s", "_k", "valid_from", "valid_to")
