"""Tumbling event-time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import stamp


def tumble(rows: DataFrame, time: str, keys: list[str], aggregates: list[Column], size: str = "10 seconds") -> DataFrame:
    """Aggregates by window and keys; the window's ends are text columns stt and edt, in front.

    A window without keys is still grouped by its start, so partial sums are made before the shuffle
    and no task sees all rows.
    """
    grouped = rows.groupBy(F.window(time, size).alias("_w"), *keys).agg(*aggregates)
    return grouped.withColumns({"stt": stamp(F.col("_w.start")), "edt": stamp(F.col("_w.end"))}).select("stt", "edt", *[c for c in grouped.columns if c != "_w"])
