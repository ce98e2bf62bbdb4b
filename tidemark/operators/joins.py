"""Time-bounded joins of two event streams; each works on batches and, with watermarks, on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, key: str, time: str, seconds: int = 5, how: str = "inner") -> DataFrame:
    """Pairs of one key whose times differ by at most ``seconds``. Columns get the suffixes _l and _r.

    Rows of a batch meet by (key, slice of time), one side in the three slices that can reach,
    so a key with many rows spreads over its slices; what an outer join adds are the rows of a side that none of the other meets, found in the
    same way. Streams join by key and range, which bounds their state.
    """
    a = left.select(*[F.col(c).alias(f"{c}_l") for c in left.columns])
    b = right.select(*[F.col(c).alias(f"{c}_r") for c in right.columns])
    span = F.expr(f"INTERVAL {seconds} SECONDS")
    near = (F.col(f"{time}_r") >= F.col(f"{time}_l") - span) & (F.col(f"{time}_r") <= F.col(f"{time}_l") + span)
    same = F.col(f"{key}_l") == F.col(f"{key}_r")
    if left.isStreaming or right.isStreaming or seconds <= 0:
        return a.join(b, same & near, how)
    once = lambda rows, x: rows.withColumn("_s", _slice(f"{time}_{x}", seconds))
    thrice = lambda rows, x: rows.withColumn("_t", F.explode(F.array(*[_slice(f"{time}_{x}", seconds) + i for i in (-1, 0, 1)])))
    meets = same & (F.col("_s") == F.col("_t")) & near
    out = once(a, "l").join(thrice(b, "r"), meets).drop("_s", "_t")
    if how in ("left", "left_outer", "full", "full_outer", "outer"):
        out = out.unionByName(once(a, "l").join(thrice(b, "r"), meets, "left_anti").drop("_s"), allowMissingColumns=True)
    if how in ("right", "right_outer", "full", "full_outer", "outer"):
        out = out.unionByName(once(b, "r").join(thrice(a, "l"), meets, "left_anti").drop("_s"), allowMissingColumns=True)
    return out


def _slice(time: str, seconds: int) -> Column:
    return F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / seconds)


def window_join(left: DataFrame, right: DataFrame, key: str, time: str, size: str = "5 seconds", how: str = "inner") -> DataFrame:
    """Pairs of one key in the same tumbling window."""
    a = left.select(*[F.col(c).alias(f"{c}_l") for c in left.columns], F.window(time, size).alias("_wl"))
    b = right.select(*[F.col(c).alias(f"{c}_r") for c in right.columns], F.window(time, size).alias("_wr"))
    return a.join(b, (F.col(f"{key}_l") == F.col(f"{key}_r")) & (F.col("_wl") == F.col("_wr")), how).withColumn("stt", F.coalesce("_wl.start", "_wr.start")).drop("_wl", "_wr")
