"""Joins that take back what they said: rows come with ``op`` 1 (insert) or -1 (withdraw), and so do results.

A left row without a partner goes out at once, with nulls, and is withdrawn when its first partner comes. What is left when
inserts and withdrawals of equal rows are counted against each other is the join of all rows so far, whatever their order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keyed import Logic, Timers, Value, Variable, process


class Join(Logic):
    """The rows of both sides of one key, as JSON texts; ``outer`` keeps left rows without partner. A side is forgotten ``ttl_ms``
    after its last change, without a withdrawal.

    The last part of a key isn't of the join's: it spreads rows whose key is null, of which nothing is kept."""

    needs = ("side", "op", "body")

    def __init__(self, outer: bool, ttl_ms: int | None, timed: bool):
        self.outer, self.timed = outer, timed
        self.variables = (Variable("left", "rows array<string>", ttl_ms), Variable("right", "rows array<string>", ttl_ms))

    def on_row(self, key: tuple, row: Any, at: int, state: dict[str, Value], timers: Timers) -> Iterable[tuple]:
        *own_key, _ = key
        when = (datetime.fromtimestamp(at / 1000, UTC),) if self.timed else ()
        if None in own_key:
            return [(*own_key, int(row.op), row.body, None, *when)] if self.outer and row.side == 0 else ()
        own, other = (state["left"], state["right"]) if row.side == 0 else (state["right"], state["left"])
        mine, theirs = (list(v[0]) if (v := s.get(at)) else [] for s in (own, other))
        op, body, out = int(row.op), row.body, []
        if op < 0 and body not in mine:
            return out  # of a row that was forgotten, or never came
        if row.side == 0:
            out += [(op, body, t) for t in theirs] or ([(op, body, None)] if self.outer else [])
        else:
            after = len(mine) + op
            alone = self.outer and (not mine or not after)  # the first partner comes, or the last one goes
            turn = [(-op, t, None) for t in theirs] if alone else []
            pairs = [(op, t, body) for t in theirs]
            out += turn + pairs if op > 0 else pairs + turn
        mine.append(body) if op > 0 else mine.remove(body)
        own.set(at, mine) if mine else own.clear()
        return [(*own_key, *o, *when) for o in out]


def changelog_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", time: str | None = None, ttl_ms: int | None = None, late: str = "1 millisecond") -> DataFrame:
    """Joins two streams of changes by columns that both have. A side without ``op`` has inserts only.

    The columns are the keys, what else the left side has, what else the right side has, and op. A row whose key
    is null meets nobody. ``how`` is left or inner.

    All rows of both sides are state, unless ``time`` names an event time that both have: then rows are taken in its order,
    ``late`` ones are dropped, and a side of a key is forgotten ``ttl_ms`` after its last change. Results have the time of the row that brought them.
    """
    rest = [[c for c in side.columns if c not in (*keys, "op", time)] for side in (left, right)]
    shapes = [T.StructType([side.schema[c] for c in cs]) for side, cs in zip((left, right), rest, strict=True)]
    times = [time] if time else []
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys)

    def tagged(side: DataFrame, n: int) -> DataFrame:
        op = F.col("op") if "op" in side.columns else F.lit(1)
        body = F.to_json(F.struct(*rest[n]), {"ignoreNullFields": "false"})
        at = F.unix_millis(time) if time else F.lit(0)
        apart = F.when(F.expr(known), F.lit(0)).otherwise(F.xxhash64(body)).cast("long").alias("apart")
        return side.select(*keys, apart, F.lit(n).alias("side"), op.cast("int").alias("op"), body.alias("body"), at.cast("long").alias("at"), *times)

    both = tagged(left, 0).unionByName(tagged(right, 1).where(known))
    fields = [T.StructField(k, left.schema[k].dataType) for k in keys] + [T.StructField("op", T.IntegerType()), T.StructField("l", T.StringType()), T.StructField("r", T.StringType())]
    output = T.StructType([*fields, *[T.StructField(c, T.TimestampType()) for c in times]])
    joined = process(both, [*keys, "apart"], ["at", "side"], output, Join(how == "left", ttl_ms, bool(time)), time, late, time)
    wide = joined.select(*keys, F.from_json("l", shapes[0]).alias("l"), F.from_json("r", shapes[1]).alias("r"), "op", *times)
    return wide.select(*keys, *[F.col(f"l.{c}").alias(c) for c in rest[0]], *[F.col(f"r.{c}").alias(c) for c in rest[1]], *times, "op")


def folded(changes: DataFrame) -> DataFrame:
    """Equal rows with their inserts less their withdrawals, as column ``op``; a sum, so it is combined before the shuffle."""
    rest = [c for c in changes.columns if c != "op"]
    return changes.groupBy(*rest).agg(F.sum("op").cast("int").alias("op")).where("op <> 0")


def write_folded(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for changes: each micro-batch leaves what it changes on the whole, in a folder of its own, so a repeated one replaces itself."""
    return lambda batch, n: folded(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")


def read_folded(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table that the changes leave; a row inserted twice is there twice."""
    rest = [c for c in schema.fieldNames() if c != "op"]
    left = folded(spark.read.option("recursiveFileLookup", "true").schema(schema).parquet(path))
    return left.select(*rest, F.explode(F.array_repeat(F.lit(1), F.col("op"))).alias("_one")).drop("_one")
