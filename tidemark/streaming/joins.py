"""Joins of change streams: watermarks and a bound on the time between partners keep their state small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.enrich import lookup
from ..plans.facts import DETAIL, ORDER, changes, order_detail
from ..plans.trade import amounts, order_sums
from ..schemas import strings
from .keyed import InOrder, process
from .logics import Buyers


def _side(rows: DataFrame, prefix: str, late: str, *names: str, **renamed: str) -> DataFrame:
    d = F.col("data")
    own = rows.select(*[d[n].alias(n) for n in names], *[d[o].alias(n) for n, o in renamed.items()], F.col("type").alias(f"{prefix}_type"), F.col("old").alias(f"{prefix}_old"), F.timestamp_seconds(F.col("ts").try_cast("long")).alias(f"{prefix}_et"))
    return own.withWatermark(f"{prefix}_et", late)


def order_pre_process(db: DataFrame, dic: DataFrame, late: str = "5 seconds", within: int = 5, timed: bool = False) -> DataFrame:
    """The wide order line of a change stream, its partners at most ``within`` seconds apart; ``timed`` keeps its time, ``d_et``.

    A line without activity or coupon comes out once, when the watermark shows that none can
    follow; there is no earlier row to take back. The batch form is ``plans.facts.order_pre_process``.
    """
    detail = _side(changes(db, "order_detail", "insert", "shop"), "d", late, *DETAIL.split(), source_type_id="source_type")
    order = _side(changes(db, "order_info", database="shop").where(F.col("type").isin("insert", "update")), "o", late, *ORDER.split(), _order="id")
    activity = _side(changes(db, "order_detail_activity", "insert", "shop"), "a", late, "activity_id", "activity_rule_id", order_detail_activity_id="id", _a="order_detail_id")
    coupon = _side(changes(db, "order_detail_coupon", "insert", "shop"), "c", late, "coupon_id", "coupon_use_id", order_detail_coupon_id="id", _c="order_detail_id")
    near = lambda other: F.expr(f"{other}_et BETWEEN d_et - INTERVAL {within} SECONDS AND d_et + INTERVAL {within} SECONDS")
    wide = lookup(detail, dic, "source_type_id", "source_type_name").join(order, (F.col("order_id") == F.col("_order")) & near("o"))
    wide = wide.join(activity, (F.col("id") == F.col("_a")) & near("a"), "left").join(coupon, (F.col("id") == F.col("_c")) & near("c"), "left")
    columns = [*DETAIL.split(), "source_type_id", "source_type_name", *ORDER.split(), "order_detail_activity_id", "activity_id", "activity_rule_id", "order_detail_coupon_id", "coupon_id", "coupon_use_id"]
    return wide.select(*columns, F.col("o_type").alias("type"), F.col("o_old").alias("old"), *(["d_et"] if timed else []))


def order_windows(db: DataFrame, dic: DataFrame, late: str = "5 seconds", within: int = 5, size: str = "10 seconds") -> DataFrame:
    """From changes to the window of orders as one query, without topics between: four joins, flags of buyers, a tumbling aggregate.

    The watermark passes from step to step. Lines without a partner leave a join only when it shows that none can come,
    so buyers' flags are given when the watermark has reached a line, in order of time.
    """
    lines = order_detail(order_pre_process(db, dic, late, within, timed=True), "d_et")
    keep = ("id", "sku_num", "order_price", "split_activity_amount", "split_coupon_amount")
    lines = lines.select("user_id", *keep, F.unix_millis("d_et").alias("ms"), "d_et")
    output = T.StructType([*strings(*keep).fields, T.StructField("ms", T.LongType()), T.StructField("rt", T.TimestampType()), T.StructField("unique_user", T.LongType()), T.StructField("new_user", T.LongType())])
    flags = process(lines, "user_id", ["ms", "id"], output, InOrder(Buyers(keep, timed=True), [*keep, "ms"], ["ms", "id"]), "d_et", None, "rt")
    grouped = amounts(flags).groupBy(F.window("rt", size).alias("w")).agg(*order_sums())
    return grouped.select(F.col("w.start").alias("stt"), F.col("w.end").alias("edt"), *[c for c in grouped.columns if c != "w"])


def first_per_key(rows: DataFrame, key: str, time: str = "et", late: str = "5 seconds") -> DataFrame:
    """The first delivery of a key within the watermark; later ones are dropped."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
