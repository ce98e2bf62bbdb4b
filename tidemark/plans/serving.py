"""Serving queries over the window tables, and their JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import day_number


def gmv(orders: DataFrame, date: int | None = None) -> DataFrame:
    """The order amount of a day (yyyyMMdd), null where there is none; without a date, of each day."""
    day = day_number(F.to_timestamp("stt"))
    amount = F.sum(F.col("order_amount").cast("decimal(24,2)")).cast("double").alias("order_amount")
    return orders.groupBy(day.alias("day")).agg(amount) if date is None else orders.where(day == date).agg(amount)


def uv_by_channel(traffic: DataFrame, date: int | None = None) -> DataFrame:
    """Visitors and bounces by channel, most visitors first."""
    rows = traffic if date is None else traffic.where(day_number(F.to_timestamp("stt")) == date)
    return rows.groupBy("ch").agg(F.sum("uv_ct").alias("uv"), F.sum("uj_ct").alias("uj_ct")).orderBy(F.desc("uv"), "ch")


def channel_chart(traffic: DataFrame, date: int) -> DataFrame:
    """The chart of :func:`channel_json` as one row of text, put together by Spark."""
    rows = uv_by_channel(traffic, date).agg(F.array_sort(F.collect_list(F.struct((-F.col("uv")).alias("less"), "ch", "uv", "uj_ct"))).alias("c"))
    series = [F.struct(F.lit(n).alias("name"), F.col(f"c.{c}").alias("data")) for n, c in (("visitors", "uv"), ("bounces", "uj_ct"))]
    data = F.struct(F.col("c.ch").alias("categories"), F.array(*series).alias("series"))
    return rows.select(F.to_json(F.struct(F.lit(0).alias("status"), F.lit("").alias("msg"), data.alias("data"))).alias("body"))


def gmv_json(orders: DataFrame, date: int) -> str:
    return json.dumps({"status": 0, "msg": "", "data": gmv(orders, date).first()["order_amount"]})


def channel_json(traffic: DataFrame, date: int) -> str:
    """The rows of :func:`uv_by_channel` as a chart, in order; a shop has a handful of channels."""
    rows = uv_by_channel(traffic, date).collect()
    series = [{"name": "visitors", "data": [r.uv for r in rows]}, {"name": "bounces", "data": [r.uj_ct for r in rows]}]
    return json.dumps({"status": 0, "msg": "", "data": {"categories": [r.ch for r in rows], "series": series}})
