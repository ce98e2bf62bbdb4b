"""Routing: application logs into five streams, and dimension changes into configured tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import LOG


def from_json_once(value: str, schema: T.StructType, options: dict[str, str] | None = None) -> Column:
    """A parsed message as the only row of a generator: filters on its fields stay above it, so each message is parsed once."""
    return F.explode(F.array(F.from_json(value, schema, options or {})))


def parse_logs(raw: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Messages that are JSON objects, parsed, and all others as they came."""
    names = raw.columns
    parsed = raw.withColumn("log", from_json_once(value, T.StructType([*LOG.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"}))
    # Where a field has another type, too, Spark says that the record is corrupt; then only the text itself can tell.
    valid = F.col("log").isNotNull() & (F.col("log._bad").isNull() | F.try_parse_json(value).isNotNull())
    good = F.coalesce(F.ltrim(F.col(value)), F.lit("")).startswith("{") & valid
    return parsed.where(good), parsed.where(~good).select(*names)


def split_logs(parsed: DataFrame) -> dict[str, DataFrame]:
    """Error logs (of any kind; they go on as well), then start logs or pages, and what pages show and do.

    Start and page logs lose ``err``; pages also lose displays and actions, which become rows
    with the log's common part, page and time.
    """
    log = parsed.select("log.*").drop("_bad")
    start, page = log.where("start IS NOT NULL"), log.where("start IS NULL")
    acts = F.coalesce("actions", "action")
    return {
        "error": log.where("err IS NOT NULL"),
        "start": start.select("common", "start", "ts"),
        "page": page.select("common", "page", "ts"),
        "display": page.select("common", F.explode("displays").alias("_d"), F.col("page.page_id").alias("page_id"), "ts").select("_d.*", "common", "page_id", "ts"),
        "action": page.select("common", F.explode(acts).alias("_a"), F.col("page.page_id").alias("page_id"), F.col("ts").alias("log_ts")).select("_a.*", "common", "page_id", "log_ts"),
    }


def route_dimensions(changes: DataFrame, config: DataFrame) -> DataFrame:
    """Inserts and updates of configured tables with their sink table, key and the columns to keep.

    The configuration is one row for a source table; Spark broadcasts it where it knows it to be small. Tables without one, and
    deletes, are dropped.
    """
    known = config.select("source_table", "sink_table", "sink_columns", F.coalesce("sink_pk", F.lit("id")).alias("sink_pk"))
    wanted = F.split("sink_columns", ",")
    rows = changes.where(F.col("type").isin("insert", "update", "bootstrap-insert")).join(known, changes["table"] == F.col("source_table"))
    kept = F.map_filter("data", lambda k, _: F.array_contains(wanted, k))
    return rows.select("sink_table", "sink_pk", F.expr("data[sink_pk]").alias("pk"), kept.alias("row"), "type", F.col("ts").cast("long").alias("ts"))


def as_text(row: Column) -> Column:
    """A map as sorted ``key=value`` text."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(row), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))), ",")
