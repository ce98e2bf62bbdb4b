"""Runs plans as streams: watermarks, several sinks for one input, routed and upserted tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.bitmaps import bitmap, bucket
from ..operators.route import parse_logs, route_dimensions, split_logs
from ..operators.upsert import read_upserts, upsert_parquet
from ..sources.topics import commit_group


def windowed(rows: DataFrame, time: str, keys: list[str], aggregates: list[Column], size: str = "10 seconds", late: str = "2 seconds") -> DataFrame:
    """A tumbling aggregate that emits a window once the watermark, ``late`` behind the newest row, has passed it."""
    grouped = rows.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), *keys).agg(*aggregates)
    return grouped.select(F.col("w.start").alias("stt"), F.col("w.end").alias("edt"), *[c for c in grouped.columns if c != "w"])


def day_firsts(rows: DataFrame, time: str, keys: list[str], order: list[str], late: str = "1 day") -> DataFrame:
    """The first row, by ``order``, of each key on each day, once the watermark has passed the day: the columns of both.

    An aggregate of Spark's own, so rows are combined before the shuffle, no Python worker is asked for a key, and closed days leave the state.
    """
    days = rows.withColumn("_day", F.date_trunc("day", time)).withWatermark("_day", late)
    return days.groupBy("_day", *keys).agg(F.min(F.struct(*order)).alias("_first")).select(*keys, "_first.*")


def windowed_bitmaps(rows: DataFrame, time: str, keys: list[str], number: str, aggregates: list[Column], size: str = "10 seconds", late: str = "2 seconds") -> DataFrame:
    """A tumbling aggregate with distinct counts whose state is bounded: for each window, key and 64 numbers a bitmap of one long.

    ``operators.bitmaps.counted`` makes counts of it, of a window or of all windows of a day.
    """
    marked = rows.withColumn("bucket", bucket(F.col(number)))
    return windowed(marked, time, [*keys, "bucket"], [bitmap(F.col(number)).alias("bitmap"), *aggregates], size, late)


#: With it a partition of a join of streams is one store, not four, each with files of its own.
JOIN_FORMAT = "spark.sql.streaming.join.stateFormatVersion"
COMPRESSION = "spark.sql.streaming.stateStore.rocksdb.compression"
PARTITIONS = "spark.sql.shuffle.partitions"
PROVIDER, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def on_rocksdb(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Streams that start within it keep their state in RocksDB, whatever the session has: keyed processors run on no other store. With
    ``partitions`` they have so many of them.

    A stream takes the settings when it starts, and its partitions from then on from its checkpoint, so the session's own are put back at once.
    """
    settings = {PROVIDER: ROCKSDB, JOIN_FORMAT: "3", COMPRESSION: "zstd"} | ({PARTITIONS: str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_once(rows: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append", partitions: int | None = None) -> StreamingQuery:
    """Takes all that is there now, in micro-batches, and ends."""
    with on_rocksdb(rows.sparkSession, partitions):
        query = rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def write_batch(path: str, columns: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """Each micro-batch has a directory of its own, so one that is run again replaces itself. What isn't among ``columns``,
    such as a set behind a count, isn't written."""
    return lambda batch, n: (batch.select(*columns) if columns else batch).write.mode("overwrite").parquet(f"{path}/batch={n}")


def console(rows: DataFrame, checkpoint: str, name: str = "console", most: int = 20) -> StreamingQuery:
    """Shows the first rows of each micro-batch on the driver's console, for debugging; takes all there is and ends."""
    with on_rocksdb(rows.sparkSession):
        query = rows.writeStream.outputMode("append").format("console").option("numRows", most).option("checkpointLocation", checkpoint).queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def fan_out_logs(raw: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Application logs into their five tables and the unreadable ones, one pass over each micro-batch."""

    def write(batch: DataFrame, n: int) -> None:
        batch.persist()
        good, bad = parse_logs(batch)
        for name, rows in {**split_logs(good), "dirty": bad}.items():
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={n}")
        batch.unpersist()

    return run_once(raw, checkpoint, write)


def route_to_tables(changes: DataFrame, config: Callable[[], DataFrame], path: str, checkpoint: str, changed: Callable[[str], None] | None = None) -> StreamingQuery:
    """Dimension changes into a table for each route, as one partitioned upsert table (see :func:`read_routed`); the routes are read anew for each micro-batch.

    A micro-batch is written once, whatever the number of routes. ``changed`` is told the name of each table that it has rows
    for, once they are written, so that a lookup of it can be forgotten.
    """

    def write(batch: DataFrame, n: int) -> None:
        routes = config()
        wrong = routes.where("coalesce(trim(sink_table), '') = '' OR coalesce(trim(BOTH ', ' FROM sink_columns), '') = ''").first()
        if wrong:
            raise ValueError(f"a route without table or columns: {wrong}")
        routed = route_dimensions(batch, routes).select("sink_table", "pk", F.to_json("row").alias("row"), "ts")
        upsert_parquet(batch.sparkSession, routed, path, ["sink_table", "pk"], ["ts"], n, "sink_table")
        for r in (batch.sparkSession.read.parquet(f"{path}/kind=batch/batch={n}").select("sink_table").distinct().collect() if changed else ()):  # names of tables
            changed(r.sink_table)

    return run_once(changes, checkpoint, write)


def read_routed(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One table of :func:`route_to_tables`; only its folders are read."""
    return read_upserts(spark, path, ["sink_table", "pk"], ["ts"], F.col("sink_table") == table).drop("sink_table")


def run_group(rows: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], topic: str, group: str) -> StreamingQuery:
    """Runs once as a consumer group. Spark tells a source of a batch when it plans the next one, so the last is told here."""
    query = run_once(rows, checkpoint, write)
    for source in json.loads(query.lastProgress.json)["sources"] if query.lastProgress else ():
        if source["endOffset"]:
            commit_group(topic, group, source["endOffset"])
    return query
