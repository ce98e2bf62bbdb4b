"""Sources and sinks. Files work everywhere; brokers and databases need their jars on the class path."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CDC, CONFIG_CHANGE


def text_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """A directory of text files as a stream of column ``value``."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str, starting: str = "latest") -> DataFrame:
    """A topic as text. Offsets live in the query's checkpoint, ``starting`` counts only at its first start. The reading itself is
    not tested here: the jar is missing."""
    return as_texts(spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).load())


def as_texts(records: DataFrame) -> DataFrame:
    """Records of a broker, whose key and value are bytes, as texts; a null value is an empty text."""
    return records.select(F.coalesce(F.col("value").cast("string"), F.lit("")).alias("value"), F.col("key").cast("string").alias("key"))


def socket_stream(spark: SparkSession, host: str, port: int) -> DataFrame:
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def jdbc_table(spark: SparkSession, url: str, table: str, split: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A table of a database. ``split`` (numeric column, lowest, highest, parts) reads it in so many tasks; without it, it is
    one task, which suits lookups."""
    if split:
        options |= dict(zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), map(str, split), strict=True))
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


class Lookup:
    """A table that is read again once it is older than ``seconds``, or after :meth:`forget`; in between it stays as it was read.

    Streams ask for it in each micro-batch, so changes of a lookup reach them within that time, or, where a change of
    a dimension is seen itself, at once.
    """

    def __init__(self, read: Callable[[], DataFrame], seconds: float = 3600, clock: Callable[[], float] = time.monotonic):
        self.read, self.seconds, self.clock, self.rows, self.at = read, seconds, clock, None, 0.0

    def __call__(self) -> DataFrame:
        if self.rows is not None and self.clock() - self.at >= self.seconds:
            self.forget()
        if self.rows is None:
            self.rows, self.at = self.read().cache(), self.clock()
        return self.rows

    def forget(self) -> None:
        if self.rows is not None:
            self.rows.unpersist()
        self.rows = None


def parse(rows: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """JSON messages as typed columns. Texts that are no JSON object are dropped, as are empty ones."""
    good = F.coalesce(F.trim(F.col(value)), F.lit("")).startswith("{") & F.try_parse_json(value).isNotNull()
    return rows.where(good).select(F.from_json(value, schema).alias("_m")).select("_m.*")


def change_stream(rows: DataFrame) -> DataFrame:
    """Change messages as database, table, type, data, old, ts."""
    return parse(rows, CDC)


def config_from_changes(rows: DataFrame) -> DataFrame:
    """Routes from a log of configuration changes (value, seq): the last change of a source table counts, and a delete removes it."""
    parsed = rows.select(F.from_json("value", CONFIG_CHANGE).alias("m"), "seq").select(F.coalesce("m.after.source_table", "m.before.source_table").alias("source_table"), "m.after", "m.op", "seq")
    last = parsed.groupBy("source_table").agg(F.max_by(F.struct("after", "op"), "seq").alias("m"))
    return last.where("m.op <> 'd' AND m.after IS NOT NULL").select("m.after.*")


def demo_lines(rows: DataFrame, value: str = "value") -> DataFrame:
    """``id,name,seconds`` lines as id, name and an event time."""
    part = F.split(value, ",")
    return rows.select(part[0].try_cast("int").alias("id"), F.get(part, F.lit(1)).alias("name"), F.timestamp_seconds(F.get(part, F.lit(2)).try_cast("long")).alias("ts"))


def to_messages(rows: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Rows as JSON values, with a JSON key for upserts."""
    value = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")
    return rows.select(value) if key is None else rows.select(F.to_json(F.struct(*key)).alias("key"), value)


def kafka_sink(rows: DataFrame, servers: str, topic: str, checkpoint: str, key: list[str] | None = None):
    """Not tested here: the jar is missing."""
    return to_messages(rows, key).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def jdbc_sink(batch: DataFrame, url: str, table: str, columns: list[str], batch_rows: int = 1000, **options: str) -> None:
    """Appends named columns in order, ``batch_rows`` in a statement; what isn't named, such as a set behind a count, isn't written.

    As the writer of ``foreachBatch``, under a processing-time trigger, which is how long rows wait at most.
    """
    batch.select(*columns).write.format("jdbc").mode("append").options(url=url, dbtable=table, batchsize=batch_rows, **options).save()


def create_dimension(spark: SparkSession, table: str, columns: str, key: str | None = None, extend: str | None = None, location: str | None = None, database: str | None = None) -> None:
    """Creates a configured table of text columns where it is missing; the key, ``id`` by default, comes first.

    ``extend`` is what the configuration adds to the statement, such as ``TBLPROPERTIES (...)``. A route without a
    table name or without columns, or a statement that fails, is an error, so that the job stops rather than loses rows.
    """
    key = key or "id"
    if not table or not (columns or "").strip(", "):
        raise ValueError(f"a route without table or columns: {table!r}, {columns!r}")
    names = [key, *[c.strip() for c in columns.split(",") if c.strip() and c.strip() != key]]
    spark.sql(f"CREATE TABLE IF NOT EXISTS {f"`{database}`." if database else ""}`{table}` ({', '.join(f'`{n}` STRING' for n in names)}) USING parquet" + (f" LOCATION '{location}'" if location else "") + (f" {extend}" if extend else ""))
