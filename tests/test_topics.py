"""Topics, groups and commits; snapshot and log; rows flushed to a database once."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tidemark.sources import topics
from tidemark.sources.flushing import FlushingWriter
from tidemark.streaming import runners


@pytest.fixture(scope="module", autouse=True)
def sources(spark):
    topics.register(spark)


def messages(spark, *ids):
    return spark.createDataFrame([(str(i % 3), f"v{i}") for i in ids], "key string, value string")


def read(spark, uri, **options):
    rows = spark.readStream.format("topic").option("path", uri)
    for k, v in options.items():
        rows = rows.option(k, v)
    return rows.load()


def taken(spark, rows, folder, uri="", group=None):
    write = runners.write_batch(f"{folder}/out")
    runners.run_group(rows, f"{folder}/state", write, uri, group) if group else runners.run_once(rows, f"{folder}/state", write)
    return sorted(r.value for r in spark.read.option("recursiveFileLookup", "true").schema(rows.schema).parquet(f"{folder}/out").collect())


def test_a_batch_is_appended_once(spark, tmp_path):
    uri = f"{tmp_path}/t"
    for batch in (0, 0, 1):
        topics.append_rows(messages(spark, *range(10)), uri, "w", batch, 2)
    topics.append_rows(messages(spark, 99), uri, "other", 0, 2)
    assert taken(spark, read(spark, uri), tmp_path / "a") == sorted([f"v{i}" for i in range(10)] * 2 + ["v99"])
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/a/out")
    places = [(r.partition, r.offset) for r in rows.collect()]
    assert len(set(places)) == 21 and {p: max(o for q, o in places if q == p) + 1 for p, _ in places} == {int(p): n for p, n in topics.Topic(uri).ends().items()}
    assert {r.key: r.n for r in rows.groupBy("key").agg(F.countDistinct("partition").alias("n")).collect()} == {"0": 1, "1": 1, "2": 1}


def test_a_group_goes_on_with_a_new_checkpoint(spark, tmp_path):
    uri = f"{tmp_path}/t"
    topics.append_rows(messages(spark, 1, 2, 3), uri, "w", 0)
    assert taken(spark, read(spark, uri, group="g"), tmp_path / "one", uri, "g") == ["v1", "v2", "v3"]
    topics.append_rows(messages(spark, 4, 5), uri, "w", 1)
    assert taken(spark, read(spark, uri, group="g"), tmp_path / "two", uri, "g") == ["v4", "v5"]
    assert taken(spark, read(spark, uri, group="h"), tmp_path / "three", uri, "h") == ["v1", "v2", "v3", "v4", "v5"]
    assert taken(spark, read(spark, uri, group="late", startingOffsets="latest"), tmp_path / "four", uri, "late") == []
    topics.commit_group(uri, "g", {"0": 1})  # never back
    assert topics.Folder(uri).read_json("groups/g.json") == {"0": 5}


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    """One task of a batch fails after others have written: nobody sees any of it, and the next run writes all of it once."""
    uri = f"{tmp_path}/t"
    spark.range(0, 40, 1, 4).selectExpr("cast(id as string) AS key", "concat('v', id) AS value").write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("key string, value string").parquet(f"{tmp_path}/in")
    broken = rows.withColumn("value", F.when(F.col("key") == "39", F.raise_error(F.lit("no"))).otherwise(F.col("value")))

    def run(source):
        return source.writeStream.format("topic").option("path", uri).option("writer", "w").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()

    with pytest.raises(Exception, match="no"):
        run(broken).awaitTermination()
    assert topics.Topic(uri).last()[0] == -1
    run(rows).awaitTermination()
    assert taken(spark, read(spark, uri), tmp_path / "a") == sorted(f"v{i}" for i in range(40))


def test_snapshot_then_log(spark, tmp_path):
    """The snapshot's rows once, then the log from where it was taken; what was in the log before is in the snapshot."""
    uri, snapshot = f"{tmp_path}/log", f"{tmp_path}/snap"
    topics.append_rows(messages(spark, 1), uri, "w", 0)
    topics.take_snapshot(spark.createDataFrame([("a",), ("b",)], "name string"), uri, snapshot)
    topics.append_rows(messages(spark, 2), uri, "w", 1)
    rows = spark.readStream.format("snapshot_log").option("path", uri).option("snapshot", snapshot).load()
    seen = lambda: [json.loads(v)["after"]["name"] if v.startswith("{") else v for v in taken(spark, rows, tmp_path / "r")]
    assert sorted(seen()) == ["a", "b", "v2"]
    topics.append_rows(messages(spark, 3), uri, "w", 2)
    assert sorted(seen()) == ["a", "b", "v2", "v3"]


def test_rows_are_flushed_once(spark, tmp_path):
    """By number or age; a repeated epoch, as after a failure between the database's commit and Spark's, is not appended again."""
    path = f"{tmp_path}/db.sqlite"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (id INTEGER, name TEXT)")
    writer = FlushingWriter(lambda: sqlite3.connect(path, timeout=60), "t", ["id", "name"], rows=5, seconds=1.0)
    spark.range(0, 23, 1, 3).selectExpr("id", "concat('n', id) AS name", "'x' AS more").write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("id long, name string, more string").parquet(f"{tmp_path}/in")
    for _ in range(2):
        query = rows.writeStream.foreach(writer).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        for f in (tmp_path / "state" / "commits").iterdir():  # Spark forgets that the epoch was done
            f.unlink()
    with sqlite3.connect(path) as db:
        assert sorted(db.execute("SELECT id, name FROM t").fetchall()) == [(i, f"n{i}") for i in range(23)]


def test_flushes_by_number_and_age(tmp_path):
    calls, now = [], [0.0]

    class Connection:
        def cursor(self):
            return self

        def execute(self, sql, values=()):
            return self

        def fetchone(self):
            return None

        def executemany(self, sql, rows):
            calls.append(len(rows))

        def commit(self):
            calls.append("commit")

        def rollback(self):
            calls.append("rollback")

        def close(self):
            pass

    writer = FlushingWriter(Connection, "t", ["id"], rows=3, seconds=1.0, clock=lambda: now[0])
    assert writer.open(0, 0)
    for i in range(7):
        now[0] += 0.1 if i < 5 else 2.0
        writer.process({"id": i})
    writer.close(None)
    assert calls == ["commit", 3, 3, 1, "commit"]
    assert writer.open(0, 1)
    writer.process({"id": 1})
    writer.close(ValueError("x"))
    assert calls[-1] == "rollback"


def test_messages_are_compressed(spark):
    """Messages repeat their names in every row, so a topic of texts takes little of the shared folder."""
    from tidemark.plans.streamed import Topics

    topics = Topics(spark)
    rows = topics.messages("m", spark.range(50).selectExpr("cast(id as string) AS some_long_name"))
    assert spark.sparkContext._jvm.java.io.File(f"{topics.folder}/m").list() is not None
    assert all(n.endswith(".gz") for n in spark.sparkContext._jvm.java.io.File(f"{topics.folder}/m").list() if n.startswith("part"))
    assert topics.run(rows, "read").count() == 50
