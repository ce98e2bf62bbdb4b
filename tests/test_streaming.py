from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import state
from tidemark.operators.bitmaps import counted
from tidemark.operators.route import route_dimensions
from tidemark.sources import adapters as A
from tidemark.streaming import processors, runners


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """State is kept for each partition, and these tables are small."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.fixture(scope="module")
def page_files(spark, sf_dir, tmp_path_factory):
    """Page views in order of time in several files, with a last row that moves the watermark past all others."""
    folder = str(tmp_path_factory.mktemp("pages"))
    pages = A.page_log(spark, sf_dir).withColumn("rt", F.col("rt").cast("timestamp")).drop("k", "event_type")
    rows = sorted(pages.collect(), key=lambda r: (r.ts, r.seq))
    late = rows[-1].asDict() | {"mid": "end", "ts": rows[-1].ts + 10**9, "rt": rows[-1].rt + timedelta(seconds=10**6), "seq": 10**9, "last_page_id": "home"}
    chunks = [rows[i : i + 250] for i in range(0, len(rows), 250)]
    for i, chunk in enumerate([*chunks, [tuple(late[c] for c in pages.columns)]]):
        spark.createDataFrame(chunk, pages.schema).coalesce(1).write.parquet(f"{folder}/{i:03d}")
    return folder, pages.schema, pages


def stream(spark, page_files):
    folder, schema, _ = page_files
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def gather(spark, rows, tmp_path):
    runners.run_once(rows, f"{tmp_path}/checkpoint", runners.write_batch(f"{tmp_path}/out"))
    return spark.read.option("recursiveFileLookup", "true").schema(rows.schema).parquet(f"{tmp_path}/out")


def test_new_visitor_repair_equals_batch(spark, page_files, tmp_path):
    got = gather(spark, processors.repair_new_visitors(stream(spark, page_files)), tmp_path).where("mid <> 'end'")
    want = state.repair_new_visitors(page_files[2])
    assert sorted((r.seq, r.is_new) for r in got.collect()) == sorted((r.seq, r.is_new) for r in want.collect())


def test_bounces_equal_batch(spark, page_files, tmp_path):
    got = gather(spark, processors.bounces(stream(spark, page_files), 3 * 3600), tmp_path)
    want = state.bounces(page_files[2], 3 * 3600)
    assert sorted(r.seq for r in got.collect()) == sorted(r.seq for r in want.collect())


def test_daily_firsts_equal_batch(spark, page_files, tmp_path):
    entries = stream(spark, page_files).where("last_page_id IS NULL")
    got = gather(spark, processors.daily_firsts(entries, "mid"), tmp_path).select("mid", F.to_date("rt").alias("d")).distinct()
    want = state.unique_visitors(page_files[2]).select("mid", F.to_date("rt").alias("d"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_windows_equal_batch(spark, page_files, tmp_path):
    rows = stream(spark, page_files).where("mid <> 'end' OR ts > 0").withColumn("number", F.coalesce(F.col("mid").try_cast("long"), F.lit(-1)))
    parts = gather(spark, runners.windowed_bitmaps(rows, "rt", ["ch"], "number", [F.count(F.lit(1)).alias("n")], "1 hour"), tmp_path)
    got = counted(parts, ["stt", "edt", "ch"], "people", F.sum("n").alias("n"))
    want = page_files[2].groupBy(F.window("rt", "1 hour").alias("w"), "ch").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("mid").alias("people")).select("w.start", "ch", "n", "people")
    assert sorted(map(tuple, got.select("stt", "ch", "n", "people").collect())) == sorted(map(tuple, want.collect()))


def test_late_rows_are_dropped(spark, tmp_path):
    """A row behind the watermark is in no window; one within it still counts. Rows are held against the watermark of two batches before."""
    base = datetime(2024, 1, 1)
    for i, seconds in enumerate(([0, 30], [29], [5, 28], [60])):
        spark.createDataFrame([(base + timedelta(seconds=x),) for x in seconds], "rt timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    rows = spark.readStream.schema("rt timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = gather(spark, runners.windowed(rows, "rt", [], [F.count(F.lit(1)).alias("n")]), tmp_path)
    assert sorted((r.stt.minute * 60 + r.stt.second, r.n) for r in got.collect()) == [(0, 1), (20, 2), (30, 1)]


def test_first_delivery_on_a_stream(spark, tmp_path):
    from tidemark.streaming.joins import first_per_key

    rows = [("a", 1, datetime(2024, 1, 1, 0, 0, 1)), ("b", 1, datetime(2024, 1, 1, 0, 0, 2))], [("a", 2, datetime(2024, 1, 1, 0, 0, 3))]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "id string, v int, et timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema("id string, v int, et timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    assert sorted((r.id, r.v) for r in gather(spark, first_per_key(source, "id"), tmp_path).collect()) == [("a", 1), ("b", 1)]


def test_socket_lines_and_console(spark, tmp_path):
    """Lines of a socket as id, name and time; each batch is shown."""
    import socket
    import threading

    from tidemark.sources.connectors import demo_lines, socket_stream, text_stream

    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        while True:
            try:
                client, _ = server.accept()
            except OSError:
                return
            client.sendall(b"1,ann,100\n2,bob,107\n")

    threading.Thread(target=serve, daemon=True).start()
    rows = demo_lines(socket_stream(spark, "127.0.0.1", server.getsockname()[1]))
    query = rows.writeStream.format("memory").queryName("socket_lines").option("checkpointLocation", f"{tmp_path}/s").start()
    try:
        for _ in range(60):
            got = sorted((r.id, r.name) for r in spark.table("socket_lines").collect())
            if len(got) == 2:
                break
            query.awaitTermination(0.5)
        assert got == [(1, "ann"), (2, "bob")]
    finally:
        query.stop()
        server.close()
    spark.createDataFrame([("3,cat,5",)], "value string").write.text(f"{tmp_path}/lines")
    query = runners.console(demo_lines(text_stream(spark, f"{tmp_path}/lines")), f"{tmp_path}/c")
    assert sum(p.numInputRows for p in query.recentProgress) == 1  # what it shows is on the JVM's own output


def test_log_fan_out(spark, sf_dir, tmp_path):
    A.raw_log(spark, sf_dir).select("value").repartition(2).write.text(f"{tmp_path}/in")
    runners.fan_out_logs(spark.readStream.text(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    n = {k: spark.read.parquet(f"{tmp_path}/out/{k}").count() for k in ("page", "start", "dirty")}
    assert sum(n.values()) == spark.read.parquet(f"{sf_dir}/events.parquet").count() and n["dirty"] > 0


def test_routed_tables(spark, sf_dir, tmp_path):
    changes = A.dimension_changes(spark, sf_dir)
    changes.write.json(f"{tmp_path}/in")
    rows = spark.readStream.schema(changes.schema).json(f"{tmp_path}/in")
    told = []
    runners.route_to_tables(rows, lambda: A.routes(spark), f"{tmp_path}/out", f"{tmp_path}/checkpoint", told.append)
    assert sorted(told) == ["dim_base_province", "dim_user_info"]
    got = {t: runners.read_routed(spark, f"{tmp_path}/out", t).count() for t in ("dim_base_province", "dim_user_info")}
    want = {r.sink_table: r.n for r in route_dimensions(changes, A.routes(spark)).groupBy("sink_table").agg(F.countDistinct("pk").alias("n")).collect()}
    assert got == want


def test_latest_of_key_holds_then_emits(spark, tmp_path):
    schema = "id string, v int, rt timestamp"
    spark.createDataFrame([("a", 1, datetime(2024, 1, 1)), ("a", 3, datetime(2024, 1, 1)), ("b", 2, datetime(2024, 1, 1))], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    out = processors.latest_of_key(rows, "id", "v", 1)
    query = out.writeStream.format("memory").queryName("latest_held").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(60):
            got = {r.id: r.v for r in spark.table("latest_held").collect()}
            if len(got) == 2:
                break
            query.awaitTermination(0.5)
        assert got == {"a": 3, "b": 2}
    finally:
        query.stop()


def test_unique_and_new_users_equal_batch(spark, page_files, tmp_path):
    rows = stream(spark, page_files).where("mid <> 'end'").select("mid", "ts", "seq")
    got = gather(spark, processors.unique_and_new(rows, "mid"), tmp_path)
    want = state.unique_and_new(page_files[2].select("mid", "ts", "seq", "rt"), "mid", F.to_date("rt"), ["ts", "seq"])
    assert sorted((r.seq, r.unique_user, r.new_user) for r in got.collect()) == sorted((r.seq, r.unique_user, r.new_user) for r in want.collect())


def test_visitors_may_be_forgotten(spark, page_files, tmp_path):
    rows = processors.repair_new_visitors(stream(spark, page_files), forget_ms=3_600_000)
    query = rows.writeStream.format("memory").queryName("forgetful").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(120):
            n = spark.sql("SELECT count(*) AS n FROM forgetful WHERE mid <> 'end'").first().n
            if n == page_files[2].count():
                return
            query.awaitTermination(0.5)
        raise AssertionError(n)
    finally:
        query.stop()


def test_order_lines_join_as_a_stream(spark, tmp_path):
    from tidemark.schemas import CDC, DICTIONARY
    from tidemark.streaming import joins

    def change(table, data, ts, kind="insert"):
        return ("shop", table, kind, data, None, str(ts))

    t = 1_704_067_200
    first = [
        change("order_detail", {"id": "1", "order_id": "o", "source_type": "2401"}, t), change("order_detail", {"id": "2", "order_id": "o", "source_type": "2401"}, t),
        change("order_detail", {"id": "3", "order_id": "late", "source_type": "2401"}, t), change("order_info", {"id": "o", "user_id": "u"}, t + 1), change("order_info", {"id": "late"}, t + 30),
        change("order_detail_activity", {"id": "a", "order_detail_id": "1", "activity_id": "x"}, t + 2),
    ]
    after = [change(x, {"id": f"end{n}", "order_id": f"end{n}", "order_detail_id": f"end{n}", "source_type": "2401"}, t + 1000 * n) for n in (1, 2) for x in ("order_detail", "order_info", "order_detail_activity", "order_detail_coupon")]
    for i, rows in enumerate((first, after[:4], after[4:])):
        spark.createDataFrame(rows, CDC).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    db = spark.readStream.schema(CDC).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    dic = spark.createDataFrame([("2401", "query", "24")], DICTIONARY)
    got = gather(spark, joins.order_pre_process(db, dic).select("id", "user_id", "activity_id", "coupon_id", "source_type_name"), tmp_path)
    assert sorted(tuple(r) for r in got.collect() if not r.id.startswith("end")) == [("1", "u", "x", None, "query"), ("2", "u", None, None, "query")]


def test_first_carts_of_days_ask_no_python_worker(spark, tmp_path):
    """A day's first row comes from an aggregate of Spark's own, whatever the order in which micro-batches bring the rows of a day."""
    at = lambda day, hour: f"2024-01-{day:02d} {hour:02d}:00:00"
    parts = [[("u", "2", at(1, 9)), ("v", "3", at(1, 5)), (None, "8", at(1, 7))], [("u", "1", at(1, 9)), ("u", "4", at(1, 8)), ("u", "5", at(2, 1))], [("u", "6", at(2, 0)), ("v", "7", None)], [("end", "end", at(20, 0))]]
    for n, rows in enumerate(parts):
        frame = spark.createDataFrame(rows, "user_id string, id string, at string")
        frame.withColumn("rt", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema("user_id string, id string, at string, rt timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    firsts = runners.day_firsts(stream, "rt", ["user_id"], ["at", "id"])
    plan = firsts._jdf.queryExecution().analyzed().toString()
    assert "InPandas" not in plan and "Python" not in plan
    runners.run_once(firsts, f"{tmp_path}/state", runners.write_batch(f"{tmp_path}/out"))
    got = spark.read.option("recursiveFileLookup", "true").schema(firsts.schema).parquet(f"{tmp_path}/out")
    assert {tuple(r) for r in got.select("user_id", "id", "at").collect()} == {("u", "4", at(1, 8)), ("u", "6", at(2, 0)), ("v", "3", at(1, 5)), (None, "8", at(1, 7))}
