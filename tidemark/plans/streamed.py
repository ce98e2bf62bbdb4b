"""Streams over the test tables: each job reads and writes topics, as folders of files, until it has taken all there is."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import stamp, time_of
from ..operators.bitmaps import counted
from ..operators.enrich import enrich
from ..operators.route import as_text
from ..operators.upsert import read_upserts, upsert_parquet
from ..schemas import CDC, CONFIG_CHANGE, strings
from ..session import shared_folder
from ..sources import adapters as A
from ..sources.connectors import change_stream, create_dimension, parse, text_stream, to_messages
from ..sources.topics import append_rows, register, take_snapshot
from ..streaming import joins, processors, runners
from ..streaming.changelog import changelog_join, read_folded, write_folded
from ..streaming.joins import first_per_key
from ..streaming.keyed import process
from ..streaming.logics import Buyers, Firsts, LatestHeld
from ..streaming.patterns import Step, match
from . import facts, trade
from .traffic import CHANNEL, keyword_rows

#: The time of a last row that moves the watermark past all others; such rows have the key END.
LAST, END = datetime(2100, 1, 1), "end"


class Topics:
    """Named folders of Parquet or text files in the shared folder, and the streams between them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def put(self, name: str, rows: DataFrame) -> str:
        rows.write.mode("append").option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return name

    def end(self, name: str, schema: T.StructType, **values) -> None:
        open_ = T.StructType([T.StructField(f.name, f.dataType) for f in schema])  # most columns of it are null
        self.put(name, self.spark.createDataFrame([tuple(values.get(f.name) for f in schema)], open_))

    def read(self, name: str, schema: T.StructType, **last) -> DataFrame:
        """A topic as a stream; ``last`` are the values of a row that ends it."""
        if last:
            self.end(name, schema, **last)
        return self.spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/{name}")

    def messages(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows as JSON messages in compressed text files, read as a stream of texts."""
        to_messages(rows).select("value").write.option("compression", "gzip").text(f"{self.folder}/{name}")
        return text_stream(self.spark, f"{self.folder}/{name}", 1_000_000)

    def run(self, rows: DataFrame, name: str, columns: list[str] | None = None, partitions: int | None = None) -> DataFrame:
        """Runs a job into a topic, only the named columns in their order where there are names; returns what it wrote."""
        rows_ = f"{self.folder}/{name}"
        runners.run_once(rows, f"{rows_}-state", runners.write_batch(rows_, columns), partitions=partitions)
        schema = T.StructType([rows.schema[c] for c in columns]) if columns else rows.schema
        return self.spark.read.option("recursiveFileLookup", "true").schema(schema).parquet(rows_)


#: Order lines whose state lies in one partition of a stream, and how many partitions it has at least, unless the session has fewer. A partition costs each stateful
#: step of a micro-batch some tenths of a second and several MB of disk, whatever it holds.
LINES_PER_STORE, LEAST_STORES = 250_000, 16


def _stores(s: SparkSession, d: str) -> int:
    """Partitions of a stream over order lines, by their number, which the files' footers tell."""
    return max(min(int(s.conf.get(runners.PARTITIONS)), LEAST_STORES), -(-A.table(s, d, "lineitem").count() // LINES_PER_STORE))


def _pages(topics: Topics, d: str) -> tuple[str, T.StructType]:
    """Page views with the repaired flag of new visitors, as a topic that has its last row."""
    rows = A.page_log(topics.spark, d).withColumn("rt", F.col("rt").cast("timestamp")).drop("k", "event_type")
    topics.put("log", rows)
    topics.run(processors.repair_new_visitors(topics.read("log", rows.schema)), "pages")
    topics.end("pages", rows.schema, mid=END, ts=int(LAST.timestamp() * 1000), seq=0, rt=LAST, last_page_id="home")
    return "pages", rows.schema


def _ends(rows: DataFrame) -> DataFrame:
    rest = [c for c in rows.columns if c not in ("stt", "edt")]
    return rows.select(stamp("stt").alias("stt"), stamp("edt").alias("edt"), *rest)


def _windows(topics: Topics, name: str, schema: T.StructType, keys: list[str], sums: list, size: str = "10 seconds", late: str = "2 seconds", columns: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    topics.end(name, schema, rt=LAST)
    rows = runners.windowed(topics.read(name, schema), "rt", keys, sums, size, late)
    return _ends(topics.run(rows, f"{name}-windows", columns, partitions))


def traffic_window(s: SparkSession, d: str) -> DataFrame:
    """Three streams, first visits, bounces and pages, are one after their union; the watermark comes after it.

    A bounce is known after its page by the bound and two watermarks, so this union waits longer than other windows.
    """
    topics = Topics(s)
    name, schema = _pages(topics, d)
    pages = lambda: topics.read(name, schema)
    topics.run(processors.unique_visitors(pages()), "uv")
    topics.run(processors.bounces(pages(), keep=(*CHANNEL,)), "jumps")
    jump_schema = T.StructType([schema[c] for c in ("mid", "ts", "seq", *CHANNEL)])

    def bean(rows: DataFrame, **ones) -> DataFrame:
        return rows.select("mid", "rt", *CHANNEL, *[F.coalesce(ones.get(c, F.lit(0)), F.lit(0)).cast("long").alias(c) for c in ("uv", "sv", "pv", "dur", "uj")])

    one = F.lit(1)
    jumps = topics.read("jumps", jump_schema).withColumn("rt", F.timestamp_millis("ts"))
    entry = F.col("last_page_id").isNull().cast("int")
    union = bean(topics.read("uv", schema), uv=one).unionByName(bean(jumps, uj=one)).unionByName(bean(pages(), sv=entry, pv=one, dur=F.col("during_time")))
    sums = [F.sum(a).alias(b) for a, b in (("uv", "uv_ct"), ("sv", "sv_ct"), ("pv", "pv_ct"), ("dur", "dur_sum"), ("uj", "uj_ct"))]
    return _ends(topics.run(runners.windowed(union, "rt", CHANNEL, sums, late="15 seconds"), "traffic"))


def visitor_repair(s: SparkSession, d: str) -> DataFrame:
    topics = Topics(s)
    name, schema = _pages(topics, d)
    return s.read.option("recursiveFileLookup", "true").schema(schema).parquet(f"{topics.folder}/{name}").where(F.col("mid") != END).select("mid", "seq", "ts", "is_new")


def visitor_days(s: SparkSession, d: str) -> DataFrame:
    topics = Topics(s)
    name, schema = _pages(topics, d)
    rows = processors.daily_firsts(topics.read(name, schema).where("last_page_id IS NULL"), "mid")
    return topics.run(rows.select("mid", F.date_format("rt", "yyyy-MM-dd").alias("day")), "days")


def _page_machine(machine: Callable[[DataFrame], DataFrame], sums: Callable[[], list]) -> Callable[[SparkSession, str], DataFrame]:
    def query(s: SparkSession, d: str) -> DataFrame:
        topics = Topics(s)
        name, schema = _pages(topics, d)
        rows = machine(topics.read(name, schema).where(F.col("mid") != END))
        topics.run(rows, "flags")
        return _windows(topics, "flags", rows.schema, [], sums())

    return query


home_detail_window = _page_machine(processors.home_detail_flags, lambda: [F.sum("home_uv").alias("home_uv_ct"), F.sum("detail_uv").alias("good_detail_uv_ct")])
login_window = _page_machine(processors.logins, lambda: [F.sum("back").alias("back_ct"), F.count(F.lit(1)).alias("uu_ct")])


def keyword_window(s: SparkSession, d: str) -> DataFrame:
    topics = Topics(s)
    name, schema = _pages(topics, d)
    rows = topics.read(name, schema)
    searched = {"item": "x", "last_page_id": "search", "item_type": "keyword"}  # the last row has a word, too
    words = keyword_rows(rows.withColumns({c: F.when(F.col("mid") == END, v).otherwise(F.col(c)) for c, v in searched.items()}))
    out = topics.run(runners.windowed(words, "rt", ["keyword"], [F.count(F.lit(1)).alias("keyword_count")], "1 hour"), "keywords")
    return _ends(out).select("stt", "edt", F.lit("search").alias("source"), "keyword", "keyword_count")


def register_window(s: SparkSession, d: str) -> DataFrame:
    topics = Topics(s)
    rows = facts.user_register(A.topic_db(s, d)).withColumn("rt", time_of(F.col("create_time")).cast("timestamp"))
    topics.put("registered", rows)
    return _windows(topics, "registered", rows.schema, [], [F.count(F.lit(1)).alias("register_ct")])


def cart_add_window(s: SparkSession, d: str) -> DataFrame:
    topics = Topics(s)
    carts = facts.cart_add(A.topic_db(s, d), A.base_dic(s)).withColumn("at", F.coalesce("operate_time", "create_time")).select("user_id", "id", "at")
    carts = carts.withColumn("rt", time_of(F.col("at")).cast("timestamp"))
    topics.put("carts", carts)
    firsts = runners.day_firsts(topics.read("carts", carts.schema, user_id=END, id=END, rt=LAST), "rt", ["user_id"], ["at", "id"])
    rows = firsts.select("user_id", "id", "at", time_of(F.col("at")).cast("timestamp").alias("rt"))
    topics.run(rows, "users")
    return _windows(topics, "users", rows.schema, [], [F.count(F.lit(1)).alias("cart_add_uu_ct")])


def _details(s: SparkSession, d: str) -> DataFrame:
    return trade.arrivals(facts.order_detail(facts.order_pre_process(A.line_changes(s, d), A.base_dic(s), A.topic_db(s, d), by_order=True)))


def order_window(s: SparkSession, d: str) -> DataFrame:
    """Order lines as messages, delivered twice: typed again, the first of each, flags of buyers, windows of event time."""
    topics = Topics(s)
    lines = _details(s, d)
    typed = parse(topics.messages("lines", lines), lines.schema).withColumn("et", time_of(F.col("create_time")).cast("timestamp"))
    needed = ["id", "user_id", "create_time", "sku_num", "order_price", "split_activity_amount", "split_coupon_amount"]
    once = first_per_key(typed.select("et", *needed), "id", late="100 days").drop("et")
    stores = _stores(s, d)
    topics.run(once, "once", partitions=stores)
    own = topics.read("once", once.schema).withColumn("ms", F.unix_millis(time_of(F.col("create_time")).cast("timestamp")))
    keep = ("id", "sku_num", "order_price", "split_activity_amount", "split_coupon_amount", "ms")
    output = T.StructType([*strings(*keep[:-1]).fields, *[T.StructField(c, T.LongType()) for c in ("ms", "unique_user", "new_user")]])
    flags = process(own, "user_id", ["ms", "id"], output, Buyers(keep))
    flags = trade.amounts(flags).withColumn("rt", F.timestamp_millis("ms"))
    topics.run(flags, "buyers", partitions=stores)
    return _windows(topics, "buyers", flags.schema, [], trade.order_sums(), partitions=stores)


def _numbered(topics: Topics, rows: DataFrame, name: str) -> DataFrame:
    """Rows with the number of their order, as a topic that has its last row."""
    rows = rows.withColumns({"rt": time_of(F.col("create_time")).cast("timestamp"), "number": F.col("order_id").cast("long")})
    topics.put(name, rows)
    topics.end(name, rows.schema, rt=LAST)
    return topics.read(name, rows.schema)


def _order_counts(topics: Topics, rows: DataFrame, name: str, keys: list[str], count: str, amount: bool, late: str) -> DataFrame:
    """Windows of numbered rows with the orders in them: bitmaps are the state, and counts are made of what the job wrote."""
    sums = [F.sum(trade.money("split_total_amount")).alias("amount")] if amount else []
    rows = rows.select(*keys, "order_id", "create_time", *(["split_total_amount"] if amount else []))
    parts = topics.run(runners.windowed_bitmaps(_numbered(topics, rows, name), "rt", keys, "number", sums, late=late), f"{name}-bitmaps")
    return _ends(counted(parts, ["stt", "edt", *keys], count, *([F.sum("amount").cast("double").alias("order_amount")] if amount else [])))


def province_window(s: SparkSession, d: str) -> DataFrame:
    """Times only grow here, so nothing is waited for."""
    topics = Topics(s)
    rows = trade.keep_latest(_details(s, d), *trade.LINE).dropna(subset=["user_id", "source_type_name"])
    out = _order_counts(topics, rows, "latest", ["province_id"], "order_ct", True, "0 seconds")
    named = enrich(out, A.dimensions(s, d)["province"], "province_id", {"name": "province_name"})
    return named.withColumn("province_name", F.coalesce("province_name", F.lit("")))


def user_spu_window(s: SparkSession, d: str) -> DataFrame:
    topics, dims = Topics(s), A.dimensions(s, d)
    rows = enrich(trade.keep_first(_details(s, d), *trade.LINE), dims["sku"], "sku_id", {"spu_id": "spu_id", "tm_id": "trademark_id", "category3_id": "category3_id"})
    out = _order_counts(topics, rows, "goods", ["user_id", "trademark_id", "spu_id", "category3_id"], "order_ct", True, "2 seconds")
    return trade.name_goods(enrich(out, dims["spu"], "spu_id", {"spu_name": "spu_name"}), dims)


def refund_window(s: SparkSession, d: str) -> DataFrame:
    topics, dims = Topics(s), A.dimensions(s, d)
    rows = enrich(facts.order_refund(A.topic_db(s, d), A.base_dic(s)), dims["sku"], "sku_id", {"tm_id": "trademark_id", "category3_id": "category3_id"})
    return trade.name_goods(_order_counts(topics, rows, "refunds", ["trademark_id", "category3_id", "user_id"], "refund_ct", False, "2 seconds"), dims)


def order_chain(s: SparkSession, d: str) -> DataFrame:
    """From changes to the window of orders in one query: no topic between the joins, the buyers' flags and the window."""
    topics = Topics(s)
    kinds = ("order_detail", "order_info", "order_detail_activity", "order_detail_coupon")
    topics.put("db", A.order_changes(s, d))
    last = int(LAST.timestamp())
    ends = [("shop", k, "insert", {"id": f"{END}{n}", "order_id": f"{END}{n}", "order_detail_id": f"{END}{n}", "source_type": "2401", "user_id": END}, None, str(last + 1000 * n)) for n in (0, 1) for k in kinds]
    topics.put("db", s.createDataFrame(ends, CDC))
    out = topics.run(joins.order_windows(topics.read("db", CDC), A.base_dic(s)), "windows", partitions=_stores(s, d))
    return _ends(out.where(F.col("stt") < F.lit(LAST)))


def _clicks(topics: Topics, d: str, name: str = "events", *columns: Column) -> DataFrame:
    """Events with their time in ms, as a topic that has its last row."""
    rows = A.table(topics.spark, d, "events").select(F.col("user_id").cast("string").alias("mid"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("seq"), "event_type", "value", F.col("ts").cast("timestamp").alias("rt"), *columns)
    topics.put(name, rows)
    return topics.read(name, rows.schema, mid=END, ts=int(LAST.timestamp() * 1000), seq=-1, event_type="end", value=0.0, rt=LAST)


#: Hours without any event after which a user's next one is told, and hours for which a told one silences others.
QUIET_HOURS, AGAIN_HOURS = 6, 24


def expiring_firsts(s: SparkSession, d: str) -> DataFrame:
    """A user's events after a silence, and the first of a day's length: one state variable lives from its last read, one from its last write."""
    topics = Topics(s)
    output = T.StructType([T.StructField(c, T.LongType()) for c in ("seq", "quiet", "again")])
    logic = Firsts(QUIET_HOURS * 3_600_000, AGAIN_HOURS * 3_600_000, ("seq",))
    return topics.run(process(_clicks(topics, d), "mid", ["ts", "seq"], output, logic, "rt"), "firsts").where("seq >= 0")


#: Seconds for which a delivery waits for later ones of its line.
HOLD_SECONDS = 5


def latest_held(s: SparkSession, d: str) -> DataFrame:
    """The latest delivery of each line once it has waited; every third line is delivered a third time, when the first two are gone."""
    topics = Topics(s)
    lines = _details(s, d).select("id", "split_total_amount", "row_op", F.unix_millis(time_of(F.col("create_time")).cast("timestamp")).alias("begin"))
    delivery = lambda op, amount: F.struct(op.cast("double").alias("row_op"), amount.alias("split_total_amount"))
    third = delivery(F.lit(9), (trade.money("split_total_amount") + 1).cast("decimal(18,2)").cast("string"))
    both = F.array_compact(F.array(delivery(F.col("row_op"), F.col("split_total_amount")), F.when(F.expr("row_op > 0 AND length(id) % 3 = 0"), third)))
    rows = lines.withColumn("_d", F.explode(both)).select("id", "_d.split_total_amount", "_d.row_op", (F.col("begin") + F.col("_d.row_op") * 1000).cast("long").alias("ms"))
    rows = rows.withColumn("rt", F.timestamp_millis("ms"))
    topics.put("deliveries", rows)
    stream = topics.read("deliveries", rows.schema, id=END, split_total_amount="0", row_op=0.0, ms=int(LAST.timestamp() * 1000), rt=LAST)
    output = T.StructType([*strings("id", "split_total_amount").fields, T.StructField("held_ms", T.LongType())])
    return topics.run(process(stream, "id", ["ms", "row_op", "split_total_amount"], output, LatestHeld(HOLD_SECONDS * 1000, "row_op", ("id", "split_total_amount")), "rt"), "latest", partitions=_stores(s, d))


#: Lines of a third of a file of the topics that are joined, so that as many tasks write and read them as they need.
LINES_PER_FILE = 600_000


def retracting_join(s: SparkSession, d: str) -> DataFrame:
    """Lines with activity and coupon, each in three micro-batches that do not fit to each other: rows go out with nulls and are taken back."""
    topics = Topics(s)
    db, parts = A.topic_db(s, d), {}
    files = max(1, -(-A.table(s, d, "lineitem").count() // LINES_PER_FILE))
    for kind, columns in (("order_detail", {"id": "id", "order_id": "order_id"}), ("order_detail_activity", {"id": "order_detail_id", "activity_id": "activity_id"}), ("order_detail_coupon", {"id": "order_detail_id", "coupon_id": "coupon_id"})):
        rows = facts.changes(db, kind).select(*[F.col("data")[old].alias(new) for new, old in columns.items()])
        rows.repartition(3 * files, F.xxhash64("id", F.lit(kind))).write.parquet(f"{topics.folder}/{kind}")
        parts[kind] = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{topics.folder}/{kind}")
    lines, activity, coupon = parts.values()
    changes = changelog_join(changelog_join(lines, activity, ["id"]), coupon, ["id"])
    folder = f"{topics.folder}/changes"
    runners.run_once(changes, f"{folder}-state", write_folded(folder), partitions=_stores(s, d))
    return read_folded(s, folder, changes.schema)


def _change(op: str, before: Column, after: Column) -> Column:
    return F.to_json(F.struct(F.lit(op).alias("op"), before.alias("before"), after.alias("after"))).alias("value")


def config_change(s: SparkSession, d: str) -> DataFrame:
    """Routes from a snapshot and then a log: customers of the first half are routed as the snapshot says, those of the second as the log has changed it."""
    register(s)
    topics = Topics(s)
    log, snapshot, routes, data = (f"{topics.folder}/{x}" for x in ("log", "snapshot", "routes", "data"))
    key, nations = F.col("n_nationkey"), A.table(s, d, "nation")
    row = lambda sink: F.struct(F.col("n_name").alias("source_table"), sink.alias("sink_table"), F.lit("id,name").alias("sink_columns"))
    first, second = row(F.concat(F.lit("dim_"), key)), row(F.concat(F.lit("dim_new_"), key))
    none = F.lit(None).cast(T.StructType([*strings("source_table", "sink_table", "sink_columns").fields]))
    take_snapshot(nations.select(first.alias("r")).select("r.*"), log, snapshot)

    def keep(batch: DataFrame, n: int) -> None:
        changes = batch.select(F.from_json("value", CONFIG_CHANGE).alias("m"), (F.when(F.col("partition") < 0, 0).otherwise(F.col("offset") + 1)).alias("version"))
        rows = changes.select(F.coalesce("m.after.source_table", "m.before.source_table").alias("source_table"), "m.op", "m.after.sink_table", "m.after.sink_columns", "version")
        upsert_parquet(s, rows, routes, ["source_table"], ["version"], n)

    def configure() -> None:
        runners.run_once(s.readStream.format("snapshot_log").option("path", log).option("snapshot", snapshot).load(), f"{routes}-state", keep)

    def config() -> DataFrame:
        return read_upserts(s, routes, ["source_table"], ["version"]).where("op <> 'd'").select("source_table", "sink_table", "sink_columns", F.lit(None).cast("string").alias("sink_pk"))

    people = A.table(s, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    data_row = F.create_map(F.lit("id"), F.col("c_custkey").cast("string"), F.lit("name"), F.col("c_name"))
    changes = people.select(F.lit("shop").alias("database"), F.col("n_name").alias("table"), F.lit("insert").alias("type"), data_row.alias("data"), F.lit(None).cast("map<string,string>").alias("old"), F.lit("1").alias("ts"), (F.col("c_custkey") % 2).alias("half"))
    stream = lambda: s.readStream.schema(CDC).parquet(f"{data}/*")
    for half in (0, 1):
        if half:
            append_rows(nations.where("n_nationkey % 3 = 1").select(_change("u", first, second)), log, "config", 0)
            append_rows(nations.where("n_nationkey % 3 = 2").select(_change("d", first, none)), log, "config", 1)
        configure()
        changes.where(F.col("half") == half).drop("half").write.parquet(f"{data}/{half}")
        runners.route_to_tables(stream(), config, f"{topics.folder}/dims", f"{topics.folder}/dims-state")
    return read_upserts(s, f"{topics.folder}/dims", ["sink_table", "pk"], ["ts"]).select("sink_table", "pk")


def group_offsets(s: SparkSession, d: str) -> DataFrame:
    """Two groups read one topic. One of them ends after half of it and goes on with a new checkpoint: the group knows where it was."""
    register(s)
    topics = Topics(s)
    topic = f"{topics.folder}/topic"
    events = A.table(s, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("string").alias("value"))

    def read(group: str, run: int) -> None:
        rows = s.readStream.format("topic").option("path", topic).option("group", group).load()
        runners.run_group(rows.select(F.lit(group).alias("reader"), "value"), f"{topics.folder}/{group}-{run}", runners.write_batch(f"{topics.folder}/out/{group}-{run}"), topic, group)

    half = F.col("value").cast("long") % 2 == 0
    append_rows(events.where(half), topic, "events", 0, 4)
    read("stopping", 0)
    append_rows(events.where(~half), topic, "events", 1, 4)
    read("stopping", 1)
    read("steady", 0)
    return s.read.option("recursiveFileLookup", "true").schema("reader string, value string").parquet(f"{topics.folder}/out")


def committed_topic(s: SparkSession, d: str) -> DataFrame:
    """Favors through a sink whose batches are seen as a whole: the job runs again with a lost checkpoint, and nothing is there twice."""
    register(s)
    topics = Topics(s)
    rows = facts.favor_add(A.topic_db(s, d))
    topics.put("favors", rows)
    topic = f"{topics.folder}/topic"
    for run in range(2):
        messages = to_messages(topics.read("favors", rows.schema), ["id"])
        query = messages.writeStream.format("topic").option("path", topic).option("writer", "favors").option("partitions", "3").option("checkpointLocation", f"{topics.folder}/sink-{run}").trigger(availableNow=True).start()
        query.awaitTermination()
    return topics.run(parse(s.readStream.format("topic").option("path", topic).load(), rows.schema), "read")


def bounce_pattern(s: SparkSession, d: str) -> DataFrame:
    """Bounces as a pattern: two entries next to each other within three hours, or one that the time ran out on; the first row of either."""
    topics = Topics(s)
    name, schema = _pages(topics, d)
    rows = topics.read(name, schema).withColumn("entry", F.col("last_page_id").isNull())
    found = match(rows, "mid", [Step("entry", times=2, next=True)], 3 * 3_600_000, "rt", timeouts=True)
    return topics.run(found.select("mid", F.col("taken")[0].alias("seq"), F.col("began").alias("ts")), "bounces")


def funnel(s: SparkSession, d: str) -> DataFrame:
    """A view, the next click after it and the next purchase after that, within ten days of the view; other events are passed over."""
    topics = Topics(s)
    rows = _clicks(topics, d).withColumns({k: F.col("event_type") == k for k in ("view", "click", "purchase")})
    found = match(rows, "mid", [Step("view"), Step("click"), Step("purchase")], 10 * 86_400_000, "rt")
    return topics.run(found.select("mid", *[F.col("taken")[i].alias(c) for i, c in enumerate(("view", "click", "purchase"))]), "funnel")


def full_join(s: SparkSession, d: str) -> DataFrame:
    """Clicks and purchases of a user within an hour of each other, and those without a partner once none can follow."""
    topics = Topics(s)
    sides = []
    for kind, x in (("click", "l"), ("purchase", "r")):
        rows = A.table(s, d, "events").where(F.col("event_type") == kind).select(F.col("user_id").alias(f"id_{x}"), F.col("event_id").alias(f"event_id_{x}"), F.col("ts").cast("timestamp").alias(f"ts_{x}"))
        topics.put(kind, rows)
        sides.append(topics.read(kind, rows.schema, **{f"id_{x}": -1 if x == "l" else -2, f"event_id_{x}": -1, f"ts_{x}": LAST}).withWatermark(f"ts_{x}", "1 minute"))
    near = F.expr("id_l = id_r AND ts_r BETWEEN ts_l - INTERVAL 1 HOUR AND ts_l + INTERVAL 1 HOUR")
    return topics.run(sides[0].join(sides[1], near, "full_outer").select("id_l", "event_id_l", "id_r", "event_id_r"), "pairs").where("coalesce(event_id_l, event_id_r) >= 0")


def log_pages(s: SparkSession, d: str) -> DataFrame:
    """Application logs in text, in one pass into five tables and the unreadable ones; the pages are read again."""
    topics = Topics(s)
    A.raw_log(s, d).select("value").write.text(f"{topics.folder}/logs")
    runners.fan_out_logs(text_stream(s, f"{topics.folder}/logs", 1_000_000), f"{topics.folder}/split", f"{topics.folder}/split-state")
    return s.read.parquet(f"{topics.folder}/split/page").select("common.*", "page.*", "ts")


def coupon_messages(s: SparkSession, d: str) -> DataFrame:
    """Change messages in text, some of them unreadable, as a typed stream of changes."""
    topics = Topics(s)
    changes = facts.changes(A.topic_db(s, d), "coupon_use")
    values = topics.messages("changes", changes)
    s.createDataFrame([("not json",), ("",), ('{"table": ',)], "value string").write.mode("append").text(f"{topics.folder}/changes")
    return topics.run(facts.coupon_get(change_stream(values)), "coupons")


def detail_messages(s: SparkSession, d: str) -> DataFrame:
    """Order lines written as messages and read again as the typed table of that topic."""
    topics = Topics(s)
    lines = facts.order_detail(facts.order_pre_process(A.line_changes(s, d), A.base_dic(s), A.topic_db(s, d), by_order=True))
    return topics.run(parse(topics.messages("lines", lines), facts.DETAIL_TOPIC), "typed")


def exactly_once(s: SparkSession, d: str) -> DataFrame:
    """A job that is started again goes on where it was, and a batch that runs again replaces itself."""
    topics = Topics(s)
    rows = facts.favor_add(A.topic_db(s, d))
    topics.put("favors", rows)
    topics.run(topics.read("favors", rows.schema), "once")
    runners.write_batch(f"{topics.folder}/once")(rows, 0)  # as after a failure between writing and committing
    return topics.run(topics.read("favors", rows.schema), "once")


def routed_tables(s: SparkSession, d: str) -> DataFrame:
    """Dimension changes as messages into a table for each route, created where it is missing; the tables are read again."""
    topics = Topics(s)
    changes = change_stream(topics.messages("changes", A.dimension_changes(s, d)))
    runners.route_to_tables(changes, lambda: A.routes(s), f"{topics.folder}/dims", f"{topics.folder}/dims-state")
    tables = [runners.read_routed(s, f"{topics.folder}/dims", name).select(F.lit(name).alias("sink_table"), "pk", as_text(F.from_json("row", "map<string,string>")).alias("row")) for name in ("dim_base_province", "dim_user_info")]
    return tables[0].unionByName(tables[1])


def created_tables(s: SparkSession, d: str) -> DataFrame:
    """A table for each region, made from its route, with its nations written into it by its columns and read again.

    The tables are in a catalog database of their own, which goes when they are written; their files stay in the shared folder.
    """
    topics, out = Topics(s), None
    regions, nations = A.table(s, d, "region"), A.table(s, d, "nation")
    columns = F.when(F.col("r_regionkey") % 2 == 0, "id,name").otherwise("name,region")
    routes = regions.select("r_regionkey", F.concat(F.lit("dim_region_"), "r_regionkey").alias("sink_table"), columns.alias("sink_columns"), F.when(F.col("r_regionkey") % 2 == 1, "name").alias("sink_pk"))
    database = f"routes_{uuid.uuid4().hex[:12]}"
    s.sql(f"CREATE DATABASE {database} LOCATION '{topics.folder}/{database}'")
    try:
        for r in routes.collect():  # a row for each table of the warehouse
            place = f"{topics.folder}/{r.sink_table}"
            create_dimension(s, r.sink_table, r.sink_columns, r.sink_pk, None, place, database)
            rows = nations.where(F.col("n_regionkey") == r.r_regionkey).select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("region"))
            names = s.table(f"{database}.{r.sink_table}").columns
            rows.select(*names).write.mode("append").insertInto(f"{database}.{r.sink_table}")
            own = s.read.schema(T.StructType([*strings(*names).fields])).parquet(place)
            own = own.select(F.lit(r.sink_table).alias("sink_table"), F.lit(",".join(names)).alias("columns"), F.concat_ws("|", *names).alias("row"))
            out = own if out is None else out.unionByName(own)
    finally:
        s.sql(f"DROP DATABASE {database} CASCADE")
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "stream_visitor_is_new_fix": visitor_repair, "stream_unique_visitor_days": visitor_days, "stream_traffic_window": traffic_window, "stream_home_detail_window": home_detail_window,
        "stream_login_window": login_window, "stream_keyword_window": keyword_window, "stream_register_window": register_window, "stream_cart_add_window": cart_add_window,
        "stream_order_window": order_window, "stream_province_window": province_window, "stream_full_join": full_join, "stream_coupon_messages": coupon_messages,
        "stream_detail_messages": detail_messages, "stream_exactly_once": exactly_once, "stream_log_pages": log_pages, "stream_routed_tables": routed_tables, "created_tables": created_tables,
        "stream_user_spu_window": user_spu_window, "stream_refund_window": refund_window, "stream_order_chain": order_chain, "stream_expiring_firsts": expiring_firsts, "stream_latest_held": latest_held,
        "stream_retracting_join": retracting_join, "stream_config_change": config_change, "stream_group_offsets": group_offsets, "stream_committed_topic": committed_topic,
        "stream_bounce_pattern": bounce_pattern, "stream_funnel": funnel,
    }
