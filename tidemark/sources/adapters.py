"""The test tables as the streams, change data, lookups and dimensions of a shop."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import stamp
from ..schemas import CONFIG, DICTIONARY

SESSION_GAP_MS = 6 * 3600 * 1000
PAGES = {"view": "home", "click": "good_detail", "purchase": "search", "signup": "register", "error": "login"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_table(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A few rows of text whose size the planner knows."""
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return spark.createDataFrame(pa.table({f.name: pa.array(list(c), pa.string()) for f, c in zip(schema, columns, strict=True)}))


def _text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _money(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)").cast("string")


def page_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page views ← events: one page for each event, in sessions that six hours without one end."""
    people = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("ar"))
    goods = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("item"))
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    page = F.coalesce(*[F.when(F.col("event_type") == a, b) for a, b in PAGES.items()])
    by = Window.partitionBy("user_id").orderBy("ts_ms", "event_id")
    events = table(spark, sf_dir, "events").withColumns({"ts_ms": F.unix_millis(F.col("ts").cast("timestamp")), "k": k, "page_id": page})
    near = F.col("ts_ms") - F.lag("ts_ms").over(by) < SESSION_GAP_MS
    events = events.withColumn("last_page_id", F.when(near, F.lag("page_id").over(by)))
    events = events.join(people, F.col("user_id") == F.col("c_custkey"), "left").join(goods, F.col("event_id") % 200 + 1 == F.col("p_partkey"), "left")
    return events.select(
        _text("user_id").alias("mid"),
        F.when(F.col("k") < 5, _text("user_id")).alias("uid"),
        F.when(F.col("k") < 50, "1").otherwise("0").alias("is_new"),
        _text(F.col("user_id") % 3).alias("vc"), _text(F.col("user_id") % 4).alias("ch"), "ar",
        "page_id", "last_page_id", "item",
        F.when(F.col("page_id") == "good_detail", "keyword").otherwise("sku").alias("item_type"),
        F.floor(F.col("value") * 1000).cast("long").alias("during_time"),
        F.col("ts_ms").alias("ts"), F.col("ts").cast("timestamp_ntz").alias("rt"), F.col("event_id").alias("seq"), "k", "event_type",
    )


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same page views as JSON messages, with start, error, display and action parts; some are no JSON."""
    p = page_log(spark, sf_dir)
    part = lambda *cs: F.struct(*cs)
    item = lambda n: part(_text(F.col("k") + n).alias("item"), F.lit("sku").alias("item_type"), F.lit(n + 1).cast("long").alias("order"))
    action = F.array(part(F.lit("cart_add").alias("action_id"), _text("k").alias("item"), F.col("ts").alias("ts")))
    message = part(
        part("mid", "uid", "is_new", "vc", "ch", "ar").alias("common"),
        F.when(F.col("event_type") != "signup", part("page_id", "last_page_id", "item", "item_type", "during_time")).alias("page"),
        F.when(F.col("event_type") == "signup", part(F.lit("icon").alias("entry"), F.col("k").cast("long").alias("loading_time"))).alias("start"),
        F.when(F.col("event_type") == "error", part(F.col("k").cast("long").alias("error_code"), F.lit("oops").alias("msg"))).alias("err"),
        F.when(F.col("event_type") == "view", F.array(item(0), item(1))).alias("displays"),
        F.when((F.col("event_type") == "click") & (F.col("k") < 50), action).alias("action"),
        F.when((F.col("event_type") == "click") & (F.col("k") >= 50), action).alias("actions"),
        "ts",
    )
    broken = F.when(F.col("seq") % 97 == 0, "not json").when(F.col("seq") % 101 == 0, "").when(F.col("seq") % 103 == 0, '{"common": {')
    return p.select(F.coalesce(broken, F.to_json(message)).alias("value"), "seq")


def _changes(rows: DataFrame, name: str | Column, kind: str | Column, data: dict[str, Column], old: Column | None = None, time: str = "at", more: tuple[str, ...] = ()) -> DataFrame:
    pairs = [x for k, v in data.items() for x in (F.lit(k), v)]
    return rows.select(
        F.lit("shop").alias("database"), (F.lit(name) if isinstance(name, str) else name).alias("table"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"),
        F.create_map(*pairs).alias("data"), (old if old is not None else F.lit(None)).cast("map<string,string>").alias("old"),
        _text(F.unix_timestamp(F.col(time).cast("timestamp"))).alias("ts"), *more,
    )


#: Order lines of one partition of their topic. What a task sorts, some 2 KB for each of them, then fits its memory however many there are.
LINES_PER_PARTITION = 60_000


def _lines(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    # They meet by the text that changes carry, so that what groups or joins lines by their order needs no further shuffle.
    o = table(spark, sf_dir, "orders").select(_text("o_orderkey").alias("order_id"), "o_orderkey", "o_custkey", F.col("o_orderdate").alias("at"))
    rows = table(spark, sf_dir, "lineitem").withColumn("order_id", _text("l_orderkey"))
    rows = (rows.repartition(partitions, "order_id") if partitions else rows).join(o, "order_id")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return rows.withColumns({"id": key, "price": F.col("l_extendedprice").cast("decimal(18,2)")})


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).withColumn("at", F.col("o_orderdate"))


def _number(c: str) -> Column:
    return _text(F.col(c).cast("long"))


#: What a line has besides its own change, and when.
LINE_PARTS = {"order_detail": "true", "order_detail_activity": "l_discount > 0.05", "order_detail_coupon": "l_tax > 0.04"}


def _line_changes(lines: DataFrame, name: str | Column, *more: str) -> DataFrame:
    """Changes of lines, their activities or their coupons, as the column ``kind`` says."""
    detail, at = F.col("kind") == "order_detail", stamp("at")
    kind = F.when(detail, "").when(F.col("kind") == "order_detail_activity", "a").otherwise("c")
    return _changes(lines, name, "insert", {
        "id": F.concat(kind, "id"), "order_id": F.col("order_id"), "sku_id": _text("l_partkey"), "order_detail_id": F.when(~detail, F.col("id")), "create_time": at,
        "sku_name": F.when(detail, F.concat(F.lit("sku "), _text("l_partkey"))), "order_price": F.when(detail, _text("price")), "sku_num": F.when(detail, _number("l_quantity")),
        "source_type": F.when(detail, _text(F.col("l_linenumber") % 5 + 2401)), "source_id": F.when(detail, _text("l_suppkey")), "split_total_amount": F.when(detail, _text((F.col("price") * F.col("l_quantity").cast("int")).cast("decimal(18,2)"))),
        "split_activity_amount": F.when(detail & F.expr(LINE_PARTS["order_detail_activity"]), _money("l_discount")), "split_coupon_amount": F.when(detail & F.expr(LINE_PARTS["order_detail_coupon"]), _money("l_tax")),
        "activity_id": F.when(~detail, _text(F.col("l_partkey") % 10)), "activity_rule_id": F.when(~detail, _text(F.col("l_suppkey") % 7)),
        "coupon_id": F.when(~detail, _text(F.col("l_suppkey") % 13)), "coupon_use_id": F.when(~detail, _text(F.col("l_orderkey") % 1000))}, more=more)


def _order_states(orders: DataFrame) -> DataFrame:
    """All states of an order from one row of it."""
    at, changed = stamp("at"), F.col("o_orderstatus") != "O"
    status = F.when(F.col("o_orderstatus") == "O", "1001").when(F.col("o_orderstatus") == "F", "1002").otherwise("1003")
    state = lambda kind, code: F.struct(kind.alias("type"), code.alias("status"))
    later = [F.when(F.expr(when), state(F.lit("update"), F.lit(code))) for when, code in (("o_orderkey % 2 = 0", "1005"), ("o_orderkey % 3 = 1", "1006"))]
    states = orders.withColumn("state", F.explode(F.array_compact(F.array(state(F.when(changed, "update").otherwise("insert"), status), *later))))
    data = {"id": _text("o_orderkey"), "user_id": _text("o_custkey"), "province_id": _text("c_nationkey"), "total_amount": _money("o_totalprice"), "create_time": at, "operate_time": at, "consignee": F.concat(F.lit("user "), _text("o_custkey")), "payment_way": F.col("o_orderpriority"), "order_status": F.col("state.status")}
    return _changes(states, "order_info", F.col("state.type"), data, F.when(F.col("state.type") == "update", F.create_map(F.lit("order_status"), F.lit("1001"))))


def line_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What :func:`topic_db` has of order lines, their activities and coupons, as a topic of its own that comes from one pass.

    The messages' key, ``order_id``, is a column beside the change: what lies by it stays so, which a value of the map would not tell.
    The number of partitions follows the number of lines, which the files' footers tell: adaptive execution merges partitions by their compressed
    bytes, and 64 MB of these are two million lines, which a task can only sort on disk.
    """
    partitions = max(1, -(-table(spark, sf_dir, "lineitem").count() // LINES_PER_PARTITION))
    kinds = F.array_compact(F.array(*[F.when(F.expr(when), name) for name, when in LINE_PARTS.items()]))
    return _line_changes(_lines(spark, sf_dir, partitions).withColumn("kind", F.explode(kinds)), F.col("kind"), "order_id")


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic of lines with that of their orders."""
    return line_changes(spark, sf_dir).drop("order_id").unionByName(_order_states(_orders(spark, sf_dir)))


def topic_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change data of all tables of the shop. A filter on ``table`` leaves only its own branch in the plan."""
    lines, orders, events = _lines(spark, sf_dir), _orders(spark, sf_dir), table(spark, sf_dir, "events")
    at, number = stamp("at"), _number
    own = {"id": F.col("id"), "order_id": F.col("order_id"), "sku_id": _text("l_partkey")}
    refunds = lines.where("l_returnflag = 'R'")
    e = events.withColumns({"at": F.col("ts"), "k": F.regexp_extract("props", "[0-9]+", 0).cast("int")})
    user = {"id": _text("event_id"), "user_id": _text("user_id")}
    coupon = user | {"coupon_id": _text(F.col("k") % 7)}
    cart = lines.withColumn("was", F.lag("l_quantity").over(Window.partitionBy("o_custkey", "l_partkey").orderBy("at", "id", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")))
    parts = [
        *[_line_changes(lines.where(when).withColumn("kind", F.lit(name)), name) for name, when in LINE_PARTS.items()],
        _order_states(orders),
        _changes(cart, "cart_info", F.when(F.col("was").isNull(), "insert").otherwise("update"), own | {
            "user_id": _text("o_custkey"), "cart_price": _text("price"), "sku_num": number("l_quantity"), "sku_name": F.concat(F.lit("sku "), _text("l_partkey")), "is_checked": F.lit("1"), "create_time": at,
            "operate_time": F.when(F.col("was").isNotNull(), at), "is_ordered": F.lit("0"), "source_type": _text(F.col("l_linenumber") % 5 + 2401), "source_id": _text("l_suppkey")},
            F.when(F.col("was").isNotNull(), F.create_map(F.lit("sku_num"), number("was")))),
        _changes(orders.where("o_orderstatus = 'O'"), "payment_info", "update", {"id": _text("o_orderkey"), "user_id": _text("o_custkey"), "order_id": _text("o_orderkey"), "payment_type": _text(F.col("o_custkey") % 4 + 1101), "payment_status": F.when(F.col("o_orderkey") % 3 != 0, "1602").otherwise("1601"), "callback_time": stamp(F.col("at") + F.expr("INTERVAL 1 HOUR"))}),
        _changes(refunds, "order_refund_info", "insert", own | {"user_id": _text("o_custkey"), "refund_type": _text(F.col("l_linenumber") % 3 + 1501), "refund_num": number("l_quantity"), "refund_amount": _text("price"), "refund_reason_type": _text(F.col("l_suppkey") % 3 + 1301), "refund_reason_txt": F.lit("late"), "create_time": at}),
        _changes(refunds, "refund_payment", "update", own | {"id": F.concat(F.lit("p"), "id"), "payment_type": _text(F.col("l_linenumber") % 4 + 1101), "callback_time": stamp(F.col("at") + F.expr("INTERVAL 2 HOURS")), "total_amount": _text("price"), "refund_status": F.when(F.col("l_linenumber") % 2 == 0, "0702").otherwise("0701")}, F.create_map(F.lit("refund_status"), F.lit("0701"))),
        _changes(e.where("event_type = 'click'"), "coupon_use", "insert", coupon | {"get_time": at, "coupon_status": F.lit("1401")}),
        _changes(e.where("event_type = 'purchase'"), "coupon_use", "update", coupon | {"order_id": _text(F.col("event_id") * 3), "using_time": at, "coupon_status": F.when(F.col("k") < 70, "1402").otherwise("1403"), "used_time": F.when(F.col("k") % 2 == 0, at)}, F.create_map(F.lit("coupon_status"), F.when(F.col("k") < 60, "1401").otherwise("1400"))),
        _changes(e.where("event_type = 'view'"), "favor_info", "insert", user | {"sku_id": _text("k"), "create_time": at}),
        _changes(e.where("event_type = 'error'"), "comment_info", "insert", user | {"sku_id": _text("k"), "order_id": _text(F.col("event_id") * 3), "create_time": at, "appraise": _text(F.col("k") % 5 + 1201)}),
        _changes(e.where("event_type = 'signup'"), "user_info", "insert", {"id": _text("user_id"), "create_time": at}),
    ]
    return reduce(DataFrame.unionByName, parts)


def dimension_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change data of dimension tables; suppliers have no route."""
    kinds = F.element_at(F.array(*map(F.lit, ("bootstrap-insert", "insert", "update", "delete"))), (F.col("key") % 4 + 1).cast("int"))
    day = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    shape = lambda t, key, name, more: table(spark, sf_dir, t).withColumns({"key": F.col(key).cast("long"), "name": F.col(name), "more": _text(more), "at": day})
    tables = {"nation": ("n_nationkey", "n_name", "n_regionkey"), "customer": ("c_custkey", "c_name", "c_nationkey"), "supplier": ("s_suppkey", "s_name", "s_nationkey")}
    return reduce(DataFrame.unionByName, [_changes(shape(t, *cs), t, kinds, {"id": _text("key"), "name": F.col("name"), "parent_id": F.col("more"), "note": F.lit("x")}) for t, cs in tables.items()])


def routes(spark: SparkSession) -> DataFrame:
    rows = [("nation", "dim_base_province", "id,name", "id", None), ("customer", "dim_user_info", "id,name,parent_id", None, None)]
    return local_table(spark, rows, CONFIG)


#: Codes and names of the dictionary that the adapters use.
DICTIONARY_ROWS = [
    ("2401", "query", "24"), ("2402", "promotion", "24"), ("2403", "recommend", "24"), ("2404", "activity", "24"),
    ("1101", "card", "11"), ("1102", "transfer", "11"), ("1103", "wallet", "11"),
    ("1201", "great", "12"), ("1202", "good", "12"), ("1203", "fair", "12"), ("1204", "poor", "12"),
    ("1301", "quality", "13"), ("1302", "size", "13"), ("1303", "other", "13"),
    ("1501", "money", "15"), ("1502", "goods", "15"),
]


def base_dic(spark: SparkSession) -> DataFrame:
    return local_table(spark, DICTIONARY_ROWS, DICTIONARY)


def dimensions(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Goods, their trademarks and three levels of categories, and provinces; some trademarks and one province are missing."""
    part = table(spark, sf_dir, "part")
    level2 = F.length("p_type") % 5
    return {
        "sku": part.select(_text("p_partkey").alias("id"), F.col("p_name").alias("spu_id"), F.col("p_brand").alias("tm_id"), F.col("p_type").alias("category3_id")),
        "spu": part.select(F.col("p_name").alias("id"), F.concat(F.lit("spu "), "p_name").alias("spu_name")).distinct(),
        "trademark": part.where(~F.col("p_brand").endswith("1")).select(F.col("p_brand").alias("id"), F.lower("p_brand").alias("tm_name")).distinct(),
        "category3": part.select(F.col("p_type").alias("id"), F.lower("p_type").alias("name"), _text(level2).alias("category2_id")).distinct(),
        "category2": part.select(_text(level2).alias("id"), F.concat(F.lit("c2 "), _text(level2)).alias("name"), _text(level2 % 3).alias("category1_id")).distinct(),
        "category1": part.select(_text(level2 % 3).alias("id"), F.concat(F.lit("c1 "), _text(level2 % 3)).alias("name")).distinct(),
        "province": table(spark, sf_dir, "nation").where("n_nationkey <> 3").select(_text("n_nationkey").alias("id"), F.col("n_name").alias("name")),
    }
