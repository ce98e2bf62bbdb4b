"""All plans over the test tables by name."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dictionary import dictionary_words
from ..functions.scalars import as_beans, latest_of, seconds_time, stamp, stamped, time_of, to_millis
from ..functions.tokens import register_splitter
from ..operators import state
from ..operators.bitmaps import bitmaps, counted, merged, number_ids
from ..operators.joins import interval_join, window_join
from ..operators.route import as_text, parse_logs, route_dimensions, split_logs
from ..operators.windows import tumble
from ..operators.versions import as_of, versions
from ..sources import adapters as A
from ..operators.upsert import compact_upserts, read_upserts, upsert_parquet
from ..schemas import strings
from ..session import shared_folder
from ..sources.connectors import config_from_changes, demo_lines
from . import facts, oracle, serving, streamed, trade, traffic

Query = Callable[[SparkSession, str], DataFrame]


def _pages(s: SparkSession, d: str) -> DataFrame:
    return state.repair_new_visitors(A.page_log(s, d))


def _logs(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return split_logs(parse_logs(A.raw_log(s, d))[0])


def _db(fact: Callable[..., DataFrame], dic: bool = False) -> Query:
    return lambda s, d: fact(A.topic_db(s, d), A.base_dic(s)) if dic else fact(A.topic_db(s, d))


def _wide(s: SparkSession, d: str) -> DataFrame:
    return facts.order_pre_process(A.line_changes(s, d), A.base_dic(s), A.topic_db(s, d), by_order=True)


def _details(s: SparkSession, d: str) -> DataFrame:
    return facts.order_detail(_wide(s, d))


def _first(s: SparkSession, d: str) -> DataFrame:
    return trade.keep_first(trade.arrivals(_details(s, d)), *trade.LINE)


def _latest(s: SparkSession, d: str) -> DataFrame:
    return trade.keep_latest(trade.arrivals(_details(s, d)), *trade.LINE)


def _paid(s: SparkSession, d: str) -> DataFrame:
    return facts.pay_detail_suc(A.topic_db(s, d), _details(s, d), A.base_dic(s))


def _provinces(s: SparkSession, d: str, size: str = "10 seconds") -> DataFrame:
    return trade.province_window(_latest(s, d), A.dimensions(s, d)["province"], size)


def _route(s: SparkSession, d: str) -> DataFrame:
    return route_dimensions(A.dimension_changes(s, d), A.routes(s)).select("sink_table", "pk", as_text(F.col("row")).alias("row"))


def _events(s: SparkSession, d: str, kind: str) -> DataFrame:
    return A.table(s, d, "events").where(F.col("event_type") == kind).select(F.col("user_id").alias("id"), "event_id", "ts")


def _windows(s: SparkSession, d: str) -> DataFrame:
    out = window_join(_events(s, d, "click"), _events(s, d, "purchase"), "id", "ts", "1 hour")
    return out.select("id_l", "event_id_l", "event_id_r", F.date_format("stt", "yyyy-MM-dd HH:mm:ss").alias("stt"))


def _demo(how: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        a = A.table(s, d, "customer").select(F.col("c_custkey").alias("id_l"), "c_name")
        b = A.table(s, d, "supplier").select((F.col("s_suppkey") * 31).alias("id_r"), "s_name")
        return a.join(b, F.col("id_l") == F.col("id_r"), how)

    return run


def _keywords_by_function(s: SparkSession, d: str) -> DataFrame:
    """The keyword count with the table function in place of the built-in split."""
    register_splitter(s)
    searched = _pages(s, d).where("item IS NOT NULL AND last_page_id = 'search' AND item_type = 'keyword'").select("rt", "item")
    searched.createOrReplaceTempView("searched_items")
    words = s.sql("SELECT rt, word AS keyword FROM searched_items, LATERAL split_words(item)")
    return tumble(words, "rt", ["keyword"], [F.count(F.lit(1)).alias("keyword_count")], "1 hour").select("stt", "edt", F.lit("search").alias("source"), "keyword", "keyword_count")


def _demo_lines(s: SparkSession, d: str, kind: str) -> DataFrame:
    """``id,name,seconds`` lines of events, an hour of which is made five seconds."""
    at = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 720)
    rows = A.table(s, d, "events").where(F.col("event_type") == kind)
    return demo_lines(rows.select(F.concat_ws(",", "user_id", "event_id", at).alias("value")))


def _short_windows(s: SparkSession, d: str) -> DataFrame:
    out = window_join(_demo_lines(s, d, "click"), _demo_lines(s, d, "purchase"), "id", "ts", "5 seconds")
    return out.select("id_l", "name_l", "name_r", F.unix_seconds(F.col("stt").cast("timestamp")).alias("begins"))


def _configured(s: SparkSession, d: str) -> DataFrame:
    """Routes from a log of configuration changes: one for each nation, of which some are changed and some removed again."""
    key = F.col("n_nationkey")
    row = lambda sink: F.struct(F.col("n_name").alias("source_table"), sink.alias("sink_table"), F.lit("id,name").alias("sink_columns"))
    first, second = row(F.concat(F.lit("dim_"), key)), row(F.concat(F.lit("dim_new_"), key))
    none = F.lit(None).cast(T.StructType([*strings("source_table", "sink_table", "sink_columns").fields]))
    change = lambda op, before, after: F.to_json(F.struct(F.lit(op).alias("op"), before.alias("before"), after.alias("after")))
    n = A.table(s, d, "nation")
    log = n.select(change("r", none, first).alias("value"), key.cast("long").alias("seq"))
    log = log.unionByName(n.where("n_nationkey % 3 = 1").select(change("u", first, second).alias("value"), (key + 100).cast("long").alias("seq")))
    log = log.unionByName(n.where("n_nationkey % 3 = 2").select(change("d", first, none).alias("value"), (key + 100).cast("long").alias("seq")))
    return config_from_changes(log).select("source_table", "sink_table", "sink_columns")


def _times(s: SparkSession, d: str) -> DataFrame:
    """Times in text and in numbers, of each order."""
    o = A.table(s, d, "orders").select("o_orderkey", stamp("o_orderdate").alias("at"))
    o = o.withColumns({"ms": to_millis(F.col("at")), "day": F.substring("at", 1, 10)})
    odd = F.concat("at", F.when(F.col("o_orderkey") % 2 == 0, ".5").otherwise(".04"))
    return o.select("o_orderkey", "ms", to_millis(F.col("day")).alias("day_ms"), stamp(seconds_time(F.col("ms") + 999)).alias("second"), latest_of(odd, F.concat("at", F.lit(".040"))).alias("later"))


def _upserted(s: SparkSession, d: str) -> DataFrame:
    """Payments of order lines as an upsert table: written twice in batches, the second with new amounts; read as the latest of each key."""
    folder, key, version = f"{shared_folder(s)}/upserts-{uuid.uuid4().hex}", ["order_detail_id"], ["version"]
    rows = _paid(s, d).select("order_detail_id", "order_id", "split_payment_amount").withColumn("version", F.lit(0))
    upsert_parquet(s, rows, folder, key, version, 0)
    compact_upserts(s, folder, key, version)
    held = read_upserts(s, folder, key, version)  # new amounts are those of the table, so payments are not made again
    upsert_parquet(s, held.where("try_cast(order_id AS BIGINT) % 2 = 0").withColumns({"split_payment_amount": F.lit("0.00"), "version": F.lit(1)}), folder, key, version, 1)
    return read_upserts(s, folder, key, version).drop("version")


def _distinct_days(s: SparkSession, d: str) -> DataFrame:
    """Orders and buyers of a day and province from the bitmaps of its ten-second windows, without their rows."""
    rows = _latest(s, d).withColumns({"rt": time_of(F.col("create_time")), "number": F.col("order_id").cast("long")})
    people = number_ids(A.table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("buyer")), "buyer").withColumnRenamed("number", "person")
    rows = rows.join(people, F.col("user_id") == F.col("buyer"))
    ids = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("id")) for kind, c in (("order_ct", "number"), ("user_ct", "person"))]))
    rows = rows.select(F.window("rt", "10 seconds").alias("w"), "province_id", ids.alias("of")).select("w", "province_id", "of.*")
    days = merged(bitmaps(rows, ["w", "province_id", "kind"], "id"), [F.date_format("w.start", "yyyy-MM-dd").alias("day"), "province_id", "kind"])
    found = counted(days, ["day", "province_id", "kind"], "n")
    return found.groupBy("day", "province_id").pivot("kind", ["order_ct", "user_ct"]).agg(F.first("n"))


def _named_in_time(s: SparkSession, d: str) -> DataFrame:
    """Orders with the name that their province had then: all are renamed once, even ones twice, and some end."""
    n = A.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), "n_name")
    at = lambda day: F.lit(f"{day} 00:00:00").cast("timestamp_ntz")
    change = lambda rows, when, suffix, gone=False: rows.select("id", F.concat("n_name", F.lit(suffix)).alias("province_name"), when.alias("at"), F.lit(gone).alias("gone"))
    log = change(n, at("1990-01-01"), "").unionByName(change(n, at("1996-01-01") + F.make_dt_interval(F.col("id")), " II"))
    log = log.unionByName(change(n.where("id % 2 = 0"), at("1998-06-01"), " III")).unionByName(change(n.where("id % 5 = 4"), at("2000-01-01"), "", True))
    orders = A.table(s, d, "orders").join(A.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").cast("long").alias("province"), F.col("o_orderdate").cast("timestamp_ntz").alias("ordered"))
    return as_of(orders, versions(log, "id", "at", deleted="gone"), "province", "ordered", "id", ["province_name"]).select("o_orderkey", "province", "province_name")


def _dictionary(s: SparkSession, d: str, sent_bytes: int) -> DataFrame:
    """Words of goods' names, and the middle and the end of each, wherever they stand in a name."""
    part = A.table(s, d, "part")
    word = part.select(F.explode(F.split("p_name", " ")).alias("w"))
    words = word.select(F.explode(F.array("w", F.substring("w", 2, 2), F.substring("w", -3, 3))).alias("word"))
    return dictionary_words(part.select("p_partkey", "p_name"), words, "p_name", sent_bytes=sent_bytes).select("p_partkey", "word", F.col("start").cast("long").alias("start"))


#: The wall clock of queries that write it, and the days of those that serve one.
AS_OF_MS, DAY, ORDER_DAY = 1_704_067_200_000, 20240115, 19960115

_PRE = "id order_id sku_id sku_name order_price sku_num create_time source_type_id source_type_name source_id split_total_amount split_activity_amount split_coupon_amount consignee total_amount order_status user_id payment_way operate_time province_id order_detail_activity_id activity_id activity_rule_id order_detail_coupon_id coupon_id coupon_use_id type".split()


def queries() -> dict[str, Query]:
    return {
        "traffic_page_view_window": lambda s, d: traffic.page_view_window(_pages(s, d)),
        "traffic_page_view_day": lambda s, d: traffic.page_view_window(_pages(s, d), "1 day", 3600),
        "visitor_is_new_fix": lambda s, d: _pages(s, d).select("mid", "seq", "ts", "is_new"),
        "visitor_is_new_joined": lambda s, d: state.repair_by(A.page_log(s, d), state.first_days(A.page_log(s, d))).select("mid", "seq", "ts", "is_new"),
        "unique_visitor_detail": lambda s, d: state.unique_visitors(_pages(s, d)).select("mid", "seq", "ts", "page_id", "vc", "ch", "ar", "is_new"),
        "user_jump_detail": lambda s, d: state.bounces(_pages(s, d)).select("mid", "seq", "ts", "page_id"),
        "user_jump_detail_wide": lambda s, d: state.bounces(_pages(s, d), 3 * 3600).select("mid", "seq", "ts", "page_id"),
        "traffic_home_detail_uv": lambda s, d: traffic.home_detail_window(_pages(s, d)),
        "user_login_window": lambda s, d: traffic.login_window(_pages(s, d)),
        "user_register_window": lambda s, d: traffic.register_window(facts.user_register(A.topic_db(s, d))),
        "keyword_window": lambda s, d: traffic.keyword_window(_pages(s, d), "1 hour"),
        "keyword_window_udtf": _keywords_by_function,
        "log_split_page": lambda s, d: _logs(s, d)["page"].select("common.*", "page.*", "ts"),
        "log_split_start": lambda s, d: _logs(s, d)["start"].select("common.*", "start.*", "ts"),
        "log_split_error": lambda s, d: _logs(s, d)["error"].select("common.mid", "page.page_id", "err.*", "ts"),
        "log_split_display": lambda s, d: _logs(s, d)["display"].select("item", "item_type", "order", "common.mid", "page_id", "ts"),
        "log_split_action": lambda s, d: _logs(s, d)["action"].select("action_id", "item", "common.mid", "page_id", "ts", "log_ts"),
        "log_dirty": lambda s, d: parse_logs(A.raw_log(s, d))[1].select("seq", "value"),
        "coupon_get": _db(facts.coupon_get),
        "coupon_order": _db(facts.coupon_order),
        "coupon_pay": _db(facts.coupon_pay),
        "favor_add": _db(facts.favor_add),
        "comment": _db(facts.comment, True),
        "user_register": _db(facts.user_register),
        "cart_add": _db(facts.cart_add, True),
        "cart_add_uu_window": lambda s, d: trade.cart_add_window(facts.cart_add(A.topic_db(s, d), A.base_dic(s))),
        "order_pre_process": lambda s, d: _wide(s, d).select(*_PRE),
        "order_detail": _details,
        "cancel_detail": lambda s, d: facts.cancel_detail(_wide(s, d)),
        "pay_detail_suc": _paid,
        "payment_suc_window": lambda s, d: trade.payment_window(_paid(s, d)),
        "order_refund": _db(facts.order_refund, True),
        "refund_pay_suc": _db(facts.refund_pay_suc, True),
        "order_window": lambda s, d: trade.order_window(_first(s, d)),
        "order_window_hour": lambda s, d: trade.order_window(_first(s, d), "1 hour"),
        "province_order_window": _provinces,
        "user_spu_order_window": lambda s, d: trade.user_spu_window(_first(s, d), A.dimensions(s, d)),
        "refund_window": lambda s, d: trade.refund_window(facts.order_refund(A.topic_db(s, d), A.base_dic(s)), A.dimensions(s, d)),
        "dedup_first": lambda s, d: _first(s, d).select("id", "order_id", "split_total_amount"),
        "dedup_latest": lambda s, d: _latest(s, d).select("id", "order_id", "split_total_amount"),
        "gmv_by_day": lambda s, d: serving.gmv(_provinces(s, d, "1 day")),
        "uv_by_channel": lambda s, d: serving.uv_by_channel(traffic.page_view_window(_pages(s, d))),
        "dim_route": _route,
        "interval_join": lambda s, d: interval_join(_events(s, d, "click"), _events(s, d, "purchase"), "id", "ts", 3600).select("id_l", "event_id_l", "event_id_r"),
        "window_join": _windows,
        "inner_join": _demo("inner"),
        "left_join": _demo("left"),
        "right_join": _demo("right"),
        "full_join": _demo("full_outer"),
        "window_join_short": _short_windows,
        "gmv_on_day": lambda s, d: serving.gmv(_provinces(s, d, "1 day"), ORDER_DAY),
        "uv_on_day": lambda s, d: serving.uv_by_channel(traffic.page_view_window(_pages(s, d)), DAY),
        "channel_chart": lambda s, d: serving.channel_chart(traffic.page_view_window(_pages(s, d)), DAY),
        "order_window_stamped": lambda s, d: stamped(trade.order_window(_first(s, d)), AS_OF_MS),
        "dedup_latest_by_time": lambda s, d: trade.keep_latest_by_time(trade.with_row_time(trade.arrivals(_details(s, d)), AS_OF_MS), *trade.LINE).select("id", "split_total_amount", "row_op_ts"),
        "province_beans": lambda s, d: as_beans(_provinces(s, d)),
        "config_routes": _configured,
        "order_times": _times,
        "upsert_payments": _upserted,
        "distinct_by_bitmap": _distinct_days,
        "as_of_province": _named_in_time,
        "dictionary_words": lambda s, d: _dictionary(s, d, 16_000_000),
        "dictionary_words_joined": lambda s, d: _dictionary(s, d, 0),
    } | streamed.queries()


def oracle_sql() -> dict[str, str]:
    return oracle.all_queries()
