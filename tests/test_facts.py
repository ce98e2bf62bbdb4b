import json

import pytest
from pyspark.sql import functions as F

from tests.compare import from_spark
from tidemark.functions.scalars import latest_of, snake_to_camel, to_millis
from tidemark.functions.tokens import register_splitter
from tidemark.operators.enrich import enrich
from tidemark.operators.enrich import lookup as enrich_by_dictionary
from tidemark.operators.joins import interval_join, window_join
from tidemark.operators.route import parse_logs, route_dimensions, split_logs
from tidemark.operators.upsert import compact_upserts, latest_per_key, read_upserts, upsert_parquet
from tidemark.plans import facts, serving, trade
from tidemark.plans.queries import queries
from tidemark.schemas import CDC, CONFIG, DICTIONARY
from tidemark.sources import adapters as A
from tidemark.sources.connectors import Lookup, as_texts, config_from_changes, create_dimension, demo_lines, jdbc_sink, jdbc_table, to_messages


def change(table, kind, data, old=None, ts="1704067200", database="shop"):
    return (database, table, kind, data, old, ts)


def test_cart_rows_are_what_was_added(spark):
    dic = spark.createDataFrame([("2401", "query", "24")], DICTIONARY)
    base = {"user_id": "u", "sku_id": "s", "source_type": "2401"}
    db = spark.createDataFrame([
        change("cart_info", "insert", base | {"id": "1", "sku_num": "3"}),
        change("cart_info", "update", base | {"id": "2", "sku_num": "5"}, {"sku_num": "3"}),
        change("cart_info", "update", base | {"id": "3", "sku_num": "4"}, {"sku_num": "5"}),
        change("cart_info", "update", base | {"id": "4", "sku_num": "4"}, {"is_checked": "0"}),
        change("cart_info", "update", base | {"id": "5", "sku_num": "x"}, {"sku_num": "5"}),
        change("cart_info", "insert", base | {"id": "6", "sku_num": "1", "source_type": "9"}),
        change("cart_info", "insert", base | {"id": "7", "sku_num": "1"}, database="other"),
    ], CDC)
    assert {r.id: r.sku_num for r in facts.cart_add(db, dic).collect()} == {"1": "3", "2": "2"}


def test_lines_meet_their_partners_as_in_left_joins(spark):
    """None, several, of lines without an id, of no line, and of another database."""
    dic = spark.createDataFrame([("2401", "query", "24")], DICTIONARY)
    line = lambda i, order="o": change("order_detail", "insert", {"id": i, "order_id": order, "source_type": "2401"})
    activity = lambda i, of, database="shop": change("order_detail_activity", "insert", {"id": i, "order_detail_id": of, "activity_id": f"x{i}"}, database=database)
    coupon = lambda i, of: change("order_detail_coupon", "insert", {"id": i, "order_detail_id": of, "coupon_id": f"c{i}"})
    db = spark.createDataFrame([
        line("1"), line("2"), line("3"), line(None), line(None), line("4", "none"), activity("a", "1"), activity("b", "1"), activity("c", None), activity("d", "9"), activity("e", "3", "other"),
        coupon("p", "1"), coupon("q", "1"), coupon("r", "2"), change("order_info", "insert", {"id": "o", "user_id": "u"}), change("order_info", "update", {"id": "o", "user_id": "u"}, {"order_status": "1"}),
    ], CDC)
    got = [(r.id, r.activity_id, r.coupon_id, r.type) for r in facts.order_pre_process(db, dic).collect()]
    each = [("1", a, c) for a in ("xa", "xb") for c in ("cp", "cq")] + [("2", None, "cr"), ("3", None, None), (None, None, None), (None, None, None)]
    assert sorted(got, key=str) == sorted([(*r, t) for r in each for t in ("insert", "update")], key=str)


def test_coupon_order_needs_the_transition(spark):
    db = spark.createDataFrame([
        change("coupon_use", "update", {"id": "1", "coupon_status": "1402", "using_time": "2024-01-01 10:00:00"}, {"coupon_status": "1401"}),
        change("coupon_use", "update", {"id": "2", "coupon_status": "1402"}, {"coupon_status": "1400"}),
        change("coupon_use", "update", {"id": "3", "coupon_status": "1402"}),
        change("coupon_use", "insert", {"id": "4", "coupon_status": "1402"}, {"coupon_status": "1401"}),
    ], CDC)
    got = facts.coupon_order(db).collect()
    assert [(r.id, r.date_id, r.user_id) for r in got] == [("1", "2024-01-01", None)]


def test_latest_delivery_wins_and_first_stays(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", 1, "q")], "id string, row_op int, v string")
    assert {r.id: r.v for r in trade.keep_latest(rows).collect()} == {"a": "z", "b": "q"}
    assert {r.id: r.v for r in trade.keep_first(rows).collect()} == {"a": "x", "b": "q"}


def test_times_compare_whatever_their_fraction(spark):
    got = spark.sql("SELECT '2024-01-01 00:00:00.04Z' a, '2024-01-01 00:00:00.040Z' b, '2024-01-01 00:00:00.1Z' c").select(latest_of(F.col("a"), F.col("b")).alias("tie"), latest_of(F.col("a"), F.col("c")).alias("later")).first()
    assert got.tie.endswith(".04Z") and got.later.endswith(".1Z")


def test_missing_dimension_keeps_the_row(spark):
    rows = spark.createDataFrame([("1",), ("2",), (None,)], "k string")
    dim = spark.createDataFrame([("1", "one")], "id string, name string")
    assert sorted((r.k or "", r.n) for r in enrich(rows, dim, "k", {"name": "n"}).collect()) == [("", None), ("1", "one"), ("2", None)]


def test_refund_keys_do_not_run_together(spark):
    refunds = spark.createDataFrame([("1", "s1", "o1", "2024-01-01 00:00:01"), ("4", "s2", "o2", "2024-01-01 00:00:01")], "user_id string, sku_id string, order_id string, create_time string")
    dims = {
        "sku": spark.createDataFrame([("s1", "1", "23"), ("s2", "12", "3")], "id string, tm_id string, category3_id string"),
        "trademark": spark.createDataFrame([], "id string, tm_name string"),
        "category3": spark.createDataFrame([], "id string, name string, category2_id string"),
        "category2": spark.createDataFrame([], "id string, name string, category1_id string"),
        "category1": spark.createDataFrame([], "id string, name string"),
    }
    got = trade.refund_window(refunds, dims).collect()
    assert sorted((r.trademark_id, r.category3_id, r.refund_ct) for r in got) == [("1", "23", 1), ("12", "3", 1)]


def test_log_split(spark):
    page = {"common": {"mid": "m"}, "page": {"page_id": "home", "during_time": 5}, "ts": 1}
    logs = [
        json.dumps(page | {"err": {"error_code": 7}, "displays": [{"item": "1"}, {"item": "2"}], "action": [{"action_id": "x"}]}),
        json.dumps(page | {"actions": [{"action_id": "y"}]}),
        json.dumps({"common": {"mid": "m"}, "start": {"entry": "icon"}, "ts": 2}),
        "not json", "", None, "[1, 2]", '{"common": {',
    ]
    good, bad = parse_logs(spark.createDataFrame([(x,) for x in logs], "value string"))
    parts = split_logs(good)
    assert {k: v.count() for k, v in parts.items()} == {"error": 1, "start": 1, "page": 2, "display": 2, "action": 2}
    assert sorted(r.action_id for r in parts["action"].collect()) == ["x", "y"]
    assert "err" not in parts["page"].columns and bad.count() == 5


def test_dimension_routes(spark):
    config = spark.createDataFrame([("t", "dim_t", "id,name", None, None)], CONFIG)
    rows = [change("t", k, {"id": "1", "name": "n", "secret": "x"}) for k in ("insert", "update", "bootstrap-insert", "delete")] + [change("other", "insert", {"id": "1"})]
    got = route_dimensions(spark.createDataFrame(rows, CDC), config).collect()
    assert len(got) == 3 and {r.sink_table for r in got} == {"dim_t"} and got[0].row == {"id": "1", "name": "n"} and got[0].pk == "1"


def test_config_changes(spark):
    after = {"source_table": "t", "sink_table": "a"}
    log = [json.dumps({"op": "r", "after": after}), json.dumps({"op": "u", "before": after, "after": after | {"sink_table": "b"}}), json.dumps({"op": "r", "after": {"source_table": "gone", "sink_table": "c"}}), json.dumps({"op": "d", "before": {"source_table": "gone"}, "after": None})]
    got = config_from_changes(spark.createDataFrame([(v, i) for i, v in enumerate(log)], "value string, seq long")).collect()
    assert [(r.source_table, r.sink_table) for r in got] == [("t", "b")]


def test_created_dimension_and_upserts(spark, tmp_path):
    create_dimension(spark, "dim_test", "id,name,id", None, "TBLPROPERTIES ('made' = 'yes')", f"{tmp_path}/dim")
    assert spark.sql("SHOW TBLPROPERTIES dim_test ('made')").first().value == "yes"
    for broken in (("dim_x", " , "), ("", "id")):
        with pytest.raises(ValueError):
            create_dimension(spark, *broken)
    assert spark.table("dim_test").columns == ["id", "name"]
    make = lambda rows: spark.createDataFrame(rows, "k string, v string, t int")
    upsert_parquet(spark, make([("a", "1", 1), ("a", "2", 2), ("b", None, 1)]), f"{tmp_path}/u", ["k"], ["t"], 0)
    upsert_parquet(spark, make([("b", "9", 2), ("a", "old", 1)]), f"{tmp_path}/u", ["k"], ["t"], 1)
    upsert_parquet(spark, make([("b", "9", 2), ("a", "old", 1)]), f"{tmp_path}/u", ["k"], ["t"], 1)
    assert {r.k: r.v for r in read_upserts(spark, f"{tmp_path}/u", ["k"], ["t"]).collect()} == {"a": "2", "b": "9"}
    compact_upserts(spark, f"{tmp_path}/u", ["k"], ["t"])
    upsert_parquet(spark, make([("b", "8", 3)]), f"{tmp_path}/u", ["k"], ["t"], 2)
    read = read_upserts(spark, f"{tmp_path}/u", ["k"], ["t"])
    assert {r.k: r.v for r in read.collect()} == {"a": "2", "b": "8"}
    assert {f.split("/kind=")[1].split("/part")[0] for f in read.inputFiles()} >= {"base/batch=1", "batch/batch=2"}
    assert latest_per_key(make([]), ["k"], ["t"]).count() == 0


def test_database_lookup_and_sink(spark):
    url = "jdbc:derby:memory:shop;create=true"
    make = lambda rows: spark.createDataFrame(rows, "dic_code string, dic_name string, n int, extra array<string>")
    jdbc_sink(make([("1", "one", 1, ["x"]), ("2", "two", 2, [])]), url, "DIC", ["dic_code", "dic_name", "n"])
    now = [0.0]
    lookup_table = Lookup(lambda: jdbc_table(spark, url, "DIC"), 3600, lambda: now[0])
    assert sorted(r[0] for r in lookup_table().collect()) == ["1", "2"] and lookup_table().columns == ["dic_code", "dic_name", "n"]
    jdbc_sink(make([("3", "three", 3, None)]), url, "DIC", ["dic_code", "dic_name", "n"])
    assert lookup_table().count() == 2
    now[0] = 3600.0
    assert lookup_table().count() == 3
    jdbc_sink(make([("4", "four", 4, None)]), url, "DIC", ["dic_code", "dic_name", "n"])
    lookup_table.forget()
    assert lookup_table().count() == 4
    parts = jdbc_table(spark, url, "DIC", ("n", 1, 5, 2))
    assert parts.rdd.getNumPartitions() == 2 and parts.count() == 4
    rows = spark.createDataFrame([("1", "a"), ("9", "b")], "code string, v string")
    assert [(r.v, r.name) for r in enrich_by_dictionary(rows, lookup_table(), "code", "name").collect()] == [("a", "one")]
    lookup_table.forget()


def test_time_joins(spark):
    rows = lambda xs: demo_lines(spark.createDataFrame([(x,) for x in xs], "value string"))
    a, b = rows(["1,a,100", "1,b,107", "2,c,100"]), rows(["1,x,105", "1,y,106", "1,z,94", "2,w,95", "bad"])
    near = interval_join(a, b, "id", "ts", 5).select("name_l", "name_r")
    assert sorted(map(tuple, near.collect())) == [("a", "x"), ("b", "x"), ("b", "y"), ("c", "w")]
    for how in ("left", "right", "full_outer"):
        slow = a.toDF("i", "n", "t").join(b.toDF("id", "name", "ts"), F.expr("i = id AND ts BETWEEN t - INTERVAL 5 SECONDS AND t + INTERVAL 5 SECONDS"), how).select("n", "name")
        assert sorted(map(tuple, interval_join(a, b, "id", "ts", 5, how).select("name_l", "name_r").collect()), key=str) == sorted(map(tuple, slow.collect()), key=str)
    same = window_join(a, b, "id", "ts", "5 seconds").select("name_l", "name_r")
    assert sorted(map(tuple, same.collect())) == [("b", "x"), ("b", "y")]


def test_splitter_table_function(spark):
    register_splitter(spark)
    spark.createDataFrame([("Big Red-box",), ("",), (None,)], "item string").createOrReplaceTempView("items")
    assert sorted(r.word for r in spark.sql("SELECT word FROM items, LATERAL split_words(item)").collect()) == ["big", "box", "red"]

    def broken(text):
        raise OSError

    register_splitter(spark, "whole", broken)
    assert [r.word for r in spark.sql("SELECT word FROM items, LATERAL whole(item) WHERE item <> ''").collect()] == ["Big Red-box"]


def test_serving_json(spark):
    orders = spark.createDataFrame([("2024-01-01 00:00:00", 1.5), ("2024-01-01 00:00:10", 2.0)], "stt string, order_amount double")
    assert json.loads(serving.gmv_json(orders, 20240101))["data"] == 3.5
    assert json.loads(serving.gmv_json(orders, 20240102))["data"] is None
    traffic = spark.createDataFrame([("2024-01-01 00:00:00", "a", 1, 0), ("2024-01-01 00:00:00", "b", 5, 2)], "stt string, ch string, uv_ct long, uj_ct long")
    chart = json.loads(serving.channel_json(traffic, 20240101))["data"]
    assert chart["categories"] == ["b", "a"] and chart["series"][0]["data"] == [5, 1]


def test_messages_and_names(spark):
    rows = spark.createDataFrame([("1", None)], "id string, v string")
    got = to_messages(rows, ["id"]).first()
    assert json.loads(got.key) == {"id": "1"} and json.loads(got.value) == {"id": "1", "v": None}
    records = spark.createDataFrame([(bytearray(b"k"), bytearray("é".encode())), (None, None)], "key binary, value binary")
    assert [tuple(r) for r in as_texts(records).collect()] == [("é", "k"), ("", None)]
    assert snake_to_camel("TM_NAME") == "tmName"
    assert spark.sql("SELECT '2024-01-01' a").select(to_millis(F.col("a")).alias("x")).first().x == 1704067200000


@pytest.mark.parametrize("name", ["order_refund", "comment", "refund_pay_suc"])
def test_dictionary_joins_drop_unknown_codes(spark, sf_dir, name):
    from tidemark.plans.queries import queries

    assert not [c for c in from_spark(queries()[name](spark, sf_dir)).columns if c.startswith("_")]


def test_lines_of_an_order_are_shuffled_once(spark, sf_dir):
    """Lines, their partners and their orders meet by the order's number, and deliveries of a line are where it is."""
    own = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2000")
    try:
        plan = queries()["dedup_first"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)
    keys = [line.split("hashpartitioning(")[1].split("#")[0] for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert sorted(k for k in keys if "cust" not in k) == ["_order", "order_id", "order_id"], keys


def test_facts_of_a_keyed_topic_are_those_of_the_other(spark, sf_dir):
    db, dic = A.topic_db(spark, sf_dir), A.base_dic(spark)
    keyed = facts.order_pre_process(A.line_changes(spark, sf_dir), dic, db, by_order=True)
    other = facts.order_pre_process(A.line_changes(spark, sf_dir), dic, db)
    assert keyed.columns == other.columns
    text = lambda rows: sorted(str(r) for r in rows.drop("old").collect())
    assert text(keyed) == text(other)


def test_later_upserts_do_not_make_the_payments_again(spark, sf_dir, monkeypatch):
    """The second batch has new amounts of what the table holds: it reads the table, not the tables that payments come from."""
    plans = []

    def seen(s, batch, *rest):
        plans.append(batch._jdf.queryExecution().optimizedPlan().toString())
        upsert_parquet(s, batch, *rest)

    monkeypatch.setattr("tidemark.plans.queries.upsert_parquet", seen)
    rows = queries()["upsert_payments"](spark, sf_dir).collect()
    assert "l_linenumber" in plans[0] and "l_linenumber" not in plans[1]
    assert all((r.split_payment_amount == "0.00") == (int(r.order_id) % 2 == 0) for r in rows) and len({int(r.order_id) % 2 for r in rows}) == 2


def test_partitions_of_lines_follow_their_number(spark, sf_dir, monkeypatch):
    """However few bytes the shuffled lines have, no task gets more of them than it can sort in memory."""
    monkeypatch.setattr(A, "LINES_PER_PARTITION", 500)
    n = -(-A.table(spark, sf_dir, "lineitem").count() // 500)
    assert n > 4 and A.line_changes(spark, sf_dir).rdd.getNumPartitions() == n
    assert queries()["dedup_latest"](spark, sf_dir).rdd.getNumPartitions() == n
