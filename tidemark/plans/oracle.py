"""The plans' results as SQL over the test tables, for comparison; written from the meaning, not from the plans."""

from __future__ import annotations

from ..sources.adapters import DICTIONARY_ROWS, PAGES
from .facts import ORDER_DETAIL

_DIC = ", ".join(f"('{c}', '{n}')" for c, n, _ in DICTIONARY_ROWS)
_PAGE = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in PAGES.items())
S = "'%Y-%m-%d %H:%M:%S'"

#: Common table expressions; each query takes those that it names, with what they need.
PARTS = {
    "raw": ("", f"""SELECT CAST(e.user_id AS VARCHAR) mid, CASE WHEN k < 5 THEN CAST(e.user_id AS VARCHAR) END uid, CASE WHEN k < 50 THEN '1' ELSE '0' END is_new,
        CAST(e.user_id % 3 AS VARCHAR) vc, CAST(e.user_id % 4 AS VARCHAR) ch, n_name ar, page_id, last_page_id, p_name item,
        CASE WHEN page_id = 'good_detail' THEN 'keyword' ELSE 'sku' END item_type, CAST(floor(value * 1000) AS BIGINT) during_time,
        (epoch_us(ts) // 1000) ts, ts AS rt, event_id seq, k, event_type, CAST(ts AS DATE) d
      FROM (SELECT *, CASE WHEN (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER w < 21600000 THEN lag(page_id) OVER w END last_page_id
            FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INT) k, CASE event_type {_PAGE} END page_id FROM events)
            WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) e
      LEFT JOIN customer ON e.user_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN part ON e.event_id % 200 + 1 = p_partkey"""),
    "pages": ("raw", """SELECT * REPLACE (CASE WHEN is_new = '1' AND d <> since THEN '0' ELSE is_new END AS is_new)
      FROM (SELECT *, first_value(CASE WHEN is_new = '1' THEN d ELSE d - 1 END) OVER (PARTITION BY mid ORDER BY ts, seq) since FROM raw)"""),
    "uv": ("pages", "SELECT * FROM pages WHERE last_page_id IS NULL QUALIFY row_number() OVER (PARTITION BY mid, d ORDER BY ts, seq) = 1"),
    "jumps": ("pages", """SELECT * FROM (SELECT *, lead(ts) OVER w nts, lead(last_page_id) OVER w nlast FROM pages WINDOW w AS (PARTITION BY mid ORDER BY ts, seq))
      WHERE last_page_id IS NULL AND (nts IS NULL OR nlast IS NULL OR nts - ts >= {within})"""),
    "dic": ("", f"SELECT * FROM (VALUES {_DIC}) t(code, label)"),
    "ln": ("", f"""SELECT l.*, o_custkey, o_orderdate ot, strftime(o_orderdate, {S}) at_s, CAST(epoch_us(o_orderdate) // 1000000 AS VARCHAR) ts_s,
        CAST(l_orderkey AS VARCHAR) order_id, CAST(l_partkey AS VARCHAR) sku_id, CAST(o_custkey AS VARCHAR) buyer, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) num,
        concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) id, CAST(l_extendedprice AS DECIMAL(18,2)) price
      FROM lineitem l JOIN orders ON l_orderkey = o_orderkey"""),
    "od": ("", f"""SELECT CAST(o_orderkey AS VARCHAR) oid, CAST(o_custkey AS VARCHAR) user_id, CAST(c_nationkey AS VARCHAR) province_id, o.*, strftime(o_orderdate, {S}) at_s,
        CAST(epoch_us(o_orderdate) // 1000000 AS VARCHAR) ts_s FROM orders o JOIN customer ON o_custkey = c_custkey"""),
    "info": ("od", """SELECT *, CASE o_orderstatus WHEN 'O' THEN '1001' WHEN 'F' THEN '1002' ELSE '1003' END status, CASE WHEN o_orderstatus = 'O' THEN 'insert' ELSE 'update' END kind FROM od
      UNION ALL SELECT *, '1005', 'update' FROM od WHERE o_orderkey % 2 = 0 UNION ALL SELECT *, '1006', 'update' FROM od WHERE o_orderkey % 3 = 1"""),
    "wide": ("dic ln info", """SELECT d.id, d.order_id, i.user_id, d.sku_id, 'sku ' || d.sku_id sku_name, d.num sku_num, CAST(d.price AS VARCHAR) order_price, i.province_id,
        a.activity_id, a.activity_rule_id, c.coupon_id, c.coupon_use_id, a.id order_detail_activity_id, c.id order_detail_coupon_id, d.at_s create_time, i.at_s operate_time, CAST(d.l_suppkey AS VARCHAR) source_id, code source_type_id, label source_type_name,
        CASE WHEN d.l_discount > 0.05 THEN CAST(CAST(d.l_discount AS DECIMAL(18,2)) AS VARCHAR) END split_activity_amount,
        CASE WHEN d.l_tax > 0.04 THEN CAST(CAST(d.l_tax AS DECIMAL(18,2)) AS VARCHAR) END split_coupon_amount,
        CAST(CAST(d.price * CAST(d.l_quantity AS INT) AS DECIMAL(18,2)) AS VARCHAR) split_total_amount, i.status order_status, i.kind "type",
        CAST(CAST(i.o_totalprice AS DECIMAL(18,2)) AS VARCHAR) total_amount, i.o_orderpriority payment_way, 'user ' || i.user_id consignee
      FROM ln d JOIN dic ON code = CAST(d.l_linenumber % 5 + 2401 AS VARCHAR) JOIN info i ON d.order_id = i.oid
      LEFT JOIN (SELECT 'a' || id id, id did, CAST(l_partkey % 10 AS VARCHAR) activity_id, CAST(l_suppkey % 7 AS VARCHAR) activity_rule_id FROM ln WHERE l_discount > 0.05) a ON a.did = d.id
      LEFT JOIN (SELECT 'c' || id id, id did, CAST(l_suppkey % 13 AS VARCHAR) coupon_id, CAST(l_orderkey % 1000 AS VARCHAR) coupon_use_id FROM ln WHERE l_tax > 0.04) c ON c.did = d.id"""),
    "details": ("wide", f"SELECT {', '.join(ORDER_DETAIL.split())} FROM wide WHERE \"type\" = 'insert'"),
    "paid": ("details dic", """SELECT d.id order_detail_id, d.order_id, CAST(o_custkey AS VARCHAR) user_id, sku_id, sku_name, province_id, activity_id, activity_rule_id, coupon_id, code payment_type_code, label payment_type_name,
        strftime(o_orderdate + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') callback_time, source_id, source_type_id, source_type_name, sku_num, order_price, split_activity_amount, split_coupon_amount, split_total_amount split_payment_amount
      FROM orders JOIN dic ON code = CAST(o_custkey % 4 + 1101 AS VARCHAR) JOIN details d ON d.order_id = CAST(o_orderkey AS VARCHAR) WHERE o_orderstatus = 'O' AND o_orderkey % 3 <> 0"""),
    "refunds": ("ln od dic", """SELECT l.id, buyer user_id, l.order_id, l.sku_id, o.province_id, l.at_s[1:10] date_id, l.at_s create_time, t.code refund_type_code, t.label refund_type_name,
        r.code refund_reason_type_code, r.label refund_reason_type_name, 'late' refund_reason_txt, num refund_num, CAST(price AS VARCHAR) refund_amount, l.ts_s ts
      FROM ln l JOIN dic t ON t.code = CAST(l_linenumber % 3 + 1501 AS VARCHAR) JOIN dic r ON r.code = CAST(l_suppkey % 3 + 1301 AS VARCHAR) JOIN od o ON o.oid = l.order_id
      WHERE l_returnflag = 'R' AND o.o_orderkey % 2 = 0"""),
    "carts": ("ln dic", """SELECT id, buyer user_id, sku_id, CAST(price AS VARCHAR) cart_price, CASE WHEN was IS NULL THEN num ELSE CAST(CAST(num AS INT) - CAST(was AS INT) AS VARCHAR) END sku_num,
        'sku ' || sku_id sku_name, '1' is_checked, at_s create_time, CASE WHEN was IS NOT NULL THEN at_s END operate_time, '0' is_ordered, CAST(NULL AS VARCHAR) order_time, code source_type_id, label source_type_name, CAST(l_suppkey AS VARCHAR) source_id
      FROM (SELECT *, lag(l_quantity) OVER (PARTITION BY o_custkey, l_partkey ORDER BY ot, id, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) was FROM ln)
      JOIN dic ON code = CAST(l_linenumber % 5 + 2401 AS VARCHAR) WHERE was IS NULL OR CAST(num AS INT) > CAST(was AS INT)"""),
    "kv": ("", """SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INT) k, strftime(ts, '%Y-%m-%d %H:%M:%S') at_s, CAST(epoch_us(ts) // 1000000 AS VARCHAR) ts_s, CAST(event_id AS VARCHAR) id, CAST(user_id AS VARCHAR) uid FROM events"""),
    "sku": ("", "SELECT CAST(p_partkey AS VARCHAR) sid, p_name spu_id, p_brand trademark_id, p_type category3_id FROM part"),
}

_REST = sorted(set(ORDER_DETAIL.split()) - {"id"})
PARTS["twice"] = ("details", "SELECT *, 0 row_op FROM details UNION ALL SELECT * REPLACE (CAST(CAST(split_total_amount AS DECIMAL(18,2)) + 1 AS VARCHAR) AS split_total_amount), 3 FROM details")
PARTS["firsts"] = ("twice", f"SELECT * FROM twice QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_op, {', '.join(f'{c} NULLS FIRST' for c in _REST)}) = 1")
PARTS["latest"] = ("twice", f"SELECT * FROM twice QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_op DESC, {', '.join(f'{c} DESC NULLS LAST' for c in _REST)}) = 1")

_NAMES = """, CASE WHEN trademark_id NOT LIKE '%1' THEN lower(trademark_id) END trademark_name, lower(category3_id) category3_name, CAST(length(category3_id) % 5 AS VARCHAR) category2_id,
      'c2 ' || CAST(length(category3_id) % 5 AS VARCHAR) category2_name, CAST(length(category3_id) % 5 % 3 AS VARCHAR) category1_id, 'c1 ' || CAST(length(category3_id) % 5 % 3 AS VARCHAR) category1_name"""


def query(parts: str, body: str, within: int = 10_000) -> str:
    need: list[str] = []

    def add(name: str) -> None:
        for other in PARTS[name][0].split():
            add(other)
        if name not in need:
            need.append(name)

    for name in parts.split():
        add(name)
    head = ", ".join(f"{n} AS ({PARTS[n][1].replace('{within}', str(within))})" for n in need)
    return f"WITH {head} {body}" if head else body


def ends(time: str, size: str = "10 seconds") -> str:
    start = f"time_bucket(INTERVAL '{size}', {time})"
    return f"strftime({start}, {S}) stt, strftime({start} + INTERVAL '{size}', {S}) edt"


def _n(x: str) -> str:
    return f"CAST(sum({x}) AS BIGINT)"


def _d(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"


def traffic(size: str, within: int) -> str:
    cols = "rt, vc, ch, ar, is_new"
    return query("pages uv jumps", f"""SELECT {ends('rt', size)}, vc, ch, ar, is_new, {_n('uv')} uv_ct, {_n('sv')} sv_ct, {_n('pv')} pv_ct, {_n('dur')} dur_sum, {_n('uj')} uj_ct FROM (
      SELECT {cols}, 0 uv, CASE WHEN last_page_id IS NULL THEN 1 ELSE 0 END sv, 1 pv, during_time dur, 0 uj FROM pages UNION ALL SELECT {cols}, 1, 0, 0, 0, 0 FROM uv UNION ALL SELECT {cols}, 0, 0, 0, 0, 1 FROM jumps)
      GROUP BY ALL""", within)


def home_detail(size: str) -> str:
    return query("pages", f"""SELECT {ends('rt', size)}, {_n("CASE WHEN page_id = 'home' THEN 1 ELSE 0 END")} home_uv_ct, {_n("CASE WHEN page_id = 'good_detail' THEN 1 ELSE 0 END")} good_detail_uv_ct
      FROM (SELECT * FROM pages WHERE page_id IN ('home', 'good_detail') QUALIFY row_number() OVER (PARTITION BY mid, page_id, d ORDER BY ts, seq) = 1) GROUP BY ALL""")


def login(size: str) -> str:
    return query("pages", f"""SELECT {ends('rt', size)}, {_n('back')} back_ct, count(*) uu_ct FROM (
      SELECT rt, CASE WHEN d - lag(d) OVER (PARTITION BY uid ORDER BY ts, seq) >= 8 THEN 1 ELSE 0 END back FROM (
        SELECT * FROM pages WHERE uid IS NOT NULL AND (last_page_id IS NULL OR last_page_id = 'login') QUALIFY row_number() OVER (PARTITION BY uid, d ORDER BY ts, seq) = 1)) GROUP BY ALL""")


def order_window(size: str) -> str:
    return query("firsts", f"""SELECT {ends('strptime(create_time, ' + S + ')', size)}, {_n('u')} order_unique_user_count, {_n('n')} order_new_user_count,
      {_d('coalesce(split_activity_amount, 0::VARCHAR)')} order_activity_reduce_amount, {_d('coalesce(split_coupon_amount, 0::VARCHAR)')} order_coupon_reduce_amount,
      CAST(sum(CAST(CAST(sku_num AS INT) * CAST(order_price AS DECIMAL(18,2)) AS DECIMAL(24,2))) AS DOUBLE) order_origin_total_amount FROM (
        SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id, create_time[1:10] ORDER BY create_time, id) = 1 THEN 1 ELSE 0 END u,
          CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY create_time, id) = 1 THEN 1 ELSE 0 END n FROM firsts) GROUP BY ALL""")


def province(size: str) -> str:
    return query("latest", f"""SELECT {ends('strptime(create_time, ' + S + ')', size)}, province_id, coalesce(max(CASE WHEN n_nationkey <> 3 THEN n_name END), '') province_name, count(DISTINCT order_id) order_ct, {_d('split_total_amount')} order_amount
      FROM latest JOIN nation ON CAST(n_nationkey AS VARCHAR) = province_id GROUP BY 1, 2, province_id""")


def user_spu(size: str) -> str:
    return query("firsts sku", f"""SELECT *, 'spu ' || spu_id spu_name {_NAMES} FROM (
      SELECT {ends('strptime(create_time, ' + S + ')', size)}, user_id, trademark_id, spu_id, category3_id, count(DISTINCT order_id) order_ct, {_d('split_total_amount')} order_amount
      FROM firsts JOIN sku ON sid = sku_id GROUP BY 1, 2, user_id, trademark_id, spu_id, category3_id)""")


def refund_window(size: str) -> str:
    return query("refunds sku", f"""SELECT * {_NAMES} FROM (SELECT {ends('strptime(create_time, ' + S + ')', size)}, trademark_id, category3_id, user_id, count(DISTINCT order_id) refund_ct
      FROM refunds JOIN sku ON sid = sku_id GROUP BY 1, 2, trademark_id, category3_id, user_id)""")


_OK = "seq % 97 <> 0 AND seq % 101 <> 0 AND seq % 103 <> 0"
_COMMON = "mid, uid, is_new, vc, ch, ar"


def all_queries() -> dict[str, str]:
    click, buy = ("SELECT user_id id, event_id, ts FROM events WHERE event_type = '%s'" % t for t in ("click", "purchase"))
    few = "(SELECT c_custkey id, c_name FROM customer)", "(SELECT s_suppkey * 31 id, s_name FROM supplier)"
    demo = lambda how: f"SELECT a.id id_l, c_name, b.id id_r, s_name FROM {few[0]} a {how} JOIN {few[1]} b ON a.id = b.id"
    coupon = "id, CAST(k % 7 AS VARCHAR) coupon_id, uid user_id"
    keyword = query("pages", f"""SELECT {ends('rt', '1 hour')}, 'search' source, keyword, count(*) keyword_count FROM (
          SELECT rt, unnest(regexp_extract_all(lower(item), '([a-z0-9]+)', 1)) keyword FROM pages WHERE item IS NOT NULL AND last_page_id = 'search' AND item_type = 'keyword') GROUP BY ALL""")
    register = query("kv", f"SELECT {ends('ts')}, count(*) register_ct FROM kv WHERE event_type = 'signup' GROUP BY ALL")
    carts = query("carts", f"""SELECT {ends('strptime(t, ' + S + ')')}, count(*) cart_add_uu_ct FROM (
          SELECT * FROM (SELECT *, coalesce(operate_time, create_time) t FROM carts) QUALIFY row_number() OVER (PARTITION BY user_id, t[1:10] ORDER BY t, id) = 1) GROUP BY ALL""")
    coupon_get = query("kv", f"SELECT {coupon}, at_s[1:10] date_id, at_s get_time, ts_s ts FROM kv WHERE event_type = 'click'")
    favor_add = query("kv", "SELECT id, uid user_id, CAST(k AS VARCHAR) sku_id, at_s[1:10] date_id, at_s create_time, ts_s ts FROM kv WHERE event_type = 'view'")
    dim_route = """SELECT * FROM (
          SELECT 'dim_base_province' sink_table, CAST(n_nationkey AS VARCHAR) pk, 'id=' || n_nationkey || ',name=' || n_name "row", CAST(n_nationkey AS BIGINT) k FROM nation UNION ALL
          SELECT 'dim_user_info', CAST(c_custkey AS VARCHAR), 'id=' || c_custkey || ',name=' || c_name || ',parent_id=' || c_nationkey, c_custkey FROM customer) WHERE k % 4 <> 3""".replace("SELECT * FROM (", 'SELECT sink_table, pk, "row" FROM (', 1)
    on_day = "CAST(rt AS DATE) = DATE '2024-01-15'"
    channels = query("pages uv jumps", f"SELECT ch, {_n('uv')} uv, {_n('uj')} uj_ct FROM (SELECT ch, 1 uv, 0 uj FROM uv WHERE {on_day} UNION ALL SELECT ch, 0, 1 FROM jumps WHERE {on_day} UNION ALL SELECT ch, 0, 0 FROM pages WHERE {on_day}) GROUP BY ch")
    dictionary = """WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) w FROM part), d AS (SELECT DISTINCT unnest([w, substring(w, 2, 2), CASE WHEN length(w) < 3 THEN w ELSE right(w, 3) END]) word FROM w)
      SELECT p_partkey, word, i - 1 AS "start" FROM (SELECT p_partkey, p_name, unnest(range(1, length(p_name) + 1)) i FROM part) p JOIN d ON substring(p_name, i, length(word)) = word AND word <> ''"""
    return {
        "traffic_page_view_window": traffic("10 seconds", 10_000),
        "traffic_page_view_day": traffic("1 day", 3_600_000),
        "visitor_is_new_fix": query("pages", "SELECT mid, seq, ts, is_new FROM pages"),
        "visitor_is_new_joined": query("pages", "SELECT mid, seq, ts, is_new FROM pages"),
        "unique_visitor_detail": query("uv", "SELECT mid, seq, ts, page_id, vc, ch, ar, is_new FROM uv"),
        "user_jump_detail": query("jumps", "SELECT mid, seq, ts, page_id FROM jumps"),
        "user_jump_detail_wide": query("jumps", "SELECT mid, seq, ts, page_id FROM jumps", 3 * 3_600_000),
        "traffic_home_detail_uv": home_detail("10 seconds"),
        "user_login_window": login("10 seconds"),
        "user_register_window": register,
        "keyword_window": keyword,
        "keyword_window_udtf": keyword,
        "stream_visitor_is_new_fix": query("pages", "SELECT mid, seq, ts, is_new FROM pages"),
        "stream_unique_visitor_days": query("uv", "SELECT mid, strftime(rt, '%Y-%m-%d') AS \"day\" FROM uv"),
        "stream_traffic_window": traffic("10 seconds", 10_000),
        "stream_home_detail_window": home_detail("10 seconds"),
        "stream_login_window": login("10 seconds"),
        "stream_keyword_window": keyword,
        "stream_register_window": register,
        "stream_cart_add_window": carts,
        "stream_order_window": order_window("10 seconds"),
        "stream_province_window": province("10 seconds"),
        "stream_full_join": f"SELECT a.id id_l, a.event_id event_id_l, b.id id_r, b.event_id event_id_r FROM ({click}) a FULL OUTER JOIN ({buy}) b ON a.id = b.id AND b.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts + INTERVAL 1 HOUR",
        "stream_coupon_messages": coupon_get,
        "stream_detail_messages": query("details", "SELECT * FROM details"),
        "stream_exactly_once": favor_add,
        "stream_log_pages": query("raw", f"SELECT {_COMMON}, page_id, last_page_id, item, item_type, during_time, ts FROM raw WHERE {_OK} AND event_type <> 'signup'"),
        "stream_routed_tables": dim_route,
        "created_tables": """SELECT 'dim_region_' || n_regionkey sink_table, CASE WHEN n_regionkey % 2 = 0 THEN 'id,name' ELSE 'name,region' END "columns", CASE WHEN n_regionkey % 2 = 0 THEN n_nationkey || '|' || n_name ELSE n_name || '|' || n_regionkey END "row" FROM nation""",
        "stream_user_spu_window": user_spu("10 seconds"),
        "stream_refund_window": refund_window("10 seconds"),
        "stream_order_chain": order_window("10 seconds"),
        "stream_expiring_firsts": """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) // 1000 ms, row_number() OVER w n, coalesce(epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER w >= 6 * 3600000, true) quiet FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
          f AS (SELECT *, ms told, true again FROM e WHERE n = 1 UNION ALL
                SELECT e.*, CASE WHEN e.ms - f.told >= 24 * 3600000 THEN e.ms ELSE f.told END, e.ms - f.told >= 24 * 3600000 FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
          SELECT event_id seq, CAST(quiet AS BIGINT) quiet, CAST(again AS BIGINT) again FROM f WHERE quiet OR again""",
        "stream_latest_held": query("details", f"""SELECT id, CAST(CAST(split_total_amount AS DECIMAL(18,2)) + 1 AS VARCHAR) split_total_amount, epoch_us(strptime(create_time, {S})) // 1000 + 5000 held_ms FROM details UNION ALL
          SELECT id, CAST(CAST(split_total_amount AS DECIMAL(18,2)) + 2 AS VARCHAR), epoch_us(strptime(create_time, {S})) // 1000 + 14000 FROM details WHERE length(id) % 3 = 0"""),
        "stream_retracting_join": query("ln", """SELECT d.id, d.order_id, a.activity_id, c.coupon_id FROM ln d LEFT JOIN (SELECT id, CAST(l_partkey % 10 AS VARCHAR) activity_id FROM ln WHERE l_discount > 0.05) a ON a.id = d.id
          LEFT JOIN (SELECT id, CAST(l_suppkey % 13 AS VARCHAR) coupon_id FROM ln WHERE l_tax > 0.04) c ON c.id = d.id"""),
        "stream_config_change": "SELECT CASE WHEN c_custkey % 2 = 1 AND n_nationkey % 3 = 1 THEN 'dim_new_' ELSE 'dim_' END || n_nationkey sink_table, CAST(c_custkey AS VARCHAR) pk FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 0 OR n_nationkey % 3 <> 2",
        "stream_group_offsets": "SELECT reader, CAST(event_id AS VARCHAR) \"value\" FROM events, (VALUES ('stopping'), ('steady')) t(reader)",
        "stream_committed_topic": favor_add,
        "stream_bounce_pattern": query("jumps", "SELECT mid, seq, ts FROM jumps", 3 * 3_600_000),
        "stream_funnel": """WITH e AS (SELECT *, epoch_us(ts) // 1000 ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) n FROM events),
          n AS (SELECT *, min(CASE WHEN event_type = 'click' THEN n END) OVER w c, min(CASE WHEN event_type = 'purchase' THEN n END) OVER w p FROM e WINDOW w AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
          SELECT CAST(v.user_id AS VARCHAR) mid, v.event_id "view", c.event_id click, p.event_id purchase FROM n v JOIN n c ON c.user_id = v.user_id AND c.n = v.c JOIN n p ON p.user_id = v.user_id AND p.n = c.p
          WHERE v.event_type = 'view' AND p.ms - v.ms < 10 * 86400000""",
        "window_join_short": f"SELECT a.id id_l, CAST(a.event_id AS VARCHAR) name_l, CAST(b.event_id AS VARCHAR) name_r, (epoch_us(a.ts) // 3600000000) * 5 begins FROM ({click}) a JOIN ({buy}) b ON a.id = b.id AND epoch_us(a.ts) // 3600000000 = epoch_us(b.ts) // 3600000000",
        "gmv_on_day": query("latest", f"SELECT {_d('split_total_amount')} order_amount FROM latest WHERE create_time[1:10] = '1996-01-15'"),
        "uv_on_day": channels,
        "channel_chart": f"""SELECT '{{"status":0,"msg":"","data":{{"categories":[' || coalesce(string_agg('"' || ch || '"', ',' ORDER BY uv DESC, ch), '') || '],"series":[{{"name":"visitors","data":[' || coalesce(string_agg(CAST(uv AS VARCHAR), ',' ORDER BY uv DESC, ch), '')
          || ']}},{{"name":"bounces","data":[' || coalesce(string_agg(CAST(uj_ct AS VARCHAR), ',' ORDER BY uv DESC, ch), '') || ']}}]}}}}' body FROM ({channels})""",
        "order_window_stamped": f"SELECT *, CAST(1704067200000 AS BIGINT) ts FROM ({order_window('10 seconds')})",
        "dedup_latest_by_time": query("latest", "SELECT id, split_total_amount, regexp_replace(strftime(TIMESTAMP '2024-01-01 00:00:03' + INTERVAL (length(id) % 10 * 20) MILLISECOND, '%Y-%m-%d %H:%M:%S.%g') || 'Z', '0{1,2}Z$', 'Z') row_op_ts FROM latest"),
        "province_beans": f'SELECT stt, edt, province_id AS "provinceId", order_ct AS "orderCt", order_amount AS "orderAmount", province_name AS "provinceName" FROM ({province("10 seconds")})',
        "config_routes": "SELECT n_name source_table, CASE WHEN n_nationkey % 3 = 1 THEN 'dim_new_' ELSE 'dim_' END || n_nationkey sink_table, 'id,name' sink_columns FROM nation WHERE n_nationkey % 3 <> 2",
        "order_times": f"""SELECT o_orderkey, epoch_us(o_orderdate) // 1000000 * 1000 ms, epoch_us(date_trunc('day', o_orderdate)) // 1000 day_ms, strftime(o_orderdate, {S}) "second",
          strftime(o_orderdate, {S}) || CASE WHEN o_orderkey % 2 = 0 THEN '.5' ELSE '.04' END "later" FROM orders""",
        "upsert_payments": query("paid", "SELECT order_detail_id, order_id, CASE WHEN CAST(order_id AS BIGINT) % 2 = 0 THEN '0.00' ELSE split_payment_amount END split_payment_amount FROM paid"),
        "distinct_by_bitmap": query("latest", "SELECT create_time[1:10] \"day\", province_id, count(DISTINCT order_id) order_ct, count(DISTINCT user_id) user_ct FROM latest GROUP BY ALL"),
        "as_of_province": """SELECT o_orderkey, CAST(n_nationkey AS BIGINT) province, n_name || CASE WHEN n_nationkey % 2 = 0 AND o_orderdate >= TIMESTAMP '1998-06-01' THEN ' III'
            WHEN o_orderdate >= TIMESTAMP '1996-01-01' + INTERVAL (n_nationkey) DAY THEN ' II' ELSE '' END province_name
          FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey WHERE NOT (n_nationkey % 5 = 4 AND o_orderdate >= TIMESTAMP '2000-01-01')""",
        "dictionary_words": dictionary, "dictionary_words_joined": dictionary,
        "log_split_page": query("raw", f"SELECT {_COMMON}, page_id, last_page_id, item, item_type, during_time, ts FROM raw WHERE {_OK} AND event_type <> 'signup'"),
        "log_split_start": query("raw", f"SELECT {_COMMON}, 'icon' entry, CAST(k AS BIGINT) loading_time, ts FROM raw WHERE {_OK} AND event_type = 'signup'"),
        "log_split_error": query("raw", f"SELECT mid, page_id, CAST(k AS BIGINT) error_code, 'oops' msg, ts FROM raw WHERE {_OK} AND event_type = 'error'"),
        "log_split_display": query("raw", f"SELECT CAST(k + n AS VARCHAR) item, 'sku' item_type, CAST(n + 1 AS BIGINT) \"order\", mid, page_id, ts FROM raw, (VALUES (0), (1)) t(n) WHERE {_OK} AND event_type = 'view'"),
        "log_split_action": query("raw", f"SELECT 'cart_add' action_id, CAST(k AS VARCHAR) item, mid, page_id, ts, ts log_ts FROM raw WHERE {_OK} AND event_type = 'click'"),
        "log_dirty": query("raw", f"SELECT seq, CASE WHEN seq % 97 = 0 THEN 'not json' WHEN seq % 101 = 0 THEN '' ELSE '{{\"common\": {{' END \"value\" FROM raw WHERE NOT ({_OK})"),
        "coupon_get": coupon_get,
        "coupon_order": query("kv", f"SELECT {coupon}, CAST(event_id * 3 AS VARCHAR) order_id, at_s[1:10] date_id, at_s order_time, ts_s ts FROM kv WHERE event_type = 'purchase' AND k < 60"),
        "coupon_pay": query("kv", f"SELECT {coupon}, CAST(event_id * 3 AS VARCHAR) order_id, at_s[1:10] date_id, at_s payment_time, ts_s ts FROM kv WHERE event_type = 'purchase' AND k % 2 = 0"),
        "favor_add": favor_add,
        "comment": query("kv dic", "SELECT id, uid user_id, CAST(k AS VARCHAR) sku_id, CAST(event_id * 3 AS VARCHAR) order_id, at_s[1:10] date_id, at_s create_time, code appraise_code, label appraise_name, ts_s ts FROM kv JOIN dic ON code = CAST(k % 5 + 1201 AS VARCHAR) WHERE event_type = 'error'"),
        "user_register": query("kv", "SELECT uid user_id, at_s[1:10] date_id, at_s create_time, ts_s ts FROM kv WHERE event_type = 'signup'"),
        "cart_add": query("carts", "SELECT * FROM carts"),
        "cart_add_uu_window": carts,
        "order_pre_process": query("wide", 'SELECT id, order_id, sku_id, sku_name, order_price, sku_num, create_time, source_type_id, source_type_name, source_id, split_total_amount, split_activity_amount, split_coupon_amount, consignee, total_amount, order_status, user_id, payment_way, operate_time, province_id, order_detail_activity_id, activity_id, activity_rule_id, order_detail_coupon_id, coupon_id, coupon_use_id, "type" FROM wide'),
        "order_detail": query("details", "SELECT * FROM details"),
        "cancel_detail": query("wide", f"SELECT {', '.join(ORDER_DETAIL.split()).replace('create_time', 'operate_time AS cancel_time')} FROM wide WHERE order_status = '1003'"),
        "pay_detail_suc": query("paid", "SELECT * FROM paid"),
        "payment_suc_window": query("paid", f"""SELECT {ends('strptime(callback_time, ' + S + ')')}, {_n('1')} payment_suc_unique_user_count, {_n('n')} payment_suc_new_user_count FROM (
          SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY callback_time, order_detail_id) = 1 THEN 1 ELSE 0 END n FROM paid
          QUALIFY row_number() OVER (PARTITION BY user_id, callback_time[1:10] ORDER BY callback_time, order_detail_id) = 1) GROUP BY ALL"""),
        "order_refund": query("refunds", "SELECT * FROM refunds"),
        "refund_pay_suc": query("ln od dic", """SELECT 'p' || l.id id, o.user_id, l.order_id, l.sku_id, o.province_id, code payment_type_code, label payment_type_name, strftime(l.ot + INTERVAL 2 HOUR, '%Y-%m-%d') date_id,
          strftime(l.ot + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') callback_time, a.n refund_num, CAST(price AS VARCHAR) refund_amount, l.ts_s ts FROM ln l JOIN dic ON code = CAST(l_linenumber % 4 + 1101 AS VARCHAR)
          JOIN od o ON o.oid = l.order_id AND o.o_orderkey % 3 = 1 JOIN (SELECT order_id, sku_id, max(num) n FROM ln WHERE l_returnflag = 'R' GROUP BY ALL) a ON a.order_id = l.order_id AND a.sku_id = l.sku_id
          WHERE l_returnflag = 'R' AND l_linenumber % 2 = 0"""),
        "order_window": order_window("10 seconds"),
        "order_window_hour": order_window("1 hour"),
        "province_order_window": province("10 seconds"),
        "user_spu_order_window": user_spu("10 seconds"),
        "refund_window": refund_window("10 seconds"),
        "dedup_first": query("firsts", "SELECT id, order_id, split_total_amount FROM firsts"),
        "dedup_latest": query("latest", "SELECT id, order_id, split_total_amount FROM latest"),
        "gmv_by_day": query("latest", f"SELECT CAST(strftime(strptime(create_time, {S}), '%Y%m%d') AS INT) AS \"day\", {_d('split_total_amount')} order_amount FROM latest GROUP BY ALL"),
        "uv_by_channel": query("pages uv jumps", f"SELECT ch, {_n('uv')} uv, {_n('uj')} uj_ct FROM (SELECT ch, 1 uv, 0 uj FROM uv UNION ALL SELECT ch, 0, 1 FROM jumps UNION ALL SELECT ch, 0, 0 FROM pages) GROUP BY ch"),
        "dim_route": dim_route,
        "interval_join": f"SELECT a.id id_l, a.event_id event_id_l, b.event_id event_id_r FROM ({click}) a JOIN ({buy}) b ON a.id = b.id AND b.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts + INTERVAL 1 HOUR",
        "window_join": f"SELECT a.id id_l, a.event_id event_id_l, b.event_id event_id_r, strftime(time_bucket(INTERVAL '1 hour', a.ts), {S}) stt FROM ({click}) a JOIN ({buy}) b ON a.id = b.id AND time_bucket(INTERVAL '1 hour', a.ts) = time_bucket(INTERVAL '1 hour', b.ts)",
        "inner_join": demo("INNER"), "left_join": demo("LEFT"), "right_join": demo("RIGHT"), "full_join": demo("FULL OUTER"),
    }
