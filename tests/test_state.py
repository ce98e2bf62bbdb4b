import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import state
from tidemark.plans import traffic

START = datetime(2024, 1, 1)
SCHEMA = "mid string, uid string, is_new string, last_page_id string, page_id string, ts long, rt timestamp_ntz, seq long"


def pages(spark, rows):
    """(mid, seconds after the start, last page, more...) as page views."""
    out = []
    for i, (mid, s, last, *more) in enumerate(rows):
        kw = more[0] if more else {}
        t = START + timedelta(seconds=s)
        out.append((mid, kw.get("uid"), kw.get("is_new", "0"), last, kw.get("page_id", "home"), int((t - datetime(1970, 1, 1)).total_seconds() * 1000), t, i))
    return spark.createDataFrame(out, SCHEMA)


E, N = None, "home"


@pytest.mark.parametrize(
    ("seq", "want"),
    [
        ([(0, E), (3, N)], []),
        ([(0, E), (3, E)], [0, 1]),
        ([(0, E)], [0]),
        ([(0, E), (30, N)], [0]),
        ([(0, E), (3, E), (6, E)], [0, 1, 2]),
        ([(0, E), (10, N)], [0]),
        ([(0, E), (9, N)], []),
        ([(0, N)], []),
    ],
)
def test_bounces(spark, seq, want):
    got = state.bounces(pages(spark, [("m", s, last) for s, last in seq]))
    assert sorted(r.seq for r in got.collect()) == want


def test_visitors_do_not_mix(spark):
    got = state.bounces(pages(spark, [("a", 0, E), ("b", 3, N), ("b", 4, E), ("b", 5, N)]))
    assert [(r.mid, r.seq) for r in got.collect()] == [("a", 0)]


def test_new_visitor_repair(spark):
    day = 86400
    got = state.repair_new_visitors(pages(spark, [("a", 0, E, {"is_new": "1"}), ("a", 60, E, {"is_new": "1"}), ("a", day, E, {"is_new": "1"}), ("b", 0, E, {"is_new": "0"}), ("b", 60, E, {"is_new": "1"})]))
    assert [r.is_new for r in got.orderBy("seq").collect()] == ["1", "1", "0", "0", "0"]


def test_returning_user(spark):
    day = 86400
    got = state.logins(pages(spark, [("m", d * day, E, {"uid": u}) for u, d in (("x", 0), ("x", 8), ("y", 0), ("y", 7), ("z", 0))]))
    assert {(r.uid, r.seq): r.back for r in got.collect()} == {("x", 0): 0, ("x", 1): 1, ("y", 2): 0, ("y", 3): 0, ("z", 4): 0}


def test_late_bounce_counts_in_its_window(spark):
    rows = pages(spark, [("m", 1, E), ("m", 500, N)]).withColumns({c: F.lit("x") for c in ("vc", "ch", "ar")} | {"during_time": F.lit(5).cast("long")})
    got = {r.stt: (r.uv_ct, r.sv_ct, r.pv_ct, r.dur_sum, r.uj_ct) for r in traffic.page_view_window(rows).collect()}
    assert got == {"2024-01-01 00:00:00": (1, 1, 1, 5, 1), "2024-01-01 00:08:20": (0, 0, 1, 5, 0)}


def test_sessions_as_they_were_counted_before(spark):
    rows = pages(spark, [("m", 1, E), ("m", 2, N)]).withColumns({c: F.lit("x") for c in ("vc", "ch", "ar")} | {"during_time": F.lit(5).cast("long")})
    assert traffic.page_view_window(rows).first().sv_ct == 1
    assert traffic.page_view_window(rows, legacy_sv=True).first().sv_ct == 2


def test_unique_visitor_takes_first_of_day(spark):
    got = state.unique_visitors(pages(spark, [("m", 10, E), ("m", 5, E), ("m", 1, N), ("m", 86400, E)]))
    assert sorted(r.seq for r in got.collect()) == [1, 3]


def test_days_joined_back_repair_like_windows(spark):
    rng = random.Random(2)
    rows = pages(spark, [(rng.choice(["busy", "busy", "busy", "a", None]), rng.randrange(9 * 86400), E, {"is_new": rng.choice("01")}) for _ in range(400)])
    want = sorted((r.seq, r.is_new) for r in state.repair_new_visitors(rows).collect())
    assert sorted((r.seq, r.is_new) for r in state.repair_by(rows, state.first_days(rows)).collect()) == want


def test_flags_of_a_busy_user(spark):
    rng = random.Random(4)
    rows = pages(spark, [(rng.choice(["busy"] * 8 + ["a", None]), rng.randrange(9 * 86400), E) for _ in range(500)])
    got = {r.seq: (r.unique_user, r.new_user) for r in state.unique_and_new(rows, "mid", F.to_date("rt"), ["ts", "seq"]).collect()}
    days, people, want = set(), set(), {}
    for r in sorted(rows.collect(), key=lambda r: (r.ts, r.seq)):
        want[r.seq] = (int((r.mid, r.rt.date()) not in days), int(r.mid not in people))
        days.add((r.mid, r.rt.date())), people.add(r.mid)
    assert got == want
