"""Keyed processors, whose rows must not depend on micro-batches or Arrow batches, against plain state machines."""

import glob
import random
from collections import Counter
from datetime import datetime, timedelta
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.streamed import queries
from tidemark.session import shared_folder
from tidemark.streaming import changelog, keyed, processors, runners
from tidemark.streaming.keyed import InOrder, Timers, Value, process
from tidemark.streaming.logics import Buyers, Firsts, LatestHeld

BASE = datetime(2024, 1, 1)
EVENTS = "user string, ms long, id long, v double, kept string, et timestamp"


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def batches(spark, folder, rows, schema, cuts):
    """Rows as one file for each cut, read as a stream of one file at a time."""
    edges = [0, *cuts, len(rows)]
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.parquet(f"{folder}/in/{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def gather(spark, rows, folder):
    runners.run_once(rows, f"{folder}/state", runners.write_batch(f"{folder}/out"))
    return [tuple(r) for r in spark.read.option("recursiveFileLookup", "true").schema(rows.schema).parquet(f"{folder}/out").collect()]


def events(seed, n=160):
    rng = random.Random(seed)
    times = sorted(rng.randrange(400) for _ in range(n))
    rows = [(f"u{rng.randrange(6)}", t * 1000, i, float(rng.randrange(5)), None if i % 7 == 0 else f"k{i}", BASE + timedelta(seconds=t)) for i, t in enumerate(times)]
    return [*rows, ("end", 10**9, 10**6, 0.0, "x", BASE + timedelta(seconds=10**6))]


def with_ms(rows):
    """Event times in ms since 1970, as the timestamps are."""
    base = int(BASE.timestamp() * 1000)
    return [(u, base + m, *rest) for u, m, *rest in rows]


def plain_firsts(rows, quiet_ms, again_ms):
    seen, told, out = {}, {}, []
    for u, at, i, *_ in rows:
        quiet, again = u not in seen or at - seen[u] >= quiet_ms, u not in told or at - told[u] >= again_ms
        seen[u] = at
        if again:
            told[u] = at
        if quiet or again:
            out.append((i, int(quiet), int(again)))
    return sorted(out)


@pytest.mark.parametrize("cuts", [[], [60, 120], [1, 2, 30, 31, 150]])
def test_variables_expire(spark, tmp_path, cuts):
    """One lives from its last read, one from its last write; the same rows however the input is cut."""
    rows = with_ms(events(3))
    output = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "quiet", "again")])
    out = process(batches(spark, tmp_path, rows, EVENTS, cuts), "user", ["ms", "id"], output, Firsts(9_000, 20_000, ("id",)), "et")
    assert sorted(gather(spark, out, tmp_path)) == plain_firsts(rows, 9_000, 20_000)


def plain_held(rows, hold):
    open_, out = {}, []
    for u, at, i, v, kept, _ in rows:
        for key in [k for k, (due, *_) in open_.items() if due <= at]:
            out.append((open_[key][2], open_[key][0]))
            del open_[key]
        if u not in open_:
            open_[u] = (at + hold, v, kept)
        elif v >= open_[u][1]:
            open_[u] = (open_[u][0], v, kept)
    return Counter(out)


@pytest.mark.parametrize("cuts", [[], [50, 51, 100]])
def test_the_latest_is_held(spark, tmp_path, cuts):
    rows = with_ms(events(5))
    output = T.StructType([T.StructField("kept", T.StringType()), T.StructField("held_at", T.LongType())])
    out = process(batches(spark, tmp_path, rows, EVENTS, cuts), "user", ["ms", "id"], output, LatestHeld(12_000, "v", ("kept",)), "et")
    want = plain_held(rows, 12_000)
    assert Counter(gather(spark, out, tmp_path)) == want and sum(want.values()) > 20


LEFT, RIGHT = "k string, a string, op int", "k string, b string, op int"


@pytest.mark.parametrize("how", ["left", "inner"])
def test_retractions_leave_the_join(spark, tmp_path, how):
    """Inserts and withdrawals of both sides in any order, in several micro-batches."""
    rng = random.Random(8)
    sides = []
    for side in "lr":
        held, rows = [], []
        for i in range(90):
            if held and rng.random() < 0.3:
                rows.append((*held.pop(rng.randrange(len(held))), -1))
            else:
                held.append((rng.choice(["x", "y", "z", None, f"{side}{i}"]), f"{i % 20}"))
                rows.append((*held[-1], 1))
        sides.append((rows, held))
    (lrows, left), (rrows, right) = sides
    changes = changelog.changelog_join(batches(spark, tmp_path / "l", lrows, LEFT, [20, 21, 60]), batches(spark, tmp_path / "r", rrows, RIGHT, [40, 70]), ["k"], how)
    runners.run_once(changes, f"{tmp_path}/state", changelog.write_folded(f"{tmp_path}/out"))
    got = Counter(tuple(r) for r in changelog.read_folded(spark, f"{tmp_path}/out", changes.schema).collect())
    want = Counter()
    for k, a in left:
        met = [(k, a, b) for q, b in right if q == k and k is not None]
        want.update(met or ([(k, a, None)] if how == "left" else []))
    assert got == want
    assert spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out").where("op < 0").count() > 0


def test_a_side_is_forgotten(spark, tmp_path):
    at = lambda s: BASE + timedelta(seconds=s)
    left = [("a", "1", at(0)), ("b", "2", at(0)), ("end", "0", at(10**6))]
    right = [("a", "p", at(4)), ("b", "q", at(6)), ("end", "0", at(10**6))]
    schema = "k string, {} string, t timestamp"
    changes = changelog.changelog_join(batches(spark, tmp_path / "l", left, schema.format("a"), []), batches(spark, tmp_path / "r", right, schema.format("b"), []), ["k"], time="t", ttl_ms=5_000)
    got = [(k, a, b, op) for k, a, b, _, op in gather(spark, changes, tmp_path) if k != "end"]
    assert sorted(got, key=str) == sorted([("a", "1", None, 1), ("a", "1", None, -1), ("a", "1", "p", 1), ("b", "2", None, 1)], key=str)


@pytest.mark.parametrize("size", [1, 7, 200])
@pytest.mark.parametrize("name", ["repair_new_visitors", "unique_visitors", "home_detail_flags", "logins", "unique_and_new", "cart_users", "bounces"])
def test_processors_with_small_arrow_batches(spark, tmp_path, size, name):
    """Keys whose rows come in several Arrow batches give the rows that they give in one."""
    rng = random.Random(1)
    rows = []
    for i in range(300):
        at = BASE + timedelta(hours=rng.randrange(24 * 20), seconds=i)
        rows.append((f"m{i % 3}", f"m{i % 3}", rng.choice("01"), rng.choice(["home", "good_detail", "search"]), rng.choice([None, "login", "home"]), int(at.timestamp() * 1000), at, i, f"{at:%Y-%m-%d %H:%M:%S}", f"m{i % 3}", f"{i}"))
    late = BASE + timedelta(days=9999)
    rows.append(("end", "end", "0", "home", "home", int(late.timestamp() * 1000), late, 10**6, "2090-01-01 00:00:00", "end", "x"))
    schema = "mid string, uid string, is_new string, page_id string, last_page_id string, ts long, rt timestamp, seq long, at string, user_id string, id string"
    machine = {"unique_and_new": lambda r: processors.unique_and_new(r, "mid"), "cart_users": lambda r: processors.cart_users(r.select("user_id", "id", "at")), "bounces": lambda r: processors.bounces(r, 3600)}.get(name, getattr(processors, name))
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    got = []
    for batch in (10_000, size):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        try:
            got.append(sorted(gather(spark, machine(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), tmp_path / str(len(got))), key=str))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0] == got[1] and got[0]


def test_keyed_streams_bring_their_store(spark, tmp_path):
    """A session that isn't the package's own keeps states elsewhere by default; its setting is as before afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    own = spark.conf.get(name)
    default = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    spark.conf.set(name, default)
    try:
        assert queries()["stream_expiring_firsts"](spark, "/root/testdata/sf0.001").count() > 0
        assert spark.conf.get(name) == default
    finally:
        spark.conf.set(name, own)


def test_rows_in_order_share_a_timer():
    """Rows of a key, in whatever order they come, have one timer, and all that the watermark has reached go on when it is woken."""
    logic = InOrder(Buyers(("id",)), ["id", "ms"], ["ms", "id"])
    state, timers = {v.name: Value(v, None) for v in logic.variables}, Timers(())
    for at in (5_000, 3_000, 9_000, 4_000):
        assert not list(logic.on_row(("u",), {"id": str(at), "ms": at}, at, state, timers))
    assert timers.due == {3_000}
    woken = Timers((), 5_000)
    assert list(logic.on_timer(("u",), 3_000, state, woken)) == [("3000", 1, 1), ("4000", 0, 0), ("5000", 0, 0)]
    assert woken.due == {9_000}
    last = Timers((), 90_000)
    assert list(logic.on_timer(("u",), 9_000, state, last)) == [("9000", 0, 0)]
    assert not last.due and state["waiting"].value is None


class Store:
    """A handle that counts what is asked of it."""

    def __init__(self):
        self.value, self.calls, self.timers = None, 0, set()

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.discard(at)


def test_a_bucket_is_read_and_written_once():
    """However many keys a bucket has, it asks the store and the timers of Spark a few times, as each call costs more than a row's work."""
    given = T.StructType([T.StructField("id", T.StringType()), T.StructField("ms", T.LongType()), T.StructField("v", T.DoubleType())])
    held = keyed._Processor(LatestHeld(5_000, "v", ("id",)), ["id"], given, ["id", "held_ms"], ["ms", "v"], True)
    store, n = Store(), 300
    held.init(store)
    rows = [[f"k{i % n}", str(1_000 + i // n * 2_000 + i % n), str(i // n)] for i in range(2 * n)]
    frame = pd.DataFrame({"keyed_bucket": [0] * len(rows), "keyed_row": [np.array(r, dtype=object) for r in rows]})
    assert not list(held.handleInputRows((0,), iter([frame]), None))
    assert store.calls <= 3 and store.timers == {6_000}
    store.calls, out = 0, []
    mark = SimpleNamespace(getCurrentWatermarkInMs=lambda: 6_100)
    out += list(held.handleExpiredTimer((0,), mark, SimpleNamespace(getExpiryTimeInMs=lambda: 6_000)))
    assert store.calls <= 3 and max(store.timers) == 6_100
    assert [tuple(r) for f in out for r in f.itertuples(index=False)] == [(f"k{i}", 6_000 + i) for i in range(100)]


@pytest.mark.parametrize("buckets", [1, 3, 4096])
def test_buckets_do_not_show(spark, tmp_path, buckets):
    """Keys that share a bucket, of several types and null as well, give the rows that they give alone; long numbers stay exact beside nulls."""
    rows = [(k, n, ms, None if i % 3 else 2**53 + i, BASE + timedelta(milliseconds=ms)) for i, (k, n, ms) in enumerate((f"k{x % 7}" if x % 7 else None, x % 2 == 0, 1_000 * x) for x in range(80))]
    rows = [(k, n, int(BASE.timestamp() * 1000) + ms, v, t) for k, n, ms, v, t in rows] + [("end", True, 10**14, 0, BASE + timedelta(days=9999))]
    schema = "k string, n boolean, ms long, v long, et timestamp"
    output = T.StructType([T.StructField("v", T.LongType()), T.StructField("quiet", T.LongType()), T.StructField("again", T.LongType())])
    out = process(batches(spark, tmp_path, rows, schema, [30, 50]), ["k", "n"], ["ms"], output, Firsts(9_000, 20_000, ("v",)), "et", buckets=buckets)
    want, seen, told = [], {}, {}
    for k, n, ms, v, _ in rows:
        quiet, again = (k, n) not in seen or ms - seen[k, n] >= 9_000, (k, n) not in told or ms - told[k, n] >= 20_000
        seen[k, n] = ms
        told[k, n] = ms if again else told[k, n]
        want += [(v, int(quiet), int(again))] if quiet or again else []
    assert Counter(gather(spark, out, tmp_path)) == Counter(want)


def test_joins_in_a_row_run_once(spark, tmp_path):
    """A join whose left side is a join itself has one stateful step more, not twice as many; rows without a key go by."""
    one = batches(spark, tmp_path / "l", [("x", "1", 1), (None, "2", 1), (None, "2", 1), (None, "3", -1), ("y", "4", 1)], LEFT, [3])
    two, three = (batches(spark, tmp_path / n, [("x", n, 1), (None, n, 1)], f"k string, {n} string, op int", []) for n in "pq")
    changes = changelog.changelog_join(changelog.changelog_join(one, two, ["k"]), three, ["k"])
    query = runners.run_once(changes, f"{tmp_path}/state", changelog.write_folded(f"{tmp_path}/out"), partitions=1)
    assert len(query.lastProgress.stateOperators) == 2 and {o.numShufflePartitions for o in query.lastProgress.stateOperators} == {1}
    got = Counter(tuple(r) for r in changelog.read_folded(spark, f"{tmp_path}/out", changes.schema).collect())
    assert got == Counter([("x", "1", "p", "q"), (None, "2", None, None), (None, "2", None, None), ("y", "4", None, None)])
    assert spark.conf.get("spark.sql.shuffle.partitions") == "2"


def test_a_join_of_streams_is_one_store(spark, tmp_path):
    """Each partition of a join has one store, whose files are compressed well; what the session has is as before afterwards."""
    stream = lambda n: batches(spark, tmp_path / n, [(f"k{i}", BASE + timedelta(seconds=i)) for i in range(20)], f"{n} string, {n}_et timestamp", []).withWatermark(f"{n}_et", "1 second")
    before = {k: spark.conf.get(k, None) for k in (runners.COMPRESSION, runners.JOIN_FORMAT, runners.PARTITIONS)}
    with runners.on_rocksdb(spark, 3):
        assert spark.conf.get(runners.COMPRESSION) == "zstd" and spark.conf.get(runners.PARTITIONS) == "3"
    rows = gather(spark, stream("a").join(stream("b"), F.expr("a = b AND a_et = b_et"), "left"), tmp_path)
    assert sorted(r[0] for r in rows) == sorted(f"k{i}" for i in range(20))
    assert not list((tmp_path / "state/state").rglob("*keyToNumValues"))
    assert {k: spark.conf.get(k, None) for k in before} == before


def test_buyers_of_the_order_window_run_by_bucket(spark):
    """Flags of buyers are given for a bucket of users at once: with a call for each user the stream took 10 ms and more of a task for each."""
    old = set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/stream-*"))
    assert queries()["stream_order_window"](spark, "/root/testdata/sf0.001").count() > 0
    (new,) = set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/stream-*")) - old
    about = [p.read_text() for p in Path(new, "buyers-state/state/0/_metadata").rglob("*") if p.is_file() and p.suffix != ".crc"]
    assert any("transformWithState" in t for t in about) and not any("applyInPandas" in t for t in about)
