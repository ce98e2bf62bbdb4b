"""Patterns, bitmaps, versions and dictionary words against plain versions."""

import itertools
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions.dictionary import Automaton, dictionary_words
from tidemark.operators import bitmaps, versions
from tidemark.streaming import runners
from tidemark.streaming.patterns import Step, match

BASE = datetime(2024, 1, 1)
ROWS = "mid string, ts long, seq long, kind string, rt timestamp"


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def found(spark, folder, rows, steps, within, timeouts, cuts=()):
    """Matches of rows (key, seconds, kind) in the order given, cut into micro-batches."""
    made = [(k, int((BASE + timedelta(seconds=s)).timestamp() * 1000), i, kind, BASE + timedelta(seconds=s)) for i, (k, s, kind) in enumerate([*rows, ("end", 10**6, "end")])]
    edges = [0, *cuts, len(made)]
    for i, (a, b) in enumerate(itertools.pairwise(edges)):
        spark.createDataFrame(made[a:b], ROWS).coalesce(1).write.parquet(f"{folder}/in/{i:03d}")
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*").withColumns({k: F.col("kind") == k for k in "ENABC"})
    out = match(stream, "mid", steps, within * 1000, "rt", timeouts=timeouts)
    runners.run_once(out, f"{folder}/state", runners.write_batch(f"{folder}/out"))
    got = spark.read.option("recursiveFileLookup", "true").schema(out.schema).parquet(f"{folder}/out").where("mid <> 'end'").collect()
    return Counter((tuple(r.taken), r.done) for r in got)


def test_worked_cases_of_the_bounce(spark, tmp_path):
    """Entry, other page: two entries next to each other within ten seconds, or an entry that the time runs out on."""
    cases = {
        "a": ([(0, "E"), (3, "N")], []),
        "b": ([(0, "E"), (3, "E")], [((0, 1), True), ((1,), False)]),
        "c": ([(0, "E")], [((0,), False)]),
        "d": ([(0, "E"), (30, "N")], [((0,), False)]),
        "e": ([(0, "E"), (3, "E"), (6, "E")], [((0, 1), True), ((1, 2), True), ((2,), False)]),
        "f": ([(0, "E"), (10, "E")], [((0,), False), ((1,), False)]),
    }
    rows = sorted(((k, s, kind) for k, (steps, _) in cases.items() for s, kind in steps), key=lambda r: r[1])
    place = {k: [i for i, r in enumerate(rows) if r[0] == k] for k in cases}
    want = Counter((tuple(place[k][i] for i in taken), done) for k, (_, out) in cases.items() for taken, done in out)
    assert found(spark, tmp_path, rows, [Step("E", times=2, next=True)], 10, True) == want


def plain(rows, steps, within, timeouts):
    """Every row that begins a match is followed on its own."""
    flat = [s for s in steps for _ in range(s.times)]
    out = Counter()
    for i, (key, begin, kind) in enumerate(rows):
        if kind != flat[0].when:
            continue
        taken, over = [i], False
        for j in range(i + 1, len(rows)):
            k, at, other = rows[j]
            if k != key or len(taken) == len(flat):
                continue
            if at - begin >= within:
                break
            if other == flat[len(taken)].when:
                taken.append(j)
            elif flat[len(taken)].next:
                over = True
                break
        if len(taken) == len(flat):
            out[tuple(taken), True] += 1
        elif not over and timeouts:
            out[tuple(taken), False] += 1
    return out


@pytest.mark.parametrize("cuts", [(), (40, 41, 90)])
@pytest.mark.parametrize("steps", [[Step("A"), Step("B"), Step("C")], [Step("A", times=2), Step("B", next=True), Step("C")], [Step("A"), Step("B", times=2, next=True)]])
def test_three_steps_equal_brute_force(spark, tmp_path, steps, cuts):
    rng = random.Random(7)
    times = sorted(rng.randrange(300) for _ in range(140))
    rows = [(f"m{rng.randrange(3)}", t, rng.choice("ABC")) for t in times]
    want = plain(rows, steps, 25, True)
    assert found(spark, tmp_path, rows, steps, 25, True, cuts) == want and {d for _, d in want} == {True, False}


def test_bitmaps_count_like_sets(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(6), f"id{rng.randrange(300)}" if rng.random() < 0.9 else None) for _ in range(900)]
    table = spark.createDataFrame(rows, "k string, w int, id string")
    numbers = bitmaps.number_ids(table, "id")
    assert numbers.count() == numbers.select("number").distinct().count() == numbers.select("id").distinct().count()
    dense = bitmaps.number_ids(table, "id", expected=1)
    assert dense.select("number").distinct().count() == dense.count() and dense.agg(F.max("number")).first()[0] < 300
    own = table.join(numbers, "id", "left")
    parts = bitmaps.bitmaps(own, ["k", "w"], "number", F.count(F.lit(1)).alias("n"))
    got = {(r.k, r.w): (r.ids, r.n) for r in bitmaps.counted(parts, ["k", "w"], "ids", F.sum("n").alias("n")).collect()}
    assert got == {(k, w): (len({i for a, b, i in rows if (a, b) == (k, w)} - {None}), sum((a, b) == (k, w) for a, b, _ in rows)) for k in "ab" for w in range(6)}
    whole = {r.k: r.ids for r in bitmaps.counted(bitmaps.merged(parts, ["k"]), ["k"], "ids").collect()}
    assert whole == {k: len({i for a, _, i in rows if a == k} - {None}) for k in "ab"}


def test_bitmaps_of_few_ids_are_small(spark):
    """Groups of an id or two, far apart: a long for each, not a bitmap of thousands of bytes."""
    rows = spark.range(400).selectExpr("id div 2 AS k", "id * 1000 - 7 AS number")
    parts = bitmaps.bitmaps(rows, ["k"], "number")
    assert dict(parts.dtypes)["bitmap"] == "bigint" and parts.count() == 400
    assert {r.n for r in bitmaps.counted(parts, ["k"], "n").collect()} == {2}


def test_facts_see_the_version_of_their_time(spark):
    """A dictionary that changes twice and ends, a busy key, facts at the very moment of a change, before all and after all."""
    at = lambda s: BASE + timedelta(seconds=s)
    log = [("x", at(0), 0, "one", False), ("x", at(50), 0, "two", False), ("x", at(50), 1, "two b", False), ("x", at(90), 0, None, True), ("x", at(120), 0, "three", False), ("y", at(10), 0, "why", False)]
    facts = [("x", at(s)) for s in (-5, 0, 49, 50, 89, 90, 119, 120, 5000)] + [("x", at(60))] * 40 + [("y", at(9)), ("y", at(10)), ("z", at(10)), (None, at(10)), ("x", None)]
    dimension = versions.versions(spark.createDataFrame(log, "code string, at timestamp, n int, name string, gone boolean"), "code", "at", ["n"], "gone")
    rows = spark.createDataFrame(facts, "k string, t timestamp")

    def name(k, t):
        if t is None:
            return None
        known = [(a, n, v, g) for c, a, n, v, g in log if c == k and a <= t]
        return None if not known or max(known, key=lambda r: r[:2])[3] else max(known, key=lambda r: r[:2])[2]

    want = Counter((k, t, name(k, t)) for k, t in facts)
    assert Counter(map(tuple, versions.as_of(rows, dimension, "k", "t", "code", ["name"], "left").collect())) == want
    assert Counter(map(tuple, versions.as_of(rows, dimension, "k", "t", "code", ["name"]).collect())) == Counter({r: n for r, n in want.items() if r[2] is not None})
    assert versions.as_of(rows.limit(0), dimension, "k", "t", "code", ["name"]).count() == 0


def test_every_word_of_a_dictionary_is_found(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 4))) for _ in range(25)] + ["aaa", "aa", "a", "", "zzzz"]
    texts = [None, "", "a", "aaaa"] + ["".join(rng.choice("abé ") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    want = Counter((i, w, s) for i, t in enumerate(texts) for w in set(words) - {""} for s in range(len(t or "")) if t.startswith(w, s))
    automaton = Automaton(set(words))
    assert Counter((i, w, s) for i, t in enumerate(texts) for w, s in automaton.find(t)) == want
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    dictionary = spark.createDataFrame([(w,) for w in [*words, "aa", None]], "word string")
    for sent in (10**6, 0):
        assert Counter(map(tuple, dictionary_words(rows, dictionary, "t", sent_bytes=sent).select("i", "word", "start").collect())) == want
    assert dictionary_words(rows, dictionary.limit(0), "t").count() == 0
