"""Operators that compare documents: suffixes, Jaccard, decontamination, nearest neighbours, loss differences."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import from_spark
from tests.llm import brute
from tidemark.llm import decontaminate, jaccard, loss_difference, nearest, queries, suffixes
from tidemark.llm.components import components

DOCS = "doc_id long, text string, lang string, key string, grams int, target int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, "x", 1, 1) for i, t in texts], DOCS)


def words(rng, n, most=400):
    return [f"w{rng.randrange(most)}" for _ in range(n)]


def test_suffixes(spark, sf_dir):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = from_spark(queries.op2_suffix_dedup(spark, sf_dir)).set_index("doc_id")
    texts = [t.encode() for _, t in table]
    for (i, _), t, gone in zip(table, texts, brute.repeats(texts), strict=True):
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        assert tuple(got.loc[i][["n_bytes", "n_removed", "n_spans", "kept_sha256"]]) == (len(t), sum(gone), runs, brute.sha(bytes(b for b, g in zip(t, gone, strict=True) if not g)))


@pytest.mark.parametrize("seed", range(3))
def test_suffix_cases(spark, seed, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK_TILES", (200_000, 40, 7)[seed])  # copies within a block, and over several
    monkeypatch.setattr(suffixes, "RUN_TILES", (100_000, 9, 60)[seed])
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcé ") for _ in range(rng.randint(150, 420))) for _ in range(6)]
    texts = ["".join(rng.choice([rng.choice(passages)[rng.randint(0, 90) :], "".join(rng.choice("xyz") for _ in range(rng.randint(0, 60)))]) for _ in range(rng.randint(0, 6))) for _ in range(60)]
    texts += ["a" * 199, "a" * 200, "b" * 201, "q" * 1000, "", None, passages[0], passages[0], "ab" * 300]
    table = docs(spark, [(None if i == 3 else i % 70, t) for i, t in enumerate(texts)])
    got = [(r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in suffixes.remove_repeats(table).collect()]
    raw = [(t or "").encode() for t in texts]
    want = []
    for i, (t, gone) in enumerate(zip(raw, brute.repeats(raw), strict=True)):
        edges = [k for k in range(len(t) + 1) if (k > 0 and gone[k - 1]) != (k < len(t) and gone[k])]
        want.append((None if i == 3 else i % 70, len(t), list(zip(edges[::2], edges[1::2], strict=True)), bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=order) == sorted(want, key=order)


def test_suffixes_of_long_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT", 5000)
    monkeypatch.setattr(suffixes, "BLOCK_TILES", 50)
    rng = random.Random(12)
    own = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = own(700)
    texts = [own(30_000) + shared + own(20_000), own(4900) + shared + own(300)] + [own(900)] * 0 + ["x" + shared[:199], "y" + shared[100:350]]
    table = [*enumerate(texts), *[(7, same := own(600))] * 20, (None, same)]
    got = {(r.doc_id, r.n_bytes, tuple(map(tuple, r.spans))) for r in suffixes.remove_repeats(docs(spark, table).coalesce(1)).collect()}
    assert got == {(0, 50_700, ((30_000, 30_700),)), (1, 5900, ((4900, 5600),)), (2, 200, ()), (3, 251, ((1, 251),)), (7, 600, ((0, 600),)), (None, 600, ((0, 600),))}


def test_suffixes_of_empty_table(spark):
    assert suffixes.remove_repeats(docs(spark, [])).count() == 0


def test_loser_tree_merges_runs():
    rng = random.Random(7)
    runs = [sorted("".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(rng.randint(0, 40))) for _ in range(5)]
    flat = [s for r in runs for s in r]
    coded, first = [], 0
    for r in runs:
        order, shared, rest = suffixes.front_code(r)
        coded.append(suffixes._run(shared, np.array([len(r[j]) for j in order], np.uint16), rest, first, np.array(order)))
        first += len(r)
    merged = list(suffixes.LoserTree(coded))
    strings = [flat[label] for label, _ in merged]
    assert strings == sorted(flat)
    assert all(n == suffixes.common(a, b, 0) for a, b, (_, n) in zip(strings, strings[1:], merged[1:], strict=False))


def family(rng, base, n, changes):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        out.append(" ".join(w[rng.randint(0, 4) : len(w) - rng.randint(0, 4)]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_cases(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", (4000, 30, 3)[seed])  # copies within a block, and over several
    rng = random.Random(seed)
    common = words(rng, 60)
    texts = [t for n in (40, 80, 120) for t in family(rng, words(rng, n), 25, 4)]
    texts += [" ".join([*words(rng, 15), *common]) for _ in range(12)]  # one passage in documents of their own
    texts += ["", None, " \n\t", "one", "ONE", "one two", "a b c d e", "A B C D E", "a b c d e", texts[0], texts[0]]
    table = list(enumerate(texts))
    want = brute.linked_components(table)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_components(docs(spark, table).repartition(3)).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(texts) - 20


@pytest.mark.parametrize("bits", [-20, 5])
def test_jaccard_with_few_counted_bits(spark, bits, monkeypatch):
    """Where n-grams that differ are counted as one, only more pass; also a long text, and repeats over several blocks."""
    monkeypatch.setattr(jaccard, "SPARE_BITS", bits)
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 20)
    rng = random.Random(4)
    long = words(rng, 30_000, 10**6)
    texts = [t for n in (30, 31, 41, 60) for t in family(rng, words(rng, n), 12, 5)] + [" ".join(long), " ".join([*long[:29_000], "x"]), " ".join(long[:20_000])]
    common = words(rng, 40)
    texts += [" ".join([*words(rng, n), *common]) for n in range(1, 25)]  # one passage in texts of many lengths
    table = list(enumerate(texts))
    rows = docs(spark, table)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_components(rows.unionByName(rows)).collect()}
    assert got == brute.linked_components(table)


def test_order_of_the_fragments():
    """The fragments of a set, one after another, are its shared n-grams in the global order."""
    pdf_of = lambda docs_: jaccard._send(docs_, 5, 3, 64, 0)
    import types

    jaccard.TaskContext, kept = types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)), jaccard.TaskContext
    try:
        a, b, c = "a b c d e f g h", "a b c d e f g h i", "b c d e f g h"
        sent = pdf_of([(i, t) for i, t in enumerate([a, b, c, *[b] * 4])])
    finally:
        jaccard.TaskContext = kept
    counted = [jaccard._count_fragment(part) for _, part in sent.groupby("fragment")]
    got = jaccard._gather_block(__import__("pandas").concat(counted), 5, 64, 75).set_index("doc_id")
    grams = lambda t: jaccard.shingles(t).view(np.int64).tolist()
    df = {g: sum(g in grams(t) for t in (a, b, c, b, b, b, b)) for g in grams(b)}
    row = got.loc[1]
    assert [len(row[p]) for p in jaccard.PARTS] == [0, 0, 5, 0, 0]
    assert [g for p in jaccard.PARTS for g in row[p]] == sorted(df, key=lambda g: (df[g], np.int64(g).view(np.uint64)))
    assert row["shared"] == 5 and row["prefix"] == 5 - 4 + 1


def test_jaccard_of_a_whole_table(spark, sf_dir):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op9_jaccard(spark, sf_dir).collect()} == brute.linked_components(table)


def test_jaccard_edges(spark):
    got = jaccard.join_components(docs(spark, [(None, "a b c d e f"), (5, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (5, 5), (7, 5), (7, 5)]
    assert jaccard.join_components(docs(spark, [])).count() == 0


@pytest.mark.parametrize("doc", [None, 7])
def test_equal_blocks_of_a_partition(spark, doc, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 4)
    monkeypatch.setattr(loss_difference, "BLOCK_DOCS", 4)
    table = docs(spark, [(doc, "a b c d e f")] * 14 + [(8, "a b c d e f"), (9, "g")]).coalesce(1)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_components(table).collect()]
    low = 8 if doc is None else 7
    assert sorted(got, key=str) == sorted([(doc, 2, None if doc is None else 7)] * 14 + [(8, 2, low), (9, 1, 9)], key=str)
    losses = loss_difference.loss_differences(table, spark.createDataFrame([(9,)], "doc_id long")).collect()
    same = [r for r in losses if r.doc_id != 9]
    assert len(losses) == 16 and len({(r.n_tokens, round(r.loss_target, 6), round(r.loss_background, 6)) for r in same}) == 1


def test_components_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100), (200, 300), (300, 200), (400, 399)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {200: 200, 300: 200, 399: 399, 400: 399}


def contaminated(df):
    return {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in df.collect()}


@pytest.mark.parametrize(("block", "whole"), [(10**7, 10**7), (60, 10**7), (60, 120)])
def test_contamination_cases(spark, block, whole):
    """One block, several in one pass, and several passes."""
    rng = random.Random(2)
    items = [(i, " ".join(words(rng, n, 40))) for i, n in enumerate((30, 14, 13, 12, 5))] + [(8, None), (9, "..."), (10, "")]
    texts = []
    for _ in range(60):
        parts = [" ".join(words(rng, rng.randint(0, 30), 60))]
        if rng.random() < 0.7:
            w = rng.choice(items[:5])[1].split()
            k = rng.randint(0, max(0, len(w) - 13))
            parts.append(", ".join(w[k : k + rng.randint(12, 20)]).upper())
        texts.append(" ".join([*parts, " ".join(words(rng, rng.randint(0, 9)))]))
    table = [*enumerate([*texts, "", None, items[0][1] * 3])]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = contaminated(decontaminate.find_contamination(docs(spark, table).repartition(2), bench, block_bytes=block, pass_bytes=whole))
    assert got == brute.contamination(table, items)
    assert all(v[1:] == (0, []) for v in contaminated(decontaminate.find_contamination(docs(spark, table), bench.limit(0))).values())
    assert decontaminate.find_contamination(docs(spark, []), bench).count() == 0


@pytest.mark.parametrize(("block", "whole"), [(10**7, 10**7), (20, 10**7), (20, 20)])
def test_contamination_of_odd_rows(spark, block, whole):
    table = [(None, "a b c"), (None, "x y z"), (5, "a b c"), (5, "x y z w"), (5, "a b c"), (6, None), (7, "d e f g, a B c")]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(("a b c", "d e f g", "d e f g h", "b c x", None))], "item_id long, text string")
    found = decontaminate.find_contamination(docs(spark, table).repartition(2), bench, block_bytes=block, pass_bytes=whole).collect()
    got = [(r.doc_id, r.n_words, r.n_hit, [tuple(s) for s in r.spans], list(r["items"])) for r in found]
    hit = (3, 3, [(0, 3)], ["0"])
    want = [(None, *hit), (None, 3, 0, [], []), (5, *hit), (5, 4, 0, [], []), (5, *hit), (6, 0, 0, [], []), (7, 7, 7, [(0, 7)], ["0", "1"])]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_contamination_of_a_whole_table(spark, sf_dir):
    read = lambda t, k: [(r[k], r.text) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").collect()]
    want = brute.contamination(read("documents", "doc_id"), read("benchmark", "item_id"))
    got = {r.doc_id: r for r in queries.op10_decontaminate(spark, sf_dir).collect()}
    for i, (n, hit, items) in want.items():
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(items), brute.sha(",".join(items)), hit > 0 and 20 * hit >= n)


def test_fm_index_finds_all():
    rng = np.random.default_rng(4)
    runs = [rng.integers(1, 4, n) for n in (40, 7, 1, 25)]
    text = np.concatenate([np.append(r, 0) for r in runs]).astype(np.int64)
    index = decontaminate.FMIndex(text)
    for size in (1, 2, 3, 5):
        patterns = np.unique(rng.integers(1, 5, (30, size)), axis=0)
        ranges, low, high = index.search(patterns.ravel(), np.arange(len(patterns)) * size, size)
        number, places = index.located(low, high)
        which = ranges[number]
        want = [(p, k) for p, x in enumerate(patterns) for k in range(len(text) - size + 1) if (text[k : k + size] == x).all()]
        assert sorted(zip(which.tolist(), places.tolist(), strict=True)) == want


def test_nearest_recall(spark, sf_dir):
    table = from_spark(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    x = np.array(table.embedding.tolist(), float)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    got = from_spark(queries.op6_nearest(spark, sf_dir))
    found = 0
    for q in np.flatnonzero(table.vec_id.astype(int) % 50 == 0):
        score = unit @ unit[q]
        score[q] = -2
        mine = got[got.query_id == table.vec_id[q]].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5]
        found += len(set(mine.vec_id) & set(table.vec_id[np.lexsort((table.vec_id.astype(int), -score))[:5]]))
    assert found >= 0.9 * len(got)


def test_nearest_cases(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=6)], 1) for i in range(1, 300)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 1) for i in range(1000, 1400)]  # one vector for most
    rows += [(2000, None, 1), (2001, [0.0] * 6, 1), (2002, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (2003, [float("nan")] * 6, 1), (2004, [float("inf")] + [1.0] * 5, 1), (2050, [2.0, 4.0, 6.0, 8.0, 10.0, 12.0], 1), (2051, [1.0, 0.0], 1), (None, [1.0] * 6, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    near = nearest.nearest(table, F.col("vec_id") % 50 == 0, range_size=64)
    got = {}
    for r in near.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[1000] == [1001, 1002, 1003, 1004, 1005] and got[1350] == [1000, 1001, 1002, 1003, 1004]
    assert got[2050] == [1000, 1001, 1002, 1003, 1004] and set(got) == {*range(50, 300, 50), *range(1000, 1400, 50), 2050}
    few = nearest.nearest(table.where("vec_id IN (50, 51)"), F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in few] == [(50, 1, 51)]
    # the score is measured, also that of copies; ties across ranges go to the smaller identifier
    x = {r[0]: np.array(r[1], float) for r in rows if r[0] and r[1] and None not in r[1]}
    for r in near.collect():
        q, v = x[r.query_id], x[r.vec_id]
        assert abs(r.score - q @ v / np.linalg.norm(q) / np.linalg.norm(v)) < 1e-12
    assert nearest.nearest(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("groups", [0, 400])
def test_nearest_recall_over_many_ranges(spark, groups, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 64))
    if groups:
        x = 0.1 * x + rng.normal(size=(groups, 64))[np.arange(6000) % groups]
    plans, choose = [], nearest._plan
    monkeypatch.setattr(nearest, "_plan", lambda *a: plans.append(choose(*a)) or plans[-1])
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    unit, found = x / np.linalg.norm(x, axis=1)[:, None], 0
    got = from_spark(nearest.nearest(table, F.col("vec_id") % 60 == 0, range_size=64))  # 94 ranges
    for q in range(0, 6000, 60):
        score = unit @ unit[q]
        score[q] = -2
        found += len(set(got.vec_id[got.query_id == q]) & set(np.argsort(-score)[:5].tolist()))
    assert len(got) == 500 and found >= 0.9 * 500
    ((curves, reach),) = plans
    assert curves * min(2 * reach + 1, 94) <= (40 if groups else 94)  # vectors that have neighbours meet less than half


def test_nearest_of_one_cell(spark):
    """Vectors that no curve tells apart still spread over ranges."""
    rng = np.random.default_rng(5)
    x = np.ones(16) + 1e-6 * rng.normal(size=(2000, 16))
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    assert nearest.nearest(table, F.col("vec_id") % 100 == 0, range_size=50).count() == 100


def test_nearest_ties_across_ranges(spark):
    """Vectors as near as each other, spread over many ranges: the smaller identifier comes first."""
    x = np.eye(40)
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = nearest.nearest(table, F.col("vec_id") % 10 == 0, range_size=2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(q, v) for q in (0, 10, 20, 30) for v in [i for i in range(6) if i != q][:5]]


def test_hilbert_order_steps_by_one():
    side, n = 4, 3
    cells = np.stack(np.meshgrid(*[np.arange(side)] * n, indexing="ij"), -1).reshape(-1, n)
    order = np.argsort(nearest.hilbert_keys(cells, 2))
    assert sorted(nearest.hilbert_keys(cells, 2).tolist()) == list(range(side**n))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def plain_losses(table, good):
    """(doc_id, text) to rows (doc_id, tokens, target loss, background loss), counted with Counter."""
    import math
    from collections import Counter

    seqs = [(i, ["<s>", *(t or "").encode().lower().split(), "</s>"]) for i, t in table]
    uni, bi = (Counter(), Counter()), (Counter(), Counter())
    for i, s in seqs:
        m = 0 if i in good else 1
        uni[m].update(s)
        bi[m].update(zip(s, s[1:], strict=False))
    vocabulary = {w for u in uni for w in u} - {"<s>", "</s>"}
    emitted, out = [sum(u.values()) - u["<s>"] for u in uni], []
    for i, s in seqs:
        own, loss = Counter(zip(s, s[1:], strict=False)), []
        for m in (0, 1):
            total = 0.0
            for a, b in zip(s, s[1:], strict=False):
                mine = own[a, b] if (i in good) == (m == 0) else 0
                one, context = (uni[m][b] + 1) / (emitted[m] + len(vocabulary) + 2), uni[m][a] - mine
                total -= math.log(0.7 * (bi[m][a, b] - mine) / context + 0.3 * one if context > 0 else one)
            loss.append(total / (len(s) - 1))
        out.append((i, len(s) - 1, *loss))
    return out


def same_losses(got, want, good):
    order = lambda r: (r[0] is None, r[0] or 0, *map(lambda x: round(x, 6), r[1:]))
    mine = sorted([(r.doc_id, r.n_tokens, r.loss_target, r.loss_background) for r in got], key=order)
    want = sorted(want, key=order)
    assert [r[:2] for r in mine] == [r[:2] for r in want]
    assert np.allclose([r[2:] for r in mine], [r[2:] for r in want], atol=1e-6)
    assert all(r.target == (r.doc_id in good) and abs(r.difference - (r.loss_target - r.loss_background)) < 1e-9 for r in got)


@pytest.mark.parametrize("block", [5000, 7])
def test_loss_differences(spark, block, monkeypatch):
    monkeypatch.setattr(loss_difference, "BLOCK_DOCS", block)
    rng = random.Random(6)
    table = [(i, " ".join(words(rng, rng.randint(0, 40), 12 if i % 3 else 30)).replace("w1", "W1")) for i in range(60)] + [(60, ""), (61, None), (62, "w1 w1 w1"), (62, "w1 w1 w1"), (None, "w2 w3"), (63, "é w4 É " * 20_000)]
    target = spark.createDataFrame([(i,) for i in range(0, 60, 3)] + [(999,), (None,), (3,)], "doc_id long")
    good = set(range(0, 60, 3))
    same_losses(loss_difference.loss_differences(docs(spark, table), target).collect(), plain_losses(table, good), good)
    assert loss_difference.loss_differences(docs(spark, []), target).count() == 0
    assert loss_difference.loss_differences(docs(spark, [(1, "a b")]), target.limit(0)).count() == 1


def test_loss_differences_of_a_whole_table(spark, sf_dir):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    same_losses(queries.op4_loss_difference(spark, sf_dir).collect(), plain_losses(table, good), good)


def test_packed_numbers_come_back():
    from tidemark.llm import packed

    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 1000):
        x = rng.integers(0, 1 << 62, n, np.uint64) >> rng.integers(0, 60, n).astype(np.uint64)
        assert (packed.numbers(packed.planes(x)) == x).all() and (packed.from_steps(packed.ascending(np.sort(x))) == np.sort(x)).all()
        assert packed.unpress(packed.press(x, b"", b"ab")) == [x.tobytes(), b"", b"ab"]


def test_loss_differences_know_every_word(spark):
    every = (f"v{i}" for i in range(10**6))
    crowd = [w for w, _ in zip((w for w in every if loss_difference.words(w)[0] >> np.uint64(loss_difference.HASH_BITS - 6) == 0), range(1200), strict=False)]  # one of 64 ranges of hashes
    table = [(i, " ".join(crowd[:1100])) for i in range(4)] + [(i, " ".join(crowd[1100:])) for i in range(4, 8)]
    got = {r.doc_id: r for r in loss_difference.loss_differences(docs(spark, table), spark.createDataFrame([(i,) for i in range(4, 8)], "doc_id long")).collect()}
    for i, r in got.items():
        n, other = (100, 1100) if i >= 4 else (1100, 100)
        mine, theirs = (4 * n + 4 + 1202), (4 * other + 4 + 1202)  # of smoothed unigrams: all words, end marks and the vocabulary
        bigram = 0.7 * 3 / 3
        # the other model knows only how a document begins and, of this one's tokens, the end mark
        want = [-(n * np.log(bigram + 0.3 * 5 / mine) + np.log(bigram + 0.3 * 5 / mine)), -(np.log(0.3 / theirs) + (n - 1) * np.log(1 / theirs) + np.log(5 / theirs))]
        both = (r.loss_target, r.loss_background) if i >= 4 else (r.loss_background, r.loss_target)
        assert np.allclose(both, np.array(want) / (n + 1), atol=1e-9)
