"""Clusters, whitening and quality rules against plain versions, and odd rows of each."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import from_spark, from_sql, rows
from tests.llm import brute
from tidemark.llm import centroids, quality, queries, whitening
from tidemark.llm.batches import in_own_session, own_session

VECTORS = "vec_id long, embedding array<double>, label int, cluster int, distance string, component int, tree binary"


def table(spark, vectors, parts=3):
    return spark.createDataFrame([(i, v, 1, 2, "x", 3, b"t") for i, v in vectors], VECTORS).repartition(parts)


def plain_clusters(vectors, k=8, rounds=10, size=64):
    """(id, vector) in Python's integers, one distance at a time."""
    kept = [(i, [math.floor(1024 * x) if abs(x) < 1e300 else int(x) * 1024 for x in v]) for i, v in vectors if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, brute.sha(f"3:{r[0]}") if r[0] is not None else "", r[1]))[:k]
    centres = [x for _, x in first]
    away = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    near = lambda x: min(range(len(centres)), key=lambda j: (away(x, centres[j]), j))
    for _ in range(rounds):
        told = [near(x) for _, x in kept]
        own = [[x for (_, x), t in zip(kept, told, strict=True) if t == j] for j in range(len(centres))]
        centres = [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else old for m, old in zip(own, centres, strict=True)]
    told = [(i, near(x), away(x, centres[near(x)])) for i, x in kept]
    fits = lambda n: n if n < 2**63 else None
    inertia = [sum(d for _, t, d in told if t == j) for j in range(len(centres))]
    return [(i, t, fits(d), fits(inertia[t]), fits(sum(inertia)), brute.sha(",".join(map(str, centres[t])))) for i, t, d in told]


def same(got, want):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def test_clusters_of_the_table(spark, sf_dir):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = from_spark(queries.op11_centroids(spark, sf_dir))
    same(got.itertuples(index=False), plain_clusters(vectors))
    assert rows(got) == rows(from_sql(queries.oracle_sql()["op11_centroids"], sf_dir))


@pytest.mark.parametrize("seed", range(3))
def test_cluster_cases(spark, seed, monkeypatch):
    """Groups, copies, ties, odd and huge vectors, in blocks and leaves of several sizes."""
    monkeypatch.setattr(centroids, "BLOCK", (16_384, 50, 7)[seed])
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (6, 64))
    vectors = [(i, (middle[i % 6] + rng.normal(0, 0.02, 64)).tolist()) for i in range(150)]
    vectors += [(i, vectors[0][1]) for i in range(200, 260)] + [(3, vectors[3][1]), (None, vectors[5][1]), (None, (-middle[1]).tolist())]
    vectors += [(300, None), (301, [1.0] * 63), (302, [1.0] * 65), (303, []), (304, [math.nan] + [1.0] * 63), (305, [None] + [1.0] * 63), (306, [math.inf] + [0.0] * 63)]
    if seed:  # beyond what doubles or longs hold exactly
        vectors += [(400, [1e4] * 64), (401, [-3e7] * 64), (402, [1e9] * 64)]
    if seed == 2:
        vectors += [(403, [1e307] * 64), (404, [1e15] * 64)]
    same(centroids.cluster(table(spark, vectors)).collect(), plain_clusters(vectors))


def test_few_vectors(spark):
    one = [(5, [0.5] * 64)] * 3
    same(centroids.cluster(table(spark, one)).collect(), plain_clusters(one))
    assert centroids.cluster(table(spark, [])).collect() == [] and centroids.cluster(table(spark, [(1, None)])).columns == centroids.cluster(table(spark, one)).columns


@pytest.mark.parametrize("leaf", [1, 4, 100])
def test_tree_filters_like_all_distances(leaf):
    """On a grid of few values, so that distances tie and boxes touch."""
    rng = np.random.default_rng(leaf)
    points = rng.integers(-2, 3, (400, 3)).astype(np.int16)
    middle = rng.integers(-2, 3, (5, 3)).astype(object)
    tree = centroids.build_tree(points, leaf)
    counts, sums, inertia, told = centroids.filter_tree(tree, middle, labels=True)
    gap = ((tree.points.astype(int)[:, None] - middle.astype(int)[None]) ** 2).sum(axis=2)
    near = gap.argmin(axis=1)
    assert (told == near).all() and sorted(map(tuple, tree.points.tolist())) == sorted(map(tuple, points.tolist()))
    for j in range(5):
        own = tree.points[near == j].astype(int)
        assert (counts[j], sums[j], inertia[j]) == (len(own), own.sum(axis=0).tolist(), int(gap[near == j, j].sum()))


def test_trees_prune_whole_nodes():
    rng = np.random.default_rng(4)
    middle = rng.normal(0, 1, (8, 64))
    tree = centroids.build_tree(centroids.integers(np.repeat(middle, 200, axis=0) + rng.normal(0, 0.01, (1600, 64)), 1024))
    hidden = centroids.Tree(**(vars(tree) | {"points": np.full_like(tree.points, 30_000)}))  # whoever looks at a vector is wrong
    z = centroids.integers(middle, 1024).astype(object)
    assert centroids.filter_tree(tree, z)[:3] == centroids.filter_tree(hidden, z)[:3]


def plain_whitening(vectors, components=32):
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, x = len(kept), np.array([v for _, v in kept], np.int64)
    sums = x.sum(axis=0)
    y = (x * n - sums) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(e)[::-1][:components]
    return {"n": n, "ids": [i for i, _ in kept], "deviation": ((x * n - sums) ** 2).sum(axis=1), "w": y @ u[:, order] / np.sqrt(e[order]), "explained": e[order] / e.sum()}


def held(got, want):
    """Same rows up to the sign of each component."""
    assert len(got) == want["w"].size and set(got.n) == {want["n"]} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    for c in range(want["w"].shape[1]):
        own = got[got.component == c + 1].sort_values(["vec_id", "whitened"])
        order = sorted(range(want["n"]), key=lambda i: (want["ids"][i], want["w"][i, c]))
        w = want["w"][order, c]
        flipped = sorted(range(want["n"]), key=lambda i: (want["ids"][i], -want["w"][i, c]))
        ours = own.whitened.to_numpy(float)
        assert np.allclose(ours, w, atol=1e-7) or np.allclose(ours, -want["w"][flipped, c], atol=1e-7), c
        assert own.deviation.tolist() == [int(want["deviation"][i]) for i in order] or sorted(own.deviation) == sorted(want["deviation"].tolist())
        assert np.allclose(own.explained.astype(float), want["explained"][c], rtol=1e-9)


def test_whitening_of_the_table(spark, sf_dir):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    held(from_spark(queries.op12_whitening(spark, sf_dir)), plain_whitening(vectors))


def test_whitening_cases(spark):
    rng = np.random.default_rng(3)
    stretch = np.diag([9.0, 5, 3, 2, 1.2, 0.7]) @ np.linalg.qr(rng.normal(0, 1, (6, 6)))[0]
    vectors = [(i, (v + 1e4).tolist()) for i, v in enumerate(rng.normal(0, 1, (300, 6)) @ stretch)]
    vectors += [(i, vectors[7][1]) for i in range(400, 430)] + [(5, vectors[5][1])]
    odd = [(600, None), (601, [math.nan] + [1.0] * 5), (602, [None] + [1.0] * 5), (603, [1.0] * 7), (604, []), (605, [1e300] * 6)]
    held(from_spark(whitening.whiten(table(spark, vectors + odd), components=4)), plain_whitening(vectors, 4))
    held(from_spark(whitening.whiten(table(spark, vectors, 1))), plain_whitening(vectors))
    got = from_spark(whitening.whiten(table(spark, [*vectors, (None, vectors[0][1])])))
    assert got.vec_id.isna().sum() == 6 and got.n[0] == len(vectors) + 1


def test_whitening_without_variance(spark):
    for vectors in ([], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)], [(1, None), (2, [])]):
        assert whitening.whiten(table(spark, vectors)).collect() == []
    flat = [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)]  # one direction only
    got = from_spark(whitening.whiten(table(spark, flat)))
    assert set(got.component) == {1} and abs(got.whitened.astype(float).var(ddof=0) - 1) < 1e-9 and got.explained[0] == pytest.approx(1)


def test_merging_equals_one_pass():
    rng = np.random.default_rng(9)
    x = rng.integers(-10**12, 10**12, (90, 5)) + 10**15
    parts = [whitening.summary(x[a:b]) for a, b in ((0, 1), (1, 50), (50, 90))]
    n, sums, scatter = whitening.merge(whitening.merge(parts[0], parts[1]), parts[2])
    exact = [[(int(a) * 90 - s) for a, s in zip(r, sums, strict=True)] for r in x.tolist()]
    want = [[sum(r[i] * r[j] for r in exact) / 8100 for j in range(5)] for i in range(5)]
    assert n == 90 and sums == [sum(c) for c in zip(*x.tolist(), strict=True)] and np.allclose(scatter, want, rtol=1e-12)
    assert whitening.deviations(whitening.centred(x, n, sums)) == [s if (s := sum(v * v for v in r)) < 2**63 else None for r in exact]


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    threes = list(zip(words, words[1:], words[2:], strict=False))
    inside = {i + k for i, t in enumerate(threes) if threes.count(t) > 1 for k in range(3)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


ODD = [None, "", " \n\t", "a", "a b a b a b a", "a b c\x1cd\x85e", "x\n x\nx\nx \n\n\n", "é ü 𝒳𝒳 #*$%&|<>", "q " * 300, "one two three\r\none two three\r\n"]


def test_counts(spark):
    rng = random.Random(2)
    texts = ODD + [" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    assert [quality.text_counts(t)[:3] + quality.text_counts(t)[4:] for t in texts] == [plain_counts(t) for t in texts]
    many = [b"w%d" % (i % (3 << 19)) for i in range(3 << 20)]  # so many words that three numbers exceed a long
    assert quality.repeated_words(many) == len(many) and quality.repeated_words(many[: 3 << 19]) == 0


def test_quality_of_the_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = from_spark(queries.op13_quality(spark, sf_dir)).set_index("doc_id")
    for i, text in docs:
        n, chars, symbols, dup, repeat = plain_counts(text) if len(text) < 3000 else quality.text_counts(text)[:3] + quality.text_counts(text)[4:]
        failed = n < 50 or 100 * repeat > 50 * n
        assert tuple(got.loc[i][["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]]) == (n, chars, symbols, dup, repeat, failed)
        assert not (failed and got.loc[i].kept)


def test_binomial_tail_is_exact():
    for n, k, p in ((10, 0, 0.3), (50, 2, 0.1), (200, 3, 0.05), (1000, 30, 0.05)):
        want = math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality.binomial_tail(k, n, p) == pytest.approx(want, rel=1e-9)
    assert quality.binomial_tail(0, 0, 0.05) == 1.0 and quality.binomial_tail(5, 100, 0.05) == 1.0


PROSE = "doc_id long, text string, lang string, stratum string, hash long, kept boolean, good boolean, rule string"


def made(rng, n, stratum, start, bad=0.2, leak=0.0):
    """Prose and symbol-ridden texts with their labels; a share ``leak`` of the good ones looks bad."""
    out = []
    for i in range(start, start + n):
        good = rng.random() >= bad
        odd = not good or rng.random() < leak
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(60, 90))]
        text = " ".join(w + ("%%%" if odd and rng.random() < 0.6 else "") for w in words)
        out.append(((i, text, stratum, "x", 1, True, True, "r"), (i, int(good), 0)))
    return out


def test_cutoffs_keep_good_documents(spark):
    """Symbols go where enough labels show it is safe, stay where good documents have them too, or where labels are few."""
    rng = random.Random(5)
    rows_ = made(rng, 600, "en", 0) + made(rng, 600, "mixed", 1000, leak=0.2) + made(rng, 30, "few", 2000) + made(rng, 500, None, 3000)
    docs, labels = spark.createDataFrame([d for d, _ in rows_], PROSE), spark.createDataFrame([x for _, x in rows_], "doc_id long, quality int, toxic int")
    got = from_spark(quality.judge(docs, labels)).set_index("doc_id")
    good = {i: q for _, (i, q, _) in rows_}
    rejected = lambda lo, hi, q: np.mean([not got.loc[i].kept for i in good if lo <= i < hi and good[i] == q])
    assert rejected(0, 1000, 1) <= quality.ALPHA and rejected(0, 1000, 0) > 0.9
    assert rejected(3000, 4000, 1) <= quality.ALPHA and rejected(3000, 4000, 0) > 0.9
    assert rejected(1000, 2000, 1) <= quality.ALPHA and rejected(2000, 3000, 0) == 0 and rejected(2000, 3000, 1) == 0


def test_false_rejections_stay_under_the_bound(spark):
    """Over many strata drawn alike, the certified cutoffs reject more than alpha of new good documents in hardly any."""
    rng = np.random.default_rng(1)
    names, n = [*quality.signals()], 400
    draws = []
    for s in range(30):
        good = rng.random(n) < 0.8
        value = np.where(good, rng.integers(0, 400, n), rng.integers(300, 900, n))
        draws += [(str(s), bool(rng.random() < 0.25), bool(g), int(v), 0, 0, 0, 0) for g, v in zip(good, value, strict=True)]
    labelled = spark.createDataFrame(draws, "stratum string, proposes boolean, good boolean, " + ", ".join(f"{x} int" for x in names))
    got = quality.certified(labelled, 0.1, 0.05, (0.0, 0.05, 0.1, 0.3)).collect()
    beyond = [max(0, 399 - r[f"cut_{names[0]}"]) / 400 for r in got]  # of good documents as they are drawn
    assert got and max(beyond) <= 0.1 + 1e-9
    assert any(b > 0 for b in beyond)


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(None if i == 3 else i % 8, t, None if i % 2 else "en", "s", 1, True, True, "r") for i, t in enumerate(ODD + ODD)], PROSE)
    labels = spark.createDataFrame([(1, None, 0), (2, 1, 0), (2, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels).collect()
    assert len(got) == 2 * len(ODD) and {r.doc_id for r in got} == {None, *range(8)}
    assert all(r.kept == (not r.base_failed) for r in got)
    assert quality.judge(docs.limit(0), labels).collect() == [] and quality.judge(docs, labels.limit(0)).count() == 2 * len(ODD)


def test_settings_stay(spark, sf_dir):
    """No query of this package changes the caller's session."""
    before = dict(spark.conf.getAll)
    for name, query in queries.queries().items():
        query(spark, sf_dir)
        assert dict(spark.conf.getAll) == before, name
    assert int(own_session(spark).conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 1000
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    inside = in_own_session(docs)
    assert inside.schema == docs.schema and inside.count() == docs.count() and inside.where(F.col("doc_id") == 1).count() == 1
    assert "Union" not in inside._jdf.queryExecution().executedPlan().toString()


def test_shuffle_files_of_ended_actions_go(spark, tmp_path):
    """A checkpoint's shuffle files are no longer wanted; rows that are taken again are made again, and the caller's session stays as it is."""
    context = spark.sparkContext._jsc.sc()
    left = lambda: context.env().mapOutputTracker().shuffleStatuses().size()
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own, of_caller = own_session(spark), spark.conf.get(name)
    rows = lambda: own.range(0, 1000, 1, 4).groupBy((F.col("id") % 7).alias("k")).count()
    before = left()
    rows().checkpoint()
    assert left() <= before
    again = rows()
    assert sorted(again.collect()) == sorted(again.collect()) and sorted(again.collect())[0] == (0, 143)
    assert own.conf.get(name) == "true" and spark.conf.get(name) == of_caller
