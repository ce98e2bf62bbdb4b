"""Exact Jaccard join of documents on word n-grams, by vertical partitioning.

The global order of n-grams is their number of documents, then their 64-bit hash. It is cut into fragments:
a document's n-grams are kept in that order, and the partial overlaps of a candidate pair are
counted by fragment and summed. Before, the numbers of documents are counted over ranges of hashes, which get
packed arrays, one row for each block of documents, so no n-gram is a row of its own until a document is known to
be able to link at all. There an n-gram is only the leading bits of its hash: n-grams that share them
count as one, so a number may be too large, which lets more pass than needed, but never too small.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .packed import ascending, fragments_for, from_steps, numbers, planes, press, range_cuts, text_bytes, unpress

SHINGLE, PERCENT = 5, 75
#: N-grams and documents of one block.
BLOCK_GRAMS, BLOCK_DOCS = 600_000, 4000
#: Where the global order is cut: at the first n-gram of so many documents. Numbers above MOST are alike.
CUTS, MOST = (3, 5, 17, 257), 65535
#: Bits of a hash that are counted beyond those that number the bytes of all texts.
SPARE_BITS = 5

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z in lower case."""
    return (text or "").encode().lower().split()


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct n-grams of a whole text as sorted 64-bit hashes; fewer words are one n-gram of their own kind."""
    own = words(text)
    if not own:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
    width = min(size, len(own))
    total = np.full(len(own) - width + 1, np.uint64(width))
    for j in range(width):
        total = _mix(total * _STEP + h[j : len(h) - width + 1 + j])
    return np.unique(total)


def _sets(texts: list[str], size: int) -> tuple[np.ndarray, list[np.ndarray], list[bytes]]:
    """For each text the number of its set; the different sets, and their names."""
    known: dict[str, int] = {}
    place: dict[bytes, int] = {}
    sets: list[np.ndarray] = []
    which = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if (k := known.get(text)) is None:
            grams = shingles(text, size)
            k = known[text] = place.setdefault(xxhash.xxh3_128_digest(grams.tobytes()), len(sets))
            if k == len(sets):
                sets.append(grams)
        which[i] = k
    return which, sets, list(place)


def _send(docs: list[tuple], size: int, fragments: int, bits: int, number: int) -> pd.DataFrame:
    """A block's n-grams by fragment, with their number of documents in it, and the block itself, which travels
    with one of them. ``number`` counts the blocks of a task, so that equal blocks have names of their own."""
    ids, absent = np.array([0 if d is None else d for d, _ in docs], np.int64), np.array([d is None for d, _ in docs], bool)
    texts = [(t or "") for _, t in docs]
    which, sets, _ = _sets(texts, size)
    raw = [t.encode() for t in texts]
    table = press(ids, absent, planes(np.array([len(t) for t in raw], np.int64)), b"".join(raw), level=3)
    block = xxhash.xxh3_64_intdigest(table, seed=TaskContext.get().partitionId() << 32 | number) >> 1
    keys, back = np.unique(np.concatenate(sets) >> np.uint64(64 - bits), return_inverse=True)
    times = np.bincount(which, minlength=len(sets))
    held = np.bincount(back, np.repeat(times, [len(g) for g in sets]), len(keys)).astype(np.int64)
    rows, cuts = [(block % fragments, block, 1, table)], range_cuts(keys, bits, fragments)
    for f in range(fragments):
        own = slice(cuts[f], cuts[f + 1])
        if own.start < own.stop:
            rows.append((f, block, 0, press(ascending(keys[own]), planes(held[own]))))
    return pd.DataFrame(rows, columns=["fragment", "block", "kind", "body"])


def _count_fragment(pdf: pd.DataFrame) -> pd.DataFrame:
    """In how many documents each n-gram of a fragment is, answered to every block that has it."""
    f = int(pdf.fragment.iloc[0])
    out = [(f, r.block, 1, r.body) for r in pdf.itertuples() if r.kind == 1]
    sent = [(r.block, *unpress(r.body)) for r in pdf.itertuples() if r.kind == 0]
    if sent:
        keys = [from_steps(k) for _, k, _ in sent]
        own, back = np.unique(np.concatenate(keys), return_inverse=True)
        held = np.bincount(back, np.concatenate([numbers(h) for *_, h in sent]), len(own)).astype(np.int64)
        held = np.minimum(held, MOST)[back]
        for (block, *_), part in zip(sent, np.split(held, np.cumsum([len(k) for k in keys])[:-1]), strict=True):
            out.append((f, block, 0, press(planes(part))))
    return pd.DataFrame(out, columns=["fragment", "block", "kind", "body"])


def _gather_block(pdf: pd.DataFrame, size: int, bits: int, percent: int) -> pd.DataFrame:
    """The documents of a block. For one document of each set that could link: the n-grams that others
    hold too, in the global order and cut into its fragments, and how many of them are the prefix."""
    ids, absent, lengths, raw = unpress(next(b for b, k in zip(pdf.body, pdf.kind, strict=True) if k == 1))
    ids, absent = np.frombuffer(ids, np.int64), np.frombuffer(absent, bool)
    ends = np.concatenate([[0], np.cumsum(numbers(lengths).astype(np.int64))]).tolist()
    which, sets, names = _sets([raw[b:e].decode() for b, e in zip(ends, ends[1:], strict=False)], size)
    sizes = np.array([len(g) for g in sets], np.int64)
    gram, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, back = np.unique(gram >> np.uint64(64 - bits), return_inverse=True)
    counted = [numbers(unpress(b)[0]) for b in pdf[pdf.kind == 0].sort_values("fragment").body]
    df = (np.concatenate(counted) if counted else np.zeros(0, np.uint64))[back].astype(np.int64)
    gram, df, owner = gram[df > 1], df[df > 1], owner[df > 1]
    shared = np.bincount(owner, minlength=len(sets))
    able = (100 * shared >= percent * sizes)[which] & (sizes[which] > 0) & ~absent
    by_id = np.flatnonzero(able)[np.argsort(ids[able], kind="stable")]
    speaks = set(by_id[np.unique(which[by_id], return_index=True)[1]].tolist())  # the smallest doc_id of each set
    order = np.lexsort((gram, df, owner))
    gram, df, cuts = gram[order].view(np.int64), df[order], np.concatenate([[0], np.cumsum(shared)]).tolist()
    rows = []
    for i, k in enumerate(which.tolist()):
        doc, n = (None if absent[i] else int(ids[i])), int(sizes[k])
        if i in speaks:
            own, many = gram[cuts[k] : cuts[k + 1]], df[cuts[k] : cuts[k + 1]]
            prefix = n - -(-percent * n // 100) + 1 - (n - len(own))
            rows.append((doc, n, names[k], len(own), float(many.sum()) / n, prefix, *np.split(own, np.searchsorted(many, CUTS))))
        else:
            rows.append((doc, n, names[k], None, None, None, *[None] * len(PARTS)))
    out = pd.DataFrame(rows, columns=["doc_id", "n", "class", "shared", "weight", "prefix", *PARTS], dtype=object)
    return out.astype({"doc_id": "Int64", "n": "int64", "shared": "Int64", "weight": "Float64", "prefix": "Int64"})


PARTS = [f"part{f}" for f in range(len(CUTS) + 1)]
DOCS = "doc_id long, n long, class binary, shared long, weight double, prefix long, " + ", ".join(f"{p} array<long>" for p in PARTS)


def able_documents(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Every document with its set size and the name of its set; for those that could link to another, one
    of each set in a block, the n-grams that others hold too, in fragments of the global order, and the length of the prefix."""
    total = text_bytes(docs)
    fragments, bits = fragments_for(docs, total), min(64, max(32, total.bit_length() + SPARE_BITS))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, n, number = [], 0, 0
        for batch in batches:
            for doc, text in zip(batch.doc_id, batch.text, strict=True):
                block.append((None if doc is None else int(doc), text))
                n += len(text or "") // 6 + 1
                if n >= BLOCK_GRAMS or len(block) >= BLOCK_DOCS:
                    yield _send(block, size, fragments, bits, number)
                    block, n, number = [], 0, number + 1
        if block:
            yield _send(block, size, fragments, bits, number)

    rows = "fragment int, block long, kind int, body binary"
    sent = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInPandas(send, rows)
    return sent.groupBy("fragment").applyInPandas(_count_fragment, rows).groupBy("block").applyInPandas(lambda pdf: _gather_block(pdf, size, bits, percent), DOCS)


def _meet(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with a fragment of either set, once for each fragment."""
    cut = sets.select("node", "n", F.posexplode(F.array(*PARTS)).alias("fragment", "segment"))  # empty ones as well
    left = cut.select(F.col("node").alias("a"), F.col("n").alias("n_a"), "fragment", F.col("segment").alias("x"))
    right = cut.select(F.col("node").alias("b"), F.col("n").alias("n_b"), "fragment", F.col("segment").alias("y"))
    return pairs.join(left, "a").join(right, ["b", "fragment"])


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with their sizes and what they have in common: partial overlaps by fragment, summed per pair."""
    partial = _meet(pairs.select("a", "b"), sets).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("x", "y")).cast("long").alias("part"))
    return partial.groupBy("a", "b").agg(F.sum("part").alias("both"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))


def _reaches(both: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    return (100 + percent) * both >= percent * (n_a + n_b)


_FACTS = ("node", "n", "shared", "component", "hub", "held")


def _across(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Pairs of rows of one key and different components, columns with _a and _b. For each key only the
    rows outside of its largest component look for partners, and only among those near enough in size: rows
    meet by key and class of size, the partner's being the same or one beside, so a key that very many hold is split."""
    sizes = rows.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("k"))
    mixed = sizes.groupBy(*keys).agg(F.max(F.struct("k", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts")
    step = F.lit(1.005 * 100 / percent)  # a little more than two linked sets can differ by
    rows = rows.join(mixed, keys).withColumn("length", F.floor(F.log("n") / F.log(step)).cast("int")).checkpoint()
    keyed = [F.col(k).alias(f"key_{k}") for k in keys]
    a = rows.where("component <> main").select(*keyed, F.col("length").alias("at"), *[F.col(c).alias(f"{c}_a") for c in _FACTS])
    near = F.explode(F.array(*[F.col("length") + d for d in (-1, 0, 1)])).alias("near")
    b = rows.select(*keyed, "main", near, *[F.col(c).alias(f"{c}_b") for c in _FACTS])
    once = (F.col("component_b") == F.col("main")) | (F.col("node_a") < F.col("node_b"))
    same = [a[f"key_{k}"] == b[f"key_{k}"] for k in keys]
    return a.join(b, reduce(and_, same) & (a["at"] == b["near"]) & once & (F.col("component_a") != F.col("component_b"))).select(*[F.col(f"{c}_{x}") for x in "ab" for c in _FACTS])


def _remaining(prefix: DataFrame, sets: DataFrame, known: DataFrame, checked: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes of different components that share a prefix n-gram and may reach the similarity.

    ``checked`` has for each class the hub that it was compared with and what they have in common. Two
    classes of one hub share no more than the smaller of their parts of it, and what they share outside of it,
    which is counted by a join on these n-grams alone.
    """
    facts = sets.select("node", "n", "shared").join(known, "node", "left").join(checked, "node", "left").select("node", "n", "shared", F.coalesce("component", "node").alias("component"), F.coalesce("hub", "node").alias("hub"), F.coalesce("held", "shared").alias("held")).checkpoint()
    least = lambda c: F.least(f"{c}_a", f"{c}_b")
    reach = lambda most: _reaches(most, F.col("n_a"), F.col("n_b"), percent)
    pairs = _across(prefix.select("gram", "node").join(facts, "node"), ["gram"], percent)
    inside = pairs.where(reach(F.when(F.col("hub_a") == F.col("hub_b"), least("held")).otherwise(least("shared"))))
    other = _meet(checked.select(F.col("node").alias("a"), F.col("hub").alias("b")), sets).select(F.col("a").alias("node"), F.explode(F.array_except("x", "y")).alias("gram"))
    outside = _across(other.join(facts, "node"), ["hub", "gram"], percent).groupBy("node_a", "node_b").agg(F.count(F.lit(1)).alias("k"), *[F.first(c).alias(c) for c in ("n_a", "n_b", "held_a", "held_b")])
    outside = outside.where(reach(least("held") + F.col("k")))
    return inside.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).union(outside.select("node_a", "node_b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def join_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Documents (doc_id, text) to doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    Two documents link when 100 * intersection >= percent * union of their sets of n-grams. Equal
    sets become one class. A document that shares too few of its n-grams with any other can't link.
    Of the rest, each class is first compared with its hub, the holder of one of its prefix n-grams whose
    own are the most frequent, and with the one that is best for most of them; what this links becomes a
    component. Then every pair of classes that share a prefix n-gram, are of different components and
    may still link by what they share with their hub is compared. So a large group of near copies
    around one text costs a comparison or two for each of its members, and no link is lost.

    Nulls: a null or empty text, or one of white space, has no n-grams and links with nothing; a null
    doc_id links with nothing and has a null component. Rows that repeat a doc_id are returned each; for links
    they count as one document. Further columns are left out; an empty table gives no rows.
    """
    every = able_documents(docs, size, percent).checkpoint()
    able = every.where("prefix IS NOT NULL")
    sets = able.groupBy("class").agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("n", "shared", "weight", "prefix", *PARTS)]).checkpoint()
    prefix = sets.select("node", "n", "shared", "weight", F.explode(F.slice(F.concat(*PARTS), F.lit(1), F.col("prefix").cast("int"))).alias("gram"))

    held = prefix.groupBy("gram").agg(F.max(F.struct("weight", "node", "n")).alias("best"), F.count(F.lit(1)).alias("k")).where("k > 1")
    near = _reaches(F.least("n", "best.n"), F.col("n"), F.col("best.n"), percent)
    tried = prefix.join(held, "gram").where((F.col("node") != F.col("best.node")) & near)
    tried = tried.groupBy("node", "best.node").agg(F.count(F.lit(1)).alias("k"), F.first("best.weight").alias("w"), F.first("shared").alias("shared")).toDF("a", "b", "k", "w", "shared")
    tried = tried.groupBy("a").agg(F.max(F.struct("w", "b"))["b"].alias("hub"), F.max(F.struct("k", "w", "b"))["b"].alias("often"), F.first("shared").alias("shared")).checkpoint()
    pairs = tried.select("a", F.col("hub").alias("b")).union(tried.select("a", F.col("often").alias("b"))).distinct()
    compared = _overlaps(pairs, sets).checkpoint()
    linked = lambda rows: rows.where(_reaches(F.col("both"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")
    first = linked(compared)
    checked = tried.join(compared.select("a", F.col("b").alias("hub"), "both"), ["a", "hub"]).select(F.col("a").alias("node"), "hub", F.col("both").alias("held"))
    rest = _remaining(prefix, sets, components(first), checked, percent)
    links = first.union(linked(_overlaps(rest, sets))).checkpoint()
    found = components(links)
    named = sets.select("class", "node").join(found, "node", "left").select("class", F.coalesce("component", "node").alias("component_id"))
    return every.select("doc_id", F.col("n").alias("n_shingles"), "class").join(named, "class", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
