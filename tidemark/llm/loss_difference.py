"""Cross-entropy difference of documents under a target and a background bigram model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packed import ascending, fragments_for, from_steps, numbers, planes, press, range_cuts, unpress

#: Weight of the bigram estimate against the unigram one.
BIGRAM = 0.7
#: Target documents whose identifiers are broadcast; beyond it they are joined.
BROADCAST_TARGETS = 1_000_000
BLOCK_WORDS, BLOCK_DOCS = 2_500_000, 5000

#: Bits of the hash that is a word or a bigram; what begins and ends a document, beside the words.
HASH_BITS = 55
MARKS = np.array([1, 2], np.uint64)
#: Kinds of rows: counts of a block, and its documents.
COUNTS, DOCUMENTS = 0, 1


def words(text: str | None) -> np.ndarray:
    """Hashes of the words of a text: runs of anything but ASCII white space, A-Z in lower case."""
    own = (text or "").encode().lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own)) >> np.uint64(64 - HASH_BITS)


def _flags(docs: DataFrame, target: DataFrame) -> tuple[DataFrame, object]:
    """Documents with a column ``target``; few target identifiers are broadcast, many are joined."""
    ids = target.select(F.col("doc_id").cast("long").alias("target_id")).where("target_id IS NOT NULL").distinct()
    docs = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text")  # text: no null turns it into a float
    n = ids.count()
    if n > BROADCAST_TARGETS:
        return docs.join(ids, docs.doc_id == ids.target_id.cast("string"), "left").select("doc_id", "text", F.col("target_id").isNotNull().alias("target")), None
    known = np.sort(ids.toPandas().target_id.to_numpy(np.int64)) if n else np.zeros(0, np.int64)
    return docs, docs.sparkSession.sparkContext.broadcast(known)


def _read(batches: Iterator[pd.DataFrame], known) -> Iterator[tuple[int | None, bool, np.ndarray]]:
    for b in batches:
        ids = [None if i is None else int(i) for i in b.doc_id]
        if known is None:
            flags = b.target.tolist()
        else:
            there = np.array([0 if i is None else i for i in ids], np.int64)
            at = np.searchsorted(known.value, there)
            flags = [i is not None and p < len(known.value) and known.value[p] == i for i, p in zip(ids, at.tolist(), strict=True)]
        for doc, flag, text in zip(ids, flags, b.text, strict=True):
            yield doc, bool(flag), words(text)


def _grams(names: np.ndarray, stream: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """The bigrams of a block of documents, whose words and marks are ``stream`` as places in ``names``.

    Returns each distinct bigram's hash, ascending, with the places of its words, and of each
    bigram of the stream its place among them.
    """
    inside = np.ones(len(stream) - 1, bool)
    inside[np.cumsum(sizes + 1)[:-1] - 1] = False  # from the end of a document to the next begin
    distinct, back = np.unique(stream[:-1][inside] * len(names) + stream[1:][inside], return_inverse=True)
    before, word = distinct // len(names), distinct % len(names)
    keys = names[before] * np.uint64(0x9E3779B97F4A7C15) + names[word]
    keys = (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    keys = (keys ^ (keys >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    keys = (keys ^ (keys >> np.uint64(31))) >> np.uint64(64 - HASH_BITS)
    order = np.argsort(keys, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return keys[order], before[order], word[order], place[back]


def _two(places: np.ndarray, flags: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each of n places occurs in the target and in the background."""
    return np.bincount(places[flags], minlength=n), np.bincount(places[~flags], minlength=n)


def _by_use(counts: np.ndarray) -> np.ndarray:
    """The order of a block's words by their number in it, so that the frequent ones have small numbers."""
    return np.argsort(-counts.astype(np.int64), kind="stable")


def _send(held: list[tuple], fragments: int, number: int) -> pd.DataFrame:
    """A block's words and bigrams by fragment, with their counts in both models, and its documents, which travel
    with one of them; ``number`` counts the blocks of a task."""
    n = len(held)
    ids, absent = np.array([h[0] or 0 for h in held], np.int64), np.array([h[0] is None for h in held], bool)
    flag, sizes = np.array([h[1] for h in held], bool), np.array([len(h[2]) + 1 for h in held], np.int64)
    names, stream = np.unique(np.concatenate([x for h in held for x in (MARKS[:1], h[2], MARKS[1:])]), return_inverse=True)
    grams, _, _, place = _grams(names, stream, sizes)
    one, two = _two(stream, np.repeat(flag, sizes + 1), len(names)), _two(place, np.repeat(flag, sizes), len(grams))
    every = one[0] + one[1]
    rank = np.empty(len(names), np.int64)
    rank[_by_use(every)] = np.arange(len(names))
    table = press(ids, absent, flag, planes(sizes), planes(every), planes(rank[stream]))
    block = xxhash.xxh3_64_intdigest(table, seed=TaskContext.get().partitionId() << 32 | number) >> 1
    rows = [(block % fragments, block, DOCUMENTS, table)]
    cuts = [range_cuts(x, HASH_BITS, fragments) for x in (names, grams)]
    for f in range(fragments):  # also where nothing is sent: each fragment answers with its totals
        parts = []
        for keys, counts, cut in ((names, one, cuts[0]), (grams, two, cuts[1])):
            own = slice(cut[f], cut[f + 1])
            parts += [ascending(keys[own]), planes(counts[0][own]), planes(counts[1][own])]
        rows.append((f, block, COUNTS, press(*parts)))
    return pd.DataFrame(rows, columns=["fragment", "block", "kind", "body"])


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums the counts of a fragment's words and bigrams over all blocks and returns to each block those of its own."""
    f = int(pdf.fragment.iloc[0])
    out = [(f, r.block, DOCUMENTS, r.body) for r in pdf.itertuples() if r.kind == DOCUMENTS]
    blocks = [r.block for r in pdf.itertuples() if r.kind == COUNTS]
    bodies = [unpress(r.body) for r in pdf.itertuples() if r.kind == COUNTS]
    answers: list[list[bytes]] = [[b[0]] for b in bodies]  # the words themselves go back, too
    totals = np.zeros(3, np.int64)
    for kind in (0, 1):
        if not bodies:
            break
        keys = [from_steps(b[3 * kind]) for b in bodies]
        own, back = np.unique(np.concatenate(keys), return_inverse=True)
        ends = np.cumsum([len(k) for k in keys])[:-1]
        for m in (1, 2):
            every = np.concatenate([numbers(b[3 * kind + m]) for b in bodies]).astype(np.int64)
            both = np.bincount(back, weights=every, minlength=len(own)).astype(np.int64)
            for answer, part in zip(answers, np.split(both[back], ends), strict=True):
                answer.append(planes(part))
            if kind == 0:  # distinct words and, for both models, what is ever predicted: all but the begin mark
                totals[0], totals[m] = len(own), both[own != MARKS[0]].sum()
    out += [(f, block, COUNTS, press(totals, *answer)) for block, answer in zip(blocks, answers, strict=True)]
    return pd.DataFrame(out, columns=["fragment", "block", "kind", "body"])


def _gather(pdf: pd.DataFrame) -> pd.DataFrame:
    """The losses of a block's documents, from the counts of its words and bigrams in all documents."""
    table = next(b for b, k in zip(pdf.body, pdf.kind, strict=True) if k == DOCUMENTS)
    ids, absent, flag, sizes, every, stream = unpress(table)
    ids, absent, flag, sizes = np.frombuffer(ids, np.int64), np.frombuffer(absent, bool), np.frombuffer(flag, bool), numbers(sizes).astype(np.int64)
    n, totals = len(ids), np.zeros(3, np.int64)
    names, counts = [], ([], [], [], [])
    for body in pdf[pdf.kind == COUNTS].sort_values("fragment").body:
        more, own, *four = unpress(body)
        totals += np.frombuffer(more, np.int64)
        names.append(from_steps(own))
        for all_, part in zip(counts, four, strict=True):
            all_.append(numbers(part))
    counts = [np.concatenate(c).astype(np.float64) for c in counts]
    unigrams, bigrams = counts[:2], counts[2:]
    stream = _by_use(numbers(every))[numbers(stream).astype(np.int64)]
    grams, before, word, place = _grams(np.concatenate(names), stream, sizes)
    mine, own = np.unique(np.repeat(np.arange(n), sizes) * len(grams) + place, return_counts=True)
    owner, gram = mine // len(grams), mine % len(grams)
    both = []
    for m in (0, 1):
        taken = np.where(flag[owner] == (m == 0), own, 0)
        unigram = (unigrams[m][word[gram]] + 1) / (totals[1 + m] + totals[0])
        context = unigrams[m][before[gram]] - taken
        seen = np.where(context > 0, BIGRAM, 0.0)
        loss = -np.log(seen * (bigrams[m][gram] - taken) / np.maximum(context, 1) + (1 - seen) * unigram)
        both.append(np.bincount(owner, weights=loss * own, minlength=n) / sizes)
    doc = pd.array(ids, "Int64")
    doc[absent] = pd.NA
    return pd.DataFrame({"doc_id": doc, "target": flag, "n_tokens": sizes, "loss_target": both[0], "loss_background": both[1], "difference": both[0] - both[1]})


def loss_differences(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Scores documents (doc_id, text) by target loss less background loss per token; lower is nearer to the target.

    ``target`` has the doc_id of the documents that train the target model; all others train the
    background model. Both are bigram models interpolated with unigrams, over the vocabulary of all documents
    and with one smoothing, from the counts of all documents. A document's own bigrams are taken out of the counts
    that score it. Counts are made by hash fragment: a fragment gets packed arrays of the distinct words and
    bigrams of every block of documents, and returns to each block the counts of its own. Words and bigrams are
    hashes of HASH_BITS bits; their number of fragments follows the size of the texts.

    Returns doc_id, target, n_tokens (words and the end mark), loss_target, loss_background and
    difference, all per token. Null and empty texts are the end mark alone; a null doc_id is
    background; a doc_id that repeats is scored for each row; further columns are left out;
    an empty table gives no rows.
    """
    fragments = fragments_for(docs)
    flagged, known = _flags(docs, target)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n, number = [], 0, 0
        for doc, flag, own in _read(batches, known):
            held.append((doc, flag, own))
            if (n := n + len(own)) >= BLOCK_WORDS or len(held) >= BLOCK_DOCS:
                yield _send(held, fragments, number)
                held, n, number = [], 0, number + 1
        if held:
            yield _send(held, fragments, number)

    rows = "fragment int, block long, kind int, body binary"
    added = flagged.mapInPandas(send, rows).groupBy("fragment").applyInPandas(_add, rows)
    return added.groupBy("block").applyInPandas(_gather, "doc_id long, target boolean, n_tokens long, loss_target double, loss_background double, difference double")


def quality_target(labels: DataFrame, quality: Column | None = None) -> DataFrame:
    """The documents whose label says that they are good."""
    return labels.where(F.col("quality") == 1 if quality is None else quality).select("doc_id")
