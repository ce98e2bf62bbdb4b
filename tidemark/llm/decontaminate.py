"""Benchmark decontamination: an FM-index over each shard of the training text, searched with benchmark windows."""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 13
#: Words of training text in one shard, every how many positions a suffix keeps its place, and bytes of benchmark text whose windows
#: are sent together, and that one pass over the documents searches.
SHARD_WORDS, SAMPLED, BLOCK_BYTES, PASS_BYTES = 250_000, 8, 16_000_000, 64_000_000
#: Windows whose search goes on side by side.
SIDE = 500_000
FOUND = "n_words:long,n_hit:long,spans:array<struct<start:int,end:int>>,items:array<string>"

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all that isn't ASCII, with A-Z in lower case."""
    return (text or "").encode().translate(_WORD_BYTES).split()


class WaveletMatrix:
    """Ranks in a sequence of small integers, for whole arrays of questions at a time."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.levels = []
        for b in reversed(range(bits)):
            bit = (sequence >> b) & 1
            ones = np.zeros(len(sequence) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((b, ones, len(sequence) - int(ones[-1])))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often symbols[i] stands before place ends[i]."""
        low, high = np.zeros(len(ends), np.int64), ends.astype(np.int64)
        for b, ones, zeros in self.levels:
            bit = ((symbols >> b) & 1).astype(bool)
            before, upto = ones[low], ones[high]
            low, high = np.where(bit, zeros + before, low - before), np.where(bit, zeros + upto, high - upto)
        return high - low

    def at(self, places: np.ndarray) -> np.ndarray:
        symbols, places = np.zeros(len(places), np.int64), places.astype(np.int64)
        for _, ones, zeros in self.levels:
            before = ones[places]
            bit = (ones[places + 1] - before).astype(bool)
            symbols = symbols << 1 | bit
            places = np.where(bit, zeros + before, places - before)
        return symbols


class FMIndex:
    """Backward search over runs of symbols of at least 1; each run ends in a 0, which no search crosses."""

    def __init__(self, sequence: np.ndarray, sampled: int = SAMPLED):
        n = len(sequence)
        order = _suffix_order(sequence)
        self.n, self.sampled = n, sampled
        self.tree = WaveletMatrix(sequence[order - 1], max(1, int(sequence.max(initial=0)).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(sequence))])
        begin = np.zeros(n, np.int64)
        begin[1:] = np.where(sequence[:-1] == 0, np.arange(1, n), 0)
        kept = ((np.arange(n) - np.maximum.accumulate(begin)) % sampled == 0)[order]
        self.kept, self.index, self.places = kept, np.cumsum(kept) - 1, order[kept]

    def search(self, sequence: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows of ``size`` symbols that begin at places of a sequence: which occur, and where in the order of suffixes."""
        which, low, high = np.arange(len(starts)), np.zeros(len(starts), np.int64), np.full(len(starts), self.n)
        for j in reversed(range(size)):
            c = sequence[starts[which] + j].astype(np.int64)
            inside = c < len(self.first) - 1
            which, low, high, c = which[inside], low[inside], high[inside], c[inside]
            low, high = self.first[c] + self.tree.rank(c, low), self.first[c] + self.tree.rank(c, high)
            alive = low < high
            which, low, high = which[alive], low[alive], high[alive]
            if not len(which):
                break
        return which, low, high

    def located(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the suffixes of each range, with the number of the range."""
        sizes = high - low
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), sizes) + np.arange(sizes.sum())
        return np.repeat(np.arange(len(low)), sizes), self._locate(rows)

    def _locate(self, rows: np.ndarray) -> np.ndarray:
        """Steps back from each suffix to one that keeps its place; a run's first always does."""
        out, left, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        while len(left):
            there = self.kept[rows]
            out[left[there]] = self.places[self.index[rows[there]]] + steps
            left, rows, steps = left[~there], rows[~there], steps + 1
            c = self.tree.at(rows)
            rows = self.first[c] + self.tree.rank(c, rows)
        return out


def _suffix_order(sequence: np.ndarray) -> np.ndarray:
    """The suffixes in order, by doubling; every 0 is a symbol of its own, so runs end all comparisons."""
    n, ends = len(sequence), sequence == 0
    rank = sequence.astype(np.int64) + int(ends.sum())
    rank[ends] = np.arange(int(ends.sum()))
    step = 1
    while True:
        following = np.zeros(n, np.int64)
        following[: n - step] = rank[step:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + following
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.concatenate([[False], key[order[1:]] != key[order[:-1]]]))
        rank[order] = new
        if not n or new[-1] == n - 1:
            return order
        step *= 2


class Windows:
    """A block of benchmark items as one sequence of word numbers, and where windows of each size begin, with their item: some twelve bytes a word."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str] = []
        numbers, begins = array("i"), defaultdict(list)
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if ids:
                begins[min(len(ids), window)].append((len(numbers), max(1, len(ids) - window + 1), len(self.names)))
                self.names.append(item)
                numbers.extend(ids)
        self.sequence = np.array(numbers, np.int32)
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size, own in sorted(begins.items()):
            starts = np.concatenate([np.arange(b, b + n, dtype=np.int32) for b, n, _ in own])
            self.by_size[size] = starts, np.repeat(np.array([i for *_, i in own], np.int32), [n for _, n, _ in own])


def _find(index: FMIndex, windows: Windows, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Occurrences of the windows of each size: their size, the range that each belongs to, its place, and the (range, item) pairs.

    Equal windows have equal ranges, so each is located once.
    """
    for size, (starts, owner) in windows.by_size.items():
        found = [index.search(windows.sequence, starts[i : i + SIDE], size) for i in range(0, len(starts), SIDE)]
        which = np.concatenate([w + i * SIDE for i, (w, *_) in enumerate(found)])
        low, high = (np.concatenate([f[k] for f in found]) for k in (1, 2))
        if not len(which):
            continue
        ranges, of = np.unique(low * (index.n + 1) + high, return_inverse=True)
        number, places = index.located(ranges // (index.n + 1), ranges % (index.n + 1))
        yield size, number, at[places], np.unique(np.stack([of, owner[which]], 1), axis=0)


def scan_shard(texts: list[list[bytes]], earlier: list[tuple], blocks: list[Windows]) -> list[dict]:
    """What is found in each document of a shard. For each block an FM-index is built over the runs of its words
    that are long enough to hold a window, since no window has another word.

    ``earlier`` has the spans and items that windows of other passes gave each document; they count on.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])  # a 0 after each document
    items: list[set[str]] = [set(own) for _, own in earlier]
    mark = np.zeros(int(bounds[-1]) + 2, np.int64)
    for d, (own, _) in enumerate(earlier):
        for s in own:
            mark[bounds[d] + s["start"]] += 1
            mark[bounds[d] + s["end"]] -= 1
    for windows in blocks:
        whole = np.zeros(int(bounds[-1]) + 1, np.int64)
        flat = np.fromiter(map(windows.vocabulary.get, chain.from_iterable(texts), repeat(0)), np.int64, int(sizes.sum()))
        whole[np.arange(len(flat)) + np.repeat(np.arange(len(texts)), sizes)] = flat
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (whole > 0).astype(np.int8), [0]])))
        begin, end = edges[::2], edges[1::2]
        long = end - begin >= min(windows.by_size, default=1)
        begin, length = begin[long], (end - begin)[long] + 1
        if not len(begin) or not windows.by_size:
            continue
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        for size, number, places, owners in _find(FMIndex(whole[at]), windows, at):
            np.add.at(mark, places, 1)
            np.add.at(mark, places + size, -1)
            cut = np.searchsorted(owners[:, 0], np.arange(owners[-1, 0] + 2))
            doc = np.searchsorted(bounds, places, "right") - 1
            for d, r in np.unique(np.stack([doc, number], 1), axis=0).tolist():
                items[d].update(windows.names[i] for i in owners[cut[r] : cut[r + 1], 1].tolist())
    hit = np.cumsum(mark) > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    turn = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    spans: list[list[dict]] = [[] for _ in texts]
    for b, e in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
        d = int(np.searchsorted(bounds, b, "right")) - 1
        spans[d].append({"start": b - int(bounds[d]), "end": e - int(bounds[d])})
    n_hit = total[bounds[1:] - 1] - total[bounds[:-1]]
    return [{"n_words": n, "n_hit": h, "spans": s, "items": sorted(i)} for n, h, s, i in zip(sizes.tolist(), n_hit.tolist(), spans, items, strict=True)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: bool = False, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Where documents (doc_id, text) hold windows of benchmark items (item_id, text).

    Returns a row for each row of ``docs``: doc_id, n_words, n_hit (words inside an occurrence of a window),
    spans (maximal runs of such words, as word numbers, end exclusive: what a removal would take) and items. With ``keep``
    it is ``row``, all columns of the document as they came, and ``found``, the columns named here, so that a filter needs no join.
    The size of the benchmark is read first. Its windows are sent in blocks of about ``block_bytes`` of text, which the driver makes one after
    another, and a pass over the documents searches as many blocks as ``pass_bytes`` hold. Only a benchmark beyond that takes several passes: each adds
    to the rows of the one before, which lie in the checkpoint folder. The result is the same for any number of blocks and passes.

    Null and empty texts have no words; items without words have no windows; repeated items count
    once; a null item_id is the text ``null``; rows with a null or repeated doc_id are each judged by their own
    text. Further columns are left out unless ``keep`` asks for them; an empty benchmark leaves every n_hit at 0; an empty table gives no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    rows = docs.select(F.struct(*docs.columns if keep else ("doc_id", "text")).alias("row"), F.lit(None).cast(f"struct<{FOUND}>").alias("found"))
    together = max(1, pass_bytes // block_bytes)
    for first in range(0, blocks, together):
        sent = [spark.sparkContext.broadcast(Windows([(r.item_id, r.text) for r in numbered.where(F.col("block") == block).collect()], window)) for block in range(first, min(first + together, blocks))]
        rows = rows.mapInArrow(_pass(sent), rows.schema)
        if first + together < blocks:
            rows = rows.checkpoint()
            for s in sent:
                s.unpersist()
    return rows if keep else rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), "found.*")


def _pass(sent):
    """A pass over documents with some blocks of windows; each row goes on as it came, with what is found so far."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Array] = []
        texts: list[list[bytes]] = []
        earlier: list[tuple] = []
        n = 0

        def shard() -> pa.RecordBatch:
            found = pa.array(scan_shard(texts, earlier, [s.value for s in sent]), kind)
            return pa.record_batch([pa.concat_arrays(kept), found], ["row", "found"])

        for batch in batches:
            row, kind, begin = batch.column(0), batch.column(1).type, 0
            for i, (text, before) in enumerate(zip(row.field("text").to_pylist(), batch.column(1).to_pylist(), strict=True)):
                texts.append(words(text))
                earlier.append((before["spans"], before["items"]) if before else ((), ()))
                if (n := n + len(texts[-1])) >= SHARD_WORDS:
                    kept.append(row.slice(begin, i + 1 - begin))
                    yield shard()
                    kept, texts, earlier, n, begin = [], [], [], 0, i + 1
            kept.append(row.slice(begin))
        if texts:
            yield shard()

    return scan
