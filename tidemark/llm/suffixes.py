"""Exact substring removal: sorted, front-coded suffix runs merged by loser trees that know common prefixes.

A window is a string of ``LENGTH`` bytes. Each window picks an anchor, the leftmost least-hashed
64-byte string in it; equal windows pick theirs at the same place. The windows of one anchor in a row
are a tile, and the tile's text is all that decides them. Only anchors that occur more than once can
have repeated windows, so the others' tiles go no further. Every other tile is a suffix (from the
anchor on) and a reversed prefix (before it): tasks sort and front-code them, exchange these runs, and
the merge gives the common prefixes that decide every window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from numpy.lib.recfunctions import repack_fields
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import ascending, fragments_for, from_steps, numbers, planes, press, range_cuts, unpress

LENGTH, ANCHOR = 200, 64
#: Tiles asked about at once, tiles sorted into one run, and windows of a text that are tiled at once.
BLOCK_TILES, RUN_TILES, SEGMENT = 200_000, 100_000, 1 << 22
_PLACE = 23  # bits of a place within a segment; the rest of the key is hash

_TILE = np.dtype([("anchor", "<u8"), ("start", "<u4"), ("before", "u1"), ("windows", "u1")])
_BYTES = np.random.default_rng(3).integers(0, 1 << 63, 256, np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all ANCHOR-byte strings, by doubling."""
    h, width = _BYTES[data], 1
    while width < ANCHOR:
        h = _mix(h[:-width] * np.uint64(0x9E3779B97F4A7C15) + h[width:])
        width *= 2
    return h


def _sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    have = 1
    out = key
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(key) - width + 1], out[width - have :]) if have < width else out


def tiles(data: bytes) -> np.ndarray:
    """The tiles of a text: hash of the anchor, start of the first window, bytes before the anchor, number of windows."""
    out = []
    span = LENGTH - ANCHOR + 1
    for at in range(0, max(0, len(data) - LENGTH + 1), SEGMENT):
        part = data[at : at + SEGMENT + LENGTH - 1]
        h = _gram_hashes(np.frombuffer(part, np.uint8))
        key = (h >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(h), dtype=np.uint64)
        place = (_sliding_min(key, span) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        count = np.diff(np.append(first, len(place)))
        own = np.zeros(len(first), _TILE)
        own["anchor"], own["start"], own["before"], own["windows"] = h[place[first]], first + at, place[first] - first, count
        out.append(own)
    return np.concatenate(out) if out else np.zeros(0, _TILE)


#: Kinds of rows: anchors of a block, and the tiles that have them.
ANCHORS, TILES = 0, 1


def _ask(held: list[tuple[int, int, np.ndarray]], fragments: int, number: int) -> pd.DataFrame:
    """The distinct anchors of a block by fragment, and whether the block has them more than once; and its tiles, which
    travel with one of the fragments. ``number`` counts the blocks of a task."""
    own = np.concatenate([t for *_, t in held])
    anchors, which, times = np.unique(own["anchor"], return_inverse=True, return_counts=True)
    lengths = np.array([len(t) for *_, t in held], np.int64)
    keys = np.array([h[:2] for h in held], np.int64)
    table = press(keys, planes(lengths), planes(own["start"]), own["before"], own["windows"], planes(which))
    block = xxhash.xxh3_64_intdigest(table, seed=TaskContext.get().partitionId() << 32 | number) >> 1
    rows, cuts = [(block % fragments, block, TILES, table)], range_cuts(anchors, 64, fragments)
    for f in range(fragments):
        part = slice(cuts[f], cuts[f + 1])
        if part.start < part.stop:
            rows.append((f, block, ANCHORS, press(ascending(anchors[part]), times[part] > 1)))
    return pd.DataFrame(rows, columns=["fragment", "block", "kind", "body"])


def _count(pdf: pd.DataFrame) -> pd.DataFrame:
    """Which anchors of a fragment more than one tile has, answered to every block that asked."""
    f = int(pdf.fragment.iloc[0])
    out = [(f, r.block, TILES, r.body) for r in pdf.itertuples() if r.kind == TILES]
    asked = [(r.block, *unpress(r.body)) for r in pdf.itertuples() if r.kind == ANCHORS]
    if asked:
        keys = [from_steps(a) for _, a, _ in asked]
        own, back = np.unique(np.concatenate(keys), return_inverse=True)
        many = np.bincount(back, weights=1 + np.concatenate([np.frombuffer(m, bool) for *_, m in asked]))[back] > 1
        for (block, *_), part in zip(asked, np.split(many, np.cumsum([len(k) for k in keys])[:-1]), strict=True):
            out.append((f, block, ANCHORS, press(np.array([len(part)], np.int64), np.packbits(part))))
    return pd.DataFrame(out, columns=["fragment", "block", "kind", "body"])


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each row of a block its tiles whose anchors others have, too."""
    table = next(b for b, k in zip(pdf.body, pdf.kind, strict=True) if k == TILES)
    keys, lengths, start, before, windows, which = unpress(table)
    keys = np.frombuffer(keys, np.int64).reshape(-1, 2)
    many = [np.zeros(0, bool)]
    for body in pdf[pdf.kind == ANCHORS].sort_values("fragment").body:
        n, bits = unpress(body)
        many.append(np.unpackbits(np.frombuffer(bits, np.uint8), count=int(np.frombuffer(n, np.int64)[0])).astype(bool))
    wanted = np.concatenate(many)[numbers(which).astype(np.int64)]
    start, before, windows = numbers(start), np.frombuffer(before, np.uint8), np.frombuffer(windows, np.uint8)
    cuts = np.concatenate([[0], np.cumsum(numbers(lengths).astype(np.int64))]).tolist()
    out = []
    for i, (key, other) in enumerate(keys.tolist()):
        at = np.flatnonzero(wanted[cuts[i] : cuts[i + 1]]) + cuts[i]
        if len(at):
            out.append((key, other, press(planes(start[at]), before[at], windows[at])))
    return pd.DataFrame(out, columns=["key", "key2", "asked"])


def _sorted(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings, and the prefix that each shares with the one before it."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    shared, last = np.zeros(len(strings), np.int64), b""
    for i, j in enumerate(order):
        shared[i] = common(last, s := strings[j], 0)
        last = s
    return np.array(order, np.int64), shared


def _classes(order: np.ndarray, shared: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number for each string, equal for equal strings, from the prefixes that sorted ones share."""
    own = sizes[order]
    same = np.zeros(len(order), bool)
    same[1:] = (shared[1:] == own[1:]) & (own[1:] == own[:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(~same)
    return out


def _thinned(order: np.ndarray, shared: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the strings, still sorted, with the prefix that each shares with the one now before it."""
    at = np.flatnonzero(keep[order])
    if not len(at):
        return order[at], shared[at]
    less = np.minimum.reduceat(shared[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1]))
    less[0] = 0
    return order[at], less


def front_code(strings: list[bytes]) -> tuple[list[int], np.ndarray, bytes]:
    """The order of the strings, the prefix that each shares with the one before it, and what is left of each, joined."""
    order, shared = _sorted(strings)
    return order.tolist(), shared.astype(np.uint16), b"".join(strings[j][n:] for j, n in zip(order.tolist(), shared.tolist(), strict=True))


def common(x: bytes, y: bytes, at: int) -> int:
    """The length of the common prefix of two strings known to share ``at`` bytes."""
    n = min(len(x), len(y))
    a, b = x[at:n], y[at:n]
    if a == b:
        return n
    return n - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8


class LoserTree:
    """Merges sorted runs. Each waiting string carries the prefix it shares with the last one that came out:
    of two, the one that shares more comes first, and only those that share as much are compared, from there on."""

    def __init__(self, runs: list[Iterator[tuple[bytes, int, int]]]):
        """A run yields (string, prefix shared with the run's string before, label)."""
        self.runs = runs
        k = 1
        while k < len(runs):
            k *= 2
        self.k = k
        leaves = [self._next(i) if i < len(runs) else None for i in range(k)]
        self.losers: list[list | None] = [None] * k
        while len(leaves) > 1:
            half = len(leaves) // 2
            up = []
            for i in range(half):
                win, self.losers[half + i] = self._play(leaves[2 * i], leaves[2 * i + 1])
                up.append(win)
            leaves = up
        self.winner = leaves[0]

    def _next(self, run: int) -> list | None:
        got = next(self.runs[run], None)
        return None if got is None else [got[0], got[1], got[2], run]

    @staticmethod
    def _play(a: list | None, b: list | None) -> tuple[list | None, list | None]:
        if a is None or b is None:
            return (a, b) if b is None else (b, a)
        if a[1] != b[1]:
            return (a, b) if a[1] > b[1] else (b, a)
        n = common(x := a[0], y := b[0], a[1])
        if x[n : n + 1] <= y[n : n + 1]:
            b[1] = n
            return a, b
        a[1] = n
        return b, a

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(label, prefix shared with the string before) of all strings in order."""
        while (won := self.winner) is not None:
            yield won[2], won[1]
            at, now = (won[3] + self.k) >> 1, self._next(won[3])
            while at:
                now, self.losers[at] = self._play(now, self.losers[at])
                at >>= 1
            self.winner = now


def _run(shared: np.ndarray, sizes: np.ndarray, rest: bytes, first: int, order: np.ndarray) -> Iterator[tuple[bytes, int, int]]:
    at, last = 0, b""
    for n, size, j in zip(shared.tolist(), sizes.tolist(), order.tolist(), strict=True):
        last = last[:n] + rest[at : at + size - n]
        at += size - n
        yield last, n, first + j


_ASKED = np.dtype([("anchor", "<u8"), ("key", "<i8"), ("key2", "<i8"), ("start", "<u4"), ("before", "<u2"), ("windows", "<u2"), ("single", "?")])
_SPANS = ["key", "key2", "start", "windows"]
_KNOWN = np.dtype([(n, _ASKED[n]) for n in _SPANS])


def _write_runs(rows: list[tuple], fragments: int) -> pd.DataFrame:
    """Sorted and front-coded runs of (suffix, reversed prefix, tile), one pair of runs for each fragment.

    Of tiles that a run shows to be equal on both sides the first goes on, marked as a repeat; the others are
    known repeats, which are only passed on.
    """
    about = np.array([(*r[2], True) for r in rows], _ASKED)
    both = []
    for side in (0, 1):
        strings = [r[side] for r in rows]
        order, shared = _sorted(strings)
        both.append((strings, order, shared, _classes(order, shared, np.array([len(x) for x in strings]))))
    _, first, back, times = np.unique(both[0][3] * (len(rows) + 1) + both[1][3], return_index=True, return_inverse=True, return_counts=True)
    keep, about["single"] = np.zeros(len(rows), bool), times[back] == 1
    keep[first] = True
    passed = np.unique(repack_fields(about[~about["single"]][_SPANS]))
    of = ((about["anchor"] >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)
    coded = [(strings, *_thinned(order, shared, keep)) for strings, order, shared, _ in both]
    out = []
    for f in np.unique(of).tolist():
        mine = keep & (of == f)
        labels = np.cumsum(mine) - 1
        parts = [about[mine]]
        for strings, order, shared in coded:
            order, shared = _thinned(order, shared, mine)
            sizes = np.array([len(strings[j]) for j in order.tolist()], np.int64)
            parts += [planes(labels[order]), planes(shared), planes(sizes), b"".join(strings[j][n:] for j, n in zip(order.tolist(), shared.tolist(), strict=True))]
        out.append((int(f), press(*parts, passed)))
        passed = passed[:0]
    return pd.DataFrame(out, columns=["fragment", "body"])


def _merge_fragment(pdf: pd.DataFrame) -> pd.DataFrame:
    """The repeated windows of the tiles of a fragment, from the merged runs of both sides."""
    about, runs, first, found = [], ([], []), 0, []
    for body in pdf.body:
        tiles_, *coded, passed = unpress(body)
        about.append(np.frombuffer(tiles_, _ASKED))
        found.append(_spans(np.frombuffer(passed, _KNOWN)))
        for side in (0, 1):
            order, shared, sizes, rest = coded[4 * side : 4 * side + 4]
            runs[side].append(_run(numbers(shared), numbers(sizes), rest, first, numbers(order)))
        first += len(about[-1])
    own = np.concatenate(about)
    (suffix, right), (prefix, left) = (np.array(list(LoserTree(r)), np.int64).reshape(-1, 2).T for r in runs)
    before, windows = own["before"].astype(np.int64), own["windows"].astype(np.int64)
    classes = _classes(suffix, right, windows + LENGTH - 1 - before) * (len(own) + 1) + _classes(prefix, left, before + 8)
    _, one, back, times = np.unique(classes, return_index=True, return_inverse=True, return_counts=True)
    found.append(_spans(own[(times[back] > 1) & own["single"]]))
    # What is left are tiles of which there is one, beside others with the same anchor.
    keep, open_ = np.zeros(len(own), bool), own["single"] & (times[back] == 1)
    keep[one] = True
    _, anchor, kinds = np.unique(own["anchor"], return_inverse=True, return_counts=True)
    asks = np.bincount(anchor, open_) > 0
    keep &= asks[anchor] & (np.bincount(anchor, keep) > 1)[anchor]
    suffix, right = _thinned(suffix, right, keep)
    prefix, left = _thinned(prefix, left, keep)
    own["single"] = open_
    out: list[tuple] = []
    rank_of = np.empty(len(own), np.int64)
    # Both orders hold an anchor's tiles together: a suffix begins with the anchor, a prefix with its hash.
    bounds = lambda order: np.concatenate([np.flatnonzero(np.diff(anchor[order], prepend=-1)), [len(order)]]).tolist()
    edges = bounds(prefix)
    side = {int(anchor[prefix[b]]): (b, e) for b, e in zip(edges, edges[1:], strict=False)}
    edges = bounds(suffix)
    for b, e in zip(edges, edges[1:], strict=False):
        lo, hi = side[int(anchor[suffix[b]])]
        rank_of[prefix[lo:hi]] = np.arange(hi - lo)
        members = suffix[b:e]
        out += _decide(own[members], right[b:e], rank_of[members], np.maximum(left[lo:hi] - 8, 0))
    found.append(pd.DataFrame(out, columns=_SPANS).astype({"windows": "int32"} | dict.fromkeys(_SPANS[:3], "int64")))
    return pd.concat(found)


def _spans(tiles_: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({n: tiles_[n].astype(np.int32 if n == "windows" else np.int64) for n in _SPANS})


def _decide(tile: np.ndarray, right: np.ndarray, rank: np.ndarray, left: np.ndarray) -> list[tuple]:
    """Windows of the tiles of one anchor, in the order of their suffixes, that another of these tiles has too.

    right[i] and left[i] are the prefixes shared with the entry before in either order; a window with
    r bytes before the anchor is shared by tiles that agree on r bytes there and on LENGTH - r after.
    """
    m, out = len(tile), []
    place = np.argsort(rank)
    for r in range(int(tile["before"].max()) + 1) if m > 12 else ():
        right_id = np.cumsum(right < LENGTH - r)
        left_id = np.empty(m, np.int64)
        left_id[place] = np.cumsum(left < r)
        _, back, times = np.unique(right_id * (m + 1) + left_id, return_inverse=True, return_counts=True)
        hit = (times[back] > 1) & tile["single"] & (tile["before"] >= r) & (tile["before"].astype(np.int64) - tile["windows"] < r)
        out += [(int(t["key"]), int(t["key2"]), int(t["start"]) + int(t["before"]) - r, 1) for t in tile[hit]]
    if m > 12:
        return out
    for x in range(m):
        if not tile["single"][x]:
            continue
        low, high = int(tile["before"][x]) - int(tile["windows"][x]) + 1, int(tile["before"][x])
        for y in range(m):
            if y != x:
                a, b = min(x, y), max(x, y)
                c, d = sorted((int(rank[x]), int(rank[y])))
                n_right, n_left = int(right[a + 1 : b + 1].min()), int(left[c + 1 : d + 1].min())
                lo, hi = max(low, LENGTH - n_right), min(high, n_left)
                if lo <= hi:
                    out.append((int(tile["key"][x]), int(tile["key2"][x]), int(tile["start"][x]) + high - hi, hi - lo + 1))
    return out


def repeated_windows(keyed: DataFrame) -> DataFrame:
    """Texts (key, key2, text) to rows (key, key2, start, windows): windows at start, start + 1, ... that start elsewhere too.

    The two keys name a row; rows of equal keys hold one text.
    """
    fragments = fragments_for(keyed)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n, number = [], 0, 0
        for batch in batches:
            for key, other, text in zip(batch.key, batch.key2, batch.text, strict=True):
                own = tiles((text or "").encode())
                if len(own):
                    held.append((key, other, own))
                if (n := n + len(own)) >= BLOCK_TILES:
                    yield _ask(held, fragments, number)
                    held, n, number = [], 0, number + 1
        if held:
            yield _ask(held, fragments, number)

    rows = "fragment int, block long, kind int, body binary"
    counted = keyed.select("key", "key2", "text").mapInPandas(send, rows).groupBy("fragment").applyInPandas(_count, rows)
    asked = counted.groupBy("block").applyInPandas(_answer, "key long, key2 long, asked binary").groupBy("key", "key2").agg(F.first("asked").alias("asked"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for key, other, text, wanted in zip(batch.key, batch.key2, batch.text, batch.asked, strict=True):
                data = text.encode()
                start, before, windows = unpress(wanted)
                for s, r, n in zip(numbers(start).tolist(), before, windows, strict=True):
                    anchor = digest(data[s + r : s + r + ANCHOR])
                    held.append((data[s + r : s + n + LENGTH - 1], anchor.to_bytes(8, "big") + data[s : s + r][::-1], (anchor, key, other, s, r, n)))
                if len(held) >= RUN_TILES:
                    yield _write_runs(held, fragments)
                    held = []
        if held:
            yield _write_runs(held, fragments)

    runs = keyed.join(asked, ["key", "key2"]).mapInPandas(cut, "fragment int, body binary")
    return runs.groupBy("fragment").applyInPandas(_merge_fragment, "key long, key2 long, start long, windows int")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) less every byte that a repeated LENGTH-byte string covers.

    Texts are UTF-8 bytes; matches stay within a document, may overlap, and are judged on the input.
    Returns doc_id, n_bytes, spans (maximal removed runs of bytes, end exclusive) and kept (the bytes
    that remain, joined). A null text is empty; shorter texts lose nothing; rows that repeat each
    other are documents of their own and so remove each other; a null doc_id stays null; further columns are left
    out; an empty table gives no rows.
    """
    # Rows alike in both columns share their keys, 128 bits of hashes; each of them still counts, and loses the same bytes.
    keys = F.xxhash64("doc_id", "text").alias("key"), F.xxhash64(F.lit(1), "text", "doc_id").alias("key2")
    keyed = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text", *keys)
    cover = repeated_windows(keyed).groupBy("key", "key2").agg(F.collect_set(F.struct("start", "windows")).alias("cover"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, cover in zip(batch.doc_id, batch.text, batch.cover, strict=True):
                data = (text or "").encode()
                gone: list[list[int]] = []
                for s, e in sorted((c["start"], c["start"] + c["windows"] + LENGTH - 1) for c in (cover if cover is not None else ())):
                    if gone and s <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], e)
                    else:
                        gone.append([s, e])
                edges = [0, *(x for g in gone for x in g), len(data)]
                kept = b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                rows.append((None if doc is None else int(doc), len(data), [{"start": s, "end": e} for s, e in gone], kept))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "spans", "kept"], dtype=object).astype({"doc_id": "Int64", "n_bytes": "int64"})

    return keyed.join(cover, ["key", "key2"], "left").mapInPandas(cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
