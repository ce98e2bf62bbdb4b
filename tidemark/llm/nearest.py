"""Approximate nearest neighbours: several shifted Hilbert orders of projected vectors, cut into ranges of keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Orders at most, projected dimensions and bits of each.
CURVES, DIMENSIONS, BITS = 8, 8, 6
#: Vectors (expected) in a range of keys: a sixteenth of the table between these bounds, more where there would be too many ranges.
LEAST, RANGE, MOST_RANGES = 64, 4096, 1 << 14
#: Keys read for each cut, queries (expected) whose true neighbours are measured, and the recall that the windows are chosen for.
PER_CUT, SAMPLE, RECALL = 16, 200, 0.95
#: Bits after a place on a curve that part vectors of one cell.
_PART = 15


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of integer coordinates along the Hilbert curve of its cube."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of each level, from the coarsest
        p = q - 1
        for i in range(n):
            turned = (x[i] & q) > 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(turned, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, q = np.zeros(x.shape[1], np.int64), 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) > 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for b in reversed(range(bits)):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _curves(size: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order a projection onto random orthogonal directions, and a shift of the grid."""
    rng, out = np.random.default_rng([seed, size]), []
    for _ in range(CURVES):
        basis = np.linalg.qr(rng.normal(size=(size, min(size, DIMENSIONS))))[0]
        out.append((basis, rng.uniform(0, 1, basis.shape[1])))
    return out


def _keys(vectors: np.ndarray, seed: int) -> np.ndarray:
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cells = 1 << BITS
    out = []
    for basis, shift in _curves(vectors.shape[1], seed):
        # A coordinate of a unit vector spreads as 1 / sqrt(size); four such spreads either way fill the grid.
        scaled = (unit @ basis) * np.sqrt(vectors.shape[1]) / 8 + 0.5
        out.append(hilbert_keys(np.clip((scaled * (cells - 1) + shift).astype(np.int64), 0, cells - 1), BITS))
    return np.stack(out, 1)


def _usable(vector: str) -> Column:
    v = F.col(vector).cast("array<double>")
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, good) & F.exists(v, lambda x: x != 0)


def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k greatest finite scores of each row, and of what ties with the last."""
    most = min(k, score.shape[1])
    edge = np.partition(score, score.shape[1] - most, axis=1)[:, score.shape[1] - most]
    return np.nonzero((score >= edge[:, None]) & (score > -np.inf))


def _ranges(keys: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(cut, keys[:, c], "right") for c, cut in enumerate(cuts)], 1)


def _cuts(keyed: DataFrame, n: int, ranges: int) -> list[np.ndarray]:
    """Keys that cut each order into ranges of about equal numbers, from about PER_CUT * ranges rows chosen by a hash."""
    chance = min(1.0, PER_CUT * ranges / max(1, n))
    place = F.pmod(F.xxhash64("entry", F.lit(7)), F.lit(1 << 30)) / F.lit(1 << 30)
    keys = np.array([r["keys"] for r in keyed.where(place < chance).select("keys").collect()], np.int64).reshape(-1, CURVES)
    at = (np.arange(1, ranges) * len(keys)) // max(1, ranges)
    return [np.unique(np.sort(keys[:, c])[at]) if len(keys) else np.zeros(0, np.int64) for c in range(CURVES)]


def _plan(keyed: DataFrame, cuts: list[np.ndarray], k: int) -> tuple[int, int]:
    """How many orders to use, and how many ranges on either side in each, so that RECALL of the true neighbours of a
    sample of the queries are met with the least work."""
    asking = keyed.where("asks")
    chance = min(1.0, SAMPLE / max(1, asking.count()))
    place = F.pmod(F.xxhash64("entry", F.lit(5)), F.lit(1 << 30)) / F.lit(1 << 30)
    rows = asking.where(place < chance).select("entry", "v", "keys").limit(4 * SAMPLE).toPandas()
    ranges = max(len(c) for c in cuts) + 1
    if not len(rows) or ranges == 1:
        return 1, ranges - 1
    groups = [(size, part.entry.to_numpy(), np.stack(part.v.to_numpy()), _ranges(np.stack(part["keys"].to_numpy()), cuts)) for size, part in rows.groupby(rows.v.map(len))]
    sent = keyed.sparkSession.sparkContext.broadcast(groups)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes = b.v.map(len)
            for size, names, q, own in sent.value:
                part = b[sizes == size]
                if not len(part):
                    continue
                x = np.stack(part.v.to_numpy())
                score = (q @ x.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)
                score[names[:, None] == part.entry.to_numpy()] = -np.inf
                i, j = _best(score, k)
                away = np.abs(own[i] - _ranges(np.stack(part["keys"].to_numpy()), cuts)[j])
                yield pd.DataFrame({"entry": names[i], "other": part.entry.to_numpy()[j], "score": score[i, j], "away": list(away)})

    found = keyed.select("entry", "v", "keys").mapInPandas(compare, "entry long, other long, score double, away array<long>")
    rank = F.row_number().over(Window.partitionBy("entry").orderBy(F.desc("score"), "other"))
    away = np.array([r.away for r in found.withColumn("n", rank).where(F.col("n") <= k).select("away").collect()], np.int64).reshape(-1, CURVES)
    if not len(away):
        return 1, ranges - 1
    plans = []
    for curves in range(1, CURVES + 1):
        nearest_way = np.sort(away[:, :curves].min(axis=1))
        reach = int(nearest_way[int(np.ceil(RECALL * len(nearest_way))) - 1])
        plans.append((curves * min(2 * reach + 1, ranges), curves, reach))
    _, curves, reach = min(plans)
    return curves, reach


def nearest(vectors: DataFrame, queries: Column, k: int = 5, identifier: str = "vec_id", vector: str = "embedding", range_size: int | None = None, seed: int = 13) -> DataFrame:
    """The k nearest rows by cosine of each row that ``queries`` selects, among all other rows.

    Returns query_id, rank, vec_id and score, nearest first and ties to the smaller identifier; the
    score is the cosine of the original vectors in double precision. Every usable vector is indexed: it has a key on each of
    several shifted Hilbert orders, which are cut into ranges. A query meets its own range and as many
    beside it, in as many of the orders, as a recall of RECALL needs on a sample of queries whose true neighbours
    are found by brute force. Where vectors have no structure that an order could follow, this is
    one order and all of its ranges. Equal vectors are one entry that keeps its k + 1 smallest identifiers, so a vector of
    many copies neither fills a range nor hides its neighbours.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without an
    identifier, take no part; vectors meet only those of their own length. Repeated rows are rows. Further columns
    are left out; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.where(_usable(vector) & F.col(identifier).isNotNull()).select(F.col(identifier).cast("long").alias("id"), F.transform(F.col(vector).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("v"), queries.alias("asks"))
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    members = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    entries = members.where("place = 1").select(F.col("id").alias("entry"), "v")
    asking = rows.where("asks").select("id", "v").join(entries, "v").select("id", "entry")
    owners = members.join(entries, "v").select("entry", F.col("id").alias("member"))

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                sizes = b.v.map(len)
                for _, part in b.groupby(sizes):
                    own = _keys(np.stack(part.v.to_numpy()), seed) << _PART
                    own |= ((part.entry.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _PART)).astype(np.int64)[:, None]
                    yield pd.DataFrame({"entry": part.entry.to_numpy(), "v": part.v.to_numpy(), "asks": part.asks.to_numpy(), "keys": list(own)})

    asked = asking.select("entry").distinct().withColumn("asks", F.lit(True))
    keyed = entries.join(asked, "entry", "left").withColumn("asks", F.coalesce("asks", F.lit(False))).mapInPandas(key, "entry long, v array<double>, asks boolean, keys array<long>").checkpoint()
    n = keyed.count()
    size = range_size or max(LEAST, min(RANGE, n // 16), n // MOST_RANGES)
    cuts = _cuts(keyed, n, max(1, -(-n // size)))
    curves, reach = _plan(keyed, cuts, k)
    sent = spark.sparkContext.broadcast(cuts)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            asks, names = b.asks.to_numpy(bool), b.entry.to_numpy()
            ranges = _ranges(np.stack(b["keys"].to_numpy()), sent.value)
            for c in range(curves):
                own, most = ranges[:, c], len(sent.value[c])
                for shift in range(-min(reach, most), min(reach, most) + 1):
                    to = own + shift
                    there = (to >= 0) & (to <= most) & (asks | (shift == 0))
                    if there.any():
                        yield pd.DataFrame({"curve": np.full(there.sum(), c, np.int32), "range": to[there].astype(np.int32), "entry": names[there], "v": b.v.to_numpy()[there], "asks": asks[there], "held": np.full(there.sum(), shift == 0)})

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pdf.groupby(pdf.v.map(len)):
            held, asks = part[part.held], part[part.asks]
            if not len(held) or not len(asks):
                continue
            x = np.stack(held.v.to_numpy())
            x_norm, names = np.linalg.norm(x, axis=1), held.entry.to_numpy()
            for at in range(0, len(asks), 256):
                some = asks.iloc[at : at + 256]
                q = np.stack(some.v.to_numpy())
                score = (q @ x.T) / np.linalg.norm(q, axis=1)[:, None] / x_norm
                i, j = np.nonzero(some.entry.to_numpy()[:, None] == names)  # a query's own entry has its copies
                out.append(pd.DataFrame({"entry": some.entry.to_numpy()[i], "other": names[j], "score": score[i, j]}))
                score[i, j] = -np.inf
                i, j = _best(score, k)
                out.append(pd.DataFrame({"entry": some.entry.to_numpy()[i], "other": names[j], "score": score[i, j]}))
        return pd.concat(out) if out else pd.DataFrame({"entry": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "score": np.zeros(0)})

    near = keyed.mapInPandas(deal, "curve int, range int, entry long, v array<double>, asks boolean, held boolean").groupBy("curve", "range").applyInPandas(meet, "entry long, other long, score double")
    near = near.groupBy("entry", "other").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("entry").orderBy(F.col("other") != F.col("entry"), F.desc("score"), "other"))
    best = near.withColumn("n", rank).where(F.col("n") <= k + 1).drop("n")  # itself and k others
    found = asking.join(best, "entry").join(owners.toDF("other", "member"), "other").where("member <> id")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "member"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("id").alias("query_id"), "rank", F.col("member").alias("vec_id"), "score")
