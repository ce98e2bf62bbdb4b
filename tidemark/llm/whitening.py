"""Embedding whitening: means and scatter by Chan's pairwise merging, eigenvectors on the driver, and a pass that verifies them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vectors import matrix, reduce_partitions

LARGEST = 2**63 - 1
#: Eigenvalues below so much of the largest count as zero: what doubles leave of a rank that isn't there.
RANK = 1e-12


def shifted(vectors: np.ndarray, scale: int, shift: int) -> np.ndarray:
    return np.floor(vectors * scale).astype(np.int64) + shift


def column_sums(x: np.ndarray) -> list[int]:
    """Exact sums of longs, however large: of their halves, put together as Python's integers."""
    return [(int(a) << 32) + int(b) for a, b in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), strict=True)]


def summary(x: np.ndarray) -> tuple[int, list[int], np.ndarray]:
    """Count, exact sums and centred scatter of the rows: first less the rounded mean, in whole numbers, then less what is left."""
    n, sums = len(x), column_sums(x)
    y = (x - np.array([round(s / n) for s in sums], np.int64)).astype(np.float64)
    y -= y.mean(axis=0)
    return n, sums, y.T @ y


def merge(a: tuple, b: tuple) -> tuple:
    """Chan's formula; the difference of the means comes from exact sums."""
    (n, s, scatter), (m, t, other) = a, b
    gap = np.array([(q * n - p * m) / (n * m) for p, q in zip(s, t, strict=True)])
    return n + m, [p + q for p, q in zip(s, t, strict=True)], scatter + other + np.outer(gap, gap) * (n * m / (n + m))


def merge_doubles(a: tuple, b: tuple) -> tuple:
    """The same formula for rows of doubles: (count, mean, centred scatter)."""
    (n, mean, scatter), (m, other_mean, other) = a, b
    gap = other_mean - mean
    return n + m, mean + gap * (m / (n + m)), scatter + other + np.outer(gap, gap) * (n * m / (n + m))


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: as longs where they fit, else as Python's integers."""
    top = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    kind = np.int64 if top < 1 << 61 else object
    return x.astype(kind) * n - np.array(sums, kind)


def deviations(apart: np.ndarray) -> list[int | None]:
    """Sums of squares of rows of whole numbers, exactly; null where no long holds one."""
    top = max((abs(int(apart.max())), abs(int(apart.min())))) if apart.size else 0
    if apart.dtype == np.int64 and top * top * apart.shape[1] <= LARGEST:
        return (apart * apart).sum(axis=1).tolist()
    return [s if (s := sum(v * v for v in row)) <= LARGEST else None for row in apart.tolist()]


def _rows(batches: Iterator[pa.RecordBatch], size: int, scale: int, shift: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Keys and integer vectors of those rows that take part."""
    for batch in batches:
        rows, vectors = matrix(batch.column(1), size)
        inside = (np.abs(vectors) * scale < 2.0**61).all(axis=1)  # else no long holds the integer
        rows, vectors = rows[inside], vectors[inside]
        if len(rows):
            yield batch.column(0).take(pa.array(rows)), shifted(vectors, scale, shift)


def common_size(embeddings: DataFrame, vector: str) -> int:
    """The most frequent number of components, the larger of equally frequent ones; 0 where there is no vector."""
    top = embeddings.where(F.size(vector) > 0).groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return top["size"] if top else 0


def whiten(embeddings: DataFrame, components: int = 32, scale: int = 64, shift: int = 1_000_000, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Whitens integer vectors x = floor(scale * c) + shift by the unit eigenvectors of their covariance V (divisor n).

    A first pass sums up each partition as count, exact sums and centred scatter, merged pairwise in a tree of tasks;
    the driver, which sees one matrix, takes its eigenvectors; a second pass merges the covariance of the whitened rows in the same
    way and holds it against the identity; the result is a third.

    Returns for each vector and component, numbered from 1 by falling eigenvalue e: key, component, n, deviation (sum of
    (n * x - S)^2, exact), whitened ((x - S/n) on the component over sqrt(e)), explained (e / trace V) and identity_error.

    Null vectors and those with null or non-finite entries are left out, as are those whose integers no long holds and
    those of another size than the most frequent one. Directions without variance (e at most RANK of the largest) have no
    whitened value and aren't returned, so equal vectors alone, a single one or an empty table give no rows. Null and repeated keys
    are rows like all others; a deviation that no long holds is null; further columns are left out.
    """
    rows = embeddings.select(key, vector)
    kind = rows.schema[key].dataType
    size = common_size(rows, vector)
    found = reduce_partitions(rows, _summaries(size, scale, shift), merge) if size else None
    basis = np.zeros((size, 0))
    if found:
        n, sums, scatter = found
        values, vectors = np.linalg.eigh(scatter / n)
        order = np.argsort(values)[::-1][:components]
        order = order[values[order] > RANK * max(values.max(), 0)]
        e, basis = values[order], vectors[:, order]
        basis = basis * np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(len(order))])
    if not basis.shape[1]:
        fields = [T.StructField(key, kind), *[T.StructField(c, t) for c, t in (("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), *((c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")))]]
        return embeddings.sparkSession.createDataFrame([], T.StructType(fields))
    projection = basis / np.sqrt(e)
    _, _, apart = reduce_partitions(rows, _whitened_scatter(size, scale, shift, n, sums, projection), merge_doubles)
    error = float(np.abs(apart / n - np.eye(len(e))).max())
    told = rows.mapInArrow(_project(size, scale, shift, n, sums, projection, key), T.StructType([T.StructField(key, kind), T.StructField("deviation", T.LongType()), T.StructField("_w", T.ArrayType(T.DoubleType()))]))
    share = F.array(*[F.lit(float(v)) for v in e / np.trace(scatter / n)])
    number = lambda c: F.col(c) + 1
    told = told.select(key, "deviation", F.posexplode("_w").alias("_p", "whitened"))
    columns: list[Column] = [F.col(key), number("_p").alias("component"), F.lit(n).cast("long").alias("n"), F.col("deviation"), F.col("whitened"), F.element_at(share, number("_p")).alias("explained"), F.lit(error).alias("identity_error")]
    return told.select(*columns)


def _summaries(size: int, scale: int, shift: int):
    def part(batches: Iterator[pa.RecordBatch]):
        total = None
        for _, x in _rows(batches, size, scale, shift):
            total = summary(x) if total is None else merge(total, summary(x))
        return total

    return part


def _whitened_scatter(size: int, scale: int, shift: int, n: int, sums: list[int], projection: np.ndarray):
    def part(batches: Iterator[pa.RecordBatch]):
        total = None
        for _, x in _rows(batches, size, scale, shift):
            w = (centred(x, n, sums) / n).astype(np.float64) @ projection
            mean = w.mean(axis=0)
            own = (len(w), mean, (w - mean).T @ (w - mean))
            total = own if total is None else merge_doubles(total, own)
        return total

    return part


def _project(size: int, scale: int, shift: int, n: int, sums: list[int], projection: np.ndarray, key: str):
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _rows(batches, size, scale, shift):
            apart = centred(x, n, sums)
            w = np.ascontiguousarray((apart / n).astype(np.float64) @ projection)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
            yield pa.record_batch([ids, pa.array(deviations(apart), pa.int64()), lists], [key, "deviation", "_w"])

    return project
