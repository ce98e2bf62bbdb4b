"""Centroid clustering: exact rounds of k-means by kd-tree filtering."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packed import press, unpress
from .vectors import matrix, reduce_partitions

#: Vectors of one tree, and of a leaf at most.
BLOCK, LEAF = 16_384, 32
LARGEST = 2**63 - 1


def exact_in_doubles(top: int, d: int) -> bool:
    """Whether sums over d components of products of integers up to ``top`` are exact in doubles, and over a block in longs."""
    return top * top * d < 1 << 47


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) in 16 or 32 bits, or as Python's integers where sums of products would not be exact otherwise."""
    with np.errstate(over="ignore"):
        whole = np.floor(vectors * scale)
    top = np.abs(whole).max(initial=0)
    if not np.isfinite(top):  # the product left the doubles; such numbers are whole
        return np.array([[int(x) * scale if abs(x) > 2**53 else int(w) for x, w in zip(*r, strict=True)] for r in zip(vectors.tolist(), whole.tolist(), strict=True)], object).reshape(vectors.shape)
    if not exact_in_doubles(int(top), vectors.shape[1]):
        return np.array([[int(x) for x in row] for row in whole.tolist()], object).reshape(vectors.shape)
    return whole.astype(np.int16 if top < 1 << 15 else np.int32)


def _size(a: np.ndarray) -> int:
    return max(abs(int(a.max())), abs(int(a.min()))) if a.size else 0


def _wide(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as doubles, or as Python's integers where sums of products of their components would not be exact."""
    kind = np.float64 if exact_in_doubles(max(map(_size, arrays)), arrays[0].shape[1]) else object
    return [a.astype(kind) for a in arrays]


@dataclass
class Tree:
    """A kd-tree over integer vectors. Node i has the vectors start[i] to end[i] and, unless left[i] is -1, the children
    left[i] and left[i] + 1; low and high are its box, sums and squares those of its vectors."""

    points: np.ndarray
    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray
    squares: np.ndarray

    def to_bytes(self, ids: pa.Array) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, (batch := pa.record_batch([ids.take(pa.array(self.order))], ["id"])).schema) as out:
            out.write_batch(batch)
        return press(sink.getvalue().to_pybytes(), pickle.dumps(self, protocol=5))

    @staticmethod
    def from_bytes(body: bytes) -> tuple[pa.Array, Tree]:
        ids, tree = unpress(body)
        return pa.ipc.open_stream(ids).read_next_batch().column(0), pickle.loads(tree)


def build_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """Halves the widest side of each box until a node is small or all of its vectors are equal."""
    order = np.arange(len(points))
    start, end, left, low, high = [0], [len(points)], [], [], []
    i = 0
    while i < len(start):  # children come after their parents
        own = points[order[start[i] : end[i]]]
        low.append(own.min(axis=0)), high.append(own.max(axis=0))
        sides = high[-1].astype(object if points.dtype == object else np.int64) - low[-1]
        widest = int(np.argmax(sides))
        if len(own) <= leaf or sides[widest] == 0 or points.dtype == object:
            left.append(-1)
        else:
            middle = len(own) // 2
            order[start[i] : end[i]] = order[start[i] : end[i]][np.argpartition(own[:, widest], middle)]
            left.append(len(start))
            start += [start[i], start[i] + middle]
            end += [start[i] + middle, end[i]]
        i += 1
    points = points[order]
    wide = points.astype(object if points.dtype == object else np.int64)
    edge = np.concatenate([np.zeros((1, points.shape[1]), wide.dtype), np.cumsum(wide, axis=0)])
    power = np.concatenate([np.zeros(1, wide.dtype), np.cumsum((wide * wide).sum(axis=1))])
    begin, stop = np.array(start), np.array(end)
    return Tree(points, order, begin, stop, np.array(left), np.array(low), np.array(high), edge[stop] - edge[begin], power[stop] - power[begin])


def filter_tree(tree: Tree, centroids: np.ndarray, labels: bool = False) -> tuple[list[int], list[list[int]], list[int], np.ndarray | None]:
    """What each centroid gets of a tree: count, sums and squared distances, and with ``labels`` the centroid of each vector.

    A centroid that another one beats strictly everywhere in a node's box is pruned there. A node with one left is
    assigned whole, by its count and sums; leaves with several are resolved vector by vector, ties by the smaller number.
    """
    k, d = centroids.shape
    z, low, high = _wide(centroids, tree.low, tree.high)
    z2 = (z * z).sum(axis=1)
    step = z[None, :, :] - z[:, None, :]  # from i to j
    up, down = np.maximum(step, 0).reshape(k * k, d).T, np.minimum(step, 0).reshape(k * k, d).T
    behind = z2[None, :] - z2[:, None]
    node, alive = np.zeros(1, np.int64), np.ones((1, k), bool)
    whole, of, leaves, left = [], [], [], []
    while len(node):
        # The vertex of the box that lies farthest from i to j; if j loses to i even there, it loses everywhere.
        reach = (high[node] @ up + low[node] @ down).reshape(-1, k, k)
        beaten = ((behind[None] - 2 * reach > 0) & alive[:, :, None]).any(axis=1)
        alive = alive & ~beaten.astype(bool)
        single = alive.sum(axis=1) == 1
        whole.append(node[single]), of.append(alive[single].argmax(axis=1))
        node, alive = node[~single], alive[~single]
        at_leaf = tree.left[node] < 0
        leaves.append(node[at_leaf]), left.append(alive[at_leaf])
        node, alive = tree.left[node[~at_leaf]], alive[~at_leaf]
        node, alive = np.concatenate([node, node + 1]), np.concatenate([alive, alive])
    whole, of, leaves, left = np.concatenate(whole), np.concatenate(of), np.concatenate(leaves), np.concatenate(left)
    sizes = tree.end[leaves] - tree.start[leaves]
    rows = np.repeat(tree.start[leaves] - np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), sizes) + np.arange(sizes.sum())
    x, c = _wide(tree.points[rows], centroids)
    gap = (c * c).sum(axis=1) - 2 * (x @ c.T)  # squared distances, but for the vector's own square
    gap[~np.repeat(left, sizes, axis=0)] = gap.max(initial=0) + 1 if gap.size else 0
    near = gap.argmin(axis=1).astype(np.int64) if len(gap) else np.zeros(0, np.int64)  # the first of equal ones
    counts, sums, inertia = [], [], []
    held = tree.points.astype(object if tree.points.dtype == object else np.int64)
    for j in range(k):
        nodes, own = whole[of == j], held[rows[near == j]]
        n = int((tree.end[nodes] - tree.start[nodes]).sum()) + len(own)
        total = [int(a) + int(b) for a, b in zip(tree.sums[nodes].sum(axis=0), own.sum(axis=0), strict=True)]
        square = int(tree.squares[nodes].sum()) + int((own * own).sum())
        centre = [int(a) for a in centroids[j]]
        counts.append(n), sums.append(total)
        inertia.append(square - 2 * sum(a * b for a, b in zip(total, centre, strict=True)) + n * sum(a * a for a in centre))
    if not labels:
        return counts, sums, inertia, None
    told = np.zeros(len(tree.points), np.int64)
    told[rows] = near
    for i, j in zip(whole.tolist(), of.tolist(), strict=True):
        told[tree.start[i] : tree.end[i]] = j
    return counts, sums, inertia, told


def forest(embeddings: DataFrame, size: int, scale: int, key: str, vector: str) -> DataFrame:
    """The vectors of every partition as kd-trees of at most BLOCK vectors, packed, one tree to a row, in the checkpoint folder."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, n = [], [], 0

        def tree() -> pa.RecordBatch:
            body = build_tree(integers(np.concatenate(vectors), scale)).to_bytes(pa.concat_arrays(ids))
            return pa.record_batch([pa.array([body], pa.binary())], ["tree"])

        for batch in batches:
            rows, found = matrix(batch.column(1), size)
            own = batch.column(0).take(pa.array(rows))
            for at in range(0, len(rows), BLOCK):  # a batch may hold more than a tree may
                ids.append(own.slice(at, BLOCK)), vectors.append(found[at : at + BLOCK])
                n += len(vectors[-1])
                if n >= BLOCK:
                    yield tree()
                    ids, vectors, n = [], [], 0
        if n:
            yield tree()

    return embeddings.select(key, vector).mapInArrow(plant, "tree binary").checkpoint()


def first_centroids(embeddings: DataFrame, k: int, size: int, scale: int, seed: str, key: str, vector: str) -> list[list[int]]:
    """The k vectors whose ``seed:<key>`` has the smallest sha256, in that order; equal keys by their components, null ones last."""
    fine = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = embeddings.where((F.size(vector) == size) & fine).select(F.col(vector).cast("array<double>").alias("v"), F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256).alias("h"))
    return [[int(x) for x in integers(np.array([r.v]), scale)[0]] for r in rows.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()]


def cluster(embeddings: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3", size: int = 64, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Clusters vectors of ``size`` components, each turned into integer floor(scale * x), by k-means in exact integers.

    Centroids start as :func:`first_centroids`. Each round assigns every vector to its nearest centroid (squared Euclidean
    distance, ties to the smaller number) and moves each centroid to the componentwise floor of its vectors' mean; one
    without vectors stays. The trees are built once and lie in the checkpoint folder; a round sends the centroids to them
    and gets counts and sums back through a tree of tasks.

    Returns for each vector: key, cluster, distance, cluster_inertia and inertia (sums of distance) and centroid_sha256, of
    the last centroids. Null vectors, those of another size and those with null or non-finite components are left out; null
    and repeated keys are vectors like all others; with fewer than k vectors there are so many centroids; an empty
    table gives no rows. Integers of any size count exactly; a distance or sum that no long holds is null. Further columns are left out.
    """
    kind = T.StructType([T.StructField(key, embeddings.schema[key].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    start = first_centroids(embeddings, k, size, scale, seed, key, vector)
    fits = lambda n: n if n <= LARGEST else None
    if not start:
        none = embeddings.sparkSession.createDataFrame([], kind)
        return none.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    centroids = np.array(start, object)
    trees = forest(embeddings, size, scale, key, vector)
    for _ in range(rounds):
        counts, sums, _ = reduce_partitions(trees, _gather(centroids), _merge)
        centroids = np.array([[x // n for x in total] if n else old for n, total, old in zip(counts, sums, centroids.tolist(), strict=True)], object)
    _, _, inertia = reduce_partitions(trees, _gather(centroids), _merge)
    told = trees.mapInArrow(_assign(centroids, key), kind)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values, t: F.element_at(F.array(*[F.lit(v).cast(t) for v in values]), F.col("cluster") + 1)
    return told.select("*", of([*map(fits, inertia)], "long").alias("cluster_inertia"), F.lit(fits(sum(inertia))).cast("long").alias("inertia"), of(names, "string").alias("centroid_sha256"))


def _gather(centroids: np.ndarray):
    """Counts, sums and squared distances of all trees of a partition."""

    def gather(batches: Iterator[pa.RecordBatch]):
        total = None
        for batch in batches:
            for body in batch.column(0):
                own = filter_tree(Tree.from_bytes(body.as_py())[1], centroids)[:3]
                total = own if total is None else _merge(total, own)
        return total

    return gather


def _merge(a: tuple, b: tuple) -> tuple:
    add = lambda x, y: [p + q for p, q in zip(x, y, strict=True)]
    return add(a[0], b[0]), [add(x, y) for x, y in zip(a[1], b[1], strict=True)], add(a[2], b[2])


def _assign(centroids: np.ndarray, key: str):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0):
                ids, tree = Tree.from_bytes(body.as_py())
                told = filter_tree(tree, centroids, labels=True)[3]
                x, c = _wide(tree.points, centroids)
                gap = ((x - c[told]) ** 2).sum(axis=1)
                away = pa.array([int(g) if g <= LARGEST else None for g in gap.tolist()], pa.int64())
                yield pa.record_batch([ids, pa.array(told.astype(np.int32)), away], [key, "cluster", "distance"])

    return assign
