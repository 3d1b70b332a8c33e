"""Exact k-means over integer vectors, each round filtered through kd-trees that are built once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import checkpointed, python_batches

#: Vectors of a tree, so that a task holds one tree at a time; vectors of a leaf that is split no more.
TREE, LEAF = 8192, 32
#: Largest magnitude of a component. Squared distances of vectors of up to 64 such components are below 2^62.
LARGEST = 1 << 27


class KdTree:
    """Nodes as arrays, parents before children. A node holds the points first to first + count of the tree's order."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        first, count, low, high, sums, left = [], [], [], [], [], []
        todo = [(0, len(points), -1)]
        while todo:
            at, n, parent = todo.pop()
            rows = points[self.order[at : at + n]]
            if parent >= 0:
                left[parent].append(len(first))
            first.append(at), count.append(n), left.append([])
            low.append(rows.min(0)), high.append(rows.max(0)), sums.append(rows.sum(0))
            extent = high[-1] - low[-1]
            if n > leaf and extent.max() > 0:
                half = n // 2
                dealt = np.argpartition(rows[:, int(extent.argmax())], half)
                self.order[at : at + n] = self.order[at : at + n][dealt]
                todo += [(at, half, len(first) - 1), (at + half, n - half, len(first) - 1)]
        self.points = points[self.order]
        self.first, self.count = np.array(first), np.array(count)
        self.low, self.high, self.sums = np.array(low), np.array(high), np.array(sums)
        self.children = np.array([c or [-1, -1] for c in left])

    def assign(self, centroids: np.ndarray) -> np.ndarray:
        """The nearest centroid of each point, in the tree's order, the smaller number of equals; and, as `whole`, of each
        node whose points were assigned at once (-1 for others)."""
        k = len(centroids)
        exact = _exact(self.low, self.high, centroids)
        centers = centroids.astype(exact)
        squares = (centers * centers).sum(1)
        out, self.whole = np.full(len(self.points), -1, np.int32), np.full(len(self.first), -1, np.int32)
        nodes, left = np.array([0]), np.ones((1, k), bool)
        while len(nodes):
            low, high = self.low[nodes].astype(exact), self.high[nodes].astype(exact)
            far = 4 * squares - 4 * ((low + high) @ centers.T)  # |2c - (low + high)|^2 but for what all centroids share
            far[~left] = np.inf if exact is np.float64 else np.iinfo(np.int64).max
            best = far.argmin(1)
            for z in np.unique(best):
                at = np.flatnonzero(best == z)
                # The least that |c - x|^2 - |z - x|^2 is in a node's box, at its corner towards c: above 0, z is nearer everywhere.
                towards = centers - centers[z]
                least = squares - squares[z] - 2 * (high[at] @ np.maximum(towards, 0).T + low[at] @ np.minimum(towards, 0).T)
                left[at] &= ~(least > 0)
            alone = left.sum(1) == 1
            self.whole[nodes[alone]] = left[alone].argmax(1)
            ends = ~alone & (self.children[nodes, 0] < 0)
            self._resolve(nodes[ends], left[ends], centers, squares, out)
            going = ~alone & ~ends
            nodes, left = self.children[nodes[going]].ravel(), np.repeat(left[going], 2, 0)
        for node in np.flatnonzero(self.whole >= 0):
            out[self.first[node] : self.first[node] + self.count[node]] = self.whole[node]
        return out

    def _resolve(self, nodes: np.ndarray, left: np.ndarray, centers: np.ndarray, squares: np.ndarray, out: np.ndarray) -> None:
        """Assigns the points of leaves to the nearest of the centroids left."""
        if not len(nodes):
            return
        n = self.count[nodes]
        rows = np.repeat(self.first[nodes] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        for at in range(0, len(rows), TREE):  # a leaf of equal points may be as large as the tree
            r = rows[at : at + TREE]
            far = squares - 2 * (self.points[r].astype(centers.dtype) @ centers.T)
            far[~np.repeat(left, n, 0)[at : at + TREE]] = np.inf if centers.dtype == np.float64 else np.iinfo(np.int64).max
            out[r] = far.argmin(1)

    def sums_of(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, componentwise sum) of each centroid's points: whole nodes by what they hold, leaves' points one by one."""
        of_point = self.assign(centroids)
        counts, sums = np.bincount(of_point, minlength=len(centroids)), np.zeros(centroids.shape, np.int64)
        whole = np.flatnonzero(self.whole >= 0)
        np.add.at(sums, self.whole[whole], self.sums[whole])
        single = np.ones(len(of_point), bool)
        for node in whole:
            single[self.first[node] : self.first[node] + self.count[node]] = False
        np.add.at(sums, of_point[single], self.points[single].astype(np.int64))
        return counts, sums

    def distances(self, centroids: np.ndarray, of_point: np.ndarray) -> np.ndarray:
        d = self.points.astype(np.int64) - centroids[of_point]
        return (d * d).sum(1)

    _arrays = ("first", "count", "low", "high", "sums", "children", "points")

    def pack(self) -> bytes:
        """The arrays in little-endian bytes, each in the narrowest integers that hold it."""
        out = []
        for name in self._arrays:
            x = getattr(self, name)
            kind = next(t for t in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(t).min <= x.min() and x.max() <= np.iinfo(t).max)
            shape = (*x.shape, 1)[:2]
            out += [np.array([int(kind[2]), *shape], "<i8").tobytes(), np.ascontiguousarray(x, kind).tobytes()]
        return b"".join(out)

    @classmethod
    def unpack(cls, data: bytes) -> KdTree:
        tree, at = cls.__new__(cls), 0
        for name in cls._arrays:
            width, rows, cols = np.frombuffer(data, "<i8", 3, at).tolist()
            x = np.frombuffer(data, f"<i{width}", rows * cols, at + 24).reshape(rows, cols)
            setattr(tree, name, x[:, 0].astype(np.int64) if name in ("first", "count") else x if name == "points" else x.astype(np.int64))
            at += 24 + width * rows * cols
        return tree


def _exact(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> type:
    """The number type in which all distances are exact: doubles, which are faster, where integers up to 2^53 will do."""
    largest = max(int(np.abs(x).max()) for x in (low, high, centroids))
    return np.float64 if 16 * low.shape[1] * (largest + 1) ** 2 < 1 << 53 else np.int64


def _seeds(points: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the least sha256 of `seed:id`, in that order; of equal ids, as of null ones, which come last, by components."""
    named = points.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    return [list(r["x"]) for r in named.orderBy(F.asc_nulls_last("h"), "x").limit(k).select("x").collect()]


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256, dim: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", tree: int = TREE) -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector of `dim` finite components.

    Each component x becomes the integer floor(scale * x), x as a double; all else is exact integer arithmetic. Vectors
    that are null, of another length, or hold a null or a number that isn't finite are left out. Centroids 0, 1, ...
    begin as the k vectors with the least hashes of `seed:id`, fewer if there are fewer vectors. In each of the rounds
    all vectors go to the nearest one (of equally near ones the smaller number), and each centroid with any becomes the
    floor of their mean. distance is the squared one to the final centroid. Rows of one id, and null ids, stay rows of
    their own; an empty table stays empty; other columns are left out. An integer beyond LARGEST raises an error, as
    distances would not be sure to fit a long.

    Each partition's vectors are cut into trees of up to `tree` vectors, which are checkpointed and used by all rounds.
    At a node, centroids that another one beats strictly at all of its box are dropped; a node with one centroid left is
    assigned by its count and sums, and the points of a leaf with several one by one. A round brings k sums of a task to
    the shuffle and k * dim to the driver; k centroids are all that is sent out.
    """
    if dim > 64:
        raise ValueError("distances of more than 64 components are not sure to fit a long")
    spark = vectors.sparkSession
    python_batches(spark, rows=2048, mb=8)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter((F.size("v") == dim) & finite)
    whole = F.transform("v", lambda x: F.when(F.abs(x) * scale < LARGEST, F.floor(x * scale).cast("long")).otherwise(F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}")).cast("long")))
    points = kept.select("id", whole.alias("x"))
    id_type = dict(points.dtypes)["id"]

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], []

        def one() -> pa.RecordBatch:
            nonlocal ids, rows
            made = KdTree(np.concatenate(rows))
            in_order = pa.concat_arrays(ids).take(pa.array(made.order))
            ids, rows = [], []
            return pa.RecordBatch.from_arrays([pa.array([made.pack()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(in_order)], pa.int32()), in_order)], ["tree", "ids"])

        for b in batches:
            for at in range(0, b.num_rows, tree):
                part = b.slice(at, tree)
                if rows and sum(map(len, rows)) + part.num_rows > tree:
                    yield one()
                ids.append(part.column(0)), rows.append(part.column(1).flatten().to_numpy().reshape(-1, dim))
        if rows and sum(map(len, rows)):
            yield one()

    trees = checkpointed(points.mapInArrow(grown, f"tree binary, ids array<{id_type}>"))
    centroids = np.array(_seeds(points, k, seed), np.int64).reshape(-1, dim)

    def summed(now: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, sums = np.zeros(len(now), object), np.zeros(now.shape, object)  # Python's integers: no sum overflows
            for b in batches:
                for data in b.column(0):
                    n, s = KdTree.unpack(data.as_py()).sums_of(now)
                    counts, sums = counts + n, sums + s
            cluster_, dim_ = (x.ravel() for x in np.indices((len(now), dim + 1)))
            every = np.concatenate([sums, counts[:, None]], 1).ravel().tolist()
            yield pa.RecordBatch.from_arrays([pa.array(cluster_, pa.int32()), pa.array(dim_, pa.int32()), pa.array([str(x) for x in every])], ["cluster", "dim", "total"])

        rows = trees.select("tree").mapInArrow(run, "cluster int, dim int, total string")
        return rows.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))

    for _ in range(rounds if len(centroids) else 0):
        total = np.zeros((len(centroids), dim + 1), object)
        for r in summed(centroids).collect():  # k * (dim + 1) numbers, whatever the rows
            total[r["cluster"], r["dim"]] = int(r["total"])
        centroids = np.array([[s // row[-1] for s in row[:-1]] if row[-1] else old for row, old in zip(total.tolist(), centroids.tolist())], np.int64)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, ids in zip(b.column(0), b.column(1)):
                t = KdTree.unpack(data.as_py())
                of_point = t.assign(centroids)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(of_point, pa.int32()), pa.array(t.distances(centroids, of_point), pa.int64())], ["id", "cluster", "distance"])

    assigned = checkpointed(trees.mapInArrow(placed, f"id {id_type}, cluster int, distance long"))
    sizes = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k at most
    rows = [(i, sizes[i], sum(sizes.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist()) if i in sizes]
    per_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = assigned.join(F.broadcast(per_cluster), "cluster")
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
