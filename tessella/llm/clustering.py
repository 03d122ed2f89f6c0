"""Operator 11: exact Lloyd rounds in integers, filtered by ball trees.

* A task quantises what it reads and builds a metric tree over every TREE_ROWS vectors: a ball has a pivot (the floor of its mean), a
  radius, a count and an integer sum of its vectors. Trees are built once, written to the shared folder, and read again in every round.
* In a round a ball with two or more centroids left in question drops those that are farther than the nearest one by more than its
  diameter: no vector in it can be nearest to them. If one is left, the whole ball goes to it with its count and sum. Else its children
  are asked, and at a leaf the exact distances decide.
* A task gives one row for each centroid and component; Spark adds them up. The driver sees k x dims sums a round.

Only vectors with ``dims`` components, none null, NaN or infinite, are kept, with every component floor(scale * x). Components beyond
LARGEST in size cannot be squared and added up in a long: such vectors are left out like the infinite ones.

Edge cases: null arrays, arrays of another length and arrays with nulls are left out; equal vectors make a ball of radius 0, which is
one leaf however many they are; a vec_id may be null (it is never a starting centroid unless there are too few others) or repeat; of
rows with one vec_id the smaller vector starts; fewer vectors than k give as many centroids; an empty table gives an empty result;
columns with other names are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, pick

K, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64, 1
#: Vectors of a tree, and of a leaf unless all its vectors are equal.
TREE_ROWS, LEAF_ROWS = 1 << 14, 48
#: Largest size of a component after scaling: squared distances of 64 of them stay below 2 ** 63.
LARGEST = 1 << 27
#: Up to this size of components a squared distance is exact in 64-bit floating point.
EXACT_IN_FLOAT = 1 << 22

_TREE = "n int, dims int, ids binary, no_id binary, points binary, begin binary, end binary, left binary, radius binary, pivot binary, total binary"


# -- vectors -------------------------------------------------------------------------------------------------------------
def quantised(lists: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are kept, and their integer components (rows x dims)."""
    sized = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(lists), dims), False))
    rows = np.flatnonzero(sized)
    flat = pc.list_flatten(lists.take(pa.array(rows)))
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), dims)  # nulls become NaN
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.floor(scale * x)
        good = np.all(np.abs(whole) <= LARGEST, axis=1)  # false for NaN
    return rows[good], whole[good].astype(np.int64)


def squared(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact squared distances (points x others) of integer vectors."""
    if max(np.abs(points).max(initial=0), np.abs(others).max(initial=0)) <= EXACT_IN_FLOAT:
        p, o = points.astype(np.float64), others.astype(np.float64)
        return ((p * p).sum(axis=1)[:, None] + (o * o).sum(axis=1) - 2.0 * (p @ o.T)).astype(np.int64)
    out = np.empty((len(points), len(others)), np.int64)
    for k, o in enumerate(others):
        gap = points - o
        out[:, k] = np.einsum("ij,ij->i", gap, gap)
    return out


# -- trees ---------------------------------------------------------------------------------------------------------------
@dataclass
class BallTree:
    """Balls by number, the root first. Ball i has the rows begin[i] to end[i] of points; its children are left[i] and left[i] + 1."""

    points: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    left: np.ndarray
    radius: np.ndarray
    pivot: np.ndarray
    total: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray) -> tuple[BallTree, np.ndarray]:
        """The tree, and the order that it brings the points into."""
        order, span, left, radius, pivot, total = np.arange(len(points)), [(0, len(points))], [], [], [], []
        i = 0
        while i < len(span):
            a, b = span[i]
            own = points[order[a:b]]
            total.append(own.sum(axis=0))
            pivot.append(np.floor_divide(total[-1], b - a))
            most = int(squared(own, pivot[-1][None]).max())
            radius.append(np.nextafter(np.sqrt(float(most)), np.inf) if most else 0.0)
            spread = own.max(axis=0) - own.min(axis=0)
            axis = int(spread.argmax())
            if b - a <= LEAF_ROWS or spread[axis] == 0:
                left.append(-1)
            else:
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, axis], half)]
                left.append(len(span))
                span += [(a, a + half), (a + half, b)]
            i += 1
        begin, end = (np.array(x, np.int64) for x in zip(*span, strict=True))
        return cls(points[order], begin, end, np.array(left), np.array(radius), np.array(pivot), np.array(total)), order

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]], int]:
        """Cluster of each point, or -1 in balls that went to a centroid as a whole; these (ball, centroid); exact distances computed."""
        cluster = np.full(len(self.points), -1)
        whole, asked = [], 0
        balls, left_in = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
        while len(balls):
            d = np.sqrt(squared(self.pivot[balls], centroids).astype(np.float64))
            d[~left_in] = np.inf
            reach = d.min(axis=1, keepdims=True) + 2.0 * self.radius[balls][:, None]
            left_in &= d <= reach + 1e-6 * (1.0 + reach)  # the slack covers rounding; it only asks for more
            alone = left_in.sum(axis=1) == 1
            whole += zip(balls[alone].tolist(), left_in[alone].argmax(axis=1).tolist(), strict=True)
            balls, left_in = balls[~alone], left_in[~alone]
            leaf = self.left[balls] < 0
            for ball, near in zip(balls[leaf].tolist(), left_in[leaf], strict=True):
                a, b = self.begin[ball], self.end[ball]
                near = np.flatnonzero(near)
                if self.radius[ball] == 0:  # equal vectors: one distance for all
                    cluster[a:b] = near[squared(self.points[a : a + 1], centroids[near])[0].argmin()]
                else:
                    cluster[a:b] = near[squared(self.points[a:b], centroids[near]).argmin(axis=1)]  # the first of the smallest
                asked += (b - a) * len(near)
            balls, left_in = self.left[balls[~leaf]], left_in[~leaf]
            balls, left_in = np.concatenate([balls, balls + 1]), np.concatenate([left_in, left_in])
        return cluster, whole, int(asked)


def _builder(dims: int, scale: int):
    def packed(ids: list, points: list[np.ndarray]) -> pa.RecordBatch:
        tree, order = BallTree.build(np.concatenate(points))
        ids = np.array(ids, object)[order]
        missing = np.array([i is None for i in ids])
        width = np.int32 if np.abs(tree.points).max(initial=0) < 1 << 31 else np.int64
        columns = [np.where(missing, 0, ids).astype(np.int64), missing, tree.points.astype(width), tree.begin, tree.end, tree.left, tree.radius, tree.pivot, tree.total]
        packed = [pa.array([x.tobytes()], pa.binary()) for x in columns]
        return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32()), pa.array([dims], pa.int32()), *packed], [c.split()[0] for c in _TREE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points = [], []
        for batch in batches:
            rows, found = quantised(batch.column("embedding"), dims, scale)
            of = batch.column("vec_id").take(pa.array(rows)).to_pylist()
            for at in range(0, len(of), TREE_ROWS):
                take = min(TREE_ROWS - len(ids), len(of) - at)
                ids, points = ids + of[at : at + take], [*points, found[at : at + take]]
                if len(ids) == TREE_ROWS:
                    yield packed(ids, points)
                    ids, points = of[at + take : at + TREE_ROWS], [found[at + take : at + TREE_ROWS]]
        if ids:
            yield packed(ids, points)

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[BallTree, pa.Array]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            n, dims = row["n"].as_py(), row["dims"].as_py()
            read = lambda c, kind=np.int64, row=row: np.frombuffer(row[c].as_buffer(), kind)
            points = row["points"].as_buffer()
            points = np.frombuffer(points, np.int32 if points.size == 4 * n * dims else np.int64).astype(np.int64).reshape(n, dims)
            tree = BallTree(points, read("begin"), read("end"), read("left"), read("radius", np.float64), read("pivot").reshape(-1, dims), read("total").reshape(-1, dims))
            yield tree, pa.array(read("ids"), mask=read("no_id", bool))


# -- rounds --------------------------------------------------------------------------------------------------------------
def _sums(centroids: np.ndarray):
    """(cluster, component, total, n): what a task's trees add to each centroid."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for tree, _ in _unpacked(batches):
            cluster, whole, _ = tree.assign(centroids)
            for ball, c in whole:
                total[c] += tree.total[ball]
                n[c] += tree.end[ball] - tree.begin[ball]
            for c in np.unique(cluster[cluster >= 0]).tolist():
                rows = cluster == c
                total[c] += tree.points[rows].sum(axis=0)
                n[c] += rows.sum()
        at = np.flatnonzero(np.repeat(n > 0, dims))
        columns = [pa.array((at // dims).astype(np.int32)), pa.array((at % dims).astype(np.int32)), pa.array(total.ravel()[at]), pa.array(np.repeat(n, dims)[at])]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "component", "total", "n"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, ids in _unpacked(batches):
            cluster, whole, _ = tree.assign(centroids)
            for ball, c in whole:
                cluster[tree.begin[ball] : tree.end[ball]] = c
            distance = np.empty(len(cluster), np.int64)
            for c in np.unique(cluster).tolist():
                rows = cluster == c
                distance[rows] = squared(tree.points[rows], centroids[c : c + 1])[:, 0]
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def first_centroids(vectors: DataFrame, k: int, dims: int, scale: int, seed: int) -> np.ndarray:
    """The kept vectors with the smallest hashes of seed:vec_id, in order of the hashes. k rows reach the driver."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(F.floor(x.cast("double") * scale).cast("double")) <= LARGEST))
    name = F.coalesce(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), F.lit("~"))
    kept = vectors.where((F.size("embedding") == dims) & finite).select(name.alias("hash"), "embedding")
    rows = kept.orderBy("hash", "embedding").limit(k).toArrow()
    _, points = quantised(rows["embedding"].combine_chunks(), dims, scale) if rows.num_rows else (None, np.empty((0, dims), np.int64))
    return points


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector kept, after so many rounds."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    rows = pick(vectors, "vec_id", "embedding")
    rows = rows.withColumn("vec_id", F.col("vec_id").cast("long"))
    centroids = first_centroids(rows, k, dims, scale, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    trees = scratch.table(rows.mapInArrow(_builder(dims, scale), _TREE), "trees")
    for _ in range(rounds):
        sums = trees.mapInArrow(_sums(centroids), "cluster int, component int, total long, n long").groupBy("cluster", "component").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        moved = centroids.copy()
        for r in sums.collect():  # k x dims rows at most
            moved[r.cluster, r.component] = r.total // r.n
        centroids = moved
    found = scratch.table(trees.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}  # k rows; null beyond a long
    every = None if None in inertia.values() or sum(inertia.values()) > 2**63 - 1 else sum(inertia.values())
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    of = spark.createDataFrame([(c, s, every, names[c]) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    scratch.drop_all_but("assigned")
    return found.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def op11_clustering(spark, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    """The rounds one after another in exact integers."""
    ctes = [
        f"q AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS p FROM embeddings "
        f"WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS})",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id::VARCHAR), p) - 1 AS INTEGER) AS cluster, p FROM q QUALIFY cluster < {K})",
    ]
    for i in range(ROUNDS + 1):
        ctes.append(f"d{i} AS (SELECT r, vec_id, q.p, cluster, CAST(list_sum(list_transform(list_zip(q.p, c.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS distance FROM q, c{i} c)")
        ctes.append(f"a{i} AS (SELECT r, any_value(vec_id) AS vec_id, any_value(p) AS p, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM d{i} GROUP BY r)")
        if i < ROUNDS:
            ctes.append(f"m{i} AS (SELECT cluster, j, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(p) AS x, unnest(range({DIMS})) AS j FROM a{i}) GROUP BY cluster, j)")
            ctes.append(f"n{i} AS (SELECT cluster, list(CAST((s - (((s % n) + n) % n)) // n AS BIGINT) ORDER BY j) AS p FROM m{i} GROUP BY cluster)")
            ctes.append(f"c{i + 1} AS (SELECT c.cluster, coalesce(n.p, c.p) AS p FROM c{i} c LEFT JOIN n{i} n USING (cluster))")
    return (
        "WITH " + ", ".join(ctes) + f" SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(c.p, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} c USING (cluster)"
    )


ORACLE = _oracle()
