"""Centroid clustering on integer vectors: Lloyd's rounds whose searches stay within balls around the current centroid.

Each vector carries an upper bound of the distance to its own centroid and a
lower bound of the distance to every other one. Between rounds the bounds follow
the centroids' moves; a vector whose upper bound lies below both its lower bound
and half the way to the centroid next to its own is not looked at. For the others
the nearest and second nearest centroid lie in the ball around the own centroid
with the radius ``2 * upper + way to the next centroid``: only these are scanned,
off a list of the centroids sorted by their distance from the own one.

Distances are compared as exact integers. Bounds are square roots rounded away
from a skip and the ball includes its surface, so a tie is always scanned and the
smaller number wins; the result is that of comparing every vector with every
centroid.

Vectors never meet: each round is one pass over a stored table, partial sums by
cluster come at the end of each of its partitions, and the driver holds nothing
but the centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored

#: Components are held to this, so that squared distances fit 64 bits; below ``PLAIN`` floating-point products are exact.
LARGEST, PLAIN = 1 << 26, 1 << 22
UP, DOWN = 1 + 1e-9, 1 - 1e-9
SCALE = 256


def _rows(col: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype="<i4").astype(np.int64).reshape(-1, dims)


def _binary(v: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in v.astype("<i4")], pa.binary())


def integer_vectors(vectors: DataFrame, dims: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, v)`` of the vectors with exactly ``dims`` components, none null or non-finite; ``v`` has ``floor(256 * x)`` as 32-bit integers.

    A component beyond 2^26 counts as 2^26 with its sign.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            v = np.clip(np.floor(SCALE * x), -LARGEST, LARGEST)
            yield pa.RecordBatch.from_arrays([b.column(0), _binary(v)], names=["vec_id", "v"])

    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x"))
    sound = rows.where((F.size("x") == dims) & ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    return sound.mapInArrow(run, f"vec_id {kind}, v binary")


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows x centroids)."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < PLAIN:
        p, q = x.astype(np.float64), c.astype(np.float64)
        return ((p * p).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * (p @ q.T)).astype(np.int64)
    return np.stack([((x - one) ** 2).sum(1) for one in c], axis=1)


def own_distance(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row to its own centroid."""
    return ((x - c) ** 2).sum(1)


class Ball:
    """Centroids, how far they moved, and each one's list of all centroids by distance."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None) -> None:
        self.c = centroids
        k = len(centroids)
        between = np.sqrt(squared(centroids, centroids).astype(np.float64))
        self.order = np.argsort(between, axis=1, kind="stable")
        self.order = np.concatenate([np.arange(k)[:, None], np.array([[j for j in row if j != i] for i, row in enumerate(self.order)], dtype=np.int64).reshape(k, k - 1)], axis=1)
        self.near = np.take_along_axis(between, self.order, axis=1)
        self.next = self.near[:, 1] if k > 1 else np.full(k, np.inf)
        self.moved = np.zeros(k) if before is None else np.sqrt(own_distance(centroids, before).astype(np.float64))
        self.fastest = int(self.moved.argmax())
        self.others = np.full(k, self.moved.max())
        self.others[self.fastest] = np.delete(self.moved, self.fastest).max(initial=0)

    def assign(self, x: np.ndarray, own: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest centroid of each row, the smaller number if several are, and the new bounds."""
        if own is None:
            return self._scan(x, np.arange(len(self.c)))
        own, upper, lower = own.copy(), (upper + self.moved[own]) * UP, np.maximum(lower - self.others[own] * UP, 0) * DOWN
        bound = np.maximum(lower, self.next[own] / 2 * DOWN)
        left = np.flatnonzero(upper >= bound)
        upper[left] = np.sqrt(own_distance(x[left], self.c[own[left]]).astype(np.float64)) * UP
        left = left[upper[left] >= bound[left]]
        was = own[left]
        for j in np.unique(was):
            mine = left[was == j]
            inside = np.searchsorted(self.near[j], (2 * upper[mine] + self.next[j]) * UP, side="right")
            rings = np.minimum(1 << np.ceil(np.log2(np.maximum(inside, 2))).astype(int), len(self.c))
            for ring in np.unique(rings):  # balls of nearly equal numbers of centroids together
                rows = mine[rings == ring]
                own[rows], upper[rows], lower[rows] = self._scan(x[rows], np.sort(self.order[j, :ring]))
        return own, upper, lower

    def _scan(self, x: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = squared(x, self.c[among])
        best = d.argmin(axis=1)  # the first of equal ones, and numbers ascend
        least = np.take_along_axis(d, best[:, None], axis=1)[:, 0]
        second = np.partition(d, 1, axis=1)[:, 1].astype(np.float64) if len(among) > 1 else np.full(len(x), np.inf)
        return among[best], np.sqrt(least.astype(np.float64)) * UP, np.sqrt(second) * DOWN


def _states(b: pa.RecordBatch) -> list[np.ndarray | None]:
    return [b.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower")] if "cluster" in b.schema.names else [None] * 3


def _round(rows: DataFrame, ball: Ball, dims: int, name: str) -> tuple[DataFrame, DataFrame]:
    """One assignment, stored: the rows with cluster and bounds, and ``(cluster, i, total, n)`` summed over each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(ball.c)
        total, n = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for b in batches:
            x = _rows(b.column("v"), dims)
            own, upper, lower = ball.assign(x, *_states(b))
            order = np.argsort(own, kind="stable")
            there, starts = np.unique(own[order], return_index=True)
            if len(there):
                total[there] += np.add.reduceat(x[order], starts, axis=0)
                n += np.bincount(own, minlength=k)
            none = pa.nulls(len(x), pa.list_(pa.int64())), pa.nulls(len(x), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(own.astype(np.int32)), pa.array(upper), pa.array(lower), *none], names=names)
        some = np.flatnonzero(n)
        columns = [pa.nulls(len(some), kind), pa.nulls(len(some), pa.binary()), pa.array(some.astype(np.int32)), pa.nulls(len(some), pa.float64()), pa.nulls(len(some), pa.float64())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(total[some].tolist(), pa.list_(pa.int64())), pa.array(n[some])], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    names = ["vec_id", "v", "cluster", "upper", "lower", "sums", "n"]
    kind = to_arrow_type(rows.schema["vec_id"].dataType)
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, v binary, cluster int, upper double, lower double, sums array<bigint>, n bigint"
    out = stored(rows.mapInArrow(run, schema), name)
    parts = out.where("sums is not null").select("cluster", "n", F.posexplode("sums").alias("i", "part"))
    return out, parts.groupBy("cluster", "i").agg(F.sum("part").alias("total"), F.sum("n").alias("n"))


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row ``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` per vector that ``integer_vectors`` keeps.

    First centroids are the ``k`` vectors with the smallest hashes of
    ``seed:vec_id``, fewer if there are fewer vectors; of rows with one id those
    whose stored bytes are smaller come first, and null ids last. A centroid
    without vectors stays. Null, short, long and non-finite vectors are left out.
    Repeated rows are vectors like others. An inertia beyond 64 bits is the
    largest long. An empty table gives an empty result; further columns are
    ignored.
    """
    rows = stored(integer_vectors(vectors, dims, id_col, vec_col), "vectors")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(digest.asc_nulls_last(), "v").select("v").limit(k).collect()
    centroids = np.array([np.frombuffer(r.v, dtype="<i4") for r in first], dtype=np.int64).reshape(-1, dims)
    if not len(centroids):
        release(rows)
        return rows.limit(0).selectExpr("vec_id", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256").where("false")
    before = None
    for i in range(rounds):
        now, sums = _round(rows, Ball(centroids, before), dims, f"round{i}")
        before, centroids = centroids, centroids.copy()
        for r in sums.collect():  # k times dims rows
            centroids[r.cluster, r.i] = r.total // r.n
        release(rows)
        rows = now.where("sums is null").drop("sums", "n")
        rows._stored_at = now._stored_at
    ball = Ball(centroids, before)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _rows(b.column("v"), dims)
            own, _, _ = ball.assign(x, *_states(b))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(own.astype(np.int32)), pa.array(own_distance(x, ball.c[own]))], names=["vec_id", "cluster", "distance"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    done = stored(rows.mapInArrow(last, f"vec_id {kind}, cluster int, distance bigint"), "assigned")
    release(rows)
    held = lambda c: F.least(c, F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    per = done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("d")).collect()  # k rows
    of = [(r.cluster, int(r.d), hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest()) for r in per]
    spark, every = vectors.sparkSession, sum(d for _, d, _ in of)
    known = spark.createDataFrame([(c, str(d), str(every), h) for c, d, h in of], "cluster int, d string, every string, centroid_sha256 string")
    known = known.select("cluster", held(F.col("d").cast("decimal(38,0)")).alias("cluster_inertia"), held(F.col("every").cast("decimal(38,0)")).alias("inertia"), "centroid_sha256")
    return done.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
