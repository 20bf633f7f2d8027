"""Exact k-means rounds over integer vectors with Drake's adaptive bounds.

A vector keeps the numbers of its nearest other centroids with a lower bound of the distance to each, one remainder bound for all further
centroids, and an upper bound of the distance to its own. Centroids move by known distances, which loosens the bounds. Where the upper
bound is below all lower ones, nothing is computed; where it is below the remainder and all bounds from some place on, only the
centroids before that place are rescanned; else all are. The number of bounds shrinks to what any vector needed in the
last round (an eighth of the centroids at least). Bounds are rounded outwards, ties are never certified, and distances are
computed in whole numbers, so the clusters are those of a full scan.

Scale: a round is one pass without a shuffle of vectors. Each task adds one row a cluster with its count, sums and distances to what it
writes; only these are aggregated, and the driver holds the centroids and one total a cluster. The state (vector, cluster, bounds) is
written and reread each round, and the round before is deleted: executors may be lost, and disk holds two rounds at most. Copies of one
vector are rows like others; nothing is grouped by vector or cluster.

Rows whose vector is null, of another length or holds null or non-finite components take no part. Components are cut at +-2**27 after quantising (less beyond
64 components), which keeps every distance in 64 bits. Rows with the same id are vectors of their own; a null id is kept, but starts
no cluster before others do. Fewer rows than clusters give as many clusters as rows; an empty table an empty result. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Vectors that a task works on at once.
ROWS = 4096
#: Whole numbers below this are exact in float64.
EXACT = 1 << 52

#: A row is a vector with its bounds, or the totals of a task and a cluster (``total`` is not null, ``cluster`` its number).
STATE = "id long, vec binary, cluster int, distance long, upper float, near binary, lower binary, total struct<n:long,distance:decimal(38,0),sums:array<long>,scanned:long,needed:int>"


def quantised(dims: int, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, vec) -> (id, vec): floor(scale * x) of usable vectors as int32, little-endian."""
    most = 1 << ((60 - (dims - 1).bit_length()) // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column("vec")
            keep = pc.fill_null(pc.equal(pc.list_value_length(vec), dims), False)
            batch = batch.filter(keep)
            vec = batch.column("vec")
            x = vec.flatten().cast(pa.float64())
            x = pc.fill_null(x, float("nan")).to_numpy(zero_copy_only=False).reshape(len(vec), dims)
            good = np.isfinite(x).all(1)
            with np.errstate(over="ignore"):
                q = np.clip(np.floor(scale * x[good]), -most, most).astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(good)), packed(q)], names=["id", "vec"])

    return run


def packed(rows: np.ndarray) -> pa.Array:
    """A binary value of each row's bytes."""
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * width
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])
    return column.cast(pa.binary())


def unpacked(column: pa.Array, kind: str, width: int) -> np.ndarray:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw.view(kind).reshape(len(column), width)


def below(x: np.ndarray) -> np.ndarray:
    """float32 numbers that are not above."""
    return np.nextafter((x * (1 - 1e-9)).astype(np.float32), np.float32(-np.inf))


def above(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + 1e-9)).astype(np.float32), np.float32(np.inf))


class Round:
    """One assignment: centroids, how far each has moved since the last one, and how many bounds to keep."""

    def __init__(self, centroids: np.ndarray, moved: np.ndarray | None, bounds: int):
        self.centroids, self.moved, self.bounds = centroids, moved, min(bounds, len(centroids) - 1)
        self.norms = (centroids**2).sum(1)

    def all_distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to all centroids."""
        most = max(int(np.abs(x).max(initial=0)), int(np.abs(self.centroids).max(initial=0)))
        if 4 * x.shape[1] * most * most < EXACT:  # whole numbers in float64
            y, c = x.astype(np.float64), self.centroids.astype(np.float64)
            return ((y**2).sum(1)[:, None] - 2 * (y @ c.T) + self.norms).astype(np.int64)
        return np.stack([((x - c) ** 2).sum(1) for c in self.centroids], 1)

    def some_distances(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Squared distances of each row to its own list of centroids."""
        out = np.empty(which.shape, np.int64)
        for k in range(which.shape[1]):
            out[:, k] = ((x - self.centroids[which[:, k]]) ** 2).sum(1)
        return out

    def scan(self, x: np.ndarray):
        """Cluster, squared distance, nearest other centroids, their bounds and the remainder's: from all centroids."""
        d = self.all_distances(x)
        order = np.argsort(d, axis=1, kind="stable")  # of equal distances the smaller number first
        sorted_d = np.take_along_axis(d, order, 1)
        b = self.bounds
        rest = np.sqrt(sorted_d[:, b + 1 : b + 2].astype(np.float64)) if b + 1 < d.shape[1] else np.full((len(x), 1), np.inf)
        lower = np.concatenate([np.sqrt(sorted_d[:, 1 : b + 1].astype(np.float64)), rest], 1)
        return order[:, 0], sorted_d[:, 0], order[:, 1 : b + 1], below(lower)

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, near: np.ndarray, lower: np.ndarray):
        """All of a block's state anew: cluster, upper, near, lower, and how many were scanned and how many bounds were needed."""
        b = near.shape[1]
        upper = above(upper.astype(np.float64) + self.moved[cluster])
        lower = lower.astype(np.float64)
        lower[:, :b] -= self.moved[near]
        lower[:, b] -= self.moved.max(initial=0.0)
        lower = below(np.maximum(lower, 0.0))
        tail = np.minimum.accumulate(lower[:, ::-1], axis=1)[:, ::-1]  # the least bound from each place on
        todo = np.flatnonzero(upper >= tail[:, 0])
        needed = 0
        if len(todo):  # the true distance instead of the bound
            d = ((x[todo] - self.centroids[cluster[todo]]) ** 2).sum(1)
            upper[todo] = above(np.sqrt(d.astype(np.float64)))
            todo = todo[upper[todo] >= tail[todo, 0]]
        certain = upper[:, None] < tail
        place = np.where(certain.any(1), certain.argmax(1), b + 1)
        for k in np.unique(place[todo]).tolist():
            rows = todo[place[todo] == k]
            if k > b:
                continue
            needed = max(needed, k)
            which = np.concatenate([cluster[rows][:, None], near[rows, :k]], 1)
            d = self.some_distances(x[rows], which)
            order = np.lexsort((which, d), axis=1)
            which, d = np.take_along_axis(which, order, 1), np.take_along_axis(d, order, 1)
            root = np.sqrt(d.astype(np.float64))
            cluster[rows], upper[rows] = which[:, 0], above(root[:, 0])
            near[rows, :k], lower[rows, :k] = which[:, 1:], below(root[:, 1:])
        full = todo[place[todo] > b]
        width = min(self.bounds, b)
        if width < b:  # bounds that are given up go into the remainder
            lower = np.concatenate([lower[:, :width], lower[:, width:].min(1)[:, None]], 1)
            near = near[:, :width].copy()
        if len(full):
            self.bounds = width
            cluster[full], d, near[full], lower[full] = self.scan(x[full])
            upper[full] = above(np.sqrt(d.astype(np.float64)))
            needed = b
        return cluster, upper, near, lower, len(full), needed


def assigned(shared, moved, bounds: int, last: bool, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """State of the last round (at first only id and vec) -> state of this one, and totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Round(shared.value, moved, bounds)
        k = len(now.centroids)
        n, far, sums = np.zeros(k, np.int64), [0] * k, np.zeros((k, dims), np.int64)
        scanned = needed = 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = unpacked(part.column("vec"), "<i4", dims).astype(np.int64)
                if moved is None:
                    cluster, d, near, lower = now.scan(x)
                    upper = above(np.sqrt(d.astype(np.float64)))
                    scanned += len(x)
                else:
                    width = len(part.column("near")[0].as_py()) // 2
                    state = part.column("cluster").to_numpy().astype(np.int64), part.column("upper").to_numpy()
                    near, lower = unpacked(part.column("near"), "<i2", width).astype(np.int64), unpacked(part.column("lower"), "<f4", width + 1)
                    cluster, upper, near, lower, full, most = now.assign(x, *state, near, lower)
                    scanned, needed = scanned + full, max(needed, most)
                d = ((x - now.centroids[cluster]) ** 2).sum(1) if last else None
                n += np.bincount(cluster, minlength=k)
                order = np.argsort(cluster, kind="stable")
                heads = np.flatnonzero(np.append(True, np.diff(cluster[order]) > 0))
                sums[cluster[order][heads]] += np.add.reduceat(x[order], heads, axis=0)
                if last:
                    for c, most in zip(cluster[order][heads].tolist(), np.split(d[order], heads[1:]), strict=True):
                        far[c] += sum(most.tolist())
                yield state_rows(part.column("id"), part.column("vec"), cluster, d, upper, near, lower)
        some = np.flatnonzero(n)
        yield total_rows(some, n, far, sums, scanned, needed)

    return common.tidy(run)


_TOTAL = pa.struct([("n", pa.int64()), ("distance", pa.decimal128(38, 0)), ("sums", pa.list_(pa.int64())), ("scanned", pa.int64()), ("needed", pa.int32())])
_TYPES = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.float32(), pa.binary(), pa.binary(), _TOTAL]
_NAMES = ["id", "vec", "cluster", "distance", "upper", "near", "lower", "total"]


def state_rows(ids, vecs, cluster, distance, upper, near, lower) -> pa.RecordBatch:
    n = len(cluster)
    distance = pa.array(distance, pa.int64()) if distance is not None else pa.nulls(n, pa.int64())
    cols = [ids, vecs, pa.array(cluster, pa.int32()), distance, pa.array(upper, pa.float32()), packed(near.astype("<i2")), packed(lower.astype("<f4")), pa.nulls(n, _TOTAL)]
    return pa.RecordBatch.from_arrays(cols, names=_NAMES)


def total_rows(clusters: np.ndarray, n: np.ndarray, far: list[int], sums: np.ndarray, scanned: int, needed: int) -> pa.RecordBatch:
    totals = [{"n": int(n[c]), "distance": far[c], "sums": sums[c].tolist(), "scanned": scanned if c == clusters[0] else 0, "needed": needed} for c in clusters.tolist()]
    cols = [pa.nulls(len(totals), kind) for kind in _TYPES]
    cols[2], cols[7] = pa.array(clusters, pa.int32()), pa.array(totals, _TOTAL)
    return pa.RecordBatch.from_arrays(cols, names=_NAMES)


def totals(state: DataFrame) -> dict[int, tuple[int, int, list[int]]]:
    """Count, distance and sums of each cluster; at -1 how many vectors were scanned whole, and the most bounds that one needed."""
    rows = state.filter("total is not null").select("cluster", "total.*")
    parts = rows.select("cluster", "n", "distance", "scanned", "needed", F.posexplode("sums").alias("place", "part"))
    first = F.col("place") == 0
    # sums of tasks fit 64 bits, those of a table may not
    wide = parts.groupBy("cluster", "place").agg(
        F.sum(F.col("part").cast("decimal(38,0)")).alias("total"),
        F.sum(F.when(first, F.col("n"))).alias("n"),
        F.sum(F.when(first, F.col("distance"))).alias("distance"),
        F.sum(F.when(first, F.col("scanned"))).alias("scanned"),
        F.max("needed").alias("needed"),
    )
    out: dict[int, tuple[int, int, list[int]]] = {}
    scanned, needed, sums = 0, 0, {}
    for r in wide.collect():  # centroids x components
        sums.setdefault(r.cluster, {})[r.place] = int(r.total)
        needed = max(needed, r.needed)
        if r.place == 0:
            out[r.cluster] = (r.n, int(r.distance), [])
            scanned += r.scanned
    out = {c: (n, d, [s for _, s in sorted(sums[c].items())]) for c, (n, d, _) in out.items()}
    out[-1] = (scanned, needed, [])
    return out


def starting(vectors: DataFrame, k: int, seed: str, dims: int) -> np.ndarray:
    """The ``k`` vectors whose ``seed:id`` has the smallest sha256 (of equal ones that with the smaller bytes)."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.select(rank.alias("rank"), "vec").orderBy(F.col("rank").asc_nulls_last(), "vec").limit(k).collect()
    return np.array([np.frombuffer(bytes(r.vec), "<i4") for r in rows], np.int64).reshape(len(rows), dims)


def centroid_clusters(
    df: DataFrame, id_column: str = "vec_id", column: str = "embedding", dims: int = 64, scale: int = 256, k: int = 40, rounds: int = 5, seed: str = "2", report: dict | None = None
) -> DataFrame:
    """Clusters of every usable vector after ``rounds`` rounds of assigning and averaging, and one more assignment.

    (id, cluster, distance, cluster_inertia, inertia, centroid_sha256); ``report`` gets, for each assignment, the vectors and how many of
    them were scanned against all centroids.
    """
    spark = df.sparkSession
    source = df.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{column}`").cast("array<double>").alias("vec"))
    with common.Stages() as done:
        vectors = done.stage(source.mapInArrow(quantised(dims, scale), "id long, vec binary"), "vectors")
        centroids = starting(vectors, k, seed, dims)
        if not len(centroids):
            schema = f"`{id_column}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
            return spark.createDataFrame([], schema)
        state, moved, bounds, least = vectors, None, -(-k // 4), -(-k // 8)
        for step in range(rounds + 1):
            last = step == rounds
            run = assigned(done.share(spark, centroids), moved, bounds, last, dims)
            rows = state if moved is None else state.filter("total is null").select(*(c for c in _NAMES if c not in ("distance", "total")))
            new = done.stage(rows.mapInArrow(run, STATE), f"round_{step}")
            done.drop(state)
            state = new
            sums = totals(state)
            scanned, needed, _ = sums.pop(-1)
            if report is not None:
                report.setdefault("vectors", []).append(sum(n for n, _, _ in sums.values()))
                report.setdefault("scanned", []).append(scanned)
                report.setdefault("bounds", []).append(bounds)
            if last:
                break
            if moved is not None:
                bounds = max(least, min(bounds, needed))
            new_centroids = centroids.copy()
            for c, (n, _, total) in sums.items():
                new_centroids[c] = [s // n for s in total]
            moved = above(np.sqrt(((new_centroids - centroids) ** 2).sum(1).astype(np.float64))).astype(np.float64)
            centroids = new_centroids
        inertia = sum(d for _, d, _ in sums.values())
        named = [(c, d, inertia, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, (_, d, _) in sums.items()]
        table = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
        out = state.filter("total is null").select(F.col("id").alias(id_column), "cluster", "distance").join(F.broadcast(table), "cluster")
        out = out.select(f"`{id_column}`", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
        return common.stage(out, "clusters")


def op12_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    return centroid_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
