"""Exact top-k by inner product: ball trees searched by branch and bound, shard by shard.

Vectors are range-sorted along a fixed random direction; each range is a shard and becomes a ball tree (split at the
median of its widest direction), built once. A node's inner products with a query are at most
``q . centre + |q| * radius``; nodes are visited in descending order of that bound, for all
queries of a block together, and a query leaves as soon as its bound falls below its kth best score. Each query
first searches its own shard, in the task that builds the tree; the kth score found there is shared with all other shards: a query is sent only
to those whose root's bound reaches it, and they return only what can still rank.

Scale: a shard has about ``SHARD`` rows. Bounds of shards are one row each and are met in blocks of ``BOUNDS``; queries travel in packed
blocks, and a shard that many queries need is sent to several tasks, each with ``BLOCK`` queries or a little more. Every
shard returns at most k rows a query.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows of a shard at most, about; and where fewer would leave cores idle, at least.
SHARD, LEAST = 20_000, 2_000
BLOCK = 20_000
#: Bytes of query vectors that a task holds.
HELD = 16 << 20
#: Shards whose bounds a task holds at once.
BOUNDS = 20_000
LEAF = 256
#: Integer scores below this are exact in float64, with room for a place in a leaf beside them in 64 bits.
EXACT = 1 << 52
PLACE = 11

def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vec) -> (id, dim, place, ints): floor(64 * x) and a projection; unusable vectors are left out."""
    for batch in batches:
        ids, dims, places, out = [], [], [], []
        for i, v in zip(batch.column("id").to_pylist(), batch.column("vec").to_pylist(), strict=True):
            if i is None or v is None or None in v:
                continue
            x = np.array(v, np.float64)
            if not np.isfinite(x).all():
                continue
            q = np.clip(np.floor(64 * x), -(2.0**62), 2.0**62).astype(np.int64)
            axis = np.random.default_rng(len(q)).standard_normal(len(q))
            norm = float(np.sqrt((q.astype(np.float64) ** 2).sum())) or 1.0
            ids.append(i)
            dims.append(len(q))
            places.append(float(q @ axis) / norm)
            out.append(q.astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(places, pa.float64()), pa.array(out, pa.binary())],
            names=["id", "dim", "place", "ints"],
        )


class Tree:
    """Ball tree over integer rows: leaves are slices of the rows, in the order of their ids; nodes have a centre, a radius and two children or none."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids)
        self.ids, self.rows = ids[order], rows[order]
        self.order = np.arange(len(rows))
        self.nodes: list[tuple[np.ndarray, float, int, int, int, int]] = []
        self._build(self.rows.astype(np.float64), 0, len(rows))
        self.ids, self.rows = self.ids[self.order], self.rows[self.order]

    def _build(self, points: np.ndarray, a: int, b: int) -> int:
        self.order[a:b].sort()
        mine = points[self.order[a:b]]
        centre = mine.mean(0) if b > a else np.zeros(points.shape[1])
        radius = float(np.sqrt(((mine - centre) ** 2).sum(1).max())) if b > a else 0.0
        at = len(self.nodes)
        self.nodes.append((centre, radius, a, b, -1, -1))
        if b - a > LEAF and radius > 0:
            far = mine[((mine - centre) ** 2).sum(1).argmax()]
            other = mine[((mine - far) ** 2).sum(1).argmax()]
            half = (b - a) // 2
            part = np.argpartition(mine @ (other - far), half)
            self.order[a:b] = self.order[a:b][part]
            left = self._build(points, a, a + half)
            right = self._build(points, a + half, b)
            self.nodes[at] = (centre, radius, a, b, left, right)
        return at

    def search(self, queries: np.ndarray, query_ids: np.ndarray, kth: np.ndarray, k: int):
        """Best k (query number, id, score) of every query with a score of at least ``kth``; a row is not its own candidate."""
        q = queries.astype(np.float64)
        norm = np.sqrt((q**2).sum(1))
        most = [float(np.abs(x).max(initial=0)) for x in (q, self.rows)]
        small = most[0] * most[1] * q.shape[1] < EXACT
        leaves = self.rows.astype(np.float64) if small else self.rows.astype(object)
        exact = q if small else queries.astype(object)
        worst = -EXACT if small else -(2**200)
        score = np.full((len(q), k), worst, np.int64 if small else object)
        owner = np.full((len(q), k), np.iinfo(np.int64).max)
        low = kth.astype(np.float64)
        heap = [(np.arange(len(q)), 0)]

        def bound(who: np.ndarray, node: int) -> np.ndarray:
            c, r, *_ = self.nodes[node]
            return upper(q[who] @ c, norm[who], r)

        while heap:
            who, node = heap.pop()
            who = who[bound(who, node) >= low[who]]
            if not len(who):
                continue
            _, _, a, b, left, right = self.nodes[node]
            if left < 0:
                for s in range(a, b, 4 * LEAF):
                    e = min(b, s + 4 * LEAF)
                    got = exact[who] @ leaves[s:e].T
                    names = self.ids[s:e]
                    use = got >= low[who][:, None]
                    use &= names != query_ids[who][:, None]
                    some = np.flatnonzero(use.any(1))
                    if not len(some):
                        continue
                    mine = who[some]
                    got = np.where(use[some], got[some], worst).astype(score.dtype)
                    names = np.broadcast_to(names, got.shape)
                    if small and got.shape[1] > 2 * k:
                        # scores and places in one number: of equal scores the smaller ids, which come first in a leaf
                        one = (got << PLACE) + ((1 << PLACE) - 1 - np.arange(got.shape[1]))
                        top = np.argpartition(one, got.shape[1] - k, axis=1)[:, -k:]
                        got, names = np.take_along_axis(got, top, 1), np.take_along_axis(names, top, 1)
                    every, name = np.concatenate([score[mine], got], 1), np.concatenate([owner[mine], np.where(got > worst, names, np.iinfo(np.int64).max)], 1)
                    if small:
                        best = np.lexsort((name, -every), axis=1)[:, :k]
                    else:
                        best = np.array([sorted(range(len(x)), key=lambda j, x=x, m=m: (-x[j], m[j]))[:k] for x, m in zip(every, name, strict=True)])
                    score[mine] = np.take_along_axis(every, best, 1)
                    owner[mine] = np.take_along_axis(name, best, 1)
                    full = owner[mine, k - 1] != np.iinfo(np.int64).max
                    low[mine[full]] = np.maximum(low[mine[full]], score[mine[full], k - 1].astype(np.float64))
                continue
            # nearer child of each query first: queries split by which bound is higher
            bl, br = bound(who, left), bound(who, right)
            first = bl >= br
            heap += [(who[first], right), (who[~first], left), (who[~first], right), (who[first], left)]
        for n in range(len(q)):
            for s, i in zip(score[n].tolist(), owner[n].tolist(), strict=True):
                if i != np.iinfo(np.int64).max and s >= kth[n]:
                    yield n, i, max(-(2**63), min(2**63 - 1, s))


def upper(product: np.ndarray, norm: np.ndarray, radius) -> np.ndarray:
    """Bound of the inner products with a ball, rounding errors included."""
    top = product + norm * radius
    return top + np.abs(top) * 1e-9 + 1e-6 * (norm + 1)


def matrix(raw: pa.Array, dim: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(raw.to_pylist()), "<i8")
    return flat.reshape(len(raw), dim) if dim else np.zeros((len(raw), 1), np.int64)


TREE, QUERY, HIT = 0, 1, 2
#: A row is a tree (``data``) with its root's ``centre`` and ``radius``, a query (``data``) with its kth score so far (``low``), or what a query found in its
#: own shard (``vec_id``, ``score``).
BUILT = "kind int, shard int, dim int, centre array<double>, radius double, data binary, id long, vec_id long, score long, low double"


def built(batches: Iterator[pa.RecordBatch], k: int, every: int) -> Iterator[pa.RecordBatch]:
    """The trees of a shard, one for each length of vectors, and its queries with the best rows they find in it."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    types = [pa.int32()] * 3 + [pa.list_(pa.float64()), pa.float64(), pa.binary()] + [pa.int64()] * 3 + [pa.float64()]
    names = ["kind", "shard", "dim", "centre", "radius", "data", "id", "vec_id", "score", "low"]
    for dim in np.unique(table.column("dim").to_numpy()).tolist():
        mine = table.filter(pc.equal(table.column("dim"), dim))
        at = mine.column("shard")[0].as_py()
        ids, rows = mine.column("id").to_numpy(), matrix(mine.column("ints"), dim)
        tree = Tree(ids, rows)
        ask = np.flatnonzero(ids % every == 0)
        hits: list[list[tuple[int, int]]] = [[] for _ in ask]
        for n, i, s in tree.search(rows[ask], ids[ask], np.full(len(ask), -np.inf), k) if len(ask) else []:
            hits[n].append((i, s))
        centre, radius, *_ = tree.nodes[0]
        out = [(TREE, at, dim, centre.tolist(), radius, pickle.dumps((tree.ids, tree.rows, tree.nodes), 5), None, None, None, None)]
        for n, mine_ in zip(ask.tolist(), hits, strict=True):
            low = float(mine_[-1][1]) if len(mine_) == k else -np.inf
            out.append((QUERY, at, dim, None, None, rows[n].astype("<i8").tobytes(), int(ids[n]), None, None, low))
            out += [(HIT, at, dim, None, None, None, int(ids[n]), i, s, None) for i, s in mine_]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


ASKED = "shard int, dim int, block int, n int, ids binary, kth binary, ints binary, tree binary"


def asked(batches: Iterator[pa.RecordBatch], bounds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Queries packed for each shard whose root's bound reaches their kth score (``low``)."""
    for batch in batches:
        for dim in np.unique(batch.column("dim").to_numpy()).tolist():
            if dim not in bounds:
                continue
            shards, centres, radii = bounds[dim]
            mine = batch.filter(pc.equal(batch.column("dim"), dim))
            step = max(1, HELD // (8 * max(dim, len(shards))))
            for s in range(0, len(mine), step):
                part = mine.slice(s, step)
                ids, home, low = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "shard", "low"))
                ints = matrix(part.column("data"), dim)
                q = ints.astype(np.float64)
                top = upper(q @ centres.T, np.sqrt((q**2).sum(1))[:, None], radii)
                go = (top >= low[:, None]) & (home[:, None] != shards)
                out = []
                for j in np.flatnonzero(go.any(0)).tolist():
                    who = np.flatnonzero(go[:, j])
                    out.append((int(shards[j]), dim, int(ids[who[0]] % (1 << 31)), len(who), ids[who].tobytes(), low[who].tobytes(), ints[who].tobytes()))
                for a in range(0, len(out), 64):
                    cols = list(zip(*out[a : a + 64], strict=True))
                    types = [pa.int32()] * 4 + [pa.binary()] * 3
                    arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(cols[0]), pa.binary())], names=["shard", "dim", "block", "n", "ids", "kth", "ints", "tree"])


def searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Searches packed queries in the tree before them."""
    tree: Tree | None = None
    for batch in batches:
        for r in batch.to_pylist():
            if r["tree"] is not None:
                tree = Tree.__new__(Tree)
                tree.ids, tree.rows, tree.nodes = pickle.loads(r["tree"])
                continue
            ids = np.frombuffer(r["ids"], np.int64)
            queries = np.frombuffer(r["ints"], "<i8").reshape(len(ids), -1)
            hits = list(tree.search(queries, ids, np.frombuffer(r["kth"], np.float64), k))
            cols = [pa.array(c, pa.int64()) for c in ([int(ids[n]) for n, _, _ in hits], [i for _, i, _ in hits], [s for _, _, s in hits])]
            yield pa.RecordBatch.from_arrays(cols, names=["query_id", "vec_id", "score"])


def best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, id_col: str, vector_col: str, k: int = 20, every: int = 20, shard: int | None = None, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every row whose id is divisible by ``every``.

    Components count as floor(64 * x); ties go to smaller ids. Vectors that are null or hold null or non-finite components take no
    part, and only vectors of equal length meet. Ids must be unique; null ids take no part; further columns are ignored; an empty table gives an
    empty result. Components beyond 2**62 / 64 are cut there, and scores to the range of a long.
    """
    spark = vectors.sparkSession
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
    with common.Stages() as done:
        rows = done.stage(source.mapInArrow(common.tidy(quantise), "id long, dim int, place double, ints binary"), "vectors")
        n = rows.count()
        shards = max(1, -(-n // (shard or SHARD)), 0 if shard else min(4 * spark.sparkContext.defaultParallelism, n // LEAST))
        # sorted ranges: equal vectors can't crowd a shard, as ids sort them on
        placed = rows.repartitionByRange(shards, "dim", "place", "id").select(F.spark_partition_id().alias("shard"), "id", "dim", "ints")
        made = done.stage(placed.mapInArrow(common.tidy(lambda it: built(it, k, every)), BUILT), "built")
        first = made.filter(F.col("kind") == HIT).select(F.col("id").alias("query_id"), "vec_id", "score")
        queries = made.filter(F.col("kind") == QUERY).select("id", "shard", "dim", "data", "low")
        trees = made.filter(F.col("kind") == TREE)
        roots = trees.select("shard", "dim", "centre", "radius")
        packets = None
        count = roots.count()
        for at in range(0, count, BOUNDS):
            # a block of shards: rows of bounded number and size
            part = roots.filter((F.col("shard") >= at) & (F.col("shard") < at + BOUNDS)) if count > BOUNDS else roots
            bounds = {}
            for r in part.collect():
                bounds.setdefault(r.dim, []).append((r.shard, r.centre, r.radius))
            bounds = {d: (np.array([x[0] for x in b]), np.array([x[1] for x in b], np.float64), np.array([x[2] for x in b])) for d, b in bounds.items()}
            shared = done.share(spark, bounds)
            sent = queries.mapInArrow(common.tidy(lambda it, shared=shared: asked(it, shared.value)), ASKED)
            packets = sent if packets is None else packets.unionByName(sent)
        if packets is None:  # an empty table
            return best(common.stage(first, "found"), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        packets = done.stage(packets, "packets")
        # a shard is sent to as many tasks as its queries need
        tasks = packets.groupBy("shard", "dim").agg(F.ceil(F.sum("n") / block).cast("int").alias("tasks"))
        sent = packets.join(tasks, ["shard", "dim"]).select(*packets.columns, F.pmod(F.xxhash64("block"), "tasks").cast("int").alias("task"))
        copies = trees.join(tasks, ["shard", "dim"]).select("shard", "dim", F.col("data").alias("tree"), F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"))
        both = sent.withColumn("late", F.lit(1)).unionByName(copies.withColumn("late", F.lit(0)), allowMissingColumns=True)
        width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        dealt = both.repartition(width, "shard", "dim", "task").sortWithinPartitions("shard", "dim", "task", "late")
        second = dealt.select("ids", "kth", "ints", "tree").mapInArrow(common.tidy(lambda it: searched(it, k)), "query_id long, vec_id long, score long")
        found = common.stage(first.unionByName(second), "found")
    return best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_ball_tree_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
