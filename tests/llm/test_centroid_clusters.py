import hashlib
import math
import random

import numpy as np
import pytest

from sparkloom.llm import centroid_clusters as cc


def brute(rows, dims, scale, k, rounds):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    centres = [v for _, v in first[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min((far(v, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        mine = [nearest(v)[1] for _, v in kept]
        for j in range(len(centres)):
            own = [v for (_, v), c in zip(kept, mine, strict=True) if c == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [nearest(v) for _, v in kept]
    inertia = {j: sum(d for d, c in last if c == j) for j in range(len(centres))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((-1 if i is None else i), c, d, inertia[c], sum(inertia.values()), digest[c]) for (i, _), (d, c) in zip(kept, last, strict=True))


def found(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@pytest.mark.parametrize("k,size,scale,rows_at_once", [(12, 1.0, 16, 4096), (40, 8.0, 256, 50), (9, 1e5, 256, 64), (1, 1.0, 16, 4096), (2, 0.05, 16, 4096)])
def test_against_brute_force(spark, k, size, scale, rows_at_once, monkeypatch):
    monkeypatch.setattr(cc, "ROWS", rows_at_once)
    rng = random.Random(k)
    centres = [[rng.gauss(0, size) for _ in range(4)] for _ in range(10)]
    rows = [(i, [c + rng.gauss(0, size / 3) for c in rng.choice(centres)]) for i in range(700)]
    rows += [(i, rows[5][1]) for i in range(700, 1000)]  # a third are copies
    rows += [(1001, None), (1002, [1.0] * 3), (1003, []), (1004, [1.0, None, 0.0, 0.0]), (1005, [float("nan")] * 4), (1006, [1.0, float("-inf"), 0.0, 0.0]), (None, [0.5] * 4), (None, [-0.5] * 4), (7, [size] * 4), (7, [size] * 4)]
    df = spark.createDataFrame([(i, v, 0, "x", -1) for i, v in rows], "vec_id long, embedding array<double>, cluster int, vec string, distance int").repartition(5)
    report = {}
    got = cc.centroid_clusters(df, dims=4, scale=scale, k=k, rounds=5, report=report)
    assert found(got) == brute(rows, 4, scale, k, 5)
    assert report["scanned"][0] == report["vectors"][0] == 1004 and len(report["scanned"]) == 6
    assert k < 12 or sum(report["scanned"][1:]) < 3 * 1004


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = [(i, [float(i % 3), 0.5]) for i in range(7)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    assert found(cc.centroid_clusters(df, dims=2, k=40)) == brute(rows, 2, 256, 40, 5)
    for none in (df.limit(0), spark.createDataFrame([(1, [1.0])], df.schema)):
        empty = cc.centroid_clusters(none, dims=2)
        assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_components_are_cut(spark):
    rows = [(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.0] * 64)]
    got = cc.centroid_clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=1, rounds=0)
    first = min((1, 2, 3), key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())
    where = {1: 1 << 27, 2: -(1 << 27), 3: 0}
    assert {r.vec_id: r.distance for r in got.collect()} == {i: 64 * (where[i] - where[first]) ** 2 for i in where}


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x = rng.integers(-300, 300, (500, 8))
    c = rng.integers(-300, 300, (20, 8))
    cluster, d, near, lower = cc.Round(c, None, 5).scan(x)
    upper = cc.above(np.sqrt(d.astype(float)))
    for bounds in (5, 4, 3):
        step = rng.integers(-30, 30, c.shape)
        c = c + step
        now = cc.Round(c, np.sqrt((step**2).sum(1)) * (1 + 1e-9), bounds)
        cluster, upper, near, lower, _, _ = now.assign(x, cluster, upper, near, lower)
        true = np.sqrt(now.all_distances(x).astype(float))
        assert near.shape[1] == bounds and (true.argmin(1) == cluster).all()
        rows = np.arange(len(x))
        assert (upper >= true[rows, cluster]).all() and (lower[:, :bounds] <= np.take_along_axis(true, near, 1)).all()
        true[rows, cluster] = np.inf
        np.put_along_axis(true, near, np.inf, 1)
        assert (lower[:, bounds] <= true.min(1)).all()
