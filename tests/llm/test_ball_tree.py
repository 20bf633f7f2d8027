import math
import random

import pytest

from sparkloom.llm import ball_tree


def brute(rows, k, every):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok[i] = [math.floor(64 * x) for x in v]
    out = set()
    for q in ok:
        if q % every == 0:
            score = sorted((-sum(a * b for a, b in zip(ok[q], ok[c], strict=True)), c) for c in ok if c != q and len(ok[c]) == len(ok[q]))
            out |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(score[:k])}
    return out


@pytest.mark.parametrize("shard,block", [(None, 20_000), (90, 7)])
def test_against_brute_force(spark, shard, block, monkeypatch):
    monkeypatch.setattr(ball_tree, "LEAF", 16)
    rng = random.Random(4)
    rows = [(i, [float(rng.gauss(0, 1)) for _ in range(6)]) for i in range(300)]
    rows += [(i, rows[40][1]) for i in range(300, 520)]
    rows += [(600, None), (620, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (640, [float("nan")] * 6), (660, [float("inf")] * 6), (None, [1.0] * 6), (680, [1.0, 2.0]), (681, [3.0, 2.0]), (700, []), (720, [1e7] * 6), (-20, [0.5] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(4)
    got = ball_tree.top_k(df, "vec_id", "embedding", 5, 20, shard, block).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == brute(rows, 5, 20)
    assert ball_tree.top_k(df.limit(0), "vec_id", "embedding").count() == 0


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(ball_tree, "BOUNDS", 150)
    rng = random.Random(9)
    rows = [(i, [float(rng.gauss(0, 1)) for _ in range(4)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = ball_tree.top_k(df, "vec_id", "embedding", 3, 40, 5)
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()} == brute(rows, 3, 40)
    assert len(got._jdf.queryExecution().toString()) < 20_000
