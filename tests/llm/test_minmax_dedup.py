import random
import re

import pytest

from sparkloom.llm.minmax_dedup import near_duplicates


def brute(rows, width, pct):
    sets = {}
    for i, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        if not w:
            sets[i] = set()
        elif len(w) < width:
            sets[i] = {tuple(w)}
        else:
            sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= pct * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("width,pct", [(3, 85), (5, 80)])
def test_against_all_pairs(spark, width, pct):
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(300)]
    rows = [(0, None), (1, ""), (2, " \t "), (3, "One"), (4, "one"), (5, "one two"), (6, "ONE two"), (7, "É x y z")]
    base = [rng.choice(vocab) for _ in range(120)]
    chain = base[:]
    for i in range(10, 40):
        chain = chain[:]
        for _ in range(rng.randint(0, 2)):
            chain[rng.randrange(len(chain))] = rng.choice(vocab)
        rows.append((i, " ".join(chain)))
    for i in range(40, 80):
        near = base[:]
        for _ in range(rng.randint(0, 5)):
            near[rng.randrange(len(near))] = rng.choice(vocab)
        rows.append((i, "\n".join(near)))
    rows += [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 60)))) for i in range(80, 120)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, key string, component_id long")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, shingle_words=width, threshold_pct=pct).collect()}
    assert got == brute(rows, width, pct)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).count() == 0


def test_parity_never_exceeds_the_difference(spark):
    import numpy as np

    from sparkloom.llm.minmax_dedup import differing, parity

    rng = np.random.default_rng(3)
    rows, want = [], []
    for k in range(60):
        n = int(rng.integers(100, 300))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[: n - int(rng.integers(0, 30))], rng.integers(0, 2**63, int(rng.integers(0, 30))).astype(np.uint64)])
        rows.append((k, parity(a).tolist(), parity(b).tolist()))
        want.append(len(np.setxor1d(a, b)))
    df = spark.createDataFrame(rows, "k int, p array<long>, q array<long>")
    got = {r.k: r.d for r in df.select("k", differing("p", "q").alias("d")).collect()}
    assert all(got[k] <= w and got[k] >= w * 0.4 and (w - got[k]) % 2 == 0 for k, w in enumerate(want))
