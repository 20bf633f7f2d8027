"""Word differences against the whole table of subsequences."""

import random
import resource
import time

from pyspark.sql import functions as F

from sparkloom.operators import diff
from sparkloom.plans.catalog import QUERIES


def brute(a, b):
    """The way back through the table of all prefixes."""
    dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            dp[i + 1][j + 1] = dp[i][j] + 1 if x == y else max(dp[i][j + 1], dp[i + 1][j])
    i, j, out = len(a), len(b), []
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((a[i], "equal"))
        elif j and (not i or dp[i][j - 1] >= dp[i - 1][j]):
            j -= 1
            out.append((b[j], "inserted"))
        else:
            i -= 1
            out.append((a[i], "deleted"))
    return out[::-1]


def test_same_way_as_the_whole_table(monkeypatch):
    monkeypatch.setattr(diff, "FREQUENT", 2)
    rng = random.Random(4)
    for _ in range(300):
        vocab = "abcdefgh"[: rng.randint(1, 8)]
        a, b = ([rng.choice(vocab) for _ in range(rng.randint(0, 40))] for _ in range(2))
        assert diff.diff(" ".join(a), " ".join(b)) == brute(a, b)
    assert diff.diff(None, "x") == [("x", "inserted")] and diff.diff("", None) == []


def test_unified_order():
    assert diff.unified("a b c d", "a x c y z d") == [("a", "equal"), ("b", "deleted"), ("x", "inserted"), ("c", "equal"), ("y", "inserted"), ("z", "inserted"), ("d", "equal")]
    rng = random.Random(5)
    for _ in range(100):
        a, b = (" ".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        rows = diff.unified(a, b)
        assert [w for w, k in rows if k != "inserted"] == a.split() and [w for w, k in rows if k != "deleted"] == b.split()
        assert ("inserted", "deleted") not in {(x[1], y[1]) for x, y in zip(rows, rows[1:], strict=False)}


def test_long_texts_take_little_memory():
    rng = random.Random(6)
    a = [f"w{int(rng.paretovariate(0.6)) % 50_000}" for _ in range(30_000)]
    b = [w if rng.random() < 0.8 else f"w{rng.randrange(50_000)}" for w in a]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    start = time.monotonic()
    equal, gone, new, _ = diff.stats(" ".join(a), " ".join(b))
    assert equal + gone == equal + new == 30_000 and equal >= 0.75 * 30_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000 and time.monotonic() - start < 60


def test_all_documents_and_items(spark):
    d = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    some = sorted(k for k in text if k + 1 in text and len(text[k] or "") + len(text[k + 1] or "") < 4000)[:40]
    got = {r.doc_id: (r.equal, r.deleted, r.inserted) for r in QUERIES["document_diff"](spark, d).collect()}
    assert len(got) == sum(k + 1 in text for k in text)
    for k in some:
        kinds = [x for _, x in brute(diff.words(text[k]), diff.words(text[k + 1]))]
        assert got[k] == tuple(kinds.count(x) for x in ("equal", "deleted", "inserted"))
    rows = QUERIES["unified_diff"](spark, d).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("place", "word", "kind"))).alias("r")).collect()
    items = {r.item_id: r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    for r in rows:
        assert [x.word for x in r.r if x.kind != "inserted"] == diff.words(items[r.item_id])
        assert [(x.word, x.kind) for x in r.r] == diff.unified(items[r.item_id], items[r.item_id + 1])
