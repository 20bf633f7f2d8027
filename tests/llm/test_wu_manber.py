import hashlib
import random
import re

import pytest

from sparkloom.llm.wu_manber import contamination


def words(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw)


def brute(docs, items, window=13):
    out = {}
    for i, text in docs:
        w, hit, got = words(text), set(), set()
        for item, t in items:
            v = words(t)
            m = min(window, len(v))
            for k in range(len(v) - m + 1) if m else []:
                for s in range(len(w) - m + 1):
                    if w[s : s + m] == v[k : k + m]:
                        hit |= set(range(s, s + m))
                        got.add(str(item))
        out[i] = (len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("pattern_words", [200_000, 120])
def test_against_brute_force(spark, pattern_words):
    rng = random.Random(9)
    vocab = ["Alpha", "beta", "é", "x1", "THE", "of", "Q"]
    make = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", " - "]) for _ in range(n))
    items = [(k, make(rng.randint(14, 30))) for k in range(9)] + [(20, None), (21, ""), (22, "..."), (23, "unique"), (24, "two words"), (2, "another row of it two words")]
    docs = [(0, None), (1, ""), (2, "!!"), (3, "a UNIQUE word"), (4, "two-words"), (5, items[3][1].upper().replace("É", "é"))]
    for k in range(6, 60):
        t = make(rng.randint(0, 60))
        if k % 2:
            t += " " + rng.choice(items[:9])[1] + " " + make(rng.randint(0, 900))
        docs.append((k, t))
    docs.append((60, make(40000) + items[0][1]))
    d = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, items string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = contamination(d, b, pattern_words=pattern_words).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows} == brute(docs, items)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "x y")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in contamination(d, b).collect()] == [(2, 0, False)]
    assert contamination(d.limit(0), b).count() == 0


@pytest.mark.parametrize("pattern_words", [200_000, 40])
def test_repeated_rows_and_long_items(spark, pattern_words):
    text = " ".join(f"w{k}" for k in range(400))
    d = spark.createDataFrame([(7, text), (7, text), (7, "other words"), (None, text), (8, None)], "doc_id long, text string").repartition(2)
    b = spark.createDataFrame([("a", text), ("b", "lone " * 14)], "item_id string, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items) for r in contamination(d, b, pattern_words=pattern_words).collect())
    assert got == [(0, 400, 400, 1), (7, 2, 0, 0), (7, 400, 400, 1), (7, 400, 400, 1), (8, 0, 0, 0)]
