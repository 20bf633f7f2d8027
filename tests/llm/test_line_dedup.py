import random
import re

import pytest

from sparkloom.llm import line_dedup


def brute(docs, pct):
    earlier, out = [], {}
    for i, text in sorted(docs, key=lambda x: x[0]):
        keep = []
        for line in (text or "").split("\n"):
            s = set(re.findall(rb"[^\x20\x09-\x0D]+", line.encode().lower()))
            gone = bool(s) and any(100 * len(s & t) >= pct * len(s | t) for t in earlier)
            if s:
                earlier.append(s)
            if not gone:
                keep.append(line)
        out[i] = None if text is None else "\n".join(keep)
    return out


@pytest.mark.parametrize("hot", [3000, 2])
@pytest.mark.parametrize("pct", [80, 75])
def test_against_all_pairs(spark, hot, pct, monkeypatch):
    rng = random.Random(hot + pct)
    vocab = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(3000)]
    docs = [(0, None), (1, ""), (2, "\n\n"), (3, "One\ntwo\none\n one "), (4, "Dé a b c d\n\ndÉ a b c d")]
    pool = []
    for k in range(5, 90):
        lines = []
        for _ in range(rng.randint(1, 9)):
            if pool and rng.random() < 0.5:
                w = rng.choice(pool)[:]
                for _ in range(rng.randint(0, 3)):
                    w[rng.randrange(len(w))] = rng.choice(vocab)
            else:
                w = [rng.choice(vocab) for _ in range(rng.randint(1, 30))]
            pool.append(w)
            lines.append(" ".join(w))
        docs.append((k, "\n".join(lines)))
    rng.shuffle(docs)
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, line int").repartition(3)
    real_posted, real_wide = line_dedup.posted, line_dedup.count_wide

    def small():  # runs in the worker, where the constants are set anew
        line_dedup.HOT, line_dedup.LONG, line_dedup.HELD = hot, 20, 50

    def posted(*args):
        small()
        yield from real_posted(*args)

    def count_wide(*args):
        small()
        yield from real_wide(*args)

    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "posted", posted)
    monkeypatch.setattr(line_dedup, "count_wide", count_wide)
    monkeypatch.setattr(line_dedup, "BUCKET", 200)
    got = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(df, pct).collect()}
    assert got == brute(docs, pct)


def test_empty_table(spark):
    assert line_dedup.without_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
