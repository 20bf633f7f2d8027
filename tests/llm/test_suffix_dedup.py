import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import common, suffix_dedup


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(400):
        text = [rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 40))] + [0]
        assert suffix_dedup.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    text = ([1, 2] * 300 + [1, 1, 2] * 100) + [0]
    assert suffix_dedup.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def brute(docs):
    first: dict[bytes, int] = {}
    for i, t in sorted(docs, key=lambda x: x[0]):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [5000, 6])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "SYMBOLS", 500)
    merge, real = suffix_dedup.merge_marks, suffix_dedup.pieces

    def merge_marks(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffix_dedup.HOT = hot  # runs in the worker
        yield from merge(key, batches)

    def pieces(*args):
        suffix_dedup.HOT = hot
        yield from real(*args)

    monkeypatch.setattr(suffix_dedup, "merge_marks", merge_marks)
    monkeypatch.setattr(suffix_dedup, "pieces", pieces)
    rng = random.Random(6)
    make = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    lines = [make(n) for n in (30, 48, 49, 50, 51, 60, 75, 100, 140, 300)]
    docs = [(0, None), (1, ""), (2, "x" * 49), (3, "x" * 50), (4, "x" * 200), (5, "y" + "x" * 80), (6, "ab" * 60), (7, "ba" * 60)]
    for k in range(8, 70):
        t = "".join(make(rng.randint(0, 60)) + (rng.choice(lines)[rng.choice([0, 0, 5, 20]) :] if rng.random() < 0.7 else "") for _ in range(rng.randint(1, 8)))
        docs.append((k, t))
    docs += [(70, docs[20][1]), (71, docs[20][1] + "tail"), (72, docs[30][1][10:])]
    for k in range(73, 90):  # near copies
        t = list(docs[40][1])
        for _ in range(3):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        docs.append((k, "".join(t)))
    rng.shuffle(docs)
    df = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, key string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == brute(docs)


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), True).count() == 0


@pytest.mark.parametrize("crowded", [256, 10_000])
def test_an_anchor_with_many_different_neighbours(spark, monkeypatch, crowded):
    monkeypatch.setattr(suffix_dedup, "SYMBOLS", 300)
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    phrase = "=" * 3 + "one stock phrase that all have" + "=" * 3
    lefts, rights = [word(40) for _ in range(6)], [word(40) for _ in range(6)]
    docs = []
    for k in range(2500):
        left = rng.choice(lefts) if rng.random() < 0.01 else word(40)
        right = rng.choice(rights) if rng.random() < 0.01 else word(40)
        docs.append((k, left[rng.randrange(20) :] + phrase + right[: 40 - rng.randrange(20)]))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect()}
    want = brute(docs)
    assert got == want and sum(x[1] > 0 for x in want.values()) > 20


def test_sub_keys():
    raw = b"b" * 20 + b"anchor-of-16-byt" + b"a" * 20
    one, two = suffix_dedup.sub_keys(-5, 20, raw)
    assert suffix_dedup.sub_keys(-5, 16, raw[4:]) == [one, two] and suffix_dedup.sub_keys(-5, 20, raw[:50]) == [two]
    assert suffix_dedup.sub_keys(-5, 15, raw[5:]) == [one] and suffix_dedup.sub_keys(6, 20, raw) != [one, two]


def test_one_very_long_text(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3_000_000))
    df = spark.createDataFrame([(1, text), (2, "x" + text[1000:2000] + "y")], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == {1: 0, 2: 1000}


def test_a_short_phrase_in_common_is_no_anchor():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    texts = [word(60) + "of one and the other" + word(60) for _ in range(300)]
    found = suffix_dedup.Anchors(pa.array(texts))
    assert len(np.unique(found.key)) == len(found.key) > 600


def test_only_first_copies_of_a_salt_are_looked_up(spark, monkeypatch):
    merge, real, stage = suffix_dedup.merge_marks, suffix_dedup.pieces, common.Stages.stage
    rows = {}

    def merge_marks(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from merge(key, batches)

    def pieces(*args):
        yield from real(*args)

    def counted(self, df, tag):
        out = stage(self, df, tag)
        rows[tag] = out.count()
        return out

    # what a patched name hides is pickled with its globals, so that workers have this number too
    monkeypatch.setattr(suffix_dedup, "HOT", 60)
    monkeypatch.setattr(suffix_dedup, "merge_marks", merge_marks)
    monkeypatch.setattr(suffix_dedup, "pieces", pieces)
    monkeypatch.setattr(common.Stages, "stage", counted)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    text, lines = word(400), [word(n) for n in (45, 60, 90)]
    docs = [(k, text[k % 3 :]) for k in range(0, 1200, 2)]
    docs += [(k, "".join(word(rng.randint(0, 40)) + rng.choice([*lines, text])[rng.choice([0, 7]) :][:80] for _ in range(3))) for k in range(1, 800, 2)]
    before = spark.conf.get(suffix_dedup.CLEANUP)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == brute(docs) and spark.conf.get(suffix_dedup.CLEANUP) == before
    assert 0 < rows["rows"] < rows["pieces"] / 4
