import random

import pyarrow as pa

from sparkloom.llm import token_trees, tokens

from .test_tokens import ODD

PATH = tokens.public("byte_bpe_50k.json")
BITS = ["a", "Bcd", " ", " ", " ", "\n", "  ", "é", "don't", ".", "12", "日", "\t", "。", "'", "<|endoftext|>", "|", "\x1f", "ê", "\u0301"]


def some_text(rng, n):
    return "".join(rng.choice(BITS) for _ in range(n))


def test_counts_follow_edits(monkeypatch):
    monkeypatch.setattr(token_trees, "LEAF", 12)
    enc = tokens.Encoder(PATH, "byte")
    count = lambda t: len(enc.whole(t))
    rng = random.Random(8)
    for _ in range(150):
        text = some_text(rng, rng.randint(0, 120))
        ((texts, counts),) = token_trees.leaves(enc, pa.array([text]))
        tree = token_trees.TokenTree(texts, counts)
        for _ in range(12):
            assert tree.text == text and tree.total == count(text)
            start, length, new = rng.randint(0, len(text) + 2), rng.choice([0, 1, 3, 40]), some_text(rng, rng.choice([0, 1, 2, 30]))
            tree.edit(start, length, new, count)
            text = text[:start] + new + text[min(start, len(text)) + length :]
        assert tree.ids[1] == sum(tree.ids[tree.width :])


def test_edits_are_local():
    enc = tokens.Encoder(PATH, "byte")
    ((texts, counts),) = token_trees.leaves(enc, pa.array(["some words " * 20000 + "end"]))
    tree = token_trees.TokenTree(texts, counts)
    tree.edit(100_000, 3, "x y", lambda t: len(enc.whole(t)))
    assert tree.encoded < 1000


def test_large_edits_are_local():
    enc = tokens.Encoder(PATH, "byte")
    count = lambda t: len(enc.whole(t))
    chinese = "".join(chr(0x4E00 + (k * 7919) % 5000) + ("，" if k % 17 == 0 else "") for k in range(60_000))
    for text in ("some words " * 20000 + "end", chinese):
        ((texts, counts),) = token_trees.leaves(enc, pa.array([text]))
        tree = token_trees.TokenTree(texts, counts)
        new = "a new sentence, " * 80
        for start in (30_000, 10, 50_000):
            tree.edit(start, 5, new, count)
            text = text[:start] + new + text[start + 5 :]
        assert tree.text == text and tree.total == count(text)
        assert tree.encoded < 3 * (len(new) + 2000)
    tree = token_trees.TokenTree(*(next(token_trees.leaves(enc, pa.array([""])))))
    tree.edit(0, 0, "x y " * 3000, count)
    assert tree.total == count("x y " * 3000)


def test_tables(spark):
    rng = random.Random(1)
    docs = [(k, t) for k, t in enumerate([*ODD, *(some_text(rng, rng.randint(0, 900)) for _ in range(40))])]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, counts int").repartition(3)
    enc = tokens.Encoder(PATH, "byte")
    trees = token_trees.build_trees(df, PATH)
    got = {r.doc_id: r for r in trees.collect()}
    assert all("".join(got[i].leaves) == (t or "") and got[i].n_tokens == len(enc.whole(t or "")) for i, t in docs)
    edits = [(3, 2, 0, 1, "zz"), (3, 1, 1, 0, " q "), (5, 0, None, None, None), (999, 0, 0, 0, "x")]
    new = {r.doc_id: r for r in token_trees.apply_edits(trees, spark.createDataFrame(edits, "doc_id long, seq int, start long, length long, new string"), PATH).collect()}
    want = dict(docs)
    want[3] = "zz" + ("a q   b")[1:]
    assert {i: r.n_tokens for i, r in new.items()} == {i: len(enc.whole(t or "")) for i, t in want.items()}
    for r in token_trees.revise(df, PATH).collect():
        text = dict(docs)[r.doc_id] or ""
        assert r.n_tokens == len(enc.whole(text))
        for start, length, x in token_trees.revision(text):
            text = text[:start] + x + text[start + length :]
        assert r.n_edited == len(enc.whole(text))
    assert token_trees.revise(df.limit(0), PATH).count() == 0
