import numpy as np
import pytest

from sparkloom.llm import common, language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_calibration(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pred = language_id.op4_language_id(spark, SF).join(docs, "doc_id").filter("held_out and lang is not null").collect()
    assert len(pred) > 100
    assert sum(r.lang_pred == r.lang for r in pred) / len(pred) > 0.95
    assert sum(r.rejected for r in pred) / len(pred) < 0.03
    assert all(0 <= r.score <= 1 for r in pred)


def test_a_text_is_scored_alike_in_any_batch():
    rows = [("the cat and the dog", "en"), ("der hund und die katze", "de")] * 30
    model = language_id.train(rows)
    texts = ["the dog", None, "", "123 ...", "a", "die katze\x00und", "É", "the cat" * 500]
    lang, score = model.predict(texts)
    for t, a, b in zip(texts, lang, score, strict=True):
        one, p = model.predict([t])
        assert one == [a] and p[0] == pytest.approx(b)
    assert lang[1:4] == ["und"] * 3 and list(score[1:4]) == [0, 0, 0]
    assert lang[0] == "en" and lang[7] == "en"


def test_edge_tables(spark):
    schema = "doc_id long, text string, lang string, lang_pred string, score int"
    df = spark.createDataFrame([(1, "some text", None, "x", 1), (None, None, "en", None, None)], schema)
    out = language_id.identify(df, language_id.fit_on(df), ["doc_id"]).collect()
    assert [r.lang_pred for r in out] == ["und", "und"] and all(r.rejected for r in out)
    assert language_id.identify(df.limit(0), language_id.fit_on(df.limit(0)), ["doc_id"]).count() == 0


def brute(text, languages, emb, w, bias, temperature):
    """Mean embedding of the n-grams of letters, one by one, under the unfolded layers."""
    low = [c if c.isalpha() else " " for c in text.lower()]
    parts = "".join(low).split()
    if not parts:
        return "und", 0.0
    total, n = np.zeros(emb.shape[1]), 0
    for word in parts:
        marked = [0, *map(ord, word), 0]
        for size in (2, 3, 4):
            for k in range(len(marked) - size + 1):
                gram = marked[k : k + size]
                h = size
                for c in gram:
                    h = ((h ^ c) * 0x9E3779B97F4A7C15) % (1 << 64)
                    h ^= h >> 32
                total += emb[(h >> 8) % (1 << language_id.BUCKET_BITS)].astype(float)
                n += 1
    z = w.astype(float) @ (total / n) + bias
    p = np.exp((z - z.max()) / temperature)
    p /= p.sum()
    return languages[int(p.argmax())], float(p.max())


def test_the_folded_table_against_unfolded_layers(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("lang is not null and text is not null").limit(150).collect()
    rows = [(r.text[:3000], r.lang) for r in docs]
    languages, emb, w, bias, temperature = language_id.fit(rows)
    model = language_id.Model(languages, (emb @ w.T).astype(np.float32), bias, temperature)
    texts = [t for t, _ in rows[:60]] + ["a", "É x", "12 a-b", "...", "", "das ist  ein\nSatz, mit (Zeichen)!", "x" * 3000]
    lang, score = model.predict(texts)
    for t, a, p in zip(texts, lang, score, strict=True):
        want, q = brute(t, languages, emb, w, bias, temperature)
        assert a == want and p == pytest.approx(q, abs=1e-4), t[:40]


def test_the_sample_is_bounded(spark):
    rows = [(k, "".join(chr(97 + (k + j) % 26) for j in range(900 if k % 3 else 20)), f"l{k % 40:02}") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    done = common.Stages()
    got = language_id.sampled(docs, done, sample=20, rows=400, chars=10_000).collect()
    assert len({r.lang for r in got}) == 40 and sum(len(r.text) for r in got) <= 2 * 10_000 and len(got) < 2 * 400
    assert len(language_id.sampled(docs, done, sample=20).collect()) > 400
    # windows begin anywhere
    text = "abcdefghijklmnopqrstuvwxyz" * 40
    many = spark.createDataFrame([(k, text, "x") for k in range(300)], "doc_id long, text string, lang string")
    assert len({r.text[0] for r in language_id.sampled(many, done, chars=10_000).collect()}) > 10
    with done:
        assert done.frames
    assert not done.frames


def test_one_very_long_text(spark):
    docs = spark.createDataFrame([(k, t, g) for k, (t, g) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 40)], "doc_id long, text string, lang string")
    model = language_id.fit_on(docs)
    long = spark.createDataFrame([(1, "the cat and the dog " * 200_000), (2, "die katze")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.identify(long, model, ["doc_id"]).collect()} == {1: "en", 2: "de"}
