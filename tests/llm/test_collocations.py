import random
import re
from collections import Counter

import pytest

from sparkloom.llm import collocations


def brute(rows, max_n, least, pct, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, max_n + 1) for i in range(len(w) - k + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) >= 2 and a >= least}
    out = {}
    for (lang, p), a in cand.items():
        inside = any(g == lang and len(q) > len(p) and 100 * b >= pct * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in cand.items())
        if not inside:
            cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])}


def made(seed):
    rng = random.Random(seed)
    vocab = ["the", "Of", "new", "York", "city", "é", "Éa", "a b", "x1", "日本", "k"]
    rows = [(None, None), ("en", ""), ("de", " \t. ; "), ("en", None), ("", "one two"), ("und", "new york new york")]
    for k in range(150):
        words = [w + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\r\n"]) for w in rng.choices(vocab, [9, 5, 3, 3, 2, 2, 1, 1, 1, 1, 1], k=rng.randint(0, 60))]
        rows.append((rng.choice(["en", "en", "de", None, "fr"]), "".join(words)))
    return rows + [("en", "New York city. " * 300), ("en", "New York city. " * 300), ("fr", "of " * 2000)]


@pytest.mark.parametrize("max_n,block,ranked,bits", [(3, 4 << 20, 100_000, 16), (4, 500, 7, 8), (2, 100, 100_000, 16)])
def test_against_brute_force(spark, max_n, block, ranked, bits, monkeypatch):
    for name, value in (("BLOCK", block), ("RANKED", ranked), ("LEAST_BITS", bits), ("MOST_BITS", bits)):
        monkeypatch.setattr(collocations, name, value)
    rows = made(max_n)
    df = spark.createDataFrame([(i, g, t, 0, "x") for i, (g, t) in enumerate(rows)], "doc_id long, lang string, text string, count int, phrase string").repartition(4)
    got = collocations.collocations(df, max_n, 10, 50, 25).collect()
    want = brute(rows, max_n, 10, 50, 25)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert any(len(r.phrase.split(" ")) == max_n for r in got)


def test_blocks_end_between_pieces(monkeypatch):
    import numpy as np

    monkeypatch.setattr(collocations, "BLOCK", 10)
    text = b"aa bb cc dd ee ff gg hh. ii, jj" + b"kk"
    offsets = np.array([0, 0, 31, 33])
    got = list(collocations.blocks(np.frombuffer(text, np.uint8), offsets))
    assert [text[a:b] for a, b in got] == [b"aa bb cc dd ee ff gg hh.", b" ii,", b" jjkk"] or b"".join(text[a:b] for a, b in got) == text
    assert all(b == 31 or b == 33 or text[b - 1 : b] in b".," for _, b in got)


def test_codes_of_many_words(spark, monkeypatch):
    import numpy as np

    words = collocations.Words(np.frombuffer(b"a b a b a c", np.uint8), np.array([0, 11]), np.array([1 << 60]))
    lang, parts, count = words.counts(words.places(2), 2)
    names = [x.decode() for x in words.names.to_pylist()]
    assert {(int(g), names[p], names[q], int(c)) for g, p, q, c in zip(lang, *parts, count, strict=True)} == {(1 << 60, "a", "b", 2), (1 << 60, "b", "a", 2), (1 << 60, "a", "c", 1)}


def test_large_counts_and_empty_tables(spark):
    big = spark.createDataFrame([("en", "a b", 10**15 - 1, 2), ("en", "a", 10**15 - 1, 1), ("en", "b", 10**15 - 1, 1), ("en", "c", 3 * 10**14, 1), ("en", "a c", 3 * 10**14 - 1, 2)], "lang string, phrase string, count long, n_words int")
    got = {r.phrase: r.score for r in collocations.scored(big, 3).collect()}
    a, c = 10**15 - 1, 3 * 10**14 - 1
    assert got == {"a b": 1_000_000, "a c": 1_000_000 * c * c // (a * 3 * 10**14)}
    empty = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert collocations.collocations(empty).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(empty, max_n=1)
