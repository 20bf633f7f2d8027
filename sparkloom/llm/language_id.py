"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean embedding of its letter n-grams (2 to 4, with word borders); embeddings and classifier are
trained together by stochastic gradient descent in numpy on a bounded sample. A temperature fitted on
held-back sample rows calibrates the probability, and a prediction below ``min_confidence`` is
rejected. For prediction the two linear layers fold into one table of a few floats a bucket.

Scale: training looks at about ``SAMPLE`` rows of a language (drawn by hash, so alike at every size), fewer where there are so many
languages that ``ROWS`` are reached, and at a window of each text, drawn anywhere in it, so that all windows together have at
most ``CHARS`` characters: that is what the driver holds. Prediction is one pass over whole texts without a shuffle; a very long text is
worked on by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textvec

#: The bounds of the sample: labelled rows of a language, about, and of all languages, and characters of all.
SAMPLE = 1200
ROWS = 100_000
CHARS = 24_000_000
BUCKET_BITS = 16
DIM = 16
EPOCHS = 5
MIN_CONFIDENCE = 0.5

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def sequence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of lower-cased letters, 0 for each run of others and at both ends of a text; each text's first place; has it letters."""
    low = ["\x00" + (t or "").lower() + "\x00" for t in texts]
    size = np.array([len(t) for t in low])
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    code = np.where(letters()[code], code, 0).astype(np.uint64)
    first = np.cumsum(size) - size
    keep = code > 0
    some = np.add.reduceat(keep, first) > 0
    keep[1:] |= code[:-1] > 0
    keep[first] = True
    at = np.cumsum(keep) - keep
    return code[keep], at[first], some


def buckets(seq: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram at each place, and whether it is one: no border inside, not a border alone."""
    m = len(seq) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    h = np.full(m, n, np.uint64)
    for k in range(n):
        h = (h ^ seq[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    letter = seq > 0
    ok = letter[1 : 1 + m].copy() if n > 2 else letter[:m] | letter[1 : 1 + m]
    for k in range(2, n - 1):
        ok &= letter[k : k + m]
    return (h >> np.uint64(8)).astype(np.int64) & ((1 << BUCKET_BITS) - 1), ok


class Model:
    """``table``: for each bucket a row of scores (the last row is 0); ``bias``, ``temperature``, ``languages``."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages, self.table, self.bias, self.temperature = languages, table, bias, temperature

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        seq, first, some = sequence(texts)
        total = np.zeros((len(texts), len(self.languages)))
        count = np.zeros(len(texts))
        for n in (2, 3, 4):
            at, ok = buckets(seq, n)
            if not len(at):
                continue
            begin = np.minimum(first, len(at) - 1)
            at = np.where(ok, at, 1 << BUCKET_BITS)
            # a text that begins beyond the last place has no n-gram of this length
            inside = first < len(at)
            for c in range(len(self.languages)):
                total[:, c] += np.where(inside, np.add.reduceat(self.table[:, c][at], begin, dtype=np.float64), 0)
            count += np.where(inside, np.add.reduceat(ok, begin, dtype=np.int64), 0)
        return total / np.maximum(count, 1)[:, None] + self.bias, some & (count > 0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        z, some = self.logits(texts)
        p = softmax(z / self.temperature)
        best = p.argmax(1)
        return [self.languages[b] if s else "und" for b, s in zip(best, some, strict=True)], np.where(some, p.max(1), 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def bags(text: str, rng: np.random.Generator, pieces: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The whole text and random stretches of it as (buckets, weights summing to 1)."""
    out = []
    cuts = [text]
    for _ in range(pieces):
        n = int(rng.integers(15, 400))
        a = int(rng.integers(0, max(1, len(text) - n)))
        cuts.append(text[a : a + n])
    for t in cuts:
        seq, _, some = sequence([t])
        if some[0]:
            ids = np.concatenate([at[ok] for at, ok in (buckets(seq, n) for n in (2, 3, 4))])
            u, c = np.unique(ids, return_counts=True)
            out.append((u, (c / c.sum()).astype(np.float32)))
    return out


def train(rows: list[tuple[str, str]], seed: int = 11) -> Model:
    """Fit on (text, language) rows, the two layers folded into one table."""
    languages, emb, w, bias, temperature = fit(rows, seed)
    return Model(languages, (emb @ w.T).astype(np.float32), bias, temperature)


def fit(rows: list[tuple[str, str]], seed: int = 11) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, float]:
    """Languages, embeddings of buckets, weights, bias and temperature; a fifth of the rows only calibrates."""
    languages = sorted({lang for _, lang in rows})
    k = len(languages)
    if not k:
        return [], np.zeros((1, DIM), np.float32), np.zeros((0, DIM), np.float32), np.zeros(0), 1.0
    number = {lang: i for i, lang in enumerate(languages)}
    rng = np.random.default_rng(seed)
    fitted, held = [], []
    for i in rng.permutation(len(rows)):
        text, lang = rows[i]
        (held if rng.random() < 0.2 and len(rows) > 20 else fitted).extend((b, number[lang]) for b in bags(text, rng, 2))
    emb = rng.uniform(-1 / DIM, 1 / DIM, ((1 << BUCKET_BITS) + 1, DIM)).astype(np.float32)
    emb[-1] = 0
    w, bias = np.zeros((k, DIM), np.float32), np.zeros(k, np.float32)
    steps, done = EPOCHS * len(fitted), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(fitted)):
            (u, c), y = fitted[i]
            rate = 0.5 * (1 - done / steps)
            done += 1
            rows_ = emb[u]
            h = c @ rows_
            d = softmax(w @ h + bias)
            d[y] -= 1
            emb[u] = rows_ - (rate * 20) * np.outer(c, d @ w)
            w -= rate * np.outer(d, h)
            bias -= rate * 0.1 * d
    table = emb @ w.T
    z = np.array([c @ table[u] + bias for (u, c), _ in held or fitted])
    y = np.array([y for _, y in held or fitted])
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return languages, emb, w, bias, float(grid[int(np.argmin(loss))])


def sampled(docs: DataFrame, done: common.Stages, sample: int = SAMPLE, rows: int = ROWS, chars: int = CHARS) -> DataFrame:
    """(text, lang, u): windows of about ``sample`` texts of each language with ``crc32(doc_id) mod 5`` not 0, in drawn order ``u``.

    At most ``rows`` windows, about, and ``chars`` characters in all, whatever the number of languages and the length of texts.
    """
    usable = docs.filter("lang is not null and text is not null and doc_id is not null").filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
    counts = done.stage(usable.select(F.col("lang").alias("of")).groupBy("of").agg(F.count("*").alias("n")), "languages")
    languages = counts.count()
    each = max(1, min(sample, rows // max(1, languages)))
    size = max(1, chars // max(1, each * languages))
    draw = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # one row a language, broadcast if counted as small: texts are not shuffled by language
    drawn = usable.select("doc_id", "text", "lang").join(common.small(counts), F.col("lang") == F.col("of")).filter(draw * F.col("n") < each)
    start = F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.greatest(F.lit(1), F.length("text") - F.lit(size) + 1)) + 1
    return drawn.select(F.substr("text", start.cast("int"), F.lit(size)).alias("text"), "lang", draw.alias("u"))


def fit_on(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on a bounded sample of the labelled rows whose ``crc32(doc_id) mod 5`` is not 0, of every language."""
    with common.Stages() as done:
        rows = [(r.text, r.lang) for r in sampled(docs, done, sample).sort("u", "lang", F.xxhash64("text")).collect()]
    model = train(rows)
    del rows
    common.trim()
    return model


NAMES = ("lang_pred", "score", "rejected")


def identify(docs: DataFrame, model: Model, keep: list[str], min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Columns ``keep`` of every row, with lang_pred, score and rejected (which ``keep`` must not hold).

    Null texts and texts without letters give ``und``, score 0, rejected. Only the text is an input. Nulls elsewhere, repeated
    rows and further columns pass through; an empty table gives an empty one.
    """
    if set(NAMES) & set(keep):
        raise ValueError(f"{NAMES} are names of results")
    return _predicted(docs, model, keep, min_confidence, False)


def accepted(docs: DataFrame, model: Model, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """The rows of ``docs``, whatever their columns, whose language is not rejected."""
    return _predicted(docs, model, docs.columns, min_confidence, True)


def _predicted(docs: DataFrame, model: Model, keep: list[str], min_confidence: float, only: bool) -> DataFrame:
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    at = "text" if "text" in keep else common.free_names(docs, "text")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textvec.slices(batch, at):
                lang, score = model.predict(part.column(at).to_pylist())
                low = np.array([x == "und" for x in lang], bool) | (score < min_confidence)
                out = pa.RecordBatch.from_arrays([part.column(c) for c in keep], names=keep)
                if only:
                    yield out.filter(pa.array(~low))
                else:
                    more = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(low)]
                    yield pa.RecordBatch.from_arrays([*out.columns, *more], names=[*keep, *NAMES])

    read = common.texts(docs, *(f"`{c}`" for c in keep), *([] if at == "text" else [F.col("text").alias(at)]))
    return read.mapInArrow(common.tidy(run), ", ".join(fields if only else [*fields, "lang_pred string", "score double", "rejected boolean"]))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, fit_on(docs), ["doc_id"])
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
