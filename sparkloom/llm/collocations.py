"""Phrases whose words stand together more often than by chance, per language.

All phrases of 1 to ``max_n`` words are exploded into rows (language, phrase, count), counted by a hash aggregate; a candidate
meets the counts of its two parts for every cut, is scored in Decimal, leaves by an anti-join with its one-word extensions, and
the rest is ranked by a window.

Scale: a task counts the phrases of each block of text before it hands them on, so the exchange gets a row for each phrase and
task. Phrases of three and more words are exploded where both phrases of one word less may be
frequent: those are marked in a bitmap of 16 bits each (64 MB at most; on a larger corpus the bitmap drops less, and counts
stay exact, as unfrequent phrases leave after counting). A word that starts a large share of all phrases is a hot
key of the join with the counts: a table of counts of known size is broadcast, a larger one is joined with skew handling (AQE).
Languages are ranked in salted groups first, then as a whole.

Nulls: a null text is empty, a null lang is ``und``. Empty texts and tables give no phrase. Repeated rows count each. Very long texts are
worked on in blocks cut between pieces (a task holds some 30 times a block, or a piece if that is longer). Other columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, textvec

#: Bytes of text that are counted at once.
BLOCK = 4 << 20
#: Rows of a batch that goes back to Spark.
ROWS = 50_000
#: The bitmap has ``2 ** bits`` bits, at least and at most.
LEAST_BITS, MOST_BITS = 16, 29
#: Bytes of a part of the bitmap on its way to the driver.
PART_BITS = 19
#: Bytes of counted phrases that may be broadcast.
SENT = 16 << 20
#: Rows of a language that one task ranks, about.
RANKED = 100_000

COUNTED = "lang string, phrase string, count long"

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
_P = np.uint64(0x9E3779B97F4A7C15)


def blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``BLOCK`` bytes that end with a row or a separator."""
    at, size = 0, len(data)
    while at < size:
        to = min(at + BLOCK, size)
        if to < size:
            row = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            cut = np.flatnonzero(_SEPARATOR[data[at:to]])
            best = max(row, at + int(cut[-1]) + 1 if len(cut) else 0)
            if best <= at:  # one piece is longer
                row = int(offsets[np.searchsorted(offsets, to)])
                cut = np.flatnonzero(_SEPARATOR[data[to:row]])
                best = to + int(cut[0]) + 1 if len(cut) else row
            to = best
        yield at, to
        at = to


class Words:
    """The words of a block: number of each in ``names``, language, and whether the next word follows it in its piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        ends_piece = _SEPARATOR[data]
        word = ~(ends_piece | (data == 32) | (data == 9))
        starts, ends, _ = textvec.spans(word, offsets)
        row = np.searchsorted(offsets, starts, "right") - 1
        piece = np.cumsum(ends_piece)[starts]
        self.follows = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
        self.lang = langs[row].astype(np.int64)
        size = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=size[1:])
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(size), pa.py_buffer(data[word])])
        coded = column.dictionary_encode()
        self.names: pa.Array = coded.dictionary
        self.ids = coded.indices.to_numpy().astype(np.int64)

    def places(self, n: int) -> np.ndarray:
        """Where a phrase of ``n`` words starts."""
        many = len(self.ids) - n + 1
        if many <= 0:
            return np.zeros(0, np.int64)
        ok = np.ones(many, bool)
        for k in range(n - 1):
            ok &= self.follows[k : k + many]
        return np.flatnonzero(ok)

    def hashes(self, at: np.ndarray, n: int, lang_hashes: np.ndarray) -> np.ndarray:
        """64-bit hashes of the language and the ``n`` words from each place on."""
        raw, offsets = textvec.buffers(self.names)
        words = textvec.word_hashes(raw, offsets[:-1], offsets[1:])
        h = lang_hashes[self.lang[at]]
        for k in range(n):
            h = textvec.mix(h * _P + words[self.ids[at + k]])
        return h

    def counts(self, at: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Languages, word numbers and counts of the different phrases of ``n`` words at ``at``."""
        many = len(self.names)
        code, span, tables = self.lang[at], int(self.lang.max(initial=0)) + 1, []
        for k in range(n):
            table = None
            if span * many >= 1 << 62:  # numbers of the phrases so far, instead of their codes
                table, code = np.unique(code, return_inverse=True)
                span = len(table)
            code, span = code * many + self.ids[at + k], span * many
            tables.append(table)
        code = np.sort(code)
        head = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
        count, code = np.diff(np.append(head, len(code))), code[head]
        words: list[np.ndarray] = []
        for table in reversed(tables):
            code, word = np.divmod(code, many)
            words.append(word)
            if table is not None:
                code = table[code]
        return code, words[::-1], count


def languages(column) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Names, the number of each row's, and hashes of the names; null is ``und``."""
    coded = pc.fill_null(column, "und").dictionary_encode()
    raw, offsets = textvec.buffers(coded.dictionary)
    return coded.dictionary, coded.indices.to_numpy(), textvec.word_hashes(raw, offsets[:-1], offsets[1:])


def rows_of(langs: pa.Array, phrases: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(counts), ROWS):
        cols = [langs.slice(k, ROWS).cast(pa.string()), phrases.slice(k, ROWS).cast(pa.string()), pa.array(counts[k : k + ROWS], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["lang", "phrase", "count"])


def exploded(sizes: list[int], bitmap) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, text) -> rows of the phrases of so many words; size 0 counts all words under the empty phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, langs, hashed = languages(batch.column("lang"))
            data, offsets = textvec.buffers(batch.column("text"))
            data = textvec.lower(data)
            for a, b in blocks(data, offsets):
                words = Words(data[a:b], np.clip(offsets, a, b) - a, langs)
                for n in sizes:
                    if not n:
                        total = np.bincount(words.lang, minlength=len(names))
                        some = np.flatnonzero(total)
                        yield from rows_of(names.take(pa.array(some)), pa.array([""] * len(some)), total[some])
                        continue
                    at = words.places(n)
                    if bitmap is not None:
                        at = at[found(bitmap.value, words.hashes(at, n - 1, hashed))]
                        at = at[found(bitmap.value, words.hashes(at + 1, n - 1, hashed))]
                    lang, parts, count = words.counts(at, n)
                    columns = [words.names.take(pa.array(p)) for p in parts]
                    phrases = pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.large_binary())) if n > 1 else columns[0]
                    yield from rows_of(names.take(pa.array(lang)), phrases, count)

    return common.tidy(run)


def found(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - int(len(bitmap) * 64).bit_length() + 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def marked(n: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, phrase) of ``n`` words -> parts of the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        size = 1 << min(bits, PART_BITS)
        for batch in batches:
            _, langs, hashed = languages(batch.column("lang"))
            data, offsets = textvec.buffers(batch.column("phrase"))
            words = Words(data, offsets, langs)
            h = words.hashes(words.places(n), n, hashed)
            at = np.unique(h >> np.uint64(64 - bits)).astype(np.int64)
            for part in np.unique(at // size).tolist():
                mine = parts.setdefault(part, np.zeros(size, bool))
                mine[at[at // size == part] % size] = True
        for part, mine in parts.items():
            packed = zlib.compress(np.packbits(mine, bitorder="little").tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([packed], pa.binary())], names=["part", "bits"])

    return common.tidy(run)


def merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for x in batch.column("bits"):
            one = np.frombuffer(zlib.decompress(x.as_py()), np.uint8)
            total = one.copy() if total is None else total | one
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["part", "bits"])


def bitmap_of(phrases: DataFrame, n: int) -> np.ndarray:
    """Marks of the phrases' hashes; its size is bounded, whatever their number."""
    bits = min(max(LEAST_BITS, (16 * max(1, phrases.count())).bit_length()), MOST_BITS)
    kind = "part int, bits binary"
    parts = phrases.select("lang", "phrase").mapInArrow(marked(n, bits), kind).groupBy("part").applyInArrow(merged, kind)
    out = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (min(bits, PART_BITS) - 3)
    for r in parts.toLocalIterator():
        out[r.part * size : (r.part + 1) * size] = np.frombuffer(zlib.decompress(bytes(r.bits)), np.uint8)
    return out.view("<u8")


def phrase_counts(docs: DataFrame, max_n: int, least: int, done: common.Stages) -> DataFrame:
    """(lang, phrase, count, n_words) of every phrase of 1 to ``max_n`` words that occurs ``least`` times or more; the empty phrase (0 words) counts all words."""
    source = common.texts(docs, F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    levels, before = [], None
    for sizes in [[0, 1, 2], *([n] for n in range(3, max_n + 1))]:
        bitmap = done.share(source.sparkSession, bitmap_of(before, sizes[0] - 1)) if before is not None else None
        rows = source.mapInArrow(exploded(sizes, bitmap), COUNTED).groupBy("lang", "phrase").agg(F.sum("count").alias("count"))
        n_words = F.when(F.col("phrase") == "", 0).otherwise(F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1)
        level = done.stage(rows.filter((F.col("count") >= least) | (F.col("phrase") == "")).withColumn("n_words", n_words), f"phrases_{sizes[-1]}")
        levels.append(level)
        before = level.filter(F.col("n_words") == sizes[-1])
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out


def sent_whole(counts: DataFrame) -> DataFrame:
    """A broadcast hint for a staged table of counts, if its counted bytes are within ``SENT``."""
    size = counts.agg(F.sum(F.octet_length("lang") + F.octet_length("phrase") + 64)).first()[0]
    return F.broadcast(counts) if (size or 0) <= SENT else counts


def scored(counts: DataFrame, max_n: int) -> DataFrame:
    """(lang, phrase, a, l, r, score, n_words) of every candidate: the lowest score of its cuts, the first of equal ones."""
    cuts = (
        counts.filter("n_words >= 2")
        .select("lang", "phrase", F.col("count").alias("a"), "n_words", F.explode(F.expr("sequence(1, n_words - 1)")).alias("cut"))
        .withColumn("first", F.expr("substring_index(phrase, ' ', cut)"))
        .withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    )
    parts = sent_whole(counts.filter(F.col("n_words").between(1, max_n - 1)).select("lang", "phrase", "count"))
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(part), F.col("count").alias(name)), ["lang", part])
    a, left, right = (F.col(c).cast("decimal(15,0)") for c in "alr")
    cuts = cuts.withColumn("up", a * a * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("down", left * right).withColumn("score", F.expr("up div down"))
    best = cuts.groupBy("lang", "phrase", "a", "n_words").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score", "n_words")


def not_subsumed(candidates: DataFrame, pct: int) -> DataFrame:
    """Candidates without a longer one that holds them and has ``pct`` percent of their count. A one-word extension decides: what holds a phrase holds one of those, which is at least as frequent."""
    first = F.expr("substring_index(phrase, ' ', n_words - 1)")
    rest = F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)")
    longer = (
        candidates.filter("n_words >= 3")
        .select(F.col("lang").alias("lang_"), F.explode(F.array(first, rest)).alias("inside"), "a")
        .groupBy("lang_", "inside")
        .agg(F.max("a").alias("most"))
    )
    covered = (F.col("lang") == F.col("lang_")) & (F.col("phrase") == F.col("inside")) & (100 * F.col("most") >= pct * F.col("a"))
    return candidates.join(longer, covered, "left_anti")


def collocations(docs: DataFrame, max_n: int = 3, least: int = 10, pct: int = 50, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each language by score, count and text: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends, and these into words at spaces and tabs. ``a`` counts a phrase of 2 to
    ``max_n`` words within pieces, candidates have ``least`` or more; ``l`` and ``r`` count its two parts at the cut that gives the lowest
    score ``floor(1000000 * a * a / (l * r))``; ``n`` counts the language's words. A candidate inside a longer
    one that has ``pct`` percent of its count or more goes. Counts up to 10**15 are exact.
    """
    if max_n < 2:
        raise ValueError("a phrase that can be cut has two words")
    spark: SparkSession = docs.sparkSession
    with common.Stages() as done:
        counts = phrase_counts(docs, max_n, least, done)
        rows = done.stage(scored(counts, max_n), "scored")
        left = done.stage(not_subsumed(rows, pct).drop("n_words"), "left")
        best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
        ranked = left
        groups = -(-left.count() // RANKED)
        if groups > 1:
            salted = Window.partitionBy("lang", F.expr(f"pmod(xxhash64(phrase), {groups})")).orderBy(*best)
            ranked = left.withColumn("place", F.row_number().over(salted)).filter(F.col("place") <= top).drop("place")
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
        total = counts.filter("n_words = 0").select("lang", F.col("count").alias("n"))
        out = common.stage(ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    return spark.read.schema(out.schema).parquet(out._stage_path)


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
