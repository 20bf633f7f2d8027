"""Benchmark decontamination by Wu-Manber search over words.

A benchmark item's windows (13 consecutive words, or all words of a shorter item) are the patterns, words the
symbols. For patterns of m symbols, a table over hashed blocks of two symbols (one, where m is 1) says how far the search may
jump; where it says 0, the hash of the pattern's last block selects a bucket of patterns, and direct
comparison, first of all word hashes and then of the words' bytes, confirms an occurrence.
All texts of a slice advance together, a position each (long texts as several runs), so the search is numpy throughout.

Scale: the documents are read once for each block of patterns (at most ``PATTERN_WORDS`` words,
a proven bound on what each task holds) and never shuffled when one block is enough;
with more blocks, only hit positions are grouped by document. Skew of documents does not matter: each is
searched where it lies.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textvec

WINDOW = 13
#: Words of benchmark text in one block of patterns.
PATTERN_WORDS = 200_000
#: Long texts are searched as runs of so many positions.
RUN = 512
TABLE_BITS = 20


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of letters, digits and non-ASCII bytes."""
    data = textvec.lower(np.frombuffer((text or "").encode(), np.uint8))
    starts, ends, _ = textvec.spans(textvec.alnum(data), np.array([0, len(data)]))
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def blocks2(h: np.ndarray) -> np.ndarray:
    """Hashes of two adjacent symbols, at the second one's place (place 0 is not a block)."""
    out = np.zeros(len(h), np.uint64)
    out[1:] = textvec.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    return out


def slot(block: np.ndarray) -> np.ndarray:
    return (block >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


class Patterns:
    """Shift table, suffix buckets and test strings of all patterns of one length."""

    def __init__(self, m: int, patterns: dict[tuple[bytes, ...], list[str]]):
        self.m, self.b = m, min(2, m)
        self.words = list(patterns)
        self.items = [patterns[p] for p in self.words]
        flat = [w for p in self.words for w in p]
        lens = np.array([len(w) for w in flat])
        data = np.frombuffer(b"".join(flat), np.uint8)
        ends = np.cumsum(lens)
        self.hashes = textvec.word_hashes(data, ends - lens, ends).reshape(len(self.words), m)
        self.shift = np.full(1 << TABLE_BITS, m - self.b + 1, np.int16)
        for at in range(self.b - 1, m):  # the block that ends at symbol `at`
            if self.b == 2:
                block = textvec.mix(self.hashes[:, at - 1] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[:, at])
            else:
                block = self.hashes[:, at]
            np.minimum.at(self.shift, slot(block), np.int16(m - 1 - at))
        order = np.argsort(block, kind="stable")
        self.last, self.bucket = block[order], order

    def search(self, h: np.ndarray, block: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end position, pattern) of occurrences in hash; positions from ``first`` up to ``last`` of each run end a window."""
        found_at, found = [], []
        at = first.copy()
        live = np.flatnonzero(at < last)
        at, last = at[live], last[live]
        while len(at):
            here = block[at]
            jump = self.shift[slot(here)].astype(np.int64)
            stop = np.flatnonzero(jump == 0)
            if len(stop):
                key, pos = here[stop], at[stop]
                a, b = np.searchsorted(self.last, key, "left"), np.searchsorted(self.last, key, "right")
                n = b - a
                who = np.repeat(np.arange(len(stop)), n)
                cand = self.bucket[np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                end = pos[who]
                if len(end):
                    same = (h[end[:, None] + np.arange(-self.m + 1, 1)] == self.hashes[cand]).all(1)
                    found_at.append(end[same])
                    found.append(cand[same])
                jump[stop] = 1
            at = at + jump
            go = at < last
            at, last = at[go], last[go]
        none = np.zeros(0, np.int64)
        return (np.concatenate(found_at), np.concatenate(found)) if found else (none, none)


def compile_patterns(items: list[tuple[str | None, str | None]], window: int) -> list[Patterns]:
    by_length: dict[int, dict] = defaultdict(lambda: defaultdict(list))
    for item, text in items:
        w = words_of(text)
        m = min(window, len(w))
        for k in range(len(w) - m + 1) if m else []:
            owners = by_length[m][tuple(w[k : k + m])]
            if item is not None and item not in owners:
                owners.append(item)
    return [Patterns(m, p) for m, p in sorted(by_length.items())]


HITS = "row long, doc_id long, n_words long, hits binary, items array<string>"


def scan(batches: Iterator[pa.RecordBatch], patterns: list[Patterns]) -> Iterator[pa.RecordBatch]:
    """Per document: its number of words, hit spans as int64 pairs (first word, end) and items that occur."""
    for batch in batches:
        for part in textvec.slices(batch, "text"):
            data, offsets = textvec.buffers(part.column("text"))
            data = textvec.lower(data)
            starts, ends, first = textvec.spans(textvec.alnum(data), offsets)
            h = textvec.word_hashes(data, starts, ends)
            spans: dict[int, list] = defaultdict(list)
            items: dict[int, set] = defaultdict(set)
            pair = blocks2(h)
            for p in patterns:
                lo, hi = first[:-1] + p.m - 1, first[1:]
                n = np.maximum(0, -(-(hi - lo) // RUN))
                run = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                begin = np.repeat(lo, n) + run * RUN
                stop = np.minimum(begin + RUN, np.repeat(hi, n))
                at, which = p.search(h, pair if p.b == 2 else h, begin, stop)
                row = np.searchsorted(first, at, "right") - 1
                for e, w, r in zip(at.tolist(), which.tolist(), row.tolist(), strict=True):
                    s = e - p.m + 1
                    if all(data[starts[s + k] : ends[s + k]].tobytes() == word for k, word in enumerate(p.words[w])):
                        spans[r].append((s - int(first[r]), e + 1 - int(first[r])))
                        items[r].update(p.items[w])
            rows = range(part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("row"),
                    part.column("doc_id"),
                    pa.array(np.diff(first).astype(np.int64)),
                    pa.array([np.array(sorted(spans[r]), "<i8").tobytes() if r in spans else b"" for r in rows], pa.binary()),
                    pa.array([sorted(items[r]) if r in items else [] for r in rows], pa.list_(pa.string())),
                ],
                names=["row", "doc_id", "n_words", "hits", "items"],
            )


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a document from the hit spans and items of all blocks."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            hit, end = 0, 0
            for s, e in np.frombuffer(r["hits"], "<i8").reshape(-1, 2).tolist():
                hit += max(0, e - max(s, end))
                end = max(end, e)
            names = sorted(set(r["items"]))
            digest = hashlib.sha256(",".join(names).encode()).hexdigest()
            out.append((r["doc_id"], r["n_words"], hit, len(names), digest, hit > 0 and 20 * hit >= r["n_words"]))
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        types = [pa.int64()] * 4 + [pa.string(), pa.bool_()]
        names_ = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names_)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pattern_words: int = PATTERN_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and wordless texts have no words and are clean; items with a null or wordless text give no window. Items with a null item_id
    count in n_hit and contaminated, but not in n_items and items_sha256. Repeated item_ids count once, windows
    that several items share count for each. An empty benchmark leaves all documents clean, an empty table gives no row. Repeated rows of documents each
    give a row, however many blocks of patterns there are; texts of any length are searched whole; further columns are ignored.
    """
    spark = docs.sparkSession
    source = common.texts(docs, F.col("doc_id").cast("long").alias("doc_id"), "text")
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = bench.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()
    few = max(1, -(-int(size.n) // (2 * pattern_words)))
    with common.Stages() as done:
        packed = bench.coalesce(few).mapInArrow(common.tidy(lambda it: pattern_blocks(it, window, pattern_words)), "items array<struct<item:string,text:string>>")
        blocks = done.stage(packed.withColumn("block", F.monotonically_increasing_id()), "patterns")
        names = sorted(r.block for r in blocks.select("block").collect())
        if len(names) > 1:
            # several blocks' hits of a row are put together by its number, which must be the same each time
            source = done.stage(source.withColumn("row", F.monotonically_increasing_id()), "rows")
        else:
            source = source.withColumn("row", F.lit(0).cast("long"))
        found = None
        for b in names or [None]:
            block = blocks.filter(F.col("block") == b).first() if names else None
            patterns = compile_patterns([(r.item, r.text) for r in block["items"]] if block else [], window)
            if len(names) < 2:  # one worker a task does both
                return source.mapInArrow(common.tidy(lambda it, p=patterns: report(scan(it, p))), RESULT)
            part = source.mapInArrow(common.tidy(lambda it, p=patterns: scan(it, p)), HITS)
            part = done.stage(part if found is None else part.filter("length(hits) > 0"), "hits")
            found = part if found is None else found.unionByName(part)
        spans = found.groupBy("row").agg(
            F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_list("hits").alias("h"), F.flatten(F.collect_list("items")).alias("items")
        )
        return common.stage(spans.mapInArrow(join_hits, HITS).mapInArrow(report, RESULT), "contamination")


def pattern_blocks(batches: Iterator[pa.RecordBatch], window: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Items in blocks of about ``limit`` words, twice that at most; longer items go in parts that overlap by all but one word of a window."""
    held: list[dict] = []
    n = 0

    def block() -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("item", pa.string()), ("text", pa.string())]))
        return pa.RecordBatch.from_arrays([pa.array([held], kind)], names=["items"])

    for batch in batches:
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text"), strict=True):
            words = words_of(text.as_py())
            for k in range(0, max(1, len(words) - window + 1), limit) if words else []:
                part = words[k : k + limit + window - 1]
                held.append({"item": item, "text": b" ".join(part).decode()})
                n += len(part)
                if n >= limit:
                    yield block()
                    held, n = [], 0
    if held:
        yield block()


def join_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        raw = []
        for r in rows:
            pairs = np.frombuffer(b"".join(r["h"]), "<i8").reshape(-1, 2)
            raw.append(pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))].tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), batch.column("n_words"), pa.array(raw, pa.binary()), batch.column("items")],
            names=["row", "doc_id", "n_words", "hits", "items"],
        )


def op7_wu_manber_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
