"""Near-duplicate groups by min-max hashing.

Each permutation of the shingle space is evaluated once and gives two signature values, its
minimum and its maximum, so a signature of 80 values costs 40 evaluations. Bands of four values
(two permutations) make bucket keys. Candidates are confirmed on full shingle sets, so the
bands only decide recall: their number is derived from the threshold for a miss chance under
one in a million for a link at the threshold itself.

Scale: texts with equal sets are one row from the first group-by on; buckets of one row are
dropped at once; a bucket never emits all its pairs. Two rounds pair each row with one hub only
(linear in rows) and merge components; then only pairs in different components remain, and of
those the rows of a bucket's largest component are never paired with each other, so the work is
(rows outside the largest component) x (bucket), and no link is lost. Of these pairs only those whose sizes and parity
bits allow the threshold come out of the join. Shingle sets are gathered only for rows that share a bucket.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textvec

ROWS = 4
MISS = 1e-6


def bands_for(pct: int) -> int:
    hit = (pct / 100) ** ROWS
    return math.ceil(math.log(MISS) / math.log(1 - hit))


def shingle_sets(column, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text of an Arrow column."""
    data, offsets = textvec.buffers(column)
    data = textvec.lower(data)
    starts, ends, first = textvec.spans(textvec.spaced(data), offsets)
    words = textvec.word_hashes(data, starts, ends)
    n = len(words)
    odd = np.uint64(0xD6E8FEB86659FD93)
    acc = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        acc = textvec.mix(acc * odd + words[k : k + len(acc)])
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            yield np.unique(acc[a : b - width + 1])
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                one = textvec.mix(one * odd + words[k])
            yield one
        else:
            yield np.zeros(0, np.uint64)


def signatures(sets: list[np.ndarray], n_hash: int) -> np.ndarray:
    """(sets, 2 * n_hash) values: minimum and maximum under each permutation; sets must not be empty."""
    rng = np.random.default_rng(77)
    mul = rng.integers(0, 2**63, (n_hash, 2), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    flat = np.concatenate(sets)
    out = np.empty((len(sets), 2 * n_hash), np.uint64)
    for j in range(n_hash):
        x = flat * mul[j, 0]
        x ^= x >> np.uint64(29)
        x *= mul[j, 1]
        out[:, 2 * j] = np.minimum.reduceat(x, at)
        out[:, 2 * j + 1] = np.maximum.reduceat(x, at)
    return out


SIGNED = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])
SIGNED_SQL = "id long, n_shingles long, digest binary, bands array<long>, bits array<long>"


def parity(s: np.ndarray) -> np.ndarray | None:
    """For each of 128 to 8192 classes of shingles (by set size, a power of two) a bit: has the set an odd number of them?"""
    if not len(s):
        return None
    size = min(8192, max(128, 1 << (len(s) - 1).bit_length()))
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


#: Parity words (of 64 bits) that stand beside each row of a bucket; longer ones are folded.
SHORT = 8


def folded(bits: str) -> F.Column:
    """Parity bits of larger sets folded to ``SHORT`` words: their words at equal places modulo that, added."""
    size = F.size(bits)
    place = F.sequence(F.lit(1), F.lit(SHORT))
    one = F.transform(place, lambda k: F.aggregate(F.sequence(F.lit(0), F.floor((size - k) / SHORT).cast("int")), F.lit(0).cast("long"), lambda a, j: a.bitwiseXOR(F.element_at(bits, (k + j * SHORT).cast("int")))))
    return F.when(size <= SHORT, F.col(bits)).otherwise(one)


def differing(p: str, q: str):
    """Places in which the parity bits of two sets differ: so many shingles at least are in one of the sets alone.

    The longer of two bit strings is folded once, which adds its halves; sets whose sizes are further apart are no candidates.
    """
    k = F.least(F.size(p), F.size(q))

    def half(c: str):
        halves = F.zip_with(F.slice(c, F.lit(1), k), F.slice(c, k + 1, k), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(c) == 2 * k, halves).otherwise(F.col(c))

    return F.aggregate(F.zip_with(half(p), half(q), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def sign(batches: Iterator[pa.RecordBatch], width: int, bands: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in textvec.slices(batch, "text"):
            sets = list(shingle_sets(part.column("text"), width))
            full = [k for k, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            if full:
                sig = signatures([sets[k] for k in full], bands * ROWS // 2).reshape(len(full), bands, ROWS)
                key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(full), bands)).copy()
                for r in range(ROWS):
                    key = textvec.mix(key * np.uint64(0x9FB21C651E98DF25) + sig[:, :, r])
                for k, row in zip(full, key.view(np.int64), strict=True):
                    keys[k] = row
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array([parity(s) for s in sets], pa.list_(pa.int64())),
                ],
                schema=SIGNED,
            )


SETS = pa.schema([("id", pa.int64()), ("s", pa.list_(pa.int64()))])


def gather(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in textvec.slices(batch, "text"):
            sets = [s.view(np.int64) for s in shingle_sets(part.column("text"), width)]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.list_(pa.int64()))], schema=SETS)


def confirmed(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """The (a, b) pairs whose full sets reach the threshold. ``a`` may repeat, ``b`` is the hub side."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    used = sets.join(common.small(common.stage(ids, "ids")), "id", "left_semi")
    left = used.select(F.col("id").alias("a"), F.col("s").alias("sa")).join(common.small(pairs), "a")
    both = left.join(used.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    inter = F.size(F.array_intersect("sa", "sb"))
    return both.filter(100 * inter >= pct * (F.size("sa") + F.size("sb") - inter)).select("a", "b")


def relabel(labels: DataFrame | None, edges: DataFrame, reps: DataFrame) -> DataFrame:
    comps = common.connected_components(edges)
    return common.stage(
        reps.join(comps, reps.rep == comps.id, "left").select("rep", F.coalesce("component", "rep").alias("comp")), "labels"
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, threshold_pct: int = 80, rounds: int = 2
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text of fewer words than a shingle is
    one shingle; a text without words (or null) has none and is linked with nothing. Linked are sets with
    ``100 * |A & B| >= threshold_pct * |A | B|``. Rows with a repeated id are kept apart only by
    their id: give unique ids. Other columns are ignored; an empty table gives an empty result.
    """
    bands = bands_for(threshold_pct)
    source = common.texts(docs, F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = common.stage(
        source.mapInArrow(common.tidy(lambda it: sign(it, shingle_words, bands)), SIGNED_SQL), "signed"
    )
    reps = common.stage(signed.filter("digest is not null").groupBy("digest").agg(F.min("id").alias("rep")), "reps")
    only = signed.join(common.small(reps.select(F.col("rep").alias("id"))), "id", "left_semi")
    rows = only.select(F.col("id").alias("rep"), F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    members = common.stage(rows.join(shared.select("key", "hub"), "key").select("key", "rep", "hub"), "members")
    ids = common.stage(members.select(F.col("rep")).distinct(), "ids")
    sets = common.stage(
        source.join(common.small(ids.select(F.col("rep").alias("id"))), "id", "left_semi").mapInArrow(
            common.tidy(lambda it: gather(it, shingle_words)), "id long, s array<long>"
        ),
        "sets",
    )
    pairs = members.groupBy("rep").agg(F.min("hub").alias("b")).filter("b <> rep").select(F.col("rep").alias("a"), "b")
    edges = common.stage(confirmed(common.stage(pairs, "pairs"), sets, threshold_pct), "links")
    labels = relabel(None, edges, ids)
    for r in range(1, rounds):
        salt = F.lit(r)
        tagged = members.select("key", "rep").join(common.small(labels), "rep")
        top = tagged.groupBy("key").agg(
            F.min_by(F.struct("rep", "comp"), F.xxhash64("rep", salt)).alias("h"), F.min("comp").alias("lo"), F.max("comp").alias("hi")
        )
        pairs = (
            tagged.join(top.filter("lo <> hi").select("key", "h"), "key")
            .filter("comp <> h.comp")
            .groupBy("rep")
            .agg(F.min("h.rep").alias("b"))
            .select(F.col("rep").alias("a"), "b")
        )
        more = common.stage(confirmed(common.stage(pairs, "pairs"), sets, threshold_pct), "links")
        edges = edges.union(more)
        labels = relabel(labels, edges, ids)
    # What is left: every pair of a bucket in different components, but for rows of its largest component on the left.
    tagged = members.select("key", "rep").join(common.small(labels), "rep")
    counts = tagged.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("most"), F.count("*").alias("k")).filter("k > 1")
    facts = signed.select(F.col("id").alias("rep"), F.col("n_shingles").alias("n"), "bits")
    open_ = common.stage(tagged.join(mixed.select("key", "most"), "key"), "open")
    facts = common.stage(facts.join(common.small(common.stage(open_.select("rep").distinct(), "ids")), "rep", "left_semi"), "facts")
    open_ = open_.join(facts.select("rep", "n", folded("bits").alias("bits")), "rep")
    left = open_.filter("comp <> most").select("key", F.col("rep").alias("a"), F.col("comp").alias("ca"), "most", F.col("n").alias("na"), F.col("bits").alias("p"))
    right = open_.select("key", F.col("rep").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("bits").alias("q"))
    sizes = (100 * F.col("na") >= threshold_pct * F.col("nb")) & (100 * F.col("nb") >= threshold_pct * F.col("na"))
    near = differing("p", "q") * (100 + threshold_pct) <= (100 - threshold_pct) * (F.col("na") + F.col("nb"))
    pairs = left.join(right, "key").filter("ca <> cb and (cb = most or a > b)").filter(sizes).filter(near).select("a", "b", "na", "nb").distinct()
    # of large sets the folded bits tell little: all bits, once a pair
    bits = common.small(facts.select("rep", "bits"), common.BROADCAST_ROWS // 100)
    pairs = common.stage(pairs, "pairs").join(bits.select(F.col("rep").alias("a"), F.col("bits").alias("p")), "a").join(bits.select(F.col("rep").alias("b"), F.col("bits").alias("q")), "b")
    pairs = pairs.filter(near).select("a", "b")
    last = common.stage(confirmed(common.stage(pairs, "pairs"), sets, threshold_pct), "links")
    labels = relabel(labels, edges.union(last), ids)
    common.trim()
    named = reps.join(labels, "rep", "left").select("digest", F.coalesce("comp", "rep").alias("comp"))
    return signed.join(named, "digest", "left").select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.coalesce("comp", "id").alias("component_id"),
        (F.coalesce("comp", "id") == F.col("id")).alias("kept"),
    )


def op5_minmax_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle_words=3, threshold_pct=85)
