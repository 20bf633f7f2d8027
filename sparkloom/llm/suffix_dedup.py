"""Removal of byte strings that an earlier document has, with suffix arrays by linear grouping construction.

1. Every string of ``WINDOW`` bytes has an anchor: its ``GRAM``-gram of least hash (the first of equals). Equal strings have
   equal anchors at equal places, so strings meet under their anchor's hash. Consecutive strings with one anchor make a piece.
   A bitmap of fixed size, of hashes that occur twice or more, drops most anchors that occur once; a group-by finds those that documents share.
2. Pieces of equal bytes are one class, whose first document is known from a group-by. In later documents all its strings are removed.
3. Only classes under an anchor with several classes can share strings in part. Such a string holds the ``SIDE`` bytes after the anchor's
   or those before it, so only classes that have either of these in common are looked at; those of an anchor with more than ``CROWDED`` classes
   are dealt by them, to two sub-keys each, and not by the anchor. Of these a task builds a suffix array: a piece
   is the sequence of its 8-byte blocks, counted from the anchor, and suffixes of pieces with the same five blocks are
   neighbours. Among these the full strings are compared, and each class learns which of its strings an earlier document has.

Suffix arrays are built by grouping: suffixes with the same prefix form a group; groups are processed from the highest down,
each refining the groups of its members' previous smaller suffixes, until groups are those of equal Lyndon prefixes; one
ascending pass then emits all groups in order. No renaming and no recursion.

Scale: documents are written once as a bucketed table in the shared folder, so that joins with positions never shuffle texts again. A passage that a
third of all documents share is a few aggregate rows a task in steps 1 and 2, and one class in step 3. There, a stock phrase or a rule of dashes
with many different neighbours is as many sub-keys; tasks work in batches of whole sub-keys, and the largest of these is that of the
commonest ``GRAM + SIDE`` bytes among classes.

An empty table gives an empty result; a very long text is worked on by itself, in memory proportional to its bytes; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, textvec
from .counting import PIECE_BITS, TABLE_BITS
from .counting import slot as counted

WINDOW, GRAM, BLOCK = 50, 24, 8
SPAN = WINDOW - GRAM + 1
#: Bytes beside an anchor: a string holds as many on one side of it at least.
SIDE = (WINDOW - GRAM) // 2
RUN = (WINDOW - BLOCK + 1) // BLOCK
PLACE_BITS = 26
MAP_BITS = 29
PIECE_WORDS = 1 << 14
#: Pieces of an anchor, by hashed counts, beyond which it is dealt over salts.
HOT = 5000
#: Classes of an anchor beyond which they are dealt by sub-keys.
CROWDED = 256
#: Symbols of a suffix array, about; sub-keys are never split between arrays.
SYMBOLS = 200_000
#: Shuffle files of a written frame go with its query, and not whenever the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of integers whose last is smaller than all others and occurs once."""
    n = len(text)
    group = [0] * n
    letters = {c: g for g, c in enumerate(sorted(set(text)))}
    members: list[list[int]] = [[] for _ in letters]
    for i, c in enumerate(text):
        g = letters[c]
        group[i] = g
        members[g].append(i)
    above = [g + 1 for g in range(len(members))]
    above[-1] = -1
    below = [g - 1 for g in range(len(members))]
    previous = [-1] * n
    # skip[i]: a place before i up to which all suffixes lie in processed groups
    skip = list(range(n))
    now = len(members) - 1
    while now >= 0:
        mine = [i for i in members[now] if group[i] == now]
        members[now] = mine
        for i in mine:
            skip[i] = i - 1
        count: dict[int, int] = {}
        for i in mine:
            p = i - 1
            while p >= 0 and skip[p] != p:
                q = skip[p]
                if q >= 0 and skip[q] != q:
                    skip[p] = skip[q]
                p = q
            previous[i] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        if count:
            new: dict[tuple[int, int], int] = {}
            # higher counts first: what comes later is put closer above the group it leaves
            for p, k in sorted(count.items(), key=lambda x: -x[1]) if len(count) > 1 else count.items():
                old = group[p]
                at = new.get((old, k))
                if at is None:
                    at = len(members)
                    new[old, k] = at
                    members.append([])
                    up = above[old]
                    above.append(up)
                    below.append(old)
                    above[old] = at
                    if up >= 0:
                        below[up] = at
                group[p] = at
                members[at].append(p)
        now = below[now]
    # groups now have equal Lyndon prefixes; slots of each, from the lowest group up
    slot = [0] * len(members)
    low = next(g for g in range(len(members)) if below[g] < 0)
    used, g = 0, low
    while g >= 0:
        slot[g] = used
        used += len(members[g])
        g = above[g]
    out = [-1] * n
    placed = [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for k in range(n):
        s = out[k] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[slot[g]] = s
            slot[g] += 1
            placed[s] = True
            s = previous[s]
    return out


class Anchors:
    """Pieces of all texts of a column: ``row``, ``start`` and ``count`` of its strings (starts within the text), ``key``, ``digest``, ``lead`` (bytes before the anchor)."""

    def __init__(self, column):
        data, offsets = textvec.buffers(column)
        self.data, self.offsets = data, offsets
        n = len(data)
        size = np.diff(offsets)
        up, down = textvec.powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(textvec._BYTE[data] * up[:n], out=total[1:])
        self.total, self.down = total, down
        last = n - WINDOW + 1
        none = np.zeros(0, np.int64)
        self.row = self.start = self.count = self.lead = none
        self.key = self.digest = np.zeros(0, np.uint64)
        if last <= 0:
            return
        grams = textvec.mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
        mask = np.uint64((1 << PLACE_BITS) - 1)
        v = (grams & ~mask) | (np.arange(len(grams), dtype=np.uint64) & mask)
        width = 1
        while 2 * width <= SPAN:
            v = np.minimum(v[:-width], v[width:])
            width *= 2
        if SPAN > width:
            v = np.minimum(v[: len(v) - (SPAN - width)], v[SPAN - width :])
        edge = np.zeros(n + 1, np.int64)
        able = np.flatnonzero(size >= WINDOW)
        np.add.at(edge, offsets[able], 1)
        np.add.at(edge, offsets[able] + size[able] - WINDOW + 1, -1)
        where = np.flatnonzero(np.cumsum(edge[:last]) > 0)
        if not len(where):
            return
        base = where & ~int(mask)
        at = (v[where] & mask).astype(np.int64) + base
        at = np.where(at < where, at + int(mask) + 1, at)
        new = np.ones(len(where), bool)
        new[1:] = (at[1:] != at[:-1]) | (where[1:] != where[:-1] + 1)
        head = np.flatnonzero(new)
        begin, anchor = where[head], at[head]
        self.count = np.diff(np.append(head, len(where)))
        self.row = np.searchsorted(offsets, begin, "right") - 1
        self.begin, self.anchor = begin, anchor
        self.start = begin - offsets[self.row]
        self.lead = anchor - begin
        self.key = grams[anchor]
        self.digest = textvec.mix(self.hash(begin, self.count + WINDOW - 1) + self.lead.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def hash(self, begin: np.ndarray, size) -> np.ndarray:
        return textvec.mix((self.total[begin + size] - self.total[begin]) * self.down[begin] + np.asarray(size).astype(np.uint64))


def slot(key: np.ndarray) -> np.ndarray:
    return (textvec.mix(key ^ np.uint64(0x5DEECE66D)) >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of anchor hashes seen once, and seen twice, in compressed parts; parts below 0 are of a table of their hashed counts."""
    counts = np.zeros(1 << TABLE_BITS, np.int64)
    once, twice = np.zeros(1 << (MAP_BITS - 6), np.uint64), np.zeros(1 << (MAP_BITS - 6), np.uint64)
    for batch in batches:
        for part in textvec.slices(batch, "text"):
            key = Anchors(part.column("text")).key
            at, n = np.unique(counted(key), return_counts=True)
            counts[at] += n
            at, n = np.unique(slot(key), return_counts=True)
            for some, many in ((at, False), (at[n > 1], True)):
                if len(some):
                    word = some >> 6
                    head = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                    bits = np.bitwise_or.reduceat(np.uint64(1) << (some & 63).astype(np.uint64), head)
                    if many:
                        twice[word[head]] |= bits
                    else:
                        twice[word[head]] |= once[word[head]] & bits
                        once[word[head]] |= bits
    names = ["part", "once", "twice"]
    for k in range(0, len(counts), 1 << PIECE_BITS):
        packed = zlib.compress(counts[k : k + (1 << PIECE_BITS)].tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([-1 - (k >> PIECE_BITS)], pa.int32()), pa.array([packed], pa.binary()), pa.array([b""], pa.binary())], names=names)
    for k in range(0, len(once), PIECE_WORDS):
        if once[k : k + PIECE_WORDS].any():
            a, b = (zlib.compress(x[k : k + PIECE_WORDS].tobytes(), 1) for x in (once, twice))
            yield pa.RecordBatch.from_arrays([pa.array([k // PIECE_WORDS], pa.int32()), pa.array([a], pa.binary()), pa.array([b], pa.binary())], names=names)


def merge_marks(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    once = twice = total = None
    for batch in batches:
        if key[0].as_py() < 0:
            for a in batch.column("once"):
                x = np.frombuffer(zlib.decompress(a.as_py()), np.int64)
                total = x if total is None else total + x
            continue
        for a, b in zip(batch.column("once"), batch.column("twice"), strict=True):
            x, y = (np.frombuffer(zlib.decompress(c.as_py()), np.uint64) for c in (a, b))
            twice = y.copy() if twice is None else twice | y | (once & x)
            once = x.copy() if once is None else once | x
    if total is not None and (total > HOT).any():
        twice = np.where(total > HOT, total, 0)
    if twice is not None and twice.any():
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())], names=["part", "twice"])


#: ``at`` holds start, n and lead (both below 64) in one number, which keeps the rows of the large exchange small.
#: ``deal`` is the key or, of an anchor in ``hot`` places of the table of counts, made of it and a salt; only then ``key`` is not null.
PIECES = "doc_id long, at long, key long, digest long, deal long"


def pieces(batches: Iterator[pa.RecordBatch], twice: np.ndarray, hot: dict[int, int]) -> Iterator[pa.RecordBatch]:
    many = np.array(sorted(hot), np.int64)
    salts = np.array([hot[k] // HOT + 1 for k in many.tolist()], np.uint64)
    for batch in batches:
        for part in textvec.slices(batch, "text"):
            a = Anchors(part.column("text"))
            at = slot(a.key)
            keep = np.flatnonzero(((twice[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool))
            ids = part.column("doc_id").take(pa.array(a.row[keep]))
            at = (a.start << 12) | (a.count << 6) | a.lead
            deal, cold = a.key[keep].copy(), np.ones(len(keep), bool)
            if len(many):
                place = np.searchsorted(many, counted(deal))
                some = np.flatnonzero(many[np.minimum(place, len(many) - 1)] == counted(deal))
                doc = textvec.mix(ids.to_numpy().view(np.uint64)[some])
                deal[some] = textvec.mix(deal[some] + doc % salts[place[some]] + np.uint64(1))
                cold[some] = False
            key = pa.array(a.key[keep].view(np.int64), mask=cold)
            at, digest, deal = (pa.array(x.view(np.int64)) for x in (at[keep], a.digest[keep], deal))
            yield pa.RecordBatch.from_arrays([ids, at, key, digest, deal], names=["doc_id", "at", "key", "digest", "deal"])


CONTENT = "sub long, key long, digest long, lo long, lead int, bytes binary"


def sub_keys(key: int, lead: int, raw: bytes, gram: int = 16, size: int = 16) -> list[int]:
    """Hashes of a class's anchor with the ``size`` bytes after its ``gram``, and with those before it.

    Equal strings of 50 bytes hold one of these if ``gram + 2 * size`` is at most 51.
    """
    out = []
    for side, part in enumerate((raw[lead + gram : lead + gram + size], raw[max(0, lead - size) : lead])):
        if len(part) == size:
            x = xxhash.xxh3_64_intdigest(key.to_bytes(8, "little", signed=True) + bytes([side]) + part)
            out.append(x - (1 << 64) if x >= 1 << 63 else x)
    return out


def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the listed pieces of documents, under their anchor or, where it is crowded, under each of their sub-keys."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            raw = (r["text"] or "").encode()
            for p in r["wanted"]:
                start, n, lead = p["at"] >> 12, p["at"] >> 6 & 63, p["at"] & 63
                piece = raw[start : start + n + WINDOW - 1]
                subs = sub_keys(p["key"], lead, piece, GRAM, SIDE) if p["crowded"] else [p["key"]]
                out += [(sub, p["key"], p["digest"], r["doc_id"], lead, piece) for sub in subs]
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["sub", "key", "digest", "lo", "lead", "bytes"])


def earlier_strings(rows: list[tuple[int, int, int, bytes]]) -> list[bytes]:
    """For classes (sub-key, lo, lead, bytes) of some sub-keys, a byte for each string: 1 if a class of its sub-key with a smaller lo has it."""
    raw = b"".join(r[3] for r in rows)
    data = np.frombuffer(raw, np.uint8)
    size = np.array([len(r[3]) for r in rows])
    begin = np.cumsum(size) - size
    lead = np.array([r[2] for r in rows])
    keys = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    lo = np.array([r[1] for r in rows], np.int64)
    up, down = textvec.powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(textvec._BYTE[data] * up[: len(data)], out=total[1:])
    # blocks of each piece, counted from its anchor
    first = -(lead // BLOCK)
    n_blocks = (size - lead) // BLOCK - first
    q = np.repeat(np.arange(len(rows)), n_blocks)
    j = np.arange(n_blocks.sum()) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks) + first[q]
    at = begin[q] + lead[q] + BLOCK * j
    name = textvec.mix((total[at + BLOCK] - total[at]) * down[at] + keys[q]) + (j + 64).astype(np.uint64)
    symbol, times = np.unique(name, return_inverse=True, return_counts=True)[1:]
    # a block that occurs once ends what can repeat; stretches of fewer blocks than a run are left out
    repeats = times[symbol] > 1
    head = np.ones(len(q), bool)
    head[1:] = (q[1:] != q[:-1]) | (repeats[1:] != repeats[:-1])
    stretch = np.cumsum(head) - 1
    kept = np.flatnonzero(repeats & (np.bincount(stretch)[stretch] >= RUN)) if len(q) else np.zeros(0, np.int64)
    flags = [np.zeros(s - WINDOW + 1, np.uint8) for s in size]
    if not len(kept):
        return [f.tobytes() for f in flags]
    # one text: stretches with 1 between them and 0 at the end
    gap = np.cumsum(np.append(0, stretch[kept][1:] != stretch[kept][:-1]))
    place = np.arange(len(kept)) + gap
    length = int(place[-1]) + 2
    text = np.ones(length + 1, np.int64)
    text[place] = symbol[kept] + 2
    text[length] = 0
    owner = np.full(len(text), -1)
    owner[place] = kept
    sa = np.array(suffix_array(text.tolist()))
    run = text[np.minimum(sa[:, None] + np.arange(RUN), length)]
    same = np.zeros(len(sa), bool)
    same[1:] = (run[1:] == run[:-1]).all(1) & (run[1:] > 1).all(1)
    group = np.cumsum(~same)
    many = np.bincount(group)[group] > 1
    block, group = owner[sa[many]], group[many]
    if len(block):
        # the strings whose first full block is this one
        w = np.repeat(np.arange(len(block)), BLOCK)
        o = BLOCK * j[block][w] - np.tile(np.arange(BLOCK), len(block)) + lead[q[block]][w]
        piece = q[block][w]
        good = (o >= 0) & (o <= size[piece] - WINDOW)
        o, piece, g = o[good], piece[good], group[w][good]
        a = begin[piece] + o
        h = textvec.mix((total[a + WINDOW] - total[a]) * down[a])
        order = np.lexsort((lo[piece], o - lead[piece], h, g))
        o, piece, g, h, a = o[order], piece[order], g[order], h[order], a[order]
        rel = o - lead[piece]
        head = np.ones(len(o), bool)
        head[1:] = (g[1:] != g[:-1]) | (h[1:] != h[:-1]) | (rel[1:] != rel[:-1])
        least = np.flatnonzero(head)[np.cumsum(head) - 1]
        for k in np.flatnonzero(lo[piece] > lo[piece[least]]).tolist():
            x, y = int(a[k]), int(a[least[k]])
            if raw[x : x + WINDOW] == raw[y : y + WINDOW]:
                flags[piece[k]][o[k]] = 1
    return [f.tobytes() for f in flags]


def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes sorted by sub-key, a batch of whole sub-keys at a time, through suffix arrays; a sub-key of one class is passed over."""
    held: list = []
    symbols = 0
    group: list = []

    def made():
        flags = earlier_strings([(r[0], r[3], r[4], r[5]) for r in held])
        out = [(r[1], r[2], f) for r, f in zip(held, flags, strict=True) if any(f)]
        cols = list(zip(*out, strict=True)) if out else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["key", "digest", "flags"])

    def ended():
        nonlocal symbols
        if len(group) > 1:
            sides = [sub_keys(r[1], r[4], r[5], GRAM, SIDE) for r in group]
            count = Counter(s for pair in sides for s in pair)
            kept = [r for r, pair in zip(group, sides, strict=True) if any(count[s] > 1 for s in pair)]
            held.extend(kept)
            symbols += sum(len(r[5]) for r in kept) // BLOCK
        group.clear()

    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("sub", "key", "digest", "lo", "lead", "bytes")), strict=True):
            if group and r[0] != group[0][0]:
                ended()
                if symbols >= SYMBOLS:
                    yield made()
                    held, symbols = [], 0
            group.append(r)
    ended()
    if held:
        yield made()


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cut(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """Documents without the bytes of their hit strings: ``hits`` are (start, number of strings)."""
    for batch in batches:
        for part in textvec.slices(batch, "text"):
            data, offsets = textvec.buffers(part.column("text"))
            edge = np.zeros(len(data) + 1, np.int64)
            hits = part.column("hits")
            if len(hits) > hits.null_count:
                owner = np.repeat(np.arange(len(hits)), pc.fill_null(pc.list_value_length(hits), 0).to_numpy())
                start, count = (hits.flatten().field(k).to_numpy().astype(np.int64) for k in (0, 1))
                begin = offsets[owner] + start
                edge += np.bincount(begin, minlength=len(edge)) - np.bincount(begin + count + WINDOW - 1, minlength=len(edge))
            gone = np.cumsum(edge[:-1]) > 0
            out = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                g = gone[a:b]
                kept = data[a:b][~g].tobytes()
                n_spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
                out.append((b - a, int(g.sum()), n_spans, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True))
            arrays = [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                arrays.append(pa.array(cols[4], pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names=names)


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every (doc_id, text), judged on the texts as UTF-8 bytes.

    Removed is each byte in a string of 50 bytes that also starts in a document of a smaller doc_id; overlaps count and matches stay
    within documents. Null is empty. doc_ids must be unique and not null. ``with_text`` adds the remaining bytes.
    """
    spark = docs.sparkSession
    source = common.texts(docs, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name, path = f"sparkloom_{uuid.uuid4().hex}", f"{common.fresh(spark)}/texts"
    spread = source if source.rdd.getNumPartitions() * n <= 20_000 else source.repartition(n, "doc_id")
    try:
        with common.setting(spark, CLEANUP, "true"):
            spread.write.option("compression", "zstd").option("path", path).bucketBy(n, "doc_id").saveAsTable(name)
            with common.Stages() as done:
                hits = repeated_strings(source, spark.table(name), n, done)
                out = spark.table(name).join(hits, "doc_id", "left").select("doc_id", "text", "hits")
                return common.stage(out.mapInArrow(common.tidy(lambda it: cut(it, with_text)), RESULT + ", kept binary" * with_text), "cut")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        common.drop_path(spark, path)


def repeated_strings(source: DataFrame, table: DataFrame, n: int, done: common.Stages) -> DataFrame:
    """(doc_id, hits): starts and numbers of the strings that an earlier document has; it reads frames of ``done``."""
    spark = source.sparkSession
    marks = source.select("text").mapInArrow(common.tidy(mark), "part int, once binary, twice binary").groupBy("part").applyInArrow(merge_marks, "part int, twice binary")
    twice, hot = np.zeros(1 << (MAP_BITS - 6), np.uint64), {}
    for r in marks.collect():
        x = np.frombuffer(zlib.decompress(bytes(r.twice)), np.uint64)
        if r.part < 0:
            hot |= {((-1 - r.part) << PIECE_BITS) + int(k): int(x[k]) for k in np.flatnonzero(x)}
        else:
            twice[r.part * PIECE_WORDS : (r.part + 1) * PIECE_WORDS] = x
    shared = done.share(spark, (twice, hot))
    hot = bool(hot)
    del twice
    found = source.mapInArrow(common.tidy(lambda it: pieces(it, *shared.value)), PIECES)
    # one exchange serves all of these: what a key's documents, its classes and each class's documents are. Of a hot key these are facts of a salt only
    by_key, by_class = Window.partitionBy("deal"), Window.partitionBy("deal", "key", "digest")
    facts = [F.min("doc_id").over(by_key).alias("a"), F.max("doc_id").over(by_key).alias("b"), (F.min("digest").over(by_key) < F.max("digest").over(by_key)).alias("mixed")]
    found = found.select("*", F.col("key").isNotNull().alias("hot"), *facts).filter("hot or a < b")
    # only mixed and hot keys are looked at again: elsewhere the two hashes would be stored for nothing
    again = F.col("mixed") | F.col("hot")
    wanted_only = (F.coalesce("key", F.when(again, F.col("deal"))).alias("key"), F.when(again, F.col("digest")).alias("digest"))
    first = (F.row_number().over(by_class.orderBy("doc_id", "at")) == 1).alias("first")
    found = found.select("doc_id", "at", *wanted_only, "mixed", F.min("doc_id").over(by_class).alias("lo"), first, "hot", F.max("doc_id").over(by_class).alias("hi"))
    found = found.withColumn("hi", F.when(F.col("hot"), F.col("hi")))
    found = done.stage(found, "pieces")
    if hot:
        # the salts' facts are few rows a key and class; those of all salts decide
        heads = found.filter("hot and first").groupBy("key", "digest").agg(F.min(F.struct("doc_id", "at")).alias("head"), F.max("hi").alias("hi"))
        heads = done.stage(heads, "heads")
        keys = heads.groupBy("key").agg(F.min("head.doc_id").alias("a"), F.max("hi").alias("b"), (F.min("digest") < F.max("digest")).alias("mixed")).filter("a < b")
        keys = done.stage(keys.select("key", "mixed"), "keys")
        # what stands after the first document of a salt is removed whatever the other salts hold; only the salts' firsts are looked up
        known = found.filter("hot and doc_id > lo").select("doc_id", "at", "key", "digest", F.lit(False).alias("mixed"), "lo", F.lit(False).alias("first"))
        rows = found.filter("hot and doc_id = lo").select("doc_id", "at", "key", "digest").join(common.small(heads.drop("hi")), ["key", "digest"]).join(common.small(keys), "key")
        rows = rows.select("doc_id", "at", "key", "digest", "mixed", F.col("head.doc_id").alias("lo"), (F.struct("doc_id", "at") == F.col("head")).alias("first"))
        found = found.filter("not hot").select(*rows.columns).unionByName(known).unionByName(done.stage(rows, "rows"))
    start, count = F.shiftright("at", 12).cast("int").alias("start"), F.shiftright("at", 6).bitwiseAND(63).cast("int").alias("n")
    classes = found.filter("mixed and first").select("doc_id", "key", "digest", "at")
    crowded = done.stage(classes.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > CROWDED).select("key", F.lit(True).alias("crowded")), "crowded")
    classes = classes.join(common.small(crowded), "key", "left").withColumn("crowded", F.col("crowded").isNotNull())
    places = classes.groupBy("doc_id").agg(F.collect_list(F.struct("key", "digest", "at", "crowded")).alias("wanted"))
    raw = table.join(places, "doc_id").select("doc_id", "text", "wanted").mapInArrow(common.tidy(contents), CONTENT)
    solved = raw.repartition(n, "sub").sortWithinPartitions("sub").mapInArrow(common.tidy(resolve), "key long, digest long, flags binary")
    solved = done.stage(solved, "solved")
    later = found.filter("doc_id > lo").select("doc_id", start, count)
    own = found.filter("mixed and doc_id = lo").join(solved, ["key", "digest"])
    # a string that both sub-keys of its class tell of is told twice, which does not matter
    one = own.select("doc_id", start, F.posexplode(F.split(F.hex("flags"), "(?<=\\G..)")).alias("j", "f")).filter("f = '01'")
    hits = later.unionByName(one.select("doc_id", (F.col("start") + F.col("j")).alias("start"), F.lit(1).alias("n")))
    return hits.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("hits"))


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
