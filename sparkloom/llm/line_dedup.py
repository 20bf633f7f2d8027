"""Near-duplicate lines by an exact set-similarity join.

A line is the set of its words. Words are ordered by rarity; two sets with Jaccard similarity t or more share a word among
their first ``n - ceil(t n) + 1``, their second common word lies within one place more. So lines meet under their rare
prefix words; a prefix word of more than ``HOT`` lines makes a key only together with the next common word. Length, positional and parity
filters cut candidates; intersections of the full sets decide. Of two similar lines the later one (by doc_id, then
line number) is removed; what counts is the input, not what other removals leave.

Scale: rarity comes from hashed counts of all words, in a table of fixed size. Lines with equal sets are one row from the first group-by
on. Postings (key, line) cross one exchange as packed columns, dealt by key into buckets of about ``BUCKET`` postings, whose number grows with
the input; where the counted postings of a two-word key, or of a word of long lines, exceed ``HOT``, the later lines of its pairs are dealt over as many salts as
needed and the earlier ones go to each, so no task holds a whole hot key. In a bucket a key's lines are in order of size, so only lines of fitting
sizes are compared. Every line first tries its nearest candidates; only lines that these do not settle are
compared with all, and their candidates leave a bucket in batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textvec
from .counting import PIECES, TABLE_BITS, gathered, pieces_of, slot

#: Lines under a key beyond which another word joins the key, or the key is dealt over salts.
HOT = 5000
#: Lines of more words keep single words as keys: they would have too many pairs of prefix words.
LONG = 128
#: Postings of a bucket, about, and those that a task holds before it sends them on.
BUCKET, HELD = 400_000, 400_000
#: Nearest candidates that a line tries before it is compared with all.
NEAREST = 2
#: Pairs held in a bucket's task.
PAIRS = 1_000_000
#: Line numbers (4 bytes each) in lists that may be broadcast, and their documents.
LIST_LINES, LIST_DOCS = 4_000_000, 300_000

_ODD = np.uint64(0x9FB21C651E98DF25)


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each line and the offset where it begins; every row has at least one line."""
    newline = np.flatnonzero(data == 10) + 1
    row = np.searchsorted(offsets, newline - 1, "right") - 1
    begin = np.concatenate([offsets[:-1], newline])
    rows = np.concatenate([np.arange(len(offsets) - 1), row])
    order = np.lexsort((begin, rows))
    return rows[order], begin[order]


class Words:
    """Distinct words of each line of a slice: ``line`` and ``h``, sorted by line and then by (rank, hash)."""

    def __init__(self, column, rank: np.ndarray | None = None):
        data, offsets = textvec.buffers(column)
        self.rows, begin = lines_of(data, offsets)
        first = np.searchsorted(self.rows, np.arange(len(offsets) - 1))
        self.number = np.arange(len(self.rows)) - first[self.rows] if len(self.rows) else np.zeros(0, np.int64)
        low = textvec.lower(data)
        starts, ends, upto = textvec.spans(textvec.spaced(low), offsets)
        h = textvec.word_hashes(low, starts, ends)
        # a row's words follow its lines' beginnings; empty rows share offsets, so lines are found within rows
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(upto))
        line = np.searchsorted(begin + self.rows, starts + owner, "right") - 1
        at = slot(h)
        order = by_line(line, at if rank is None else rank[at], h)
        line, h = line[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
        self.line, self.h = line[new], h[new]
        self.begin = np.searchsorted(self.line, np.arange(len(self.rows)))
        self.n = np.diff(np.append(self.begin, len(self.line)))


def by_line(line: np.ndarray, rank: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Order by (line, rank, hash): one number holds line, rank and the low bits of the hash, if no two words are equal in these alone."""
    rest = 64 - TABLE_BITS - int(line[-1]).bit_length() if len(line) else 0
    if rest >= 16:
        one = (line.astype(np.uint64) << np.uint64(rest + TABLE_BITS)) | (rank.astype(np.uint64) << np.uint64(rest)) | (h & np.uint64((1 << rest) - 1))
        order = np.argsort(one)
        one, sorted_h = one[order], h[order]
        if not ((one[1:] == one[:-1]) & (sorted_h[1:] != sorted_h[:-1])).any():
            return order
    return np.lexsort((h, rank, line))


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashed counts of all words, and the number of lines."""
    total, lines = np.zeros(1 << TABLE_BITS, np.uint32), 0
    for batch in batches:
        for part in textvec.slices(batch, "text"):
            data, offsets = textvec.buffers(part.column("text"))
            lines += len(offsets) - 1 + int((data == 10).sum())
            data = textvec.lower(data)
            starts, ends, _ = textvec.spans(textvec.spaced(data), offsets)
            at, n = np.unique(slot(textvec.word_hashes(data, starts, ends)), return_counts=True)
            total[at] += n.astype(np.uint32)
    yield pieces_of(total, lines)


def rarity(counts: np.ndarray) -> np.ndarray:
    """Place of each slot in the order of counts; equal counts are in the order of slots."""
    rank = np.empty(len(counts), np.uint32)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.uint32)
    return rank


LINES = "doc_id long, line int, n int, d long, x long, y long, p array<long>"


def described(batches: Iterator[pa.RecordBatch], rank: np.ndarray, pct: int) -> Iterator[pa.RecordBatch]:
    """One row per line with words: size, digest and parity bits of its set, and its prefix (``p``: the rarest words, one more than needed).

    ``x`` and ``y`` have a bit for each of 128 classes of words, set if the line has an odd number of them: sets whose bits differ
    in k places differ in k words at least.
    """
    for batch in batches:
        for part in textvec.slices(batch, "text"):
            w = Words(part.column("text"), rank)
            full = np.flatnonzero(w.n)
            at = w.begin[full]
            digest, odd = np.zeros(0, np.uint64), np.zeros((2, 0), np.uint64)
            if len(full):
                digest = np.add.reduceat(textvec.mix(w.h), at)
                bit = np.uint64(1) << (w.h & np.uint64(63))
                half = (w.h >> np.uint64(6)) & np.uint64(1)
                odd = np.stack([np.bitwise_xor.reduceat(bit * (half ^ np.uint64(1 - k)), at) for k in (0, 1)])
            room = np.where(w.n >= 3, np.minimum(w.n, w.n + (-pct * w.n // 100) + 2), 0)
            place = np.arange(len(w.h)) - w.begin[w.line] if len(w.h) else np.zeros(0, np.int64)
            kept = place < room[w.line]
            ends = np.concatenate([[0], np.cumsum(room[full])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(pa.array(w.rows[full])),
                    pa.array(w.number[full].astype(np.int32)),
                    pa.array(w.n[full].astype(np.int32)),
                    pa.array(digest.view(np.int64)),
                    *(pa.array(k.view(np.int64)) for k in odd),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(w.h[kept].view(np.int64))),
                ],
                names=["doc_id", "line", "n", "d", "x", "y", "p"],
            )


class Prefixes:
    """Prefix words of a batch of lines: ``word``, its line's number ``owner``, ``place``; ``head`` is false for the last, which is only a second word."""

    def __init__(self, batch: pa.RecordBatch):
        p = batch.column("p")
        size = np.diff(p.offsets.to_numpy())
        self.word = p.flatten().to_numpy().view(np.uint64)
        self.owner = np.repeat(np.arange(len(size)), size)
        self.place = np.arange(len(self.word)) - np.repeat(np.cumsum(size) - size, size)
        self.head = self.place < size[self.owner] - 1
        self.n = batch.column("n").to_numpy()

    def keys(self, counts: np.ndarray, pct: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
        """(key, owner, room, wide): ``room`` is the most common words of lines that first meet under the key; wide keys may need salts."""
        c = counts[slot(self.word)]
        at = np.flatnonzero(self.head & (c > 1) & (c <= HOT))
        yield self.word[at], self.owner[at], self.n[self.owner[at]] - self.place[at], False
        hot = np.flatnonzero(self.head & (c > HOT))
        n = self.n[self.owner[hot]]
        at = hot[100 * n >= pct * LONG]
        yield textvec.mix(self.word[at] + _ODD), self.owner[at], self.n[self.owner[at]] - self.place[at], True
        at, step = hot[n <= LONG], 0
        while len(at):
            step += 1
            at = at[at + step < len(self.word)]
            at = at[self.owner[at + step] == self.owner[at]]
            yield textvec.mix(self.word[at] * _ODD + self.word[at + step]), self.owner[at], self.n[self.owner[at]] - self.place[at + step] + 1, True


def count_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashed counts of prefix words, and their number."""
    total, n = np.zeros(1 << TABLE_BITS, np.uint32), 0
    for batch in batches:
        p = Prefixes(batch)
        at, k = np.unique(slot(p.word[p.head]), return_counts=True)
        total[at] += k.astype(np.uint32)
        n += int(p.head.sum())
    yield pieces_of(total, n)


def count_wide(batches: Iterator[pa.RecordBatch], counts: np.ndarray, pct: int) -> Iterator[pa.RecordBatch]:
    """Hashed counts of keys that may need salts, and their number."""
    total, n = np.zeros(1 << TABLE_BITS, np.uint32), 0
    for batch in batches:
        for key, *_, wide in Prefixes(batch).keys(counts, pct):
            if wide:
                at, k = np.unique(slot(key), return_counts=True)
                total[at] += k.astype(np.uint32)
                n += len(key)
    yield pieces_of(total, n)


#: Columns of packed postings; ``y`` follows for lines of ``WIDE`` words or more, where ``x`` alone tells little.
COLUMNS = ("key", "doc", "line", "n", "place", "side", "x")
WIDE = 64


def packed(cols: dict[str, np.ndarray]) -> bytes:
    """Columns of postings, sorted by doc, as bytes: numbers (of documents, their differences) in the fewest bytes that hold their range."""
    out = [np.array([len(cols["key"]), cols["doc"][0]], "<i8").tobytes()]
    for name in COLUMNS:
        x = cols[name]
        if name in ("key", "x"):
            out.append(x.tobytes())
            continue
        x = np.diff(x, prepend=x[:1]) if name == "doc" else x.astype(np.int64)
        low = int(x.min())
        top = int(x.max()) - low
        size = 0 if not top else next(s for s in (1, 2, 4, 8) if top < 1 << (8 * s))
        out += [np.array([low, size], "<i8").tobytes(), (x - low).astype(f"<u{size}").tobytes() if size else b""]
    out.append(cols["y"][cols["n"] >= WIDE].tobytes())
    return b"".join(out)


def unpacked(raw: bytes) -> dict[str, np.ndarray]:
    m, doc = np.frombuffer(raw, "<i8", 2).tolist()
    at, out = 16, {}
    for name in COLUMNS:
        kind = {"key": "<u4", "x": "<u8"}.get(name)
        if kind is not None:
            out[name] = np.frombuffer(raw, kind, m, at)
            at += out[name].nbytes
            continue
        low, size = np.frombuffer(raw, "<i8", 2, at).tolist()
        at += 16
        x = (np.frombuffer(raw, f"<u{size}", m, at).astype(np.int64) if size else np.zeros(m, np.int64)) + low
        at += size * m
        out[name] = doc + np.cumsum(x) if name == "doc" else x.astype(np.int32)
    out["y"] = np.zeros(m, np.uint64)
    out["y"][out["n"] >= WIDE] = np.frombuffer(raw, "<u8", -1, at)
    return out


POSTED = "bucket int, rows binary"
#: Which sides of pairs a posting takes: earlier line, later line, both.
EARLIER, LATER, BOTH = 1, 2, 3


def posted(batches: Iterator[pa.RecordBatch], counts: np.ndarray, wide: np.ndarray | None, buckets: int, pct: int, asked: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Postings of lines, packed by bucket. With ``asked`` (which slots hold keys of open lines) only lines with ``open`` are later ones."""
    held: list[dict[str, np.ndarray]] = []
    size = 0

    def sent() -> pa.RecordBatch:
        all_ = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        at = all_.pop("bucket")
        order = np.lexsort((all_["doc"], at))
        head = np.flatnonzero(np.append(True, at[order][1:] != at[order][:-1]))
        rows = [packed({k: v[part] for k, v in all_.items()}) for part in np.split(order, head[1:])]
        return pa.RecordBatch.from_arrays([pa.array(at[order][head], pa.int32()), pa.array(rows, pa.binary())], names=["bucket", "rows"])

    for batch in batches:
        if not batch.num_rows:
            continue
        doc, line, x, y = (batch.column(c).to_numpy() for c in ("doc_id", "line", "x", "y"))
        is_open = batch.column("open").to_numpy(zero_copy_only=False) if asked is not None else None
        p = Prefixes(batch)
        for key, owner, room, hot in p.keys(counts, pct):
            side = np.full(len(key), BOTH, np.int8)
            if asked is not None:
                use = asked[slot(key)]
                key, owner, room = key[use], owner[use], room[use]
                side = np.where(is_open[owner], BOTH, EARLIER).astype(np.int8)
            home = key
            if hot and wide is not None and len(key):
                salts = 1 + wide[slot(key)].astype(np.int64) // HOT
                mine = textvec.mix(doc[owner].astype(np.uint64) * _ODD + line[owner].astype(np.uint64)) % salts.astype(np.uint64)
                each = np.repeat(np.arange(len(key)), salts)
                salt = (np.arange(len(each)) - np.repeat(np.cumsum(salts) - salts, salts)).astype(np.uint64)
                side = np.where(salt == mine[each], side[each], side[each] & EARLIER)
                key, owner, room = key[each], owner[each], room[each]
                home = np.where(salts[each] > 1, textvec.mix(key + salt), key)
            if len(key):
                home = textvec.mix(home)
                held.append(
                    {
                        "bucket": (home >> np.uint64(32)).astype(np.int64) % buckets,
                        "key": home.astype(np.uint32),
                        "doc": doc[owner],
                        "line": line[owner],
                        "n": p.n[owner],
                        "place": (p.n[owner] - room).astype(np.int32),
                        "side": side,
                        "x": x[owner].view(np.uint64),
                        "y": y[owner].view(np.uint64),
                    }
                )
                size += len(key)
            if size >= HELD:
                yield sent()
                held, size = [], 0
    if held:
        yield sent()


FOUND = "b_doc long, b_line int, far int, a_doc long, a_line int, more boolean"


def candidates(c: dict[str, np.ndarray], pct: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(earlier, later, differing bits) of postings, sorted by (key, n), that may be of similar lines."""
    n, doc, line, side = (c[k] for k in ("n", "doc", "line", "side"))
    room = n - c["place"]
    i, step = np.arange(len(n)), 0
    while len(i):
        step += 1
        i = i[i + step < len(n)]
        j = i + step
        # sizes grow within a key: what is too large now stays so
        i = i[(c["key"][i] == c["key"][j]) & (100 * n[i] >= pct * n[j])]
        j = i + step
        fits = np.minimum(room[i], room[j]) * (100 + pct) >= pct * (n[i] + n[j])
        a, b = i[fits], j[fits]
        far = np.bitwise_count(c["x"][a] ^ c["x"][b]).astype(np.int64)
        both = (n[a] >= WIDE) & (n[b] >= WIDE)
        far += np.where(both, np.bitwise_count(c["y"][a] ^ c["y"][b]), 0)
        near = far * (100 + pct) <= (100 - pct) * (n[a] + n[b])
        a, b, far = a[near], b[near], far[near]
        swap = (doc[a] > doc[b]) | ((doc[a] == doc[b]) & (line[a] > line[b]))
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        good = (side[a] & EARLIER > 0) & (side[b] & LATER > 0) & ((doc[a] != doc[b]) | (line[a] != line[b]))
        if good.any():
            yield a[good], b[good], far[good]


def met(pct: int, nearest: int | None):
    """Function of a bucket: the candidates of each later line, or its ``nearest`` ones only; ``more`` tells of others."""

    def few(c, a, b, far, more):
        """The nearest of each line; of equals the first."""
        order = np.lexsort((c["line"][a], c["doc"][a], far, c["line"][b], c["doc"][b]))
        a, b, far, more = a[order], b[order], far[order], more[order]
        new = np.append(True, (c["doc"][b[1:]] != c["doc"][b[:-1]]) | (c["line"][b[1:]] != c["line"][b[:-1]]))
        again = ~new & np.append(False, (c["doc"][a[1:]] == c["doc"][a[:-1]]) & (c["line"][a[1:]] == c["line"][a[:-1]]))
        owner = np.cumsum(new) - 1
        owner_more = np.bincount(owner, more) > 0
        a, b, far, owner = a[~again], b[~again], far[~again], owner[~again]
        head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        rank = np.arange(len(a)) - head[owner]
        owner_more |= np.bincount(owner) > nearest
        keep = rank < nearest
        return a[keep], b[keep], far[keep], owner_more[owner[keep]]

    def rows(c, a, b, far, more) -> pa.RecordBatch:
        cols = [pa.array(c["doc"][b]), pa.array(c["line"][b], pa.int32()), pa.array(far, pa.int32()), pa.array(c["doc"][a]), pa.array(c["line"][a], pa.int32()), pa.array(more)]
        return pa.RecordBatch.from_arrays(cols, names=["b_doc", "b_line", "far", "a_doc", "a_line", "more"])

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpacked(raw.as_py()) for batch in batches for raw in batch.column("rows")]
        c = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        order = np.lexsort((c["n"], c["key"]))
        c = {k: v[order] for k, v in c.items()}
        held: list = []
        size = 0
        for a, b, far in candidates(c, pct):
            held.append((a, b, far, np.zeros(len(a), bool)))
            size += len(a)
            if size >= PAIRS:
                all_ = tuple(np.concatenate(x) for x in zip(*held, strict=True))
                if nearest is None:
                    yield rows(c, *all_)
                    held, size = [], 0
                else:
                    held = [few(c, *all_)]
                    size = 0
        if held:
            all_ = tuple(np.concatenate(x) for x in zip(*held, strict=True))
            yield rows(c, *(all_ if nearest is None else few(c, *all_)))

    return run


def wanted_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, line, s): the sets of the ``wanted`` lines of documents, as 64-bit hashes."""
    for batch in batches:
        for part in textvec.slices(batch, "text"):
            data, offsets = textvec.buffers(part.column("text"))
            rows, begin = lines_of(data, offsets)
            first = np.searchsorted(rows, np.arange(len(offsets)))
            lists = part.column("wanted")
            row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            number = lists.flatten().to_numpy()
            line = first[row] + number
            stop = np.append(begin, len(data))[line + 1]
            last = line + 1 == first[row + 1]
            stop = np.where(last, offsets[row + 1], stop - 1)
            raw = data.tobytes()
            texts = pa.array([raw[x:y] for x, y in zip(begin[line].tolist(), stop.tolist(), strict=True)], pa.binary())
            w = Words(texts)
            ends = pa.array(np.append(w.begin, len(w.h)).astype(np.int32))
            sets = pa.ListArray.from_arrays(ends, pa.array(w.h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(number, pa.int32()), sets], names=["doc_id", "line", "s"])


def small_lists(df: DataFrame, column: str) -> DataFrame:
    """Broadcast hint for a staged frame of lists, if their counted lengths are within the bound."""
    size = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(column)), F.lit(0)).alias("m")).first()
    return F.broadcast(df) if size.n <= LIST_DOCS and size.m <= LIST_LINES else df


def similar(source: DataFrame, pairs: DataFrame, pct: int) -> DataFrame:
    """The later lines (doc_id, line) of staged pairs (b_doc, b_line, a_doc, a_line) whose full sets are similar; staged."""
    with common.Stages() as done:
        firsts = done.stage(pairs.select(F.col("a_doc").alias("doc_id"), F.col("a_line").alias("line")).distinct(), "firsts")
        laters = done.stage(pairs.select(F.col("b_doc").alias("doc_id"), F.col("b_line").alias("line")).distinct(), "laters")
        wanted = done.stage(firsts.union(laters).groupBy("doc_id").agg(F.collect_set("line").alias("wanted")), "wanted")
        read = source.join(small_lists(wanted, "wanted"), "doc_id").select("doc_id", "text", "wanted")
        sets = done.stage(read.mapInArrow(common.tidy(wanted_sets), "doc_id long, line int, s array<long>"), "sets")
        on_a = sets.join(common.small(firsts), ["doc_id", "line"], "left_semi").select(F.col("doc_id").alias("a_doc"), F.col("line").alias("a_line"), "s")
        on_b = sets.join(common.small(laters), ["doc_id", "line"], "left_semi").select(F.col("doc_id").alias("b_doc"), F.col("line").alias("b_line"), F.col("s").alias("t"))
        both = on_b.join(pairs, ["b_doc", "b_line"]).join(on_a, ["a_doc", "a_line"])
        inter = F.size(F.array_intersect("s", "t"))
        good = both.filter(100 * inter >= pct * (F.size("s") + F.size("t") - inter))
        return common.stage(good.select(F.col("b_doc").alias("doc_id"), F.col("b_line").alias("line")).distinct(), "later")


def repeated_lines(docs: DataFrame, pct: int = 80) -> DataFrame:
    """(doc_id, removed array<int>): the numbers, from 0, of lines that repeat an earlier line; only documents with such lines."""
    if not 75 <= pct <= 100:
        raise ValueError("pct must be 75 to 100")
    spark = docs.sparkSession
    source = common.texts(docs, F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    with common.Stages() as done:

        def share(value):
            return done.share(spark, value)

        rank = share(rarity(gathered(source.select("text").mapInArrow(common.tidy(count_words), PIECES))[0]))
        lines = done.stage(source.mapInArrow(common.tidy(lambda it: described(it, rank.value, pct)), LINES), "lines")
        rank.destroy()
        done.values.remove(rank)
        # Sets that occur more than once, with their first lines: all other lines are the only ones of their classes.
        same = ["d", "x", "y", "n"]
        groups = lines.groupBy(*same).agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("k")).filter("k > 1")
        groups = done.stage(groups.select(*same, "first"), "groups")
        judged = lines.join(common.small(groups, common.BROADCAST_ROWS // 3), same, "left")
        place = F.struct("doc_id", "line")
        repeats = done.stage(judged.filter(F.col("first") != place).select("doc_id", "line"), "repeats")
        classes = judged.filter(F.col("first").isNull() | (F.col("first") == place)).select("doc_id", "line", "n", "x", "y", "p").filter("size(p) > 0")
        counts, total = gathered(lines.select("n", "p").mapInArrow(common.tidy(count_prefixes), PIECES))
        wide, n_wide = None, 0
        shared, hot = share(counts), (counts > HOT).any()
        del counts
        if hot:
            wide, n_wide = gathered(lines.select("n", "p").mapInArrow(common.tidy(lambda it: count_wide(it, shared.value, pct)), PIECES))
        salts = share(wide)
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total + n_wide) // BUCKET))

        def meeting(lines: DataFrame, nearest: int | None, asked=None) -> DataFrame:
            def run(it):
                return posted(it, shared.value, salts.value, buckets, pct, None if asked is None else asked.value)

            return lines.mapInArrow(common.tidy(run), POSTED).groupBy("bucket").applyInArrow(common.tidy_group(met(pct, nearest)), FOUND)

        found = done.stage(meeting(classes, NEAREST), "found")
        line_b = ["b_doc", "b_line"]
        best = F.min(F.struct("far", "a_doc", "a_line")).alias("p")
        nearest = done.stage(found.groupBy(*line_b).agg(best, F.max("more").alias("more")).select(*line_b, "p.a_doc", "p.a_line", "more"), "nearest")
        first = done.keep(similar(source, nearest.select(*line_b, "a_doc", "a_line"), pct))
        settled = first.select(F.col("doc_id").alias("b_doc"), F.col("line").alias("b_line"))
        left = found.join(common.small(settled), line_b, "left_anti").join(nearest, [*line_b, "a_doc", "a_line"], "left_anti")
        second = done.keep(similar(source, done.stage(left.select(*line_b, "a_doc", "a_line").distinct(), "others"), pct))
        later = first.union(second)
        # what remains open is compared with every earlier line it shares a key with
        more = found.filter("more").select(F.col("b_doc").alias("doc_id"), F.col("b_line").alias("line")).distinct()
        open_ = done.stage(more.join(common.small(later.select("doc_id", "line")), ["doc_id", "line"], "left_anti"), "open")
        if not open_.isEmpty():
            flagged = classes.join(common.small(open_.withColumn("open", F.lit(True))), ["doc_id", "line"], "left").withColumn("open", F.coalesce("open", F.lit(False)))
            flagged = flagged.select("doc_id", "line", "n", "x", "y", "p", "open")
            keys, _ = gathered(flagged.filter("open").select("n", "p").mapInArrow(lambda it: count_keys(it, shared.value, pct), PIECES))
            rest = meeting(flagged, None, share(keys > 0)).select(*line_b, "a_doc", "a_line").distinct()
            rest = rest.join(found, [*line_b, "a_doc", "a_line"], "left_anti")
            later = later.union(done.keep(similar(source, done.stage(rest, "rest"), pct)))
        removed = repeats.union(later.select("doc_id", "line"))
        return common.stage(removed.groupBy("doc_id").agg(F.array_sort(F.collect_list("line")).alias("removed")), "removed")


def count_keys(batches: Iterator[pa.RecordBatch], counts: np.ndarray, pct: int) -> Iterator[pa.RecordBatch]:
    """Hashed counts of all keys."""
    total = np.zeros(1 << TABLE_BITS, np.uint32)
    for batch in batches:
        for key, *_ in Prefixes(batch).keys(counts, pct):
            total[np.unique(slot(key))] = 1
    yield pieces_of(total, 0)


def without_repeated_lines(docs: DataFrame, pct: int = 80) -> DataFrame:
    """All columns of ``docs``, with ``text`` without its repeated lines, and ``_lines``, ``_removed``: their numbers.

    Lines end at newlines; words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Lines without words stay. A null text stays null
    and has no lines; an empty table gives an empty one. doc_ids must be unique (rows with a null doc_id stay as they are). Further columns pass
    through, whatever their names but the two above, which raise a ValueError.
    """
    if {"_lines", "_removed"} & set(docs.columns):
        raise ValueError("_lines and _removed are names of results")
    key, gone_ = common.free_names(docs, "doc", "gone")
    removed = repeated_lines(docs, pct).select(F.col("doc_id").alias(key), F.col("removed").alias(gone_))
    joined = docs.join(small_lists(removed, gone_), F.col("doc_id").cast("long") == F.col(key), "left")
    parts = F.split("text", "\n", -1)
    left = F.filter(parts, lambda x, i: ~F.array_contains(F.col(gone_), i.cast("int")))
    text = F.when(F.col(gone_).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return joined.select(
        *(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns),
        F.coalesce(F.size(parts), F.lit(0)).alias("_lines"),
        F.coalesce(F.size(gone_), F.lit(0)).alias("_removed"),
    )


def op8_line_set_join(spark, sf_dir: str) -> DataFrame:
    out = without_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id",
        F.when(F.col("_lines") < 0, 0).otherwise(F.col("_lines")).cast("long").alias("n_lines"),
        F.when(F.col("_removed") < 0, 0).otherwise(F.col("_removed")).cast("long").alias("n_removed"),
        F.length(text).cast("long").alias("kept_chars"),
        F.sha2(text, 256).alias("kept_sha256"),
    )
