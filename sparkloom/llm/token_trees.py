"""Token counts that follow edits.

Each document keeps a segment tree. Leaves are stretches of pre-tokens, cut only before a single space between two
characters that are no white space, or between a letter or digit and a sign, where no token of the vocabulary crosses; inner
nodes hold the sums of characters and ids below them. An edit finds its leaves by character sums, re-encodes only these, plus neighbours
where the edit made a cut unsafe (the boundary context), and updates the sums on their paths to the root. A large insertion becomes leaves of its own; only sums
are then added up anew. A stretch without any cut is one leaf, however long.

Scale: building is one pass over the texts. Trees are a table keyed by doc_id; a batch of edits joins them by
doc_id, and untouched documents are not read again unless asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textvec, tokens

#: Bytes of a leaf, about; a leaf of more than 8 times that is cut again.
LEAF = 128
#: No cut before a bar, which is in the vocabulary's marker for the end of a text.
CUT = regex.compile(r"(?<=\S)(?= \S)|(?<=[\p{L}\p{N}])(?=[^\s\p{L}\p{N}|])")


def safe(left: str, right: str) -> bool:
    """Whether the ids of ``left + right`` are those of both in turn, as far as their ends tell (false where unsure)."""
    near = left[-1:] + right[:2]
    return len(near) > 1 and any(m.start() == 1 for m in CUT.finditer(near))


def stretches(text: str) -> list[str]:
    """``text`` in leaves of about ``LEAF`` characters, as far as cuts allow."""
    out, at = [], 0
    for m in CUT.finditer(text):
        if m.start() - at >= LEAF:
            out.append(text[at : m.start()])
            at = m.start()
    return [*out, text[at:]]


class TokenTree:
    """``texts`` and ``counts`` of leaves; ``chars`` and ``ids`` are sums over an implicit binary tree whose root is 1."""

    def __init__(self, texts: list[str], counts: list[int]):
        self.texts = texts or [""]
        counts = counts or [0]
        self.width = 1 << (len(self.texts) - 1).bit_length()
        pad = [0] * (self.width - len(self.texts))
        self.chars = [0] * self.width + [len(t) for t in self.texts] + pad
        self.ids = [0] * self.width + list(counts) + pad
        for k in range(self.width - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.ids[k] = self.ids[2 * k] + self.ids[2 * k + 1]
        self.encoded = 0

    @classmethod
    def build(cls, text: str, count) -> TokenTree:
        """``count`` gives the number of ids of a string."""
        texts = stretches(text)
        return cls(texts, [count(t) for t in texts])

    @property
    def total(self) -> int:
        return self.ids[1]

    @property
    def text(self) -> str:
        return "".join(self.texts)

    def leaf(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at ``place`` (the last leaf with text for the end), and the place in it."""
        if place >= self.chars[1]:
            k = len(self.texts) - 1
            while k and not self.texts[k]:
                k -= 1
            return k, len(self.texts[k])
        k = 1
        while k < self.width:
            k *= 2
            if place >= self.chars[k]:
                place -= self.chars[k]
                k += 1
        return k - self.width, place

    def put(self, k: int, text: str, count: int) -> None:
        self.texts[k] = text
        k += self.width
        more, many = len(text) - self.chars[k], count - self.ids[k]
        while k:
            self.chars[k] += more
            self.ids[k] += many
            k //= 2

    def edit(self, start: int, length: int, new: str, count) -> None:
        """Replace ``length`` characters from ``start`` (both cut to the text) by ``new``."""
        start = max(0, min(start, self.chars[1]))
        length = max(0, min(length, self.chars[1] - start))
        a, at = self.leaf(start)
        b, end = self.leaf(start + length) if length else (a, at)
        if b < a:
            b, end = a, at
        before = "".join(self.texts[a : b + 1])
        skip = sum(map(len, self.texts[a:b]))
        region = before[:at] + new + before[skip + end :]
        # boundary context: a neighbour joins while the cut between it and the region is not safe
        while True:
            left = a - 1
            while left >= 0 and not self.texts[left]:
                left -= 1
            right = b + 1
            while right < len(self.texts) and not self.texts[right]:
                right += 1
            if left >= 0 and not safe(self.texts[left], region):
                region, a = self.texts[left] + region, left
            elif right < len(self.texts) and not safe(region, self.texts[right]):
                region, b = region + self.texts[right], right
            else:
                break
        self.encoded += len(region)
        if len(region) > 8 * LEAF:
            parts = stretches(region)
            counts = self.ids[self.width : self.width + len(self.texts)]
            done = self.encoded
            self.__init__([*self.texts[:a], *parts, *self.texts[b + 1 :]], [*counts[:a], *(count(t) for t in parts), *counts[b + 1 :]])
            self.encoded = done
            return
        self.put(a, region, count(region))
        for k in range(a + 1, b + 1):
            self.put(k, "", 0)


def leaves(enc: tokens.Encoder, column: pa.Array) -> Iterator[tuple[list[str], list[int]]]:
    """Leaf texts and counts of every text of a column (null: no leaf)."""
    data, offsets, starts, first, _, n, alone = enc.look_up(column)
    raw = data.tobytes()
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    bin_ = (starts - offsets[row]) // LEAF
    new = np.ones(len(starts), bool)
    new[1:] = (row[1:] != row[:-1]) | (bin_[1:] != bin_[:-1])
    head = np.flatnonzero(new)
    total = np.add.reduceat(n, head).tolist() if len(head) else []
    of_row = np.searchsorted(row[head], np.arange(len(offsets)))
    begin = starts[head]
    begin = np.where(begin > offsets[row[head]], begin - 1, begin).tolist()
    for k in range(len(offsets) - 1):
        if alone[k]:
            tree = TokenTree.build(column[k].as_py(), lambda t: len(enc.whole(t)))
            yield tree.texts, tree.ids[tree.width : tree.width + len(tree.texts)]
        else:
            a, b = of_row[k], of_row[k + 1]
            ends = (begin[a + 1 : b] + [int(offsets[k + 1])])[: b - a]
            texts, counts = [raw[x:y].decode() for x, y in zip(begin[a:b], ends, strict=True)], total[a:b]
            if any(len(t) > 8 * LEAF for t in texts):
                cut = [(t, n) if len(t) <= 8 * LEAF else None for t, n in zip(texts, counts, strict=True)]
                pairs = [[c] if c else [(x, len(enc.whole(x))) for x in stretches(t)] for c, t in zip(cut, texts, strict=True)]
                texts, counts = map(list, zip(*(x for p in pairs for x in p), strict=True))
            yield texts, counts


TREES = "doc_id long, n_tokens long, leaves array<string>, counts array<int>"


def build_trees(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, leaves, counts) of every (doc_id, text): what a tree is made of. A null text has no leaf and no token.

    Repeated rows each give a tree (and ``apply_edits`` edits each); an empty table gives none; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer, "byte")
        for batch in batches:
            for part in textvec.slices(batch, "text"):
                texts, counts = zip(*leaves(enc, part.column("text")), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([sum(c) for c in counts], pa.int64()), pa.array(texts, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int32()))],
                    names=["doc_id", "n_tokens", "leaves", "counts"],
                )

    return common.texts(docs, F.col("doc_id").cast("long"), "text").mapInArrow(run, TREES)


def apply_edits(trees: DataFrame, edits: DataFrame, tokenizer: str) -> DataFrame:
    """Trees after (doc_id, seq, start, length, new) edits, each in terms of the text that the earlier ones (by seq) left.

    Documents without edits keep their rows; edits of absent documents are ignored; a null ``new`` is empty, null numbers
    are 0, places beyond the text are cut to it. ``n_encoded`` tells how many characters were encoded again.
    """
    seq = F.array_sort(F.collect_list(F.struct("seq", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), "new")))
    grouped = edits.groupBy(F.col("doc_id").cast("long").alias("e_doc")).agg(seq.alias("edits"))
    joined = trees.join(grouped, F.col("doc_id") == F.col("e_doc"), "left").select("doc_id", "leaves", "counts", "edits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer, "byte")
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                tree = TokenTree(r["leaves"], r["counts"])
                for e in r["edits"] or []:
                    tree.edit(e["start"] or 0, e["length"] or 0, e["new"] or "", lambda t: len(enc.whole(t)))
                out.append((r["doc_id"], tree.total, tree.texts, tree.ids[tree.width : tree.width + len(tree.texts)], tree.encoded))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            types = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "n_tokens", "leaves", "counts", "n_encoded"])

    return joined.mapInArrow(run, TREES + ", n_encoded long")


def revision(text: str) -> list[tuple[int, int, str]]:
    """The edits by which the registered query revises a text: delete, insert and replace words at its quarters."""
    n = len(text)
    return [(n // 4, min(12, n), ""), (n // 2, 0, " a new phrase"), (3 * n // 4, min(5, n), "other")]


def revise(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, n_edited (ids after the edits of ``revision``), n_encoded (characters encoded for them), in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer, "byte")
        for batch in batches:
            for part in textvec.slices(batch, "text"):
                out = []
                for text, (texts, counts) in zip(part.column("text").to_pylist(), leaves(enc, part.column("text")), strict=True):
                    tree = TokenTree(texts, counts)
                    before = tree.total
                    for start, length, new in revision(text or ""):
                        tree.edit(start, length, new, lambda t: len(enc.whole(t)))
                    out.append((before, tree.total, tree.encoded))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))], names=["doc_id", "n_tokens", "n_edited", "n_encoded"]
                )

    return common.texts(docs, F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_edited long, n_encoded long")


def op3_token_trees(spark, sf_dir: str) -> DataFrame:
    return revise(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokens.public("byte_bpe_50k.json"))
