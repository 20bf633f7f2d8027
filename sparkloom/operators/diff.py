"""Word differences of two texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import floor, isqrt

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.text import WS

SPLIT = re.compile(rf"({WS}+|[()\[\]{{}},;:.!?'\"。、])")


def words(text: str | None) -> list[str]:
    """Words and single punctuation marks."""
    return [t for t in SPLIT.split(text or "") if t and t.strip()]


#: Words of the second text that stand in more places keep their places as bits; those of others are set anew for each use.
FREQUENT = 128


class Rows:
    """Rows of the table of longest common subsequences of all prefixes, a bit for each word of ``b``: is the row as long without this word?

    A row follows from the one before by an addition, a subtraction and two bit operations on whole rows. Every ``step``-th one is kept, and those between are made
    again where the way back needs them: memory grows with the root of the first text's length.
    """

    def __init__(self, a: list[str], b: list[str]):
        self.a, self.size = a, len(b)
        self.places: dict[str, list[int]] = {}
        for k, w in enumerate(b):
            self.places.setdefault(w, []).append(k)
        self.bits = {w: self._mask(p) for w, p in self.places.items() if len(p) > FREQUENT}
        self.step = isqrt(len(a)) + 1
        self.kept = [(1 << self.size) - 1]
        row = self.kept[0]
        for i in range(len(a)):
            row = self._next(row, i)
            if (i + 1) % self.step == 0:
                self.kept.append(row)
        self.block, self.rows = -1, [row]

    def _mask(self, places: list[int]) -> int:
        out = bytearray(self.size // 8 + 1)
        for k in places:
            out[k >> 3] |= 1 << (k & 7)
        return int.from_bytes(out, "little")

    def _next(self, row: int, i: int) -> int:
        w = self.a[i]
        if w not in self.places:
            return row
        used = row & (self.bits[w] if w in self.bits else self._mask(self.places[w]))
        return ((row + used) | (row - used)) & self.kept[0]

    def as_long_without(self, i: int, j: int) -> bool:
        """Whether the first ``i`` words of one and ``j`` of the other have as long a subsequence without the last of these ``j``."""
        block = i // self.step
        if block != self.block:
            self.block, self.rows = block, [self.kept[block]]
            for k in range(block * self.step, min(len(self.a), (block + 1) * self.step - 1)):
                self.rows.append(self._next(self.rows[-1], k))
        return bool(self.rows[i - block * self.step] >> (j - 1) & 1)


def diff(left: str | None, right: str | None) -> list[tuple[str, str]]:
    """(word, equal | deleted | inserted) in order. Of two ways the one that inserts later words first, read from the end, is taken."""
    a, b = words(left), words(right)
    i, j, out = len(a), len(b), []
    while i and j and a[i - 1] == b[j - 1]:  # read from the end, equal words are always taken
        i, j = i - 1, j - 1
        out.append((a[i], "equal"))
    later = Rows(a[:i], b[:j]) if i and j else None
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((a[i], "equal"))
        elif j and (not i or later.as_long_without(i, j)):
            j -= 1
            out.append((b[j], "inserted"))
        else:
            i -= 1
            out.append((a[i], "deleted"))
    return out[::-1]


def unified(left: str | None, right: str | None) -> list[tuple[str, str]]:
    """The same words, in each stretch between equal words the deleted ones before the inserted ones."""
    out, new = [], []
    for word, kind in diff(left, right):
        if kind == "inserted":
            new.append((word, kind))
            continue
        if kind == "equal":
            out += new
            new = []
        out.append((word, kind))
    return out + new


def stats(left: str | None, right: str | None) -> tuple[int, int, int, int]:
    """Equal, deleted and inserted words, and the share of the left words that are equal in percent."""
    kinds = [k for _, k in diff(left, right)]
    equal, gone, new = kinds.count("equal"), kinds.count("deleted"), kinds.count("inserted")
    total = equal + gone
    return equal, gone, new, int(floor(100 * equal / total + 0.5)) if total else 0


def with_diff(df: DataFrame, left: str, right: str) -> DataFrame:
    """``df`` with equal, deleted, inserted and similarity of two text columns. Two texts of 200,000 words take some 100 MB and seconds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [stats(a, b) for a, b in zip(batch[left], batch[right], strict=True)]
            yield batch.assign(**{n: [g[k] for g in got] for k, n in enumerate(("equal", "deleted", "inserted", "similarity"))})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, equal int, deleted int, inserted int, similarity int")


def unified_rows(df: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """(key, place, word, kind): the words of two text columns in unified order, a row each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, a, b in zip(batch[key], batch[left], batch[right], strict=True):
                rows = unified(a, b)
                if rows:
                    yield pd.DataFrame({key: k, "place": range(len(rows)), "word": [w for w, _ in rows], "kind": [x for _, x in rows]})

    return df.select(key, left, right).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, place int, word string, kind string")
