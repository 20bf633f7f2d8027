"""Whole texts to token ids with the tokenizers library, encoding each distinct space-delimited chunk once.

Tokens of both vocabularies never cross a single space between two non-space characters, so a
text's ids are its chunks' ids in turn. Chunks are found by 64-bit hashes and recognised by their bytes; those not met before are
encoded by the library, a thousand a call, and all ids are put together by array gathers. A text where this cut is not safe, or with a
chunk whose hash belongs to another one, goes to the library whole. The memory of chunks is bounded and per worker; it changes
speed, never results.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from . import common, textvec

#: Chunks that a worker remembers; beyond it those met in one slice only are forgotten, or all if the others are over half of these.
CHUNKS = 400_000
_FIRST = np.uint64(0x5851F42D4C957F2D)


class Column:
    """An array that grows at its end; eight bytes beyond it may be read."""

    def __init__(self, kind):
        self.x, self.n = np.zeros(1 << 12, kind), 0

    def add(self, more: np.ndarray) -> None:
        need = self.n + len(more)
        if need + 8 > len(self.x):
            self.x = np.concatenate([self.x[: self.n], np.zeros(need + max(need // 2, 8), self.x.dtype)])
        self.x[self.n : need] = more
        self.n = need


class Encoder:
    """``kind`` "byte": a chunk keeps its leading space; "word": white space is dropped."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.kind = kind
        self.inside = np.ones(256, bool)
        self.inside[[32] if kind == "byte" else [10, 32]] = False
        if kind == "byte":
            size = self.lib.get_vocab_size()
            self.opens = np.array([self.lib.id_to_token(k).startswith("Ġ") for k in range(size)])
        else:
            (self.mark,) = self.lib.encode("0", add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        # sorted hashes and their chunks' numbers; of each chunk its ids' place and number, bytes, and whether it opens a text
        self.keys, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.pool, self.bytes = Column(np.uint16), Column(np.uint8)
        self.at, self.size, self.bad = Column(np.int64), Column(np.int32), Column(bool)
        self.begin, self.span, self.opened, self.met = Column(np.int64), Column(np.int64), Column(bool), Column(np.int32)

    def shrink(self) -> None:
        """Forget chunks that were met in one slice only."""
        old, kept = self.__dict__.copy(), np.flatnonzero(self.met.x[: self.met.n] > 1)
        self.forget()
        if len(kept) > CHUNKS // 2:
            return
        renamed = np.full(old["met"].n, -1, np.int32)
        renamed[kept] = np.arange(len(kept), dtype=np.int32)
        stay = renamed[old["number"]] >= 0
        self.keys, self.number = old["keys"][stay], renamed[old["number"][stay]]
        for at, counts, values in (("at", "size", "pool"), ("begin", "span", "bytes")):
            first, n = old[at].x[kept], old[counts].x[kept].astype(np.int64)
            upto = np.cumsum(n) - n
            getattr(self, at).add(upto)
            getattr(self, counts).add(n)
            getattr(self, values).add(old[values].x[np.repeat(first - upto, n) + np.arange(n.sum())])
        for name in ("bad", "opened", "met"):
            getattr(self, name).add(old[name].x[kept])

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, np.uint16)

    def together(self, texts: list[str]) -> np.ndarray:
        return np.concatenate([np.array(e.ids, np.uint16) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)])

    def each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after another, and their numbers."""
        ids = [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(ids)), np.uint16), np.array([len(x) for x in ids], np.int64)

    def several(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``each``, of chunks without a special case in them; a chunk's leading space is not in it."""
        if self.kind == "byte":
            ids = self.together([" " + " ".join(chunks[k : k + 1000]) for k in range(0, len(chunks), 1000)])
            begin = np.flatnonzero(self.opens[ids])
            if len(begin) == len(chunks):
                return ids, np.diff(np.append(begin, len(ids)))
            return self.each([" " + c for c in chunks])
        ids = self.together([" 0 ".join(chunks[k : k + 1000]) + " 0" for k in range(0, len(chunks), 1000)])
        end = np.flatnonzero(ids == self.mark)
        if len(end) == len(chunks):
            return np.delete(ids, end), np.diff(end, prepend=-1) - 1
        return self.each(chunks)

    def learn(self, keys: np.ndarray, raw: list[bytes], opening: np.ndarray) -> None:
        """``opening``: the chunk begins a text, so no space stands before it."""
        byte = self.kind == "byte"
        bad, odd, plain, texts = [], [], [], []
        chunks = [r.decode() for r in raw]
        for k, (c, first) in enumerate(zip(chunks, opening.tolist(), strict=True)):
            if byte and (c[0].isspace() or c[-1].isspace()):
                bad.append(k)
            elif "<" in c or not c.isprintable() or (first if byte else "0" in c):
                odd.append(k)
                texts.append(c if first or not byte else " " + c)
            else:
                plain.append(k)
        parts = [self.several([chunks[k] for k in plain])] if plain else []
        parts += [self.each(texts)] if texts else []
        parts.append((np.zeros(0, np.uint16), np.zeros(len(bad), np.int64)))
        order = np.array(plain + odd + bad, np.int64)
        where = np.searchsorted(self.keys, keys)
        number = np.empty(len(keys), np.int32)
        number[order] = np.arange(len(keys), dtype=np.int32) + self.at.n
        self.keys, self.number = np.insert(self.keys, where, keys), np.insert(self.number, where, number)
        size, span = np.concatenate([n for _, n in parts]), np.array([len(raw[k]) for k in order.tolist()], np.int64)
        for at, counts, values, n, more in (
            (self.at, self.size, self.pool, size, np.concatenate([x for x, _ in parts])),
            (self.begin, self.span, self.bytes, span, np.frombuffer(b"".join(raw[k] for k in order.tolist()), np.uint8)),
        ):
            at.add(values.n + np.cumsum(n) - n)
            counts.add(n)
            values.add(more)
        self.bad.add(np.arange(len(order)) >= len(order) - len(bad))
        self.opened.add(opening[order])
        self.met.add(np.zeros(len(order), np.int32))

    def look_up(self, column: pa.Array):
        """Chunks of a text column: bytes, starts, each row's first chunk, each chunk's place in the pool and number of ids, and
        the rows where chunks can't be encoded by themselves."""
        data, offsets = textvec.buffers(column)
        starts, ends, first = textvec.spans(self.inside[data], offsets)
        size = ends - starts
        h = textvec.word_hashes(data, starts, ends)
        n_rows, chunks = len(offsets) - 1, np.diff(first)
        alone = np.zeros(n_rows, bool)
        opens = np.zeros(len(starts), bool)
        if self.kind == "byte":
            spaces = np.searchsorted(np.flatnonzero(data == 32), offsets)
            alone = np.diff(spaces) != np.maximum(chunks - 1, 0)
            opening = first[:-1][chunks > 0]
            opens[opening] = True
            h[opening] = textvec.mix(h[opening] ^ _FIRST)
        unique, index, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) > CHUNKS:
            self.shrink()
        where = np.searchsorted(self.keys, unique)
        new = np.ones(len(unique), bool)
        if len(self.keys):
            new = self.keys[np.minimum(where, len(self.keys) - 1)] != unique
        if new.any():
            raw = data.tobytes()
            at = index[new]
            self.learn(unique[new], [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], opens[at])
            where = np.searchsorted(self.keys, unique)
        chunk = self.number[where]
        self.met.x[chunk] += 1
        # equal hashes are not enough: chunks of a hash are compared with the first of them here, and that with the known chunk
        eight = textvec.eights(data)
        known = np.ndarray(len(self.bytes.x) - 7, "<u8", self.bytes.x, strides=(1,))
        same = (self.span.x[chunk] == size[index]) & (self.opened.x[chunk] == opens[index])
        check = np.flatnonzero(same)
        one, met = index[check], chunk[check]
        same[check] = textvec.equal(data, eight, starts[one], self.bytes.x, known, self.begin.x[met], size[one])
        model = index[inverse]
        again = np.flatnonzero(model != np.arange(len(model)))
        to = model[again]
        alike = (size[again] == size[to]) & (opens[again] == opens[to])
        check = np.flatnonzero(alike)
        alike[check] = textvec.equal(data, eight, starts[again[check]], data, eight, starts[to[check]], size[again[check]])
        bad = (self.bad.x[chunk] | ~same)[inverse]
        bad[again[~alike]] = True
        if bad.any():
            alone[np.searchsorted(first, np.flatnonzero(bad), "right") - 1] = True
        return data, offsets, starts, first, self.at.x[chunk][inverse], self.size.x[chunk][inverse].astype(np.int64), alone

    def encode(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of a column, one text after another, and each text's number of ids; null is empty.

        With ``end_id`` every text is followed by it.
        """
        _, _, _, first, a, n, alone = self.look_up(column)
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self.pool.x[np.repeat(a - upto[:-1], n) + np.arange(upto[-1])]
        sizes = upto[first[1:]] - upto[first[:-1]]
        if alone.any():
            cut = np.concatenate([[0], np.cumsum(sizes)])
            parts = [self.whole(column[k].as_py()) if alone[k] else ids[cut[k] : cut[k + 1]] for k in range(len(alone))]
            ids, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
        if end_id is not None:
            ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
        return ids, sizes


def binary(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column of 16-bit little-endian ids, a row for each text."""
    offsets = np.concatenate([[0], 2 * np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u2"))])


def encoder(path: str, kind: str) -> Encoder:
    """One per worker process, while its tasks use it."""
    return common.kept((path, kind), lambda: Encoder(path, kind))


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
