"""Vectorised work on Arrow text columns: word spans and 64-bit word hashes without Python strings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; one longer text makes a slice of its own.
SLICE = 1 << 19

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = []

#: Words of more bytes are hashed one by one.
LONG = 64
#: The first bytes of eight.
_FRONT = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return data | (((data - np.uint8(65)) < 26).view(np.uint8) << 5)


def spaced(data: np.ndarray) -> np.ndarray:
    """True at bytes of words: all but space and 0x09-0x0D."""
    return ~((data == 32) | ((data - np.uint8(9)) < 5))


def alnum(data: np.ndarray) -> np.ndarray:
    """True at bytes of words, after lower-casing A-Z: digits, a-z and all from 0x80."""
    return ((data - np.uint8(48)) < 10) | ((data - np.uint8(97)) < 26) | (data >= 128)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE + 1)
        up, down = np.full(size, _P), np.full(size, _PINV)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold about ``size`` bytes; every row has at least itself."""
    if not batch.num_rows:
        return
    _, offsets = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def spans(word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of True within rows, and the first run's number of each row (and their count at the end)."""
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    edge = offsets[(offsets > 0) & (offsets < len(word))]
    start[edge] = word[edge]
    end[edge - 1] = word[edge - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``data`` on (0 beyond its end), and at its end, as numbers."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def front(eight: np.ndarray, starts: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The first ``left`` (8 at most) bytes at ``starts``."""
    return eight[starts] & _FRONT[np.minimum(left, 8)]


def equal(data: np.ndarray, eight: np.ndarray, at: np.ndarray, data2: np.ndarray, eight2: np.ndarray, at2: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes at ``at`` equal those at ``at2`` of the other data; ``eight`` and ``eight2`` are the ``eights`` of both."""
    out = front(eight, at, size) == front(eight2, at2, size)
    k = 8
    more = np.flatnonzero(out & (size > k))
    huge = more[size[more] > LONG]
    more = more[size[more] <= LONG]
    while len(more):
        out[more] = front(eight, at[more] + k, size[more] - k) == front(eight2, at2[more] + k, size[more] - k)
        k += 8
        more = more[size[more] > k]
    for w in huge.tolist():
        a, b, n = at[w], at2[w], size[w]
        out[w] = np.array_equal(data[a : a + n], data2[b : b + n])
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges; equal ranges have equal hashes wherever they lie.

    Ranges of one length up to 8 bytes never collide; longer ones are mixed eight bytes at a time, and beyond ``LONG`` bytes
    hashed by BLAKE2.
    """
    size = ends - starts
    eight = eights(data)
    h = mix(front(eight, starts, size) ^ (size.astype(np.uint64) * _P))
    k = 8
    more = np.flatnonzero(size > k)
    huge = more[size[more] > LONG]
    more = more[size[more] <= LONG]
    while len(more):
        h[more] = mix(h[more] * _P + front(eight, starts[more] + k, size[more] - k))
        k += 8
        more = more[size[more] > k]
    for w in huge.tolist():
        h[w] = int.from_bytes(hashlib.blake2b(data[starts[w] : ends[w]], digest_size=8).digest(), "little")
    return h
