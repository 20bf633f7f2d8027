"""Hashed counts over all rows: a table of fixed size, whatever the input's, sent in compressed pieces."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TABLE_BITS = 22
PIECE_BITS = 16
PIECES = "piece int, counts binary"


def slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def pieces_of(total: np.ndarray, n: int) -> pa.RecordBatch:
    """Counts as compressed pieces of the table; piece -1 holds ``n``."""
    pieces = total.reshape(-1, 1 << PIECE_BITS)
    used = np.flatnonzero(pieces.any(1))
    packed = [zlib.compress(pieces[k].astype(np.int64).tobytes(), 1) for k in used] + [zlib.compress(np.array([n], np.int64).tobytes())]
    return pa.RecordBatch.from_arrays([pa.array(np.append(used, -1), pa.int32()), pa.array(packed, pa.binary())], names=["piece", "counts"])


def add_counts(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for raw in batch.column("counts"):
            x = np.frombuffer(zlib.decompress(raw.as_py()), np.int64)
            total = x if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["piece", "counts"])


def gathered(rows: DataFrame) -> tuple[np.ndarray, int]:
    """The table of hashed counts of fixed size, whatever the input's (16 MB, counts end at 2**32 - 1), and the number beside it."""
    table, n = np.zeros(1 << TABLE_BITS, np.uint32), 0
    for r in rows.groupBy("piece").applyInArrow(add_counts, PIECES).collect():
        x = np.frombuffer(zlib.decompress(bytes(r.counts)), np.int64)
        if r.piece < 0:
            n = int(x[0])
        else:
            table[r.piece << PIECE_BITS : (r.piece + 1) << PIECE_BITS] = np.minimum(x, 2**32 - 1)
    return table, n
