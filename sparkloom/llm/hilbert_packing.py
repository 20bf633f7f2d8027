"""Packing along a space-filling curve.

Each document's hashed bag of token ids is projected to ``DIMS`` coordinates; their Hilbert index is the key by
which documents are range-sorted, so documents of one sequence are alike. Along the curve
the stream of ids is cut every ``length`` ids. What remains at the end of a range is cut
at powers of two, which need no padding.

Scale: texts are tokenised once, and 16-bit ids with their key are staged. One range shuffle on (key, doc_id) puts
neighbours together; each range packs itself, so nothing is numbered in one task. Equal
keys (copies, empty texts) are split by doc_id, so a group of copies with a third of all
rows spans many ranges.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textvec, tokens

LENGTH = 2048
#: Bytes of 16-bit ids of a range, about, unless the session's number of shuffle partitions asks for smaller ones.
RANGE = 32 << 20
DIMS = 4
BITS = 12
BUCKETS = 1 << 16


def projection() -> np.ndarray:
    """A fixed random direction of every coordinate for every hashed id."""
    return np.random.default_rng(4242).standard_normal((BUCKETS, DIMS)).astype(np.float32)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index of integer points (rows) along the Hilbert curve of their dimension, by Skilling's transform."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) > 0
            t = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def place(ids: np.ndarray, sizes: np.ndarray, proj: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents whose ids lie one after another."""
    at = np.cumsum(sizes) - sizes
    point = np.add.reduceat(proj[ids], at, axis=0)
    point /= np.maximum(np.linalg.norm(point, axis=1, keepdims=True), 1e-9)
    cell = np.clip(((point + 1) * (1 << (BITS - 1))).astype(np.int64), 0, (1 << BITS) - 1)
    return hilbert(cell)


def keyed(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    enc, proj = tokens.encoder(path, "byte"), projection()
    for batch in batches:
        for part in textvec.slices(batch, "text"):
            ids, sizes = enc.encode(part.column("text"), end_id)
            key = place(ids, sizes, proj)
            columns = [part.column("doc_id"), pa.array(key), pa.array(sizes, pa.int64()), tokens.binary(ids, sizes)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "n", "ids"])


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(batches: Iterator[pa.RecordBatch], length: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Pieces of a range in curve order. Holds back less than one sequence."""
    base, number = TaskContext.get().partitionId() << 40, 0
    rows: list[list] = []  # doc_id, start, ids of a piece, all ids of the document
    size = 0

    def close(pieces: list[list]) -> list[tuple]:
        nonlocal number
        at, out = 0, []
        for doc, start, ids, total in pieces:
            out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, base + number, at, ids))
            at += len(ids)
        number += 1
        return out

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            arrays.append(pa.array([x.astype(np.int32) for x in cols[7]], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    out: list[tuple] = []
    for batch in batches:
        for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
            ids = np.frombuffer(raw.as_py(), "<u2")
            at = 0
            while at < len(ids):
                take = min(length - size, len(ids) - at)
                rows.append([doc, at, ids[at : at + take], len(ids)])
                size += take
                at += take
                if size == length:
                    out += close(rows)
                    rows, size = [], 0
            if len(out) >= 4096:
                yield batch_of(out)
                out = []
    while size:
        want = 1 << (size.bit_length() - 1)
        size -= want
        mine = []
        while want:
            doc, start, ids, total = rows[0]
            if len(ids) <= want:
                mine.append(rows.pop(0))
                want -= len(ids)
            else:
                mine.append([doc, start, ids[:want], total])
                rows[0] = [doc, start + want, ids[want:], total]
                want = 0
        out += close(mine)
    if out:
        yield batch_of(out)


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of all (doc_id, text) in sequences of at most ``length`` ids; ``with_ids`` adds the ids themselves.

    A null or empty text is its end id alone. A document longer than a sequence goes on in the next ones. Repeated rows are packed
    each for itself. ``length`` must be a power of two. An empty table gives no piece; further columns are ignored.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    spark = docs.sparkSession
    source = common.texts(docs, F.col("doc_id").cast("long"), "text")
    staged = common.stage(source.mapInArrow(common.tidy(lambda it: keyed(it, tokenizer, end_id)), "doc_id long, key long, n long, ids binary"), "keyed")
    size = staged.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * size // RANGE))
    curve = staged.repartitionByRange(parts, "key", "doc_id").sortWithinPartitions("key", "doc_id")
    return curve.select("doc_id", "ids").mapInArrow(lambda it: pack(it, length, with_ids), PIECES + ", ids array<int>" * with_ids)


def op10_hilbert_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokens.public("byte_bpe_50k.json"))
