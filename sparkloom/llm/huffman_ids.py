"""Token-id output as canonical length-limited Huffman code, decodable block by block.

Format: a folder with two Parquet tables. ``codebook`` is one row: code length of every id (bytes) and the
length limit; canonical codes follow from the lengths. ``blocks`` has one row for each block:
part (rank of the range of doc_ids), seq (rank in it), n_ids and ``block``, a self-contained
byte string (little endian)::

    "SLH1" | n_docs u32 | n_ids u32 | lane u32 | n_bits u64 | doc_id i64 * n_docs
    | ids of each document u32 * n_docs | bit offset of every lane-th id u64 * ceil(n_ids / lane) | bits

Documents lie in ascending doc_id order within a block, blocks in (part, seq) order.
Decoding is table driven: one table of 2**limit entries gives id and length for the next bits, and
the checkpoints let all lanes of a block advance together.

Scale: text is tokenised once and staged; counts are pre-aggregated per task, and only one row
per vocabulary entry meets on the driver. The range shuffle by doc_id moves 16-bit ids, not text.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, textvec, tokens

LIMIT = 18
BLOCK_IDS = 1 << 18
LANE = 128
HEAD = struct.Struct("<4sIIIQ")


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that don't occur."""
    symbols = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(symbols) <= 1:
        out[symbols] = 1
        return out
    if len(symbols) > 1 << limit:
        raise ValueError(f"{len(symbols)} ids need more than {limit} bits")
    order = symbols[np.argsort(counts[symbols], kind="stable")]
    weight = counts[order].astype(np.float64)
    n = len(order)
    rows, packed = [], np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate([weight, packed])
        at = np.argsort(merged, kind="stable")
        rows.append(at < n)
        merged = merged[at]
        even = len(merged) // 2 * 2
        packed = merged[0:even:2] + merged[1:even:2]
    take, length = 2 * n - 2, np.zeros(n, np.int64)
    for leaf in reversed(rows):
        used = int(leaf[:take].sum())
        length[:used] += 1
        take = 2 * (take - used)
    out[order] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    size = lengths[order].astype(np.int64)
    top = int(size.max()) if len(size) else 0
    first = np.cumsum(np.concatenate([[0], (1 << (top - size))[:-1]])) if len(size) else np.zeros(0, np.int64)
    codes = np.zeros(len(lengths), np.uint32)
    codes[order] = first >> (top - size)
    return codes


def table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For every value of the next ``limit`` bits: id * 32 + code length."""
    top = int(lengths.max()) if len(lengths) else 0
    codes = canonical(lengths)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    size = lengths[order].astype(np.int64)
    out = np.zeros(1 << top, np.uint32)
    span = 1 << (top - size)
    out[: span.sum()] = np.repeat((order * 32 + size).astype(np.uint32), span)
    assert not len(order) or int(codes[order[0]]) == 0
    return out, top


def pack(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    n_bits = int(end[-1]) if len(end) else 0
    value = codes[ids].astype(np.uint64) << (32 - size - (start & 7)).astype(np.uint64)
    bits = np.zeros((n_bits + 7) // 8 + 4)
    for k in range(4):
        part = (value >> np.uint64(24 - 8 * k)) & np.uint64(255)
        bits += np.bincount((start >> 3) + k, part, len(bits))
    return b"".join(
        (
            HEAD.pack(b"SLH1", len(doc_ids), len(ids), LANE, n_bits),
            doc_ids.astype("<i8").tobytes(),
            sizes.astype("<u4").tobytes(),
            start[::LANE].astype("<u8").tobytes(),
            bits[: (n_bits + 7) // 8].astype(np.uint8).tobytes(),
        )
    )


def unpack(block: bytes, decode: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, their numbers of ids, and all ids of a block."""
    magic, n_docs, n_ids, lane, n_bits = HEAD.unpack_from(block)
    if magic != b"SLH1":
        raise ValueError("not a block of this format")
    at = HEAD.size
    doc_ids = np.frombuffer(block, "<i8", n_docs, at)
    sizes = np.frombuffer(block, "<u4", n_docs, at + 8 * n_docs)
    lanes = -(-n_ids // lane)
    at += 12 * n_docs
    where = np.frombuffer(block, "<u8", lanes, at).astype(np.int64)
    raw = np.zeros((n_bits + 7) // 8 + 8, np.uint32)
    raw[: (n_bits + 7) // 8] = np.frombuffer(block, np.uint8, (n_bits + 7) // 8, at + 8 * lanes)
    word = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    out = np.zeros((lane, lanes), np.uint32)
    shift, mask = 32 - top, np.uint32((1 << top) - 1)
    last = len(word) - 1
    for k in range(min(lane, n_ids)):
        got = decode[(word[np.minimum(where >> 3, last)] >> (shift - (where & 7)).astype(np.uint32)) & mask]
        out[k] = got >> np.uint32(5)
        where = where + (got & np.uint32(31))
    return doc_ids, sizes, out.T.reshape(-1)[:n_ids]


#: Bytes of 16-bit ids of a range, about, unless the session's number of shuffle partitions asks for smaller ones.
RANGE = 32 << 20


def tokenize(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    enc = tokens.encoder(path, "word")
    for batch in batches:
        for part in textvec.slices(batch, "text"):
            column = tokens.binary(*enc.encode(part.column("text"), end_id))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), column], names=["doc_id", "ids"])


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        data, _ = textvec.buffers(batch.column("ids"))
        total += np.bincount(data.view("<u2") if len(data) else np.zeros(0, np.int64), minlength=1 << 16)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["id", "n"])


BLOCKS = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("block", pa.binary())])


def blocks(batches: Iterator[pa.RecordBatch], lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    codes, part, seq = canonical(lengths), TaskContext.get().partitionId(), 0
    held: list = []

    def flush():
        nonlocal seq
        ids = np.frombuffer(b"".join(x for _, x in held), "<u2")
        block = pack(np.array([d for d, _ in held], np.int64), np.array([len(x) // 2 for _, x in held]), ids, codes, lengths)
        seq += 1
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([block], pa.binary())], schema=BLOCKS
        )

    size = 0
    for batch in batches:
        for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
            held.append((doc, ids.as_py()))
            size += len(held[-1][1]) // 2
            if size >= BLOCK_IDS:
                yield flush()
                size = 0
    if held:
        yield flush()


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Encode every text of (doc_id, text) into ``path``; a null text is empty and gives the end id alone.

    Repeated doc_ids stay, side by side; an empty table gives no blocks. One document is never cut, so a block
    holds at least ``BLOCK_IDS`` ids or the last ones of its range. Ids must be below 65,536.
    """
    spark = docs.sparkSession
    source = common.texts(docs, F.col("doc_id").cast("long"), "text")
    staged = common.stage(source.mapInArrow(common.tidy(lambda it: tokenize(it, tokenizer, end_id)), "doc_id long, ids binary"), "ids")
    rows = staged.mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 << 16, np.int64)
    for r in rows:
        counts[r.id] = r.n
    lengths = code_lengths(counts)
    spark.createDataFrame([(bytearray(lengths.tobytes()), LIMIT)], "lengths binary, code_limit int").coalesce(1).write.parquet(f"{path}/codebook")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * int(counts.sum()) // RANGE))
    ordered = staged.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(lambda it: blocks(it, lengths), "part int, seq int, n_ids long, block binary").write.option(
        "compression", "uncompressed"
    ).parquet(f"{path}/blocks")
    common.drop_stage(staged)


def read_blocks(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    """Blocks with ``start``, the ids of all blocks before; and the code lengths."""
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/codebook").first().lengths), np.uint8)
    table_ = spark.read.parquet(f"{path}/blocks")
    sums = sorted((r.part, r.n) for r in table_.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before, total = [], 0
    for part, n in sums:
        before.append((part, total))
        total += n
    first = spark.createDataFrame(before, "part int, before long")
    w = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    place = table_.select("part", "seq", "n_ids").withColumn("inner", F.coalesce(F.sum("n_ids").over(w), F.lit(0)))
    place = place.join(F.broadcast(first), "part").select("part", "seq", (F.col("before") + F.col("inner")).alias("start"))
    return table_.join(place, ["part", "seq"]).select("start", "block"), lengths


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids array<int>) of every document in the files."""
    table_, lengths = read_blocks(spark, path)

    def decode(batches):
        tab, top = table(lengths)
        for batch in batches:
            for start, block in zip(batch.column("start").to_pylist(), batch.column("block"), strict=True):
                doc, sizes, ids = unpack(block.as_py(), tab, top)
                end = np.cumsum(sizes.astype(np.int64))
                arrays = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], end]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start + end - sizes), arrays], names=["doc_id", "start", "ids"])

    return table_.mapInArrow(decode, "doc_id long, start long, ids array<int>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    table_, lengths = read_blocks(spark, path)

    def digest(batches):
        tab, top = table(lengths)
        for batch in batches:
            for start, block in zip(batch.column("start").to_pylist(), batch.column("block"), strict=True):
                doc, sizes, ids = unpack(block.as_py(), tab, top)
                end = np.cumsum(sizes.astype(np.int64))
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(end.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc), pa.array(start + end - sizes), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return table_.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_huffman_ids(spark, sf_dir: str) -> DataFrame:
    path = f"{common.fresh(spark)}/ids"
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokens.public("word_bpe_49k.json"))
    return read_digests(spark, path)
