import random
import zlib

import numpy as np
import pytest

from sparkloom.llm import common, huffman_ids, tokens


def test_code_lengths_are_optimal_and_limited():
    counts = np.array([0, 5, 5, 1, 1, 40, 0, 3])
    free = huffman_ids.code_lengths(counts, 18)
    assert sum(2.0 ** -int(x) for x in free if x) == 1
    assert (free * counts).sum() == 87  # by Huffman's algorithm: 2 + 5 + 10 + 15 + 55
    fib = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    short = huffman_ids.code_lengths(fib, 4)
    assert short.max() == 4 and sum(2.0 ** -int(x) for x in short) == 1
    assert list(huffman_ids.code_lengths(np.array([0, 0, 9]), 4)) == [0, 0, 1]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_block_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.zipf(1.3, n) % 3000
    lengths = huffman_ids.code_lengths(np.bincount(np.append(ids, 7), minlength=3000))
    sizes = np.array([n, 0])
    block = huffman_ids.pack(np.array([3, 4]), sizes, ids, huffman_ids.canonical(lengths), lengths)
    doc, size, back = huffman_ids.unpack(block, *huffman_ids.table(lengths))
    assert list(doc) == [3, 4] and list(size) == [n, 0] and np.array_equal(back, ids)


def test_files_give_back_all_ids(spark):
    path = tokens.public("word_bpe_49k.json")
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    rng = random.Random(3)
    texts = [None, "", "  ", "Hello  World 00's", "é́ x y\x1fz", "<|endoftext|> a", "long " * 4000]
    texts += [" ".join(rng.choice(["Alpha", "beta,", "GAMMA.\nnew", "1700", "don't"]) for _ in range(rng.randint(0, 400))) for _ in range(60)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, ids string").repartition(5)
    out = f"{common.fresh(spark)}/t"
    huffman_ids.write_ids(df, out, path)
    want, start = {}, 0
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        want[i] = (start, ids)
        start += len(ids)
    assert {r.doc_id: (r.start, r.ids) for r in huffman_ids.read_ids(spark, out).collect()} == want
    crc = {i: (s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, (s, x) in want.items()}
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in huffman_ids.read_digests(spark, out).collect()} == crc


def test_empty_table(spark):
    out = f"{common.fresh(spark)}/t"
    huffman_ids.write_ids(spark.createDataFrame([], "doc_id long, text string"), out, tokens.public("word_bpe_49k.json"))
    assert huffman_ids.read_digests(spark, out).count() == 0
