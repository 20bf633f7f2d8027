import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sparkloom.llm import hilbert_packing, tokens


def test_hilbert_neighbours_touch():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    key = hilbert_packing.hilbert(side, 3)
    assert sorted(key) == list(range(512))
    walk = side[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_every_id_lies_in_one_piece(spark):
    from tokenizers import Tokenizer

    path = tokens.public("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rng = random.Random(1)
    texts = [None, "", " ", "a  b\n c", "word " * 9000, "x\n\ny", "<|endoftext|>"]
    texts += [" ".join(rng.choice(["red", "green,", "blue.\nNew", "été"]) for _ in range(rng.randint(0, 900))) for _ in range(50)]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, key int").repartition(3)
    pieces = hilbert_packing.pack_documents(df, path, with_ids=True).collect()
    docs, seqs = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append(p)
        seqs[p.sequence_id].append(p)
        assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        mine = sorted(docs[i], key=lambda p: p.start)
        assert [x for p in mine for x in p.ids] == ids
        at = 0
        for p in mine:
            assert p.start == at and p.doc_tokens == len(ids)
            at += p.length
    for mine in seqs.values():
        at = 0
        for p in sorted(mine, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and at & (at - 1) == 0


def test_empty_and_wrong_length(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert hilbert_packing.pack_documents(df, tokens.public("byte_bpe_50k.json")).count() == 0
    with pytest.raises(ValueError):
        hilbert_packing.pack_documents(df, "", length=1000)
