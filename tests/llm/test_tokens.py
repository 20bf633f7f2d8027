import random

import pyarrow as pa
import pytest

from sparkloom.llm import tokens

ODD = ["", None, " a", "a  b", "a \n b", "x\n\ny z", "don't  'S 00 0", "É <|endoftext|> q", "a b\x1fc d", "１２ 日本 語", "\ta b ", "a ́ b é́", "a  b", "a\n b", "trail\n", "0 0", "\x00 x", "a b c", "don't don't", "'s 's", "x " * 500]


@pytest.mark.parametrize("name,kind", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_same_ids_as_the_library(name, kind, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNKS", 40)
    enc = tokens.Encoder(tokens.public(name), kind)
    rng = random.Random(2)
    bits = [" ", " ", " ", "\n", "a", "Be", "don't", "é", ".", ",", "12", "0", " ", "\t", "<", "日"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    for at in range(0, len(texts), 37):
        part = texts[at : at + 37]
        ids, sizes = enc.encode(pa.array(part, pa.string()), 1)
        want = [enc.lib.encode(t or "", add_special_tokens=False).ids + [1] for t in part]
        assert sizes.tolist() == [len(w) for w in want]
        assert ids.tolist() == [x for w in want for x in w]


@pytest.mark.parametrize("name,kind", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_equal_hashes_are_not_equal_chunks(name, kind, monkeypatch):
    real = tokens.textvec.word_hashes
    monkeypatch.setattr(tokens.textvec, "word_hashes", lambda *a: real(*a) & tokens.np.uint64(0x3F << 40))
    enc = tokens.Encoder(tokens.public(name), kind)
    thue = ["a"]
    while len(thue[0]) < 8192:
        thue = [t + t.translate(str.maketrans("ab", "ba")) for t in thue]
    long = [t[:n] for n in (1024, 2048, 8192) for t in (thue[0], thue[0].translate(str.maketrans("ab", "ba")))]
    for texts in (ODD, long, [f"{t} {u}" for t in long for u in ("x", "words of it")], ["some words", "of words", "other wordy things " * 40]):
        ids, sizes = enc.encode(pa.array(texts, pa.string()))
        want = [enc.lib.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


def test_long_words_have_own_hashes():
    np, textvec = tokens.np, tokens.textvec
    thue = b"a"
    while len(thue) < 8192:
        thue += thue.translate(bytes.maketrans(b"ab", b"ba"))
    words = [thue[:n] for n in range(1, 80)] + [w[:n] for n in (1024, 4096, 8192) for w in (thue, thue.translate(bytes.maketrans(b"ab", b"ba")))]
    data, size = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    ends = np.cumsum(size)
    assert len(set(textvec.word_hashes(data, ends - size, ends).tolist())) == len(words)
