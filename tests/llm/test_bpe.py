import random

import public_tokenizers
import pytest
import tiktoken

from keelson.llm import bpe

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
PLAIN = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
MERGER = bpe.Merger(RANKS)


def encode(text):
    return bpe.Encoder(MERGER, public_tokenizers.PATTERN).encode(text)


def test_every_kind_of_character():
    for code in range(0, 0x110000, 211):
        if not 0xD800 <= code < 0xE000:
            text = f"a{chr(code)}b1{chr(code)} {chr(code)}x"
            assert encode(text) == PLAIN.encode_ordinary(text), hex(code)


@pytest.mark.parametrize("size", [0, 1, 2, 5, 16, 17, 18, 40, 300, 5000])
def test_random_texts(size):
    rng = random.Random(size)
    for alphabet in ("ab", "aé \n'st1", "the on ing\t😀%"):
        for _ in range(15):
            text = "".join(rng.choice(alphabet) for _ in range(size))
            assert encode(text) == PLAIN.encode_ordinary(text)


def test_long_pieces_and_lazy_split(monkeypatch):
    for text in ("a" * 50_000, "ab" * 9_000 + "<|endoftext|>"):
        assert encode(text) == PLAIN.encode_ordinary(text)
    monkeypatch.setattr(bpe, "CHARS_AT_ONCE", 64)
    text = "some words, and more of them; " * 40
    assert encode(text) == PLAIN.encode_ordinary(text)


def test_tree_and_rows_agree():
    rng = random.Random(2)
    for _ in range(300):
        piece = bytes(rng.choice(b" thenigrs\xc3\xa9") for _ in range(rng.randrange(2, 18)))
        assert bpe.np.frombuffer(MERGER.merge([piece])[0], "int32").tolist() == bpe.merge_piece(piece, RANKS)


def test_round_trip_of_a_frame(spark):
    texts = ["hello wörld  x", None, "", "\x00\x1f \n\n é😀", "hello wörld  x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coded = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS)
    for row in coded.collect():
        assert row.token_ids == PLAIN.encode_ordinary(row.text or "") and bytes(row.decoded).decode() == (row.text or "")
    assert bpe.decode(bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN), RANKS).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(docs.withColumnRenamed("doc_id", "Token_IDs"), RANKS, public_tokenizers.PATTERN)
