import base64
import hashlib
import random
import struct
import sys

import pytest

from gleaner.llm import pieces as P
from gleaner.llm.tokens import vocabulary


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import public_tokenizers
    import tiktoken

    with open(vocabulary(P.RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(data):
    return list(struct.unpack(f"<{len(data) // 4}I", data))


def test_every_character_is_encoded_as_the_library_would(tiktoken_encoding):
    own = P.codec(P.RANKS)
    for start in range(0, sys.maxunicode, 4096):
        some = [chr(c) for c in range(start, start + 4096) if not 0xD800 <= c < 0xE000]
        # Each character between letters, digits, blanks and marks: its class shows in the split.
        text = "\n".join(f"a{c}1 {c} ,{c}{c}" for c in some)
        assert ids_of(own.encode(text)) == tiktoken_encoding.encode_ordinary(text)


def test_random_texts_go_both_ways(tiktoken_encoding):
    own, r = P.codec(P.RANKS), random.Random(7)
    parts = ["the", " quick", "ñandú", "日本語", "  ", "\n\n", "\t", "'s", "'ll", "12345", "!!", "\x00", "\U0001f600", "é", "é", "<|endoftext|>", "▁", " ", "aaaa", "\r\n", "ʼ", "Ω"]
    for _ in range(400):
        text = "".join(r.choices(parts, k=r.randint(0, 60)))
        ids = own.encode(text)
        assert ids_of(ids) == tiktoken_encoding.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_every_token_of_the_file_and_long_matches(tiktoken_encoding, monkeypatch):
    own, r = P.codec(P.RANKS), random.Random(3)
    assert all(own.decode(struct.pack("<I", rank)) == token for token, rank in tiktoken_encoding._mergeable_ranks.items())
    texts = [t.decode() for t in tiktoken_encoding._mergeable_ranks if t.decode(errors="ignore").encode() == t]
    assert [ids_of(own.encode(t)) for t in texts] == [tiktoken_encoding.encode_ordinary(t) for t in texts]
    long = "".join(r.choices("abcdefghij", k=20000))
    assert ids_of(own.encode(long)) == tiktoken_encoding.encode_ordinary(long)
    monkeypatch.setattr(P, "MATCHES", 7)
    monkeypatch.setattr(P, "CACHE_WORDS", 20)
    text = " ".join(r.choices(texts, k=3000))
    assert ids_of(own.encode(text)) == tiktoken_encoding.encode_ordinary(text)


def test_bytes_that_are_no_text_have_pieces_too():
    own = P.codec(P.RANKS)
    assert len(own.bytes_of) == len(own.ranks) and all(P.as_bytes(P.as_piece(bytes([b]))) == bytes([b]) for b in range(256))
    assert own.model.unk_id() == len(own.ranks)


def test_documents_with_nulls_copies_and_further_columns(spark, tiktoken_encoding):
    texts = [(1, "Hello world, hello", 5), (1, "Hello world, hello", 6), (2, None, 1), (3, "", 1), (None, "ñ ñ", 1), (4, "word " * 50000, 1)]
    df = spark.createDataFrame(texts, "doc_id long, text string, n_tokens int")
    rows = P.decoded(P.encoded(df)).collect()
    want = [(d, t or "") for d, t, _ in texts]
    assert sorted(((r.doc_id, bytes(r.decoded).decode()) for r in rows), key=repr) == sorted(want, key=repr)
    assert sorted(ids_of(bytes(r.ids)) for r in rows) == sorted(tiktoken_encoding.encode_ordinary(t) for _, t in want)
    assert P.decoded(P.encoded(df.limit(0))).collect() == []


def test_query_over_the_tables(spark, sf_dir, tiktoken_encoding):
    rows = {r.doc_id: r for r in P.op13_byte_bpe(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    for doc_id, text in docs:
        ids = tiktoken_encoding.encode_ordinary(text or "")
        r = rows[doc_id]
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
