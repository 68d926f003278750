"""Byte-level BPE by way of sentencepiece: a model serialised from a rank file, and both directions over documents.

Every byte stands for a character of its own, so a token is a piece of such characters; pieces are scored by negative
rank and nothing is normalised, so the merges of best score are those of lowest rank, the leftmost first. Texts are
split by the vocabulary's pattern, and each match is encoded by itself; ids are turned back by the inverse mapping.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table
from .tokens import CACHE_WORDS, portions, vocabulary

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Byte b is the character of code point FIRST + b: none of them is a blank or means anything to sentencepiece.
FIRST = 0x100
TO_CHARACTERS = {b: FIRST + b for b in range(256)}
TO_BYTES = {FIRST + b: b for b in range(256)}
# Fixed values of sentencepiece's model format: field numbers and kinds.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, KIND, NORMAL, UNKNOWN = 1, 2, 3, 1, 2
MODEL_KIND, BPE, VOCABULARY_SIZE, UNKNOWN_ID, BEGIN_ID, END_ID, PAD_ID = 3, 2, 4, 40, 41, 42, 43
NAME, DUMMY_PREFIX, FEWER_BLANKS, MARKED_BLANKS = 1, 3, 4, 5
#: Matches of a text that are looked up at once, and the longest that is remembered.
MATCHES, LONGEST = 1 << 18, 64

ENCODED = "doc_id long, n_tokens long, ids binary"
DECODED = "doc_id long, n_tokens long, ids binary, decoded binary"

_codecs: dict[str, Codec] = {}


def as_piece(token: bytes) -> str:
    return token.decode("latin-1").translate(TO_CHARACTERS)


def as_bytes(piece: str) -> bytes:
    return piece.translate(TO_BYTES).encode("latin-1")


def varint(x: int) -> bytes:
    x &= (1 << 64) - 1
    out = bytearray()
    while x > 0x7F:
        out.append(x & 0x7F | 0x80)
        x >>= 7
    return bytes([*out, x])


def number(field: int, x: int) -> bytes:
    return varint(field << 3) + varint(x)


def single(field: int, x: float) -> bytes:
    return varint(field << 3 | 5) + struct.pack("<f", x)


def block(field: int, data: bytes) -> bytes:
    return varint(field << 3 | 2) + varint(len(data)) + data


def serialised(tokens: list[tuple[bytes, int]]) -> bytes:
    """A sentencepiece BPE model whose piece i is the i-th of ``tokens`` (bytes and rank); a piece for the unknown comes last."""
    body = [block(PIECES, block(PIECE, as_piece(t).encode()) + single(SCORE, -rank) + number(KIND, NORMAL)) for t, rank in tokens]
    body.append(block(PIECES, block(PIECE, b"<unk>") + single(SCORE, 0.0) + number(KIND, UNKNOWN)))
    trainer = number(MODEL_KIND, BPE) + number(VOCABULARY_SIZE, len(body)) + number(UNKNOWN_ID, len(tokens)) + b"".join(number(x, -1) for x in (BEGIN_ID, END_ID, PAD_ID))
    normalizer = block(NAME, b"identity") + b"".join(number(x, 0) for x in (DUMMY_PREFIX, FEWER_BLANKS, MARKED_BLANKS))
    return b"".join(body) + block(TRAINER, trainer) + block(NORMALIZER, normalizer)


def codec(name: str) -> Codec:
    """The worker's codec for a rank file, made once."""
    if name not in _codecs:
        _codecs[name] = Codec(name)
    return _codecs[name]


class Codec:
    """Both directions for one rank file; piece i of the model has the i-th smallest rank."""

    def __init__(self, name: str):
        import public_tokenizers
        import regex
        import sentencepiece

        with open(vocabulary(name), "rb") as lines:
            tokens = sorted(((base64.b64decode(a), int(b)) for a, b in map(bytes.split, lines)), key=lambda x: x[1])
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised(tokens))
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.ranks = np.array([rank for _, rank in tokens], "<u4")
        pieces = [self.model.id_to_piece(i) for i in range(len(tokens))]
        self.bytes_of = {rank: as_bytes(p) for p, (_, rank) in zip(pieces, tokens, strict=True)}
        self.whole = {p: self.ranks[i].tobytes() for i, p in enumerate(pieces)}
        self.known: dict[str, bytes] = {}

    def encode_matches(self, matches: list[str]) -> list[bytes]:
        """Ids of each match: a token as it stands is itself, all others go through the model."""
        mapped = [as_piece(x.encode()) for x in matches]
        found = [self.whole.get(x) for x in mapped]
        rest = iter(self.model.encode([x for x, ids in zip(mapped, found, strict=True) if ids is None], num_threads=1))
        return [self.ranks[next(rest)].tobytes() if ids is None else ids for ids in found]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        found = (m.group() for m in self.pattern.finditer(text)) if len(text) > MATCHES else iter(self.pattern.findall(text))
        out = []
        while matches := [*islice(found, MATCHES)]:
            if len(self.known) > CACHE_WORDS:
                self.known = {}
            known, long = self.known, {}
            new = [*set(matches).difference(known)]
            for match, ids in zip(new, self.encode_matches(new), strict=True):
                (known if len(match) <= LONGEST else long)[match] = ids
            out += map((known | long if long else known).__getitem__, matches)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoded(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """Every document's ids (``ids``: little-endian unsigned 32-bit) and their number, by the rank file ``ranks``.

    A null text is empty and has no ids; a very long text is looked up in portions of its matches, a match without end
    (letters alone) as one; equal texts have equal ids and repeated rows stay; an empty table gives no rows; a null
    doc_id stays null; further columns are not read. An invalid text does not occur: Spark's strings are UTF-8.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for batch in batches:
            doc_ids, texts = batch.column(0), [x or "" for x in batch.column(1).to_pylist()]
            for part in portions(texts):
                ids = [own.encode(x) for x in texts[part]]
                yield pa.RecordBatch.from_arrays([doc_ids[part], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ENCODED)


def decoded(rows: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``rows`` of ``encoded`` with the bytes that their ids stand for; an id that the file lacks stops the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = [own.decode(x.as_py() or b"") for x in some.column(2)]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return bounded_batches(rows).select("doc_id", "n_tokens", "ids").mapInArrow(run, DECODED)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decoded(encoded(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
