import hashlib
import zlib

import numpy as np
import pytest

from gleaner.llm import flac, media

TEXTS = ["", "a", "plain text " * 200, "ünïcödé — 漢字 " * 90, "a" * 5000, "\x00\xff" * 2000, "".join(map(chr, np.random.default_rng(0).integers(32, 0x2FF, 9000)))]


def test_payloads_round_trip_and_seek():
    payloads = [media.payload_of(x) for x in TEXTS] + [np.random.default_rng(1).bytes(576 * 40)]
    files = flac.encode(payloads)
    assert flac.decode(files) == payloads
    for p, f in zip(payloads, files, strict=True):
        for sample in {0, 575, len(p) // 2, len(p) - 1}:
            first, block = flac.seek(f, sample)
            assert first <= sample < first + 576 and block == p[first : first + 576]


def test_all_subframe_kinds_occur():
    rng = np.random.default_rng(2)
    x = np.stack([np.full(576, 7), rng.integers(-128, 128, 576), np.cumsum(rng.integers(-1, 2, 576)).clip(-128, 127), np.round(50 * np.sin(np.arange(576) / 9))]).astype(np.int64)
    kinds = {f[6] >> 1 for f in flac.encode_frames(x, np.arange(4))}
    assert {0, 1} < kinds and len(kinds) >= 3
    raw = b"".join(frames := flac.encode_frames(x, np.arange(4)))
    at = np.cumsum([0, *map(len, frames)])
    assert np.array_equal(flac.decode_frames(np.frombuffer(raw, np.uint8), at[:-1], at[1:]), x)


@pytest.mark.parametrize("place", [200, -3, 30])
def test_damage_is_found(place):
    data = bytearray(flac.encode([media.payload_of("some words to be kept safe " * 60)])[0])
    data[place] ^= 4
    with pytest.raises(ValueError):
        flac.decode([bytes(data)])


def test_numbers_are_coded_as_in_utf_8():
    n = np.array([0, 127, 128, 2047, 2048, 65535, 65536, 1114111])
    coded, size = flac.coded_numbers(n)
    for k, row, m in zip(n, coded, size, strict=True):
        assert bytes(row[:m].tolist()) == chr(k).encode("utf-8", "surrogatepass")


def test_documents_as_media(spark):
    rows = [(i, x, "c") for i, x in enumerate(TEXTS)] + [(3, TEXTS[3], "c"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    stored = media.encode_documents(docs)
    found = media.pcm_blocks(stored).collect()
    want = sorted((hashlib.sha256(media.payload_of(x)).hexdigest(), len((x or "").encode())) for _, x, _ in rows)
    assert sorted((r.payload_sha256, r.n_bytes) for r in found) == want
    for r in found:
        p = media.payload_of(next(x for i, x, _ in rows if i == r.doc_id))
        assert (r.payload_bytes, r.tail_crc32) == (len(p), zlib.crc32(p[-32:]))
        assert b"".join(bytes(b.pcm) for b in r.blocks) == p and [b.first_sample for b in r.blocks] == list(range(0, len(p), 576))
    assert len({(r.media_sha256, r.feature) for r in found if r.doc_id == 3}) == 1
    assert media.pcm_blocks(stored.limit(0)).count() == 0
    assert media.encode_documents(docs.limit(0)).count() == 0
