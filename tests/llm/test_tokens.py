import io
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from gleaner.llm import packing, token_files, tokens
from gleaner.llm.tokens import encoder, vocabulary

TEXTS = [
    "", " ", "Hello, world!", "it's I'll don't THE The the", "a  b   c\n\n d \n", "tab\tand\x1cseparators\x85here x",
    "naïve ÉCOLE Straße ΣΑΣ ΟΔΟΣ İstanbul K", "数字 漢字 かな 123 45.6", "<|endoftext|> is text", "x" * 3000, "end.\n", "..,;: a.,b ?!", "é É",
]


@pytest.mark.parametrize(("name", "spaces"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_are_those_of_the_library(name, spaces):
    own = encoder(name, spaces)
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("abcé ,.\n'sT1ß—") for _ in range(rng.randrange(60))) for _ in range(400)]
    for _ in range(2):
        assert own.encode(texts) == own.whole(texts)


def test_words_of_latin_letters_go_to_the_model_alone(monkeypatch):
    own = tokens.Encoder(token_files.VOCABULARY, False)
    asked = []
    of_words = own.of_words
    monkeypatch.setattr(own, "of_words", lambda by, words: asked.append((by is own.letters, set(words))) or of_words(by, words))
    letters = [chr(c) for c in range(0x21, 0x250)]
    texts = ["".join(x) for x in zip(letters, letters[1:], letters[7:], strict=False)] + [f"a{x}b {x} {x}'s st{x}." for x in letters] + [f"a{chr(c)}b" for c in range(0x21)]
    assert own.encode(texts) == own.whole(texts)
    assert own.encode(["some words, é'tait WORDS"]) == own.whole(["some words, é'tait WORDS"])
    assert asked[-2:] == [(True, {"some", "words"}), (False, {"é'tait"})]


def test_differencing_is_near_equal():
    sizes = np.random.default_rng(0).integers(1, 257, 900)
    found = packing.pack_group(sizes, 1024)
    sums = np.bincount(found, sizes)
    assert sums.max() <= 1024 and len(sums) <= -(-sizes.sum() // 1024) + 2
    assert list(packing.pack_group(np.array([1024, 1000, 30]), 1024)) != [0, 0, 0]


def rows(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, start string")


DATA = [(3, "b c", "x"), (1, None, "y"), (None, "lost", "z"), (2, "", "q"), (3, "b c", "x"), (7, "long words here " * 900, "w")]


def test_packing_covers_each_id_once(spark):
    found = packing.pack(rows(spark, DATA)).collect()
    places = defaultdict(list)
    for x in found:
        places[x.sequence_id].append((x.offset, x.length))
        assert zlib.crc32(x.ids) == x.ids_crc32 and len(x.ids) == 4 * x.length
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    for doc, text, _ in DATA:
        ids = encoder(packing.VOCABULARY, True).whole([text or ""])[0] + np.uint32(0).tobytes()
        own = sorted({(x.start, bytes(x.ids)) for x in found if x.doc_id == doc})  # the repeated rows' pieces are equal
        assert b"".join(x for _, x in own) == ids
    assert sum(x.length for x in found if x.doc_id == 3) == 2 * found[[x.doc_id for x in found].index(3)].doc_tokens
    assert packing.pack(rows(spark, [])).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    folder = str(tmp_path / "tokens")
    shards = token_files.write_tokens(rows(spark, DATA), folder)
    found = sorted(token_files.read_tokens(shards, folder).collect(), key=lambda x: x.start)
    texts = [d[1] or "" for d in sorted(DATA, key=lambda d: (d[0] is not None, d[0] or 0))]
    at = 0
    for x, ids in zip(found, encoder(token_files.VOCABULARY, False).whole(texts), strict=True):
        ids += np.uint32(token_files.END).tobytes()
        assert (x.start, x.n_tokens, x.ids_crc32, bytes(x.ids)) == (at, len(ids) // 4, zlib.crc32(ids), ids)
        at += len(ids) // 4
    assert [x.doc_id for x in found] == [None, 1, 2, 3, 3, 7]
    assert token_files.write_tokens(rows(spark, []), folder).count() == 0


def test_many_empty_texts_make_small_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 64)
    found = packing.pack(rows(spark, [(i, "", "x") for i in range(2000)]), keep_ids=False)
    groups = found.groupBy((found.sequence_id / (1 << 21)).cast("long").alias("g")).count().collect()
    assert sum(x["count"] for x in groups) == 2000 and max(x["count"] for x in groups) < 150 and len(groups) >= 31


def test_shards_are_rolled_by_size_and_documents(spark, tmp_path, monkeypatch):
    data = [(i // 3, f"some words {i} " * (i % 7), "x") for i in range(90)] + [(None, "same", "x")] * 20
    monkeypatch.setattr(token_files, "SHARD_BYTES", 400)
    monkeypatch.setattr(token_files, "SHARD_DOCS", 9)
    folder = str(tmp_path / "rolled")
    shards = token_files.write_tokens(rows(spark, data), folder)
    sizes = shards.collect()
    assert len(sizes) > 12 and max(x.docs for x in sizes) == 9 and sum(x.docs for x in sizes) == len(data)
    found = sorted(token_files.read_tokens(shards, folder).collect(), key=lambda x: x.start)
    assert [x.doc_id for x in found] == [None] * 20 + [i // 3 for i in range(90)]
    want = encoder(token_files.VOCABULARY, False).whole([d[1] for d in sorted(data, key=lambda d: (d[0] is not None, d[0] or 0))])
    assert [bytes(x.ids)[:-4] for x in found] == want


class Handle(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_a_reader_opens_only_the_frames_it_needs(tmp_path):
    writer = token_files.ShardWriter(str(tmp_path), 0)
    docs = [np.arange(i, i + 9000, dtype="<u4").tobytes() for i in range(12)]
    for i, ids in enumerate(docs):
        writer.add(i, ids)
    writer.close()
    raw = (tmp_path / writer.sink.name).read_bytes()
    reader = token_files.ShardReader(Handle(raw))
    opened = []
    frame = reader.frame
    reader.frame = lambda k: opened.append(k) or frame(k)
    assert [x[2] for x in reader.documents(np.array([7]))] == [docs[7]] and len(opened) == 1
    broken = bytearray(raw)
    broken[int(reader.starts[opened[0]]) + 100] ^= 1
    with pytest.raises(Exception):
        list(token_files.ShardReader(Handle(bytes(broken))).documents(np.array([7])))


def test_vocabularies_are_a_parameter(tmp_path):
    assert vocabulary(str(tmp_path / "own.json")) == str(tmp_path / "own.json")


def test_tasks_follow_bytes_and_rows():
    assert token_files.needed_tasks(0, 0) == 1
    assert token_files.needed_tasks(token_files.TASK_DOCS + 1, 0) == 2
    assert token_files.needed_tasks(5, 10 * token_files.TASK_BYTES) == 10


def test_many_tasks_give_the_same_files_content(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i % 37, f"some words {i} of it" * (i % 5)) for i in range(300)] + [(None, None)], "doc_id long, text string")
    rows = []
    for size in (1 << 28, 512):
        monkeypatch.setattr(token_files, "TASK_BYTES", size)
        folder = str(tmp_path / f"t{size}")
        shards = token_files.write_tokens(docs, folder)
        rows.append((shards.count(), sorted((r.start, r.n_tokens) for r in token_files.read_tokens(shards, folder, keep_ids=False).collect())))
        assert rows[-1][1][-1][0] + rows[-1][1][-1][1] == sum(n for _, n in rows[-1][1])
    assert rows[1][0] > rows[0][0] and sum(n for _, n in rows[0][1]) == sum(n for _, n in rows[1][1])
