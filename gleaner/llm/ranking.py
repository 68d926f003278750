"""Ranked lexical search by windowed bucket scoring.

Documents stay where they are read: each task numbers its own as they come and writes their postings of the queries'
terms in windows of fixed size, term by term. Statistics over all documents make the weights; then the windows are
traversed: an item's postings are scattered and added into one array of a window's scores, which fits a core's cache,
a bitset tells the slots that are occupied, and these are harvested into the item's heap. Only heaps leave a task.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, saved, table

#: Slots of a window (of 8 bytes each), and postings at which one is closed before that.
SLOTS, POSTINGS = 1 << 14, 1 << 21
#: Terms, repeats included, of the items that are searched in one pass; an item of more is a pass of its own.
TERMS = 1 << 19
TOP = 20
#: Bytes of a text that are split at once.
PART = 1 << 22
# Fixed values of the score: scale of weights and of term frequencies, and the share of a document's length.
WEIGHT, UNIT, SATURATION, BASE, BY_LENGTH = 1000, 1_000_000_000, 12, 75, 25

#: Bytes that separate terms become blanks, A-Z small letters; all others stay.
APART = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
FOLDED = bytes(0x20 if b in APART else b | 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))

WINDOWS = "doc_ids array<long>, lengths binary, terms binary, counts binary, slots binary, frequencies binary"
HITS = "item int, doc_id long, score long"
RANKED = "item_id long, rank int, doc_id long, score long"


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The text's terms in order, a part of the text at a time."""
    data = text.encode().translate(FOLDED)
    start = 0
    while start < len(data):
        stop = data.find(b" ", start + PART) if len(data) - start > PART else -1
        stop = len(data) if stop < 0 else stop
        yield data[start:stop].split()
        start = stop


class Windowed:
    """Postings of one window while it fills."""

    def __init__(self) -> None:
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self.terms: list[np.ndarray] = []
        self.frequencies: list[np.ndarray] = []
        self.postings = 0

    def add(self, doc_id: int | None, length: int, terms: np.ndarray, frequencies: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.lengths.append(length)
        self.terms.append(terms)
        self.frequencies.append(frequencies)
        self.postings += len(terms)

    def full(self, slots: int, most: int) -> bool:
        return len(self.docs) >= slots or self.postings >= most

    def batch(self) -> pa.RecordBatch:
        """The window as a row: postings sorted by term, then slot."""
        terms, frequencies = np.concatenate(self.terms), np.concatenate(self.frequencies)
        slots = np.repeat(np.arange(len(self.docs)), [len(x) for x in self.terms])
        order = np.argsort(terms, kind="stable")
        own, counts = np.unique(terms, return_counts=True)
        rows = {"lengths": np.array(self.lengths, "<i8"), "terms": own.astype("<i4"), "counts": counts.astype("<i4"), "slots": slots[order].astype("<u2"), "frequencies": frequencies[order].astype("<i8")}
        columns = {"doc_ids": pa.array([self.docs], pa.list_(pa.int64()))} | {k: pa.array([x.tobytes()], pa.binary()) for k, x in rows.items()}
        return pa.RecordBatch.from_pydict(columns)


def postings(docs: DataFrame, numbers: dict[bytes, int], slots: int = SLOTS, most: int = POSTINGS) -> DataFrame:
    """The saved windows of ``docs`` (doc_id, text) for the terms that ``numbers`` numbers from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, number = Windowed(), numbers.get
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found: Counter[int] = Counter()
                length = 0
                for words in terms_of(text.as_py() or ""):
                    length += len(words)
                    found.update(filter(None, map(number, words)))
                if length:
                    window.add(doc_id, length, np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found)))
                    if window.full(slots, most):
                        yield window.batch()
                        window = Windowed()
        if window.docs:
            yield window.batch()

    return saved(bounded_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, WINDOWS), "postings")


def statistics(windows: DataFrame) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, all their terms, and the documents that hold each numbered term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for batch in batches:
            for lengths, terms, counts in zip(*(batch.column(i) for i in range(3)), strict=True):
                lengths = np.frombuffer(lengths.as_py(), "<i8")
                total.update(dict(zip(np.frombuffer(terms.as_py(), "<i4").tolist(), np.frombuffer(counts.as_py(), "<i4").tolist(), strict=True)))
                total.update({0: len(lengths), -1: int(lengths.sum())})
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array(total.values(), pa.int64())], ["term", "n"])

    # A row for each term of the queries: at most about TERMS.
    sums = dict(windows.select("lengths", "terms", "counts").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n")).collect())
    return sums.pop(0, 0), sums.pop(-1, 0), sums


def weight(documents: int, holding: int) -> int:
    return math.floor(WEIGHT * math.log((2 * documents + 2) / (2 * holding + 1)))


def scored(windows: DataFrame, items: list[dict[int, int]], top: int, slots: int = SLOTS) -> DataFrame:
    """The ``top`` documents of each task for each item (terms and their repeats): item, doc_id and score."""
    documents, all_terms, holding = statistics(windows)
    weights = {term: weight(documents, n) for term, n in holding.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A heap's entry is (score, negative doc_id): the smallest of ``top`` is the first to go.
        heaps: list[list[tuple[int, float | int]]] = [[] for _ in items]
        scores = np.zeros(slots, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                lengths, terms, counts = np.frombuffer(row["lengths"], "<i8"), np.frombuffer(row["terms"], "<i4"), np.frombuffer(row["counts"], "<i4")
                at, tf = np.frombuffer(row["slots"], "<u2").astype(np.int64), np.frombuffer(row["frequencies"], "<i8")
                m = 100 - BY_LENGTH + np.array([BY_LENGTH * n * documents // all_terms for n in lengths.tolist()], np.int64)
                parts = UNIT * tf // (1000 * tf + SATURATION * m[at])
                gains, bits = {}, {}
                for term, stop, n in zip(terms.tolist(), np.cumsum(counts).tolist(), counts.tolist(), strict=True):
                    own, here = at[stop - n : stop], np.zeros(slots, bool)
                    here[own] = True
                    gains[term], bits[term] = (own, weights[term] * parts[stop - n : stop]), np.packbits(here)
                for heap, wanted in zip(heaps, items, strict=True):
                    present = [t for t in wanted if t in gains]
                    if not present:
                        continue
                    for t in present:
                        own, gain = gains[t]
                        scores[own] += wanted[t] * gain
                    occupied = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce([bits[t] for t in present])))
                    harvest(heap, occupied, scores[occupied], row["doc_ids"], top)
                    scores[occupied] = 0
        rows = [(k, None if doc == -math.inf else -doc, score) for k, heap in enumerate(heaps) for score, doc in heap]
        for start in range(0, len(rows), 1 << 16):
            item, doc, score = zip(*rows[start : start + (1 << 16)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return windows.mapInArrow(run, HITS)


def harvest(heap: list[tuple[int, float | int]], slots: np.ndarray, scores: np.ndarray, doc_ids: list[int | None], top: int) -> None:
    """Puts the best of a window into an item's heap; equal scores go by doc_id, one that is missing last."""
    least = heap[0][0] if len(heap) == top else 1
    if len(scores) > top:
        # Ties of the last place all stay: their doc_ids decide in the heap.
        least = max(least, int(np.partition(scores, len(scores) - top)[-top]))
    for k in np.flatnonzero(scores >= least).tolist():
        doc = doc_ids[slots[k]]
        entry = (int(scores[k]), -math.inf if doc is None else -doc)
        if len(heap) < top:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)


def passes(items: DataFrame, most: int = TERMS) -> Iterator[tuple[list[int | None], list[dict[int, int]], dict[bytes, int]]]:
    """Items in bounded portions as they stream to the driver: their ids, their terms with repeats, and the terms' numbers."""
    ids: list[int | None] = []
    wanted: list[dict[int, int]] = []
    numbers: dict[bytes, int] = {}
    held = 0
    for item_id, text in items.toLocalIterator():
        terms = Counter(word for words in terms_of(text or "") for word in words)
        if held and held + sum(terms.values()) > most:
            yield ids, wanted, numbers
            ids, wanted, numbers, held = [], [], {}, 0
        if terms:
            held += sum(terms.values())
            ids.append(item_id)
            wanted.append({numbers.setdefault(t, len(numbers) + 1): n for t, n in terms.items()})
    if ids:
        yield ids, wanted, numbers


def best(hits: DataFrame, top: int) -> DataFrame:
    """Hits with their rank within the item, up to ``top``; each task first keeps its own best ones."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, slots: int = SLOTS, most: int = POSTINGS) -> DataFrame:
    """The ``top`` highest-scoring rows of ``docs`` (doc_id, text) for every row of ``items`` (item_id, text): ``RANKED``.

    A null or empty text has no terms: such a document is not counted, such an item has no rows. Texts are read whole, the
    longest in parts. Every row is a document, and an item, of its own: copies and repeated ids stand side by side; equal
    scores go by doc_id, rows without one last. Empty tables give no rows; further columns are not read. Items are searched
    ``TERMS`` terms at a time, which bounds what tasks are told; documents are read once for each such pass. A window has
    ``slots`` documents (65536 at most) and is closed before that at ``most`` postings.
    """
    out = docs.sparkSession.createDataFrame([], RANKED)
    for ids, wanted, numbers in passes(items.select(F.col("item_id").cast("long"), "text")):
        found = best(scored(postings(docs, numbers, slots, most), wanted, top, slots), top)
        out = out.unionByName(found.select(item_ids(ids).alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out


def item_ids(ids: list[int | None]) -> Column:
    return F.get(F.from_json(F.lit(str(ids).replace("None", "null")), "array<long>"), F.col("item"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = f"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}'))"
ORACLE = f"""WITH t AS (SELECT doc_id, {_TERMS} AS term FROM documents),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
  d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY 1),
  g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM d),
  w AS (SELECT term, floor({WEIGHT} * ln((2 * any_value(g.docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, g GROUP BY 1),
  q AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, {_TERMS} AS term FROM benchmark) GROUP BY 1, 2),
  s AS (SELECT item_id, doc_id, sum(repeats * w * ({UNIT} * tf // (1000 * tf + {SATURATION} * (100 - {BY_LENGTH} + ({BY_LENGTH} * n * g.docs) // g.words))))::BIGINT AS score
        FROM q JOIN tf USING (term) JOIN w USING (term) JOIN d USING (doc_id), g GROUP BY 1, 2)
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0
  QUALIFY rank <= {TOP}"""
