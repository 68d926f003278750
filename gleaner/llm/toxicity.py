"""Toxicity: a linear-chain conditional random field tags toxic spans; its marginals score documents.

Tokens are runs of letters and digits. Labels are given by document, so tokens are labelled first: in
toxic documents, those with a feature (word or beginning of a word) that labelled toxic documents have
and clean ones lack. The field has two tags and features of the word, its beginnings and its end; it is
fitted by stochastic gradient on a bounded sample of documents, in shards whose weights are averaged. Forward-backward runs over whole texts, and a
logistic layer turns the sum and maximum of the marginals into the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import BLOCK, batch_of, block_batch, merged_blocks
from .common import bounded_batches, saved, table
from .shingles import BYTES, PLACES, mixed, text_arrays

BUCKETS = 1 << 20
#: Labelled documents of each label that the field is fitted on: the documented bound of the fit.
FIT_DOCS = 2000
#: Tokens of a fitted segment; scoring has no such bound.
SEGMENT = 256
#: Segments of one step of the fit, its passes, rate and decay, and bytes of text that a task passes over at most.
STEP = 64
EPOCHS = 4
RATE = 0.5
DECAY = 1e-4
SHARD_BYTES = 1 << 21
THRESHOLD = 0.7
BEGINNINGS = (3, 4, 5, 6, 7, 8)
FEATURES = 2 + len(BEGINNINGS)
#: A feature marks tokens if at least so many sampled toxic documents have it, and so many times the clean ones' share.
SUPPORT, RATIO = 8, 20.0

INSIDE = np.zeros(256, bool)
INSIDE[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def tokens(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature buckets (tokens x FEATURES), each text's first token, and tokens' byte starts and ends."""
    inside = INSIDE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = starts[starts < len(data)]
    first[at] = inside[at]
    begin = np.flatnonzero(first)
    text = np.searchsorted(begin, starts)
    if not len(begin):
        return np.zeros((0, FEATURES), np.int64), text, begin, begin
    where = np.flatnonzero(inside)
    own = data[where]
    lead = np.searchsorted(where, begin)
    length = np.diff(np.append(lead, len(where)))
    place = np.arange(len(own)) - np.repeat(lead, length)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTES[own] * PLACES[place & 4095], dtype=np.uint64)])
    found = [mixed(sums[lead + length] - sums[lead])]
    for n in BEGINNINGS:
        found.append(mixed(sums[lead + np.minimum(n, length)] - sums[lead] + np.uint64(n)))
    # The last three bytes, hashed by their place from the end.
    tail = sum(BYTES[own[np.maximum(lead + length - 1 - k, lead)]] * PLACES[100 + k] for k in range(3))
    found.append(mixed(tail + np.uint64(99)))
    buckets = (np.stack(found, 1) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return buckets, text, begin, where[lead + length - 1] + 1


def messages(odds: np.ndarray, reset: np.ndarray, step: np.ndarray, start: np.ndarray, block: int = 128) -> np.ndarray:
    """Normalised forward messages (n x 2) of chains that lie one after the other.

    ``odds`` is each token's factor for tag 1 against tag 0, ``reset`` marks chains' first tokens. Blocks
    of tokens are run side by side: first each block's transfer matrix, then the blocks in a row, then
    the messages inside all blocks; the result is that of a single pass.
    """
    n = len(odds)
    k = -(-n // block)
    e = np.ones(k * block)
    e[:n] = odds
    r = np.zeros(k * block, bool)
    r[:n] = reset
    e, r = e.reshape(k, block), r.reshape(k, block)
    m = np.stack([np.where(r, start[0], step[0, 0]), np.where(r, start[1], step[0, 1]) * e, np.where(r, start[0], step[1, 0]), np.where(r, start[1], step[1, 1]) * e])
    p = np.zeros((4, k))
    p[0] = p[3] = 1
    for j in range(block):
        a, b, c, d = m[:, :, j]
        p = np.stack([p[0] * a + p[1] * c, p[0] * b + p[1] * d, p[2] * a + p[3] * c, p[2] * b + p[3] * d])
        p /= p.max(0)
    heads, x, y = np.zeros((k, 2)), 0.5, 0.5
    for i, (a, b, c, d) in enumerate(p.T.tolist()):
        heads[i] = x, y
        x, y = x * a + y * c, x * b + y * d
        x, y = x / (x + y), y / (x + y)
    out = np.zeros((k, block, 2))
    x, y = heads.T
    for j in range(block):
        a, b, c, d = m[:, :, j]
        x, y = x * a + y * c, x * b + y * d
        total = x + y
        x, y = x / total, y / total
        out[:, j, 0], out[:, j, 1] = x, y
    return out.reshape(-1, 2)[:n]


@dataclass
class Field:
    """The chain's weights: by feature bucket, of tag transitions and starts; and the document layer."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    layer: np.ndarray = field(default_factory=lambda: np.array([-4.0, 0.0, 0.0]))

    def marginals(self, score: np.ndarray, reset: np.ndarray) -> np.ndarray:
        """Each token's probability of the toxic tag; ``score`` is its features' sum of weights."""
        if not len(score):
            return score
        odds, step = np.exp(np.clip(score, -30, 30)), np.exp(self.step)
        ahead = messages(odds, reset, step, np.exp(self.start))
        last = np.append(reset[1:], True)
        behind = messages(odds[::-1], last[::-1], step.T, np.ones(2))[::-1]
        both = ahead * behind / np.stack([np.ones(len(odds)), odds], 1)
        return both[:, 1] / both.sum(1)

    def marginals_of(self, x: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Marginals of the tokens of texts; ``text`` has each text's first token and the end."""
        reset = np.zeros(len(x), bool)
        reset[text[:-1][np.diff(text) > 0]] = True
        return self.marginals(self.weights[x].sum(1, dtype=np.float64), reset)

    def summed(self, p: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum and maximum of each text's marginals."""
        total, most = np.zeros(len(text) - 1), np.zeros(len(text) - 1)
        full = np.flatnonzero(np.diff(text))
        if len(full):
            total[full] = np.add.reduceat(p, text[full])
            most[full] = np.maximum.reduceat(p, text[full])
        return total, most

    def document(self, p: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Scores of texts from their tokens' marginals."""
        total, most = self.summed(p, text)
        z = self.layer @ np.stack([np.ones(len(total)), np.log1p(total), most])
        return 1 / (1 + np.exp(-z))


def segments(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Index and feature buckets (tokens x FEATURES) of every text."""
    for base, data, starts in text_arrays(column):
        x, text, _, _ = tokens(data, starts)
        for i in range(len(text) - 1):
            yield base + i, x[text[i] : text[i + 1]]


def marked_features(sample: DataFrame) -> np.ndarray:
    """The buckets that mark tokens of toxic documents: see the module's docstring."""
    size = {int(x["toxic"]): x["count"] for x in sample.groupBy("toxic").count().collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros((2, BUCKETS), np.uint32)
        for batch in batches:
            toxic = batch.column(1).to_pylist()
            for i, x in segments(batch.column(0)):
                df[int(toxic[i]), np.unique(x[:, :-1])] += 1
        yield block_batch(df.ravel(), "<u4")

    df = merged_blocks(sample.select("text", "toxic").mapInArrow(run, BLOCK), np.add, "<u4").reshape(2, -1).astype(np.int64)
    clean, bad = max(1, size.get(0, 0)), max(1, size.get(1, 0))
    return (df[1] >= min(SUPPORT, max(2, bad // 20))) & (df[1] / bad > RATIO * (df[0] + 0.5) / clean)


def descend(model: Field, squares: np.ndarray, small: np.ndarray, part: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """One AdaGrad step on the likelihood of the token labels of ``part``; changes its arguments.

    ``squares`` sums squared slopes by bucket, ``small`` those of transitions and starts.
    """
    x, y = np.concatenate([a for a, _ in part]), np.concatenate([b for _, b in part])
    reset = np.zeros(len(x), bool)
    reset[np.cumsum([0, *(len(a) for a, _ in part[:-1])])] = True
    score = model.weights[x].sum(1, dtype=np.float64)
    odds, step = np.exp(np.clip(score, -30, 30)), np.exp(model.step)
    ahead = messages(odds, reset, step, np.exp(model.start))
    last = np.append(reset[1:], True)
    behind = messages(odds[::-1], last[::-1], step.T, np.ones(2))[::-1]
    both = ahead * behind / np.stack([np.ones(len(odds)), odds], 1)
    p = both[:, 1] / both.sum(1)
    error = (p - y) / len(part)
    slope = np.bincount(x.ravel(), np.repeat(error, x.shape[1]), BUCKETS)
    used = np.flatnonzero(slope)
    slope = slope[used] + DECAY * model.weights[used]
    squares[used] += slope**2
    model.weights[used] -= RATE * slope / np.sqrt(squares[used])
    inner = np.flatnonzero(~reset)
    pair = ahead[inner - 1][:, :, None] * step[None] * behind[inner][:, None, :]
    pair /= pair.sum((1, 2), keepdims=True)
    true = np.bincount(y[inner - 1] * 2 + y[inner], minlength=4).reshape(2, 2)
    g = (pair.sum(0) - true) / len(part)
    small[:4] += g.ravel() ** 2
    model.step -= RATE * g / np.sqrt(small[:4].reshape(2, 2))
    head = np.flatnonzero(reset)
    g = (np.array([(1 - p[head]).sum(), p[head].sum()]) - np.bincount(y[head].astype(int), minlength=2)) / len(part)
    small[4:] += g**2
    model.start -= RATE * g / np.sqrt(small[4:])


def train_field(sample: DataFrame, marked: np.ndarray, shards: int) -> Field:
    """Fits the field in ``EPOCHS`` passes over ``sample`` (text, toxic, key).

    A pass is one job: every shard descends from the same weights, text after text, holding one batch of
    segments, and the changes are averaged over the shards that made them.
    """
    spark = sample.sparkSession
    model, squares, small = Field(), np.full(BUCKETS, 1e-3, np.float32), np.full(6, 1e-3)
    for epoch in range(EPOCHS):
        held = spark.sparkContext.broadcast((np.packbits(marked), model, squares, small))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits, before, old, old_small = held.value
            marks = np.unpackbits(bits).astype(bool)
            own, sums, own_small = Field(before.weights.copy(), before.step.copy(), before.start.copy()), old.copy(), old_small.copy()
            part: list[tuple[np.ndarray, np.ndarray]] = []
            for batch in batches:
                toxic = batch.column(1).to_pylist()
                for i, x in segments(batch.column(0)):
                    y = marks[x[:, :-1]].any(1) & bool(toxic[i])
                    for a in range(0, len(x), SEGMENT):
                        part.append((x[a : a + SEGMENT], y[a : a + SEGMENT]))
                        if len(part) == STEP:
                            descend(own, sums, own_small, part)
                            part = []
            if part:
                descend(own, sums, own_small, part)
            change, more = own.weights - before.weights, sums - old
            used = np.flatnonzero(more)
            # After the buckets come the numbers of transitions and starts.
            rest = np.concatenate([(own.step - before.step).ravel(), own.start - before.start])
            at = np.append(used, BUCKETS + np.arange(6))
            yield batch_of({"bucket": pa.array(at.astype(np.int32)), "change": pa.array(np.append(change[used], rest)), "square": pa.array(np.append(more[used], own_small - old_small))})

        dealt = sample.repartition(shards, "key").sortWithinPartitions(F.xxhash64("key", F.lit(epoch)), "key").select("text", "toxic")
        changes = dealt.mapInArrow(run, "bucket int, change double, square double")
        # At most a row a bucket comes to the driver.
        rows = changes.groupBy("bucket").agg(F.avg("change").alias("change"), F.sum("square").alias("square")).toArrow()
        at, change, square = (x.to_numpy() for x in rows.columns)
        word, new = at < BUCKETS, np.zeros((2, 6))
        model = Field(model.weights.copy(), model.step, model.start)
        squares = squares.copy()
        model.weights[at[word]] += change[word]
        squares[at[word]] += square[word]
        new[:, at[~word] - BUCKETS] = change[~word], square[~word]
        model.step, model.start, small = model.step + new[0, :4].reshape(2, 2), model.start + new[0, 4:], small + new[1]
        held.destroy()
    return model


def document_layer(sample: DataFrame, model: Field) -> np.ndarray:
    """Logistic weights over sum and maximum of each document's marginals: Newton steps with a small ridge."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data, starts in text_arrays(batch.column(0)):
                x, text, _, _ = tokens(data, starts)
                total, most = shared.value.summed(shared.value.marginals_of(x, text), text)
                n = len(total)
                yield batch_of({"total": pa.array(total), "most": pa.array(most), "toxic": batch.column(1)[base : base + n].cast(pa.int32()), "key": batch.column(2)[base : base + n]})

    # A few numbers a sampled document come to the driver.
    rows = sample.select("text", "toxic", "key").mapInArrow(run, "total double, most double, toxic int, key long").collect()
    x = np.array([(1.0, np.log1p(r["total"]), r["most"]) for r in sorted(rows, key=lambda r: r["key"])])
    y, w = np.array([r["toxic"] for r in sorted(rows, key=lambda r: r["key"])]), np.zeros(3)
    for _ in range(50):
        q = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x.T * (q * (1 - q) + 1e-9)) @ x + 0.5 * np.eye(3), x.T @ (q - y) + 0.5 * w)
    return w


def sampled(docs: DataFrame, labels: DataFrame, learns: Column, fit_docs: int = FIT_DOCS) -> DataFrame:
    """text, toxic (0 or 1) and key of the documents learned from: ``fit_docs`` of each label, by hash, at most.

    Of rows with equal doc_id one text is taken, so that ``fit_docs`` bounds the rows too.
    """
    marks = labels.where(learns & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    by_hash = F.xxhash64("doc_id")
    picked = [marks.where(F.col("toxic") == k).orderBy(by_hash, "doc_id").limit(fit_docs) for k in (0, 1)]
    few = F.broadcast(picked[0].union(picked[1]))  # at most 2 * fit_docs rows
    joined = docs.select("doc_id", "text").where("text is not null").join(few, "doc_id")
    texts = joined.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    return saved(texts.select("text", "toxic", F.xxhash64("doc_id").alias("key")), "toxicity-sample")


def fit(docs: DataFrame, labels: DataFrame, learns: Column, fit_docs: int = FIT_DOCS) -> Field:
    """Learns from rows of ``labels`` (doc_id, toxic) for which ``learns`` holds and their texts in ``docs``.

    The sample's whole texts are learned from; it stays a table that tasks stream, so that neither driver nor
    task holds more of it than a batch. Labels of one kind only, or none, give the field that finds nothing toxic.
    """
    sample = sampled(bounded_batches(docs), labels, learns, fit_docs)
    seen = sample.agg(F.min("toxic").alias("least"), F.max("toxic").alias("most"), F.sum(F.octet_length("text")).alias("bytes")).first()
    if seen["least"] == seen["most"]:
        return Field()
    model = train_field(sample, marked_features(sample), -(-seen["bytes"] // SHARD_BYTES))
    model.layer = document_layer(sample, model)
    return model


def score(docs: DataFrame, model: Field, *keep: str, spans: bool = True) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``score`` and, if asked for, ``spans`` of toxic tokens.

    Spans are half-open character offsets, one a token; equal texts score alike, so ties stay ties;
    texts of any length are read whole, each as one chain. Null and empty texts have no tokens and the score of none;
    repeated rows are scored alike; an empty table gives no rows; columns not kept cannot clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = bounded_batches(docs).select(F.struct(*keep).alias("row"), F.col("text").alias("t"))
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data, starts in text_arrays(batch.column(1)):
                x, text, begin, end = tokens(data, starts)
                p = shared.value.marginals_of(x, text)
                n = len(text) - 1
                columns = {"row": batch.column(0)[base : base + n], "score": pa.array(shared.value.document(p, text))}
                if spans:
                    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters before each byte
                    hit = np.flatnonzero(p > 0.5)
                    of = np.searchsorted(text, hit, "right") - 1
                    a, b = before[begin[hit]] - before[starts[of]], before[end[hit]] - before[starts[of]]
                    ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32)
                    columns["spans"] = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["start", "end"]))
                yield batch_of(columns)

    schema = f"row {kind}, score double" + (", spans array<struct<start: long, end: long>>" if spans else "")
    return rows.mapInArrow(run, schema).select("row.*", "score", *["spans"] * spans)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    found = score(docs, model, "doc_id")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
