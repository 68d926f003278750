"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three lower-cased characters are hashed; document frequencies are counted over all
training documents. The regression is trained by follow-the-regularised-leader with elastic-net
penalties on a bounded sample of labelled rows, and a temperature fitted on rows kept from that
training scales its probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import batch_of, block_batch, merged_blocks
from .common import bounded_batches, table

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Labelled rows the regression is fitted on: the documented bound of the fit, dealt evenly over the languages.
#: Languages with fewer rows give all of theirs and leave the rest to the others; each gives one at least.
FIT_ROWS = 3000
#: Of each language's, one in so many is kept for the temperature.
CALIBRATE = 5
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")
#: Texts of fewer letters say too little to be told from strange ones.
FEW_LETTERS = 20
#: First letters of the scripts that strange texts are written in.
SCRIPTS = (0x3B1, 0x430, 0x561, 0x5D0, 0x621, 0x905, 0xE01, 0x10D0, 0x3041, 0x4E00, 0x6C00, 0xAC00)


def grams(text: str) -> np.ndarray:
    """Hash buckets of all n-grams of the whole text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    found, code = [], points.astype(np.uint64)
    for n in ORDERS:
        if n > 1:
            code = code[:-1] * np.uint64(0x100000001B3) + points[n - 1 :]
        if not len(code):
            break
        spread = (code + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        found.append((spread >> np.uint64(48)).astype(np.int64))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(grams(text), minlength=BUCKETS)
    where = np.flatnonzero(counts)
    return where, counts[where]


@dataclass
class Model:
    """Weights by bucket and language, inverse document frequencies and the temperature."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, where: np.ndarray, counts: np.ndarray) -> np.ndarray:
        value = (1 + np.log(counts)) * self.idf[where]
        return value / (np.sqrt((value**2).sum()) or 1)

    def logits(self, where: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(where, counts) @ self.weights[where] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or LETTER.search(text) is None:
            return UNDETERMINED, 0.0
        p = softmax(self.logits(*counted(text)) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(-1, keepdims=True))
    return z / z.sum(-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], langs: list[str], idf: np.ndarray, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, epochs: int = 4, batch: int = 16, aside: list[bool] | None = None) -> Model:
    """Follow the regularised leader (proximal) over mini-batches; then the temperature, on rows set ``aside``."""
    model = Model(langs, idf, np.zeros((BUCKETS, len(langs)), np.float32), np.zeros(len(langs)))
    aside = [not i % CALIBRATE for i in range(len(rows))] if aside is None else aside
    keep = [i for i, x in enumerate(aside) if not x]
    z, n = np.zeros((BUCKETS, len(langs))), np.zeros((BUCKETS, len(langs)))
    bias_n, rng = np.full(len(langs), 1e-8), np.random.default_rng(5)

    def leader(where: np.ndarray) -> np.ndarray:
        free = np.sign(z[where]) * np.maximum(np.abs(z[where]) - l1, 0)
        return -free / ((beta + np.sqrt(n[where])) / alpha + l2)

    for _ in range(epochs):
        order = rng.permutation(keep)
        for part in np.array_split(order, max(1, len(order) // batch)):
            where = np.concatenate([rows[i][0] for i in part] or [np.zeros(0, np.int64)])
            if not len(where):
                continue
            used, place = np.unique(where, return_inverse=True)
            weights, at, slope = leader(used), 0, np.zeros((len(used), len(langs)))
            pull = np.zeros(len(langs))
            for i in part:
                own, counts, label = rows[i]
                mine = place[at : at + len(own)]
                at += len(own)
                value = model.vector(own, counts)
                error = softmax(value @ weights[mine] + model.bias)
                error[label] -= 1
                slope[mine] += value[:, None] * error
                pull += error
            slope, pull = slope / len(part), pull / len(part)
            sigma = (np.sqrt(n[used] + slope**2) - np.sqrt(n[used])) / alpha
            z[used] += slope - sigma * weights
            n[used] += slope**2
            bias_n += pull**2
            model.bias -= 0.1 * pull / np.sqrt(bias_n)
    model.weights = leader(np.arange(BUCKETS)).astype(np.float32)
    kept = [x for x, out in zip(rows, aside, strict=True) if out and len(x[0])]
    if kept:
        logits, label = np.array([model.logits(*x[:2]) for x in kept]), [x[2] for x in kept]
        loss = {t: -np.log(softmax(logits / t)[np.arange(len(kept)), label] + 1e-12).mean() for t in np.geomspace(0.02, 5, 80)}
        model.temperature = float(min(loss, key=loss.get))
    return model


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all ``texts`` each bucket occurs, and how many have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, bool)
        docs = 0
        for batch in batches:
            for text in batch.column(0):
                found = grams(text.as_py() or "")
                if len(found):
                    seen[found] = True
                    total += seen
                    seen[found] = False
                    docs += 1
        if docs:
            # Bucket 0 carries the number of documents too: the table is one of pairs.
            yield block_batch(np.stack([total, np.full(BUCKETS, docs)], 1).ravel(), "<u8")

    pairs = merged_blocks(texts.mapInArrow(run, "block int, counts binary"), np.add, "<u8").reshape(-1, 2)
    return (pairs[:, 0], int(pairs[0, 1])) if len(pairs) else (np.zeros(BUCKETS, np.uint64), 0)


def dealt(sizes: list[int], fit_rows: int) -> int:
    """The most rows that each language may give so that all give ``fit_rows`` at most; one at least."""
    left = fit_rows
    for k, size in enumerate(sorted(sizes)):
        if size * (len(sizes) - k) > left:
            return max(1, left // (len(sizes) - k))
        left -= size
    return max(sizes, default=1)


def sample(known: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list[str], DataFrame]:
    """The languages of ``known`` and its rows (text, lang, n) to fit on: of each language the same number of distinct rows, or all it has.

    A first cut by hash keeps more than that of each language, so that only few rows are numbered.
    """
    key = F.xxhash64("doc_id", "text")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(key).alias("distinct")).collect()
    if not sizes:
        return [], known.select("text", "lang", F.lit(1).alias("n"))
    share = dealt([x["n"] for x in sizes], fit_rows)
    # Room for the error of the distinct count (0.3 is six of its deviations) and for chance.
    room = 1.3 * share + 6 * share**0.5 + 20
    rate = F.create_map(*[y for x in sizes for y in (F.lit(x["lang"]), F.lit(min(1.0, room / max(1, x["distinct"]))))])
    roll = F.pmod(key, F.lit(1 << 40)) / (1 << 40)
    few = known.where(roll < rate[F.col("lang")]).select("doc_id", "text", "lang").distinct()
    numbered = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(roll, "doc_id", "text")))
    return sorted(x["lang"] for x in sizes), numbered.where(F.col("n") <= share).select("text", "lang", "n")


def strange(text: str, seed: int) -> str:
    """``text`` in no language: its letters shuffled, exchanged within the alphabet, or taken from another script."""
    rng, text = np.random.default_rng(seed), text.lower()
    letters = [*LETTER.finditer(text)]
    if seed % 3 == 0:
        new = [letters[k].group() for k in rng.permutation(len(letters))]
    else:
        old = sorted({x.group() for x in letters})
        codes = rng.permutation([ord(x) for x in dict.fromkeys([*"abcdefghijklmnopqrstuvwxyz", *old])]) if seed % 3 == 1 else rng.choice(SCRIPTS) + rng.permutation(len(old))
        table = dict(zip(old, map(chr, codes.tolist()), strict=False))
        new = [table[x.group()] for x in letters]
    out = [*text]
    for x, to in zip(letters, new, strict=True):
        out[x.start()] = to
    return "".join(out)


def fit(docs: DataFrame, learns: Column, fit_rows: int = FIT_ROWS, open_set: bool = False) -> Model:
    """Learns from the rows of ``docs`` (doc_id, text, lang) for which ``learns`` holds.

    With ``open_set`` one row in three is learned a second time, made strange, as ``und``: the model then tells
    texts of the learned languages from others, and its temperature is fitted on both.
    """
    known = bounded_batches(docs).where(learns & F.col("lang").isNotNull() & F.col("text").isNotNull())
    df, total = document_frequencies(known.select("text"))
    idf = np.log((1 + total) / (1 + df.astype(float))) + 1
    langs, picked = sample(known, fit_rows)
    if not langs:
        return Model([], idf, np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    langs = sorted({*langs, UNDETERMINED}) if open_set else langs
    place = {k: i for i, k in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            learned = [*zip(*(x.to_pylist() for x in batch.columns), strict=True)]
            if open_set:
                learned += [(strange(text, n // 3), UNDETERMINED, n // 3 + 1) for text, _, n in learned if n % 3 == 0 and len(LETTER.findall(text)) >= FEW_LETTERS]
            both = [counted(x) for x, _, _ in learned]
            yield batch_of({"w": pa.array([a.astype("<u2").tobytes() for a, _ in both], pa.binary()), "c": pa.array([b.astype("<u4").tobytes() for _, b in both], pa.binary()), "lang": pa.array([x[1] for x in learned], pa.string()), "n": pa.array([x[2] for x in learned], pa.int32())})

    rows = sorted(picked.mapInArrow(run, "w binary, c binary, lang string, n int").collect(), key=lambda x: (x["n"], x["lang"]))
    # A language's first rows are trained on, so that one of a single row is learned too.
    aside = [not x["n"] % CALIBRATE for x in rows]
    return train([(np.frombuffer(x["w"], "<u2").astype(np.int64), np.frombuffer(x["c"], "<u4"), place[x["lang"]]) for x in rows], langs, idf, aside=aside)


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``lang_pred`` and ``score``; whole texts are read.

    Null texts and texts without a letter are ``und`` with score 0; texts of any length are read whole; of
    languages equally likely the first by name counts; repeated rows are predicted alike; an empty table gives no rows; columns of ``docs`` that are not kept cannot clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = bounded_batches(docs).select(F.struct(*keep).alias("row"), F.col("text").alias("t"))
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(x.as_py()) for x in batch.column(1)]
            yield batch_of({"row": batch.column(0), "lang_pred": pa.array([x for x, _ in found], pa.string()), "score": pa.array([y for _, y in found], pa.float64())})

    return rows.mapInArrow(run, f"row {kind}, lang_pred string, score double").select("row.*", "lang_pred", "score")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, F.col("doc_id").isNotNull() & ~held_out())
    return predict(docs, model, "doc_id").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
