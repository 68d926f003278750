"""Approximate nearest neighbours by learned partitions.

A neighbour graph of a bounded sample is cut into balanced parts by recursive bisection; a small network
learns which part a vector's neighbours are in. It gives every row of the table its partition and routes
each query to its most probable partitions, whose rows are ranked by the exact measure.

A partition of many rows is cut once more in the same way, by a network learned from rows of its own, so
partitions keep their size up to ``PARTS * INNER`` of them. The samples are the only bounded things: all
rows are indexed, partitions of any size are searched in blocks of rows and queries, and a query's
partitions are extended until they hold enough candidates.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import bounded_batches, saved, table, within

#: Rows the partitions are learned from, those of smallest id hash; the documented bound of the fit.
SAMPLE = 8192
#: Rows beside the sample that the number of probes is chosen on; of small tables one row in eight.
HELD_OUT = 1024
PARTS = 64
#: A partition expected to hold more rows is cut into parts of about so many, at most ``INNER``, learned from ``INNER_SAMPLE`` of its rows.
PART_ROWS = 1 << 16
INNER = 64
INNER_SAMPLE = 4096
NEIGHBOURS = 10
#: Queries are routed to the fewest partitions that find this share of the neighbours of rows held out of the fit.
RECALL = 0.94
#: Rows and queries of a block that one task compares.
BLOCK_ROWS = 4096
BLOCK_QUERIES = 2048


def graph(x: np.ndarray, k: int) -> np.ndarray:
    """Each row's ``k`` rows of largest inner product, itself left out."""
    k = min(k, len(x) - 1)
    found = np.zeros((len(x), k), np.int64)
    for a in range(0, len(x), 1024):
        scores = x[a : a + 1024] @ x.T
        scores[np.arange(len(scores)), a + np.arange(len(scores))] = -np.inf
        found[a : a + 1024] = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return found


def halves(edges: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """A balanced cut of a graph of ``n`` nodes: sides by a slow eigenvector, then improved by swaps."""
    u, v = np.concatenate([edges, edges[:, ::-1]]).T
    degree = np.bincount(u, minlength=n) + 1.0
    x = rng.standard_normal(n)
    for _ in range(60):
        x -= (x * degree).sum() / degree.sum()
        x = 0.5 * x + 0.5 * (np.bincount(u, x[v], n) + x) / degree
        x /= np.abs(x).max() + 1e-12
    side = np.zeros(n, bool)
    side[np.argsort(x, kind="stable")[n // 2 :]] = True
    for _ in range(8):
        gain = np.bincount(u, np.where(side[u] == side[v], -1.0, 1.0), n)
        a, b = np.flatnonzero(~side), np.flatnonzero(side)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = min(len(a), len(b))
        swaps = int((gain[a[:m]] + gain[b[:m]] > 0).sum() * 0.5)
        if not swaps:
            break
        side[a[:swaps]], side[b[:swaps]] = True, False
    return side


def balanced_parts(near: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """A part below ``parts`` (a power of two) for each node of a neighbour graph, in equal numbers."""
    rng, part = np.random.default_rng(seed), np.zeros(len(near), np.int64)
    edges = np.stack([np.repeat(np.arange(len(near)), near.shape[1]), near.ravel()], 1)
    for _ in range(parts.bit_length() - 1):
        inside = edges[part[edges[:, 0]] == part[edges[:, 1]]]
        of, new = part[inside[:, 0]], part * 2
        for p in np.unique(part):
            nodes = np.flatnonzero(part == p)
            place = np.full(len(near), -1)
            place[nodes] = np.arange(len(nodes))
            new[nodes] += halves(place[inside[of == p]], len(nodes), rng)
        part = new
    return part


class Router:
    """A network with one hidden layer that gives each partition's probability for a vector."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 30, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.scale = 1 / (np.sqrt((x**2).sum(1).mean() / x.shape[1]) + 1e-12)
        shapes = [(x.shape[1], hidden), (hidden,), (hidden, target.shape[1]), (target.shape[1],)]
        self.weights = [rng.standard_normal(s) * (2 / s[0]) ** 0.5 if len(s) == 2 else np.zeros(s) for s in shapes]
        first, second, step = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0
        for epoch in range(epochs):
            rate = 3e-3 * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
                step += 1
                inner = np.maximum(x[rows] * self.scale @ self.weights[0] + self.weights[1], 0)
                error = (self.softmax(inner) - target[rows]) / len(rows)
                back = (error @ self.weights[2].T) * (inner > 0)
                slopes = [(x[rows] * self.scale).T @ back, back.sum(0), inner.T @ error, error.sum(0)]
                for w, g, m, v in zip(self.weights, slopes, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def softmax(self, inner: np.ndarray) -> np.ndarray:
        z = inner @ self.weights[2] + self.weights[3]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.softmax(np.maximum(x * self.scale @ self.weights[0] + self.weights[1], 0))


class Cells:
    """The network of all partitions and those of partitions that are cut once more; parts are numbered through."""

    def __init__(self, router: Router, inner: dict[int, Router]):
        self.router, self.inner = router, inner
        self.sizes = np.array([inner[p].weights[3].size if p in inner else 1 for p in range(router.weights[3].size)])
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Each part's probability."""
        odds = np.repeat(self.router(x), self.sizes, axis=1)
        for p, own in self.inner.items():
            odds[:, self.first[p] : self.first[p + 1]] *= own(x)
        return odds

    def home(self, x: np.ndarray) -> np.ndarray:
        """The part that a row is kept in."""
        top = self.router(x).argmax(1)
        part = self.first[top]
        for p, own in self.inner.items():
            if (mine := top == p).any():
                part[mine] += own(x[mine]).argmax(1)
        return part


def learned(own: np.ndarray, parts: int) -> Router:
    """A network for at most ``parts`` balanced parts (a power of two) of the neighbour graph of ``own``."""
    while parts > 1 and len(own) < 16 * parts:
        parts //= 2
    if len(own) < 2:
        return Router(own, np.ones((len(own), 1)), epochs=0)
    near = graph(own, NEIGHBOURS)
    part = balanced_parts(near, parts)
    # A row's target: its own part and those of its neighbours.
    target = np.zeros((len(own), parts))
    for column in np.column_stack([part, part, near_parts := part[near]]).T:
        target[np.arange(len(own)), column] += 1
    target /= near_parts.shape[1] + 2
    return Router(own, target)


def held_rows(n: int) -> int:
    return min(HELD_OUT, n // 8)


def probes_of(odds, home, x: np.ndarray, k: int, recall: float = RECALL) -> int:
    """The fewest parts that find ``recall`` of the neighbours of the last rows of ``x``, which were not learned from."""
    held, parts = held_rows(len(x)), odds(x[:1]).shape[1]
    if not held or parts == 1:
        return parts
    asked = np.arange(len(x) - held, len(x))
    scores = x[asked] @ x.T
    scores[np.arange(held), asked] = -np.inf
    true = np.argsort(-scores, axis=1)[:, : min(k, len(x) - 1)]
    rank = np.argsort(np.argsort(-odds(x[asked]), axis=1), axis=1)
    needed = np.take_along_axis(rank, home(x)[true], axis=1)
    found = np.cumsum(np.bincount(needed.ravel(), minlength=parts)) / needed.size
    return int(np.searchsorted(found, recall)) + 1 if found[-1] >= recall else parts


def fit(x: np.ndarray, k: int, parts: int = PARTS, recall: float = RECALL) -> tuple[Router, int]:
    """The router of a sample whose last rows are kept from learning, and the number of partitions a query is sent to."""
    router = learned(x[: len(x) - held_rows(len(x))], parts)
    return router, probes_of(router, lambda rows: router(rows).argmax(1), x, k, recall)


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row id and score of each query's ``k`` best rows of a block, ties to smaller ids."""
    out = []
    for a in range(0, len(queries), 256):
        scores = queries[a : a + 256] @ rows.T
        scores[query_ids[a : a + 256, None] == ids[None]] = -np.inf
        kth = np.partition(scores, -k, axis=1)[:, -k] if len(rows) > k else np.full(len(scores), -np.inf)
        # Products are summed again, all in one order, for whatever rounding might put among the best.
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(kth), kth, 0)))
        q, r = np.nonzero((scores >= (kth - slack)[:, None]) & np.isfinite(scores))
        exact = (queries[a + q] * rows[r]).sum(1)
        order = np.lexsort((ids[r], -exact, q))
        q, r, exact = q[order], r[order], exact[order]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else q
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = rank < k
        out.append((query_ids[a + q[keep]], ids[r[keep]], exact[keep]))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``v`` (array<double>) of rows with an id and a finite, non-zero vector."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("id").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's ``k`` nearest rows found: query_id, rank, vec_id, score.

    ``is_query`` is a condition on ``id``. Null ids and vectors that are null, empty, zero or hold null or
    non-finite components take no part. Vectors are compared with those of their length, each length by a
    router of its own. Rows with equal ids are one candidate, at its best score; ties of score go to smaller ids;
    fewer than ``k`` candidates are all returned; an empty table gives no rows; further columns are not read.
    """
    rows = usable(vectors, id_col, vector_col)
    widths = sorted(x["n"] for x in rows.select(F.size("v").alias("n")).distinct().collect())
    found = [candidates(rows.where(F.size("v") == n), is_query, k) for n in widths]
    found = [x for x in found if x is not None]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    merged = reduce(DataFrame.union, found).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def candidates(rows: DataFrame, is_query, k: int) -> DataFrame | None:
    """Query, row and score of each query's best rows of each block; ``rows`` (id, v) have vectors of one length."""
    spark = rows.sparkSession
    keyed = rows.withColumn("key", F.xxhash64("id"))
    # Of rows with equal ids one is learned from; at most the sample's rows come to the driver.
    few = within(keyed, "key", SAMPLE + HELD_OUT).groupBy("key").agg(F.min("v").alias("v"))
    sample = sorted(few.collect(), key=lambda r: r["key"])
    x = np.array([r["v"] for r in sample])
    router = learned(x[: len(x) - held_rows(len(x))], PARTS)
    share = np.bincount(router(x).argmax(1), minlength=router.weights[3].size) / len(x)
    cells = Cells(router, inner_routers(keyed.where(F.col("key") > sample[-1]["key"]), router, share * rows.count()))
    probes = probes_of(cells, cells.home, x, k)
    shared = spark.sparkContext.broadcast(cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                part = pa.array(shared.value.home(matrix(batch.column("v"))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns, part], ["id", "v", "part"])

    index = saved(bounded_batches(rows).mapInArrow(place, "id long, v array<double>, part int"), "vector-index")
    # One row a partition comes to the driver.
    counts = {x["part"]: x["n"] for x in index.groupBy("part").agg(F.count("*").alias("n")).collect()}
    in_part = np.array([counts.get(p, 0) for p in range(cells.first[-1])])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 512):
                batch = whole[a : a + 512]
                order = np.argsort(-shared.value(matrix(batch.column("v"))), axis=1)
                held = np.cumsum(in_part[order], axis=1)
                # Besides the probable ones, as many partitions as hold k candidates and the query itself.
                wanted = (np.arange(order.shape[1])[None] < probes) | (np.concatenate([np.zeros((len(held), 1), int), held[:, :-1]], 1) <= k)
                q, j = np.nonzero(wanted & (in_part[order] > 0))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(q)), batch.column("v").take(pa.array(q)), pa.array(order[q, j].astype(np.int32))], ["id", "v", "part"])

    routed = saved(index.where(is_query).select("id", "v").mapInArrow(route, "id long, v array<double>, part int"), "vector-queries")
    asked = {x["part"]: x["n"] for x in routed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    blocks = [(p, -(-n // BLOCK_ROWS), -(-asked[p] // BLOCK_QUERIES)) for p, n in counts.items() if p in asked]
    if not blocks:
        return None
    shape = F.broadcast(spark.createDataFrame(blocks, "part int, nr int, nq int"))  # at most PARTS * INNER rows
    pick = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = routed.join(shape, "part").withColumn("q", pick("nq")).withColumn("r", every("nr")).select("part", "q", "r", "id", "v")
    right = index.join(shape, "part").withColumn("r", pick("nr")).withColumn("q", every("nq")).select("part", "q", "r", "id", "v")

    def rank(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(block):
            return pd.DataFrame({"query_id": np.zeros(0, int), "vec_id": np.zeros(0, int), "score": np.zeros(0)})
        q, r, score = best(np.stack(queries["v"]), queries["id"].to_numpy(), np.stack(block["v"]), block["id"].to_numpy(), k)
        return pd.DataFrame({"query_id": q, "vec_id": r, "score": score})

    key = ("part", "q", "r")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(rank, "query_id long, vec_id long, score double")


def inner_routers(rows: DataFrame, router: Router, expected: np.ndarray) -> dict[int, Router]:
    """Networks for the partitions that are ``expected`` to hold more than ``PART_ROWS`` rows, each learned in a task."""
    parts = {p: min(INNER, 1 << (int(-(-n // PART_ROWS)) - 1).bit_length()) for p, n in enumerate(expected) if n > PART_ROWS}
    if not parts:
        return {}
    rate = {p: min(1.0, 1.5 * INNER_SAMPLE / expected[p]) for p in parts}
    roll = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 40)) / (1 << 40)
    shared = rows.sparkSession.sparkContext.broadcast(router)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                part = shared.value(matrix(batch.column("v"))).argmax(1)
                keep = pa.array(batch.column("roll").to_numpy() < np.array([rate.get(p, 0) for p in range(len(expected))])[part])
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(part.astype(np.int32))], ["id", "v", "part"]).filter(keep)

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        p = int(group["part"].iloc[0])
        own = learned(np.stack(group.sort_values("id")["v"].iloc[:INNER_SAMPLE]), parts[p])
        return pd.DataFrame({"part": [p], "router": [pickle.dumps(own)]})

    few = bounded_batches(rows).select("id", "v", roll.alias("roll")).where(F.col("roll") < max(rate.values()))
    placed = few.mapInArrow(place, "id long, v array<double>, part int").groupBy("part", "id").agg(F.min("v").alias("v"))
    # At most PARTS networks come to the driver.
    found = placed.groupBy("part").applyInPandas(learn, "part int, router binary").collect()
    return {x["part"]: pickle.loads(x["router"]) for x in found}


def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
