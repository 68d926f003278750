"""Centroid clustering: Lloyd's rounds over kd-trees that hold counts, integer sums and boxes.

Every task cuts its vectors into blocks and builds a kd-tree of each; the trees are written once and every round
walks them. A centroid that is farther than another one everywhere in a node's box is pruned (strictly: where both
may tie, both stay), a node with one centroid left is assigned whole by its count and sum, and the vectors of a leaf
are compared with what is left. All arithmetic is on integers and exact, so the rounds are those of comparing every
vector with every centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, saved, table

SIZE, SCALE = 64, 1024
CLUSTERS, ROUNDS, SEED = 8, 10, 3
#: Vectors of a tree and of a leaf: bounds of what a task holds and resolves at once.
BLOCK, LEAF = 8192, 32
#: Components below this keep squared distances of SIZE components in 64 bits; others are handled as Python integers.
SAFE = 1 << 27
#: Sums leave the tasks in digits of this base, so that no size of table or component overflows them.
DIGIT = 1 << 40
MOST = (1 << 63) - 1

TREES = "vec_ids array<long>, wide boolean, points binary, ranges binary, boxes binary, sums binary"
PARTS = "cluster int, at int, digit int, value long"
ASSIGNED = "vec_id long, cluster int, distance long"


class Tree(NamedTuple):
    """Points in the tree's order; a node's range in them, its left child (the right one follows) or -1, box and sum."""

    points: np.ndarray
    ranges: np.ndarray
    boxes: np.ndarray
    sums: np.ndarray


def grown(points: np.ndarray) -> tuple[np.ndarray, Tree]:
    """The kd-tree of integer ``points`` and their order in it: halves along the widest side of the box."""
    order, ranges, boxes, sums = np.arange(len(points)), [[0, len(points), -1]], [], []
    for node in ranges:  # grows on the way
        start, stop, _ = node
        own = points[order[start:stop]]
        low, high = own.min(axis=0), own.max(axis=0)
        boxes.append((low, high))
        sums.append(own.sum(axis=0))
        side = int((high - low).argmax())
        if stop - start > LEAF and high[side] > low[side]:
            half = (stop - start) // 2
            order[start:stop] = order[start:stop][np.argpartition(own[:, side], half)]
            node[2] = len(ranges)
            ranges += [[start, start + half, -1], [start + half, stop, -1]]
    return order, Tree(points[order], np.array(ranges), np.array(boxes), np.array(sums))


def squares(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, a row for each point."""
    return ((points[:, None, :] - centroids) ** 2).sum(axis=-1)


def walked(tree: Tree, centroids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray | int, int]]:
    """Ranges of points with their cluster: one number and the node where a whole node has it, else a number a point and -1."""
    nodes, alive = np.array([0]), np.ones((1, len(centroids)), bool)
    while len(nodes):
        low, high = tree.boxes[nodes, 0], tree.boxes[nodes, 1]
        middle = squares(low + high, 2 * centroids)
        star = centroids[np.where(alive, middle, middle.max() + 1).argmin(axis=1)][:, None, :]
        # Of all points of the box the corner towards a centroid favours it most against the star.
        corner = np.where(centroids > star, high[:, None, :], low[:, None, :])
        alive &= ((centroids - corner) ** 2 - (star - corner) ** 2).sum(axis=-1) <= 0
        one, left = alive.sum(axis=1) == 1, tree.ranges[nodes, 2]
        for node, who in zip(nodes[one].tolist(), alive[one].argmax(axis=1).tolist(), strict=True):
            yield int(tree.ranges[node, 0]), int(tree.ranges[node, 1]), who, node
        leaves = ~one & (left < 0)
        for node, who in zip(nodes[leaves].tolist(), alive[leaves], strict=True):
            start, stop, left_over = int(tree.ranges[node, 0]), int(tree.ranges[node, 1]), np.flatnonzero(who)
            yield start, stop, left_over[squares(tree.points[start:stop], centroids[left_over]).argmin(axis=1)], -1
        inner = ~one & (left >= 0)
        nodes, alive = np.concatenate([left[inner], left[inner] + 1]), np.concatenate([alive[inner], alive[inner]])


def clusters_of(wide: bool, tree: Tree, centroids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray | int, int]]:
    """``walked``, or where components are not safe in 64 bits every point compared by itself."""
    if wide:
        yield 0, len(tree.points), np.concatenate([squares(x, centroids).argmin(axis=1) for x in np.array_split(tree.points, -(-len(tree.points) // LEAF))]), -1
    else:
        yield from walked(tree, centroids)


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """Integers of any size from doubles that are whole."""
    return np.array([int(x) for x in values.ravel()], object).reshape(values.shape)


def as_centroids(rows: list[list[int]]) -> np.ndarray:
    return np.array(rows, object if any(abs(x) >= SAFE for row in rows for x in row) else np.int64)


def trees(vectors: DataFrame) -> DataFrame:
    """The saved table of kd-trees over ``vectors`` (vec_id, embedding: SIZE finite components each)."""

    def packed(ids: list[int | None], values: np.ndarray, wide: bool) -> pa.RecordBatch:
        if wide:
            order, tree = np.arange(len(values)), Tree(values, np.zeros((0, 3)), np.zeros((0, 2, SIZE)), np.zeros((0, SIZE)))
        else:
            order, tree = grown(values.astype(np.int64))
        kinds = ("<f8" if wide else "<i4", "<i4", "<i4", "<i8")
        row = {"vec_ids": pa.array([[ids[i] for i in order.tolist()]], pa.list_(pa.int64())), "wide": pa.array([wide])}
        row |= {name: pa.array([x.astype(kind).tobytes()], pa.binary()) for name, x, kind in zip(Tree._fields, tree, kinds, strict=True)}
        return pa.RecordBatch.from_pydict(row)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, tuple[list[int | None], list[np.ndarray]]] = {False: ([], []), True: ([], [])}
        for batch in batches:
            values = np.floor(SCALE * batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, SIZE)
            ids, far = batch.column(0).to_pylist(), np.abs(values).max(axis=1, initial=0) >= SAFE
            for wide, (own, rows) in held.items():
                for i in np.flatnonzero(far == wide).tolist():
                    own.append(ids[i])
                    rows.append(values[i])
                    if len(own) == BLOCK:
                        yield packed(own, np.array(rows), wide)
                        own.clear()
                        rows.clear()
        for wide, (own, rows) in held.items():
            if own:
                yield packed(own, np.array(rows), wide)

    return saved(bounded_batches(vectors).select(F.col("vec_id").cast("long"), "embedding").mapInArrow(build, TREES), "kd-trees")


def loaded(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[list[int | None], bool, Tree, np.ndarray]]:
    """Trees of a batch and the centroids, both as integers that hold the arithmetic."""
    for row in batch.to_pylist():
        wide = row["wide"]
        read = lambda name, kind, *shape: np.frombuffer(row[name], kind).reshape(-1, *shape)  # noqa: B023, E731
        points = whole_numbers(read("points", "<f8", SIZE)) if wide else read("points", "<i4", SIZE)
        tree = Tree(points, read("ranges", "<i4", 3), read("boxes", "<i4", 2, SIZE), read("sums", "<i8", SIZE))
        kind = object if wide or centroids.dtype == object else np.int64
        yield row["vec_ids"], wide, Tree(points.astype(kind), tree.ranges.astype(np.int64), tree.boxes.astype(kind), tree.sums.astype(kind)), centroids.astype(kind)


def one_round(table_: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after every vector went to its nearest one: floors of means, an empty one as it was."""
    given = as_centroids(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last column counts.
        total = np.zeros((len(given), SIZE + 1), object)
        for batch in batches:
            for _, wide, tree, own in loaded(batch, given):
                for start, stop, who, node in clusters_of(wide, tree, own):
                    if node >= 0:
                        total[who, :SIZE] += tree.sums[node].astype(object)
                        total[who, SIZE] += stop - start
                    else:
                        for c in np.unique(who).tolist():
                            mine = tree.points[start:stop][who == c]
                            total[c, :SIZE] += mine.sum(axis=0).astype(object)
                            total[c, SIZE] += len(mine)
        rows = []
        for (c, at), x in np.ndenumerate(total):
            x, digit = int(x), 0
            while x:
                # The rest of a negative number goes on as it is once it is small.
                x, value = divmod(x, DIGIT) if abs(x) >= DIGIT else (0, x)
                rows.append((c, at, digit, value))
                digit += 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["cluster", "at", "digit", "value"])

    sums = np.zeros((len(centroids), SIZE + 1), object)
    # A row for each cluster, component and digit: a few hundred.
    for c, at, digit, value in table_.mapInArrow(run, PARTS).groupBy("cluster", "at", "digit").agg(F.sum("value")).collect():
        sums[c, at] += value * DIGIT**digit
    return [[x // sums[c, SIZE] for x in sums[c, :SIZE].tolist()] if sums[c, SIZE] else centroids[c] for c in range(len(centroids))]


def assigned(table_: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster and squared distance of every vector."""
    given = as_centroids(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, wide, tree, own in loaded(batch, given):
                who = np.zeros(len(ids), np.int32)
                for start, stop, c, _ in clusters_of(wide, tree, own):
                    who[start:stop] = c
                far = [min(int(x), MOST) for x in ((tree.points - own[who]) ** 2).sum(axis=1)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(who), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])

    return table_.mapInArrow(run, ASSIGNED)


def usable(vectors: DataFrame) -> DataFrame:
    """Vectors of SIZE components, none null or non-finite."""
    fine = lambda x: x.isNotNull() & (F.abs(x) < float("inf"))  # noqa: E731  NaN is above all
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == SIZE) & F.forall("embedding", fine)).select("vec_id", "embedding")


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The ``clusters`` usable vectors of smallest hash of their id, as integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("long").cast("string")), 256)
    rows = vectors.orderBy(digest.asc_nulls_last(), "embedding").limit(clusters).select("embedding").collect()
    return [[int(np.floor(SCALE * float(x))) for x in row["embedding"]] for row in rows]


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """Every usable vector with its cluster, distance, the inertias and its centroid (components and their hash).

    Vectors that are null, of another length, or hold a null or non-finite component take no part and have no row.
    Rows of equal vec_id are vectors of their own; those without one are clustered too but are the last to start as
    centroids, and of equal ids the smaller vector comes first. Fewer vectors than ``clusters`` give as many clusters;
    no vectors, no rows. Components of any finite size are exact; distances and inertias beyond 64 bits are given
    as the largest long. Further columns are not read.
    """
    spark, kept = vectors.sparkSession, usable(vectors)
    centroids = first_centroids(kept, clusters, seed)
    if not centroids:
        return spark.createDataFrame([], f"{ASSIGNED}, cluster_inertia long, inertia long, centroid array<decimal(38,0)>, centroid_sha256 string")
    built = trees(kept)
    for _ in range(rounds):
        centroids = one_round(built, centroids)
    found = saved(assigned(built, centroids), "clusters")
    # At most ``clusters`` rows.
    inertia = dict(found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())
    total, rows = sum(map(int, inertia.values())), []
    for c, x in inertia.items():
        digest = hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
        rows.append((c, min(int(x), MOST), min(total, MOST), [str(v) for v in centroids[c]], digest))
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<string>, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings")).drop("centroid")


def oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The rounds written out one after the other, every vector against every centroid."""
    far = "SELECT vec_id, any_value(h) AS h, c, sum((p.v - q.v) * (p.v - q.v))::BIGINT AS far FROM p JOIN c{k} q USING (d) GROUP BY vec_id, c"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, arg_min(c, (far, c)) AS c, min(far) AS far FROM ({far.format(k=k)}) GROUP BY vec_id)")
        if k < rounds:
            mean = f"SELECT a.c, p.d, sum(p.v)::BIGINT AS s, count(*) AS n FROM p JOIN a{k} a USING (vec_id) GROUP BY 1, 2"
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT q.c, q.d, CASE WHEN m.n IS NULL THEN q.v ELSE ((m.s - ((m.s % m.n) + m.n) % m.n) // m.n)::BIGINT END AS v FROM c{k} q LEFT JOIN ({mean}) m USING (c, d))")
    return f"""WITH e AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      p AS MATERIALIZED (SELECT vec_id, sha256('{seed}:' || vec_id) AS h, unnest(range({SIZE})) AS d, floor({SCALE} * unnest(embedding)::DOUBLE)::BIGINT AS v FROM e),
      s AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c FROM e QUALIFY c < {clusters}),
      c0 AS MATERIALIZED (SELECT c, d, v FROM p JOIN s USING (vec_id)),
      {", ".join(steps)},
      t AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
      SELECT vec_id, c::INT AS cluster, far AS distance, (sum(far) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(far) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{rounds} JOIN t USING (c)"""


ORACLE = oracle()
