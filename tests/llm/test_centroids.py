import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import centroids as C

SCHEMA = "vec_id long, embedding array<double>, label int, cluster int"


def plain(rows, clusters=8, rounds=10):
    """Every vector against every centroid, in Python integers."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    started = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    at = [v for _, v in started[:clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def nearest(v):
        return min((far(v, c), k) for k, c in enumerate(at))

    for _ in range(rounds):
        own = [[] for _ in at]
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        at = [[sum(x) // len(o) for x in zip(*o, strict=True)] if o else c for o, c in zip(own, at, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = {k: sum(d for _, d, c in found if c == k) for k in range(len(at))}
    clip = lambda x: min(x, 2**63 - 1)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, c, clip(d), clip(inertia[c]), clip(sum(inertia.values())), digest[c]) for i, d, c in found), key=repr)


def result(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, C.clustered(df).drop("centroid").collect()), key=repr)


def vectors(n, seed=0, scale=1.0):
    r = random.Random(seed)
    hubs = [[r.gauss(0, scale) for _ in range(64)] for _ in range(12)]
    return [(i, [x + r.gauss(0, 0.05 * scale) for x in r.choice(hubs)], 0, 7) for i in range(n)]


def test_rounds_equal_comparing_every_vector(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 100)
    monkeypatch.setattr(C, "LEAF", 4)
    rows = vectors(400)
    assert result(spark, rows) == plain(rows)


def test_ties_copies_nulls_and_odd_vectors(spark):
    rows = vectors(40, 1)
    grid = [(100 + k, [float(k % 2)] * 32 + [float(k // 2 % 2)] * 32, 0, 0) for k in range(24)]
    odd = [(50, None, 0, 0), (51, [1.0] * 63, 0, 0), (52, [None] + [1.0] * 63, 0, 0), (53, [math.nan] * 64, 0, 0), (54, [math.inf] * 64, 0, 0), (55, [], 0, 0)]
    twice = [(5, rows[6][1], 0, 0), (5, rows[6][1], 0, 0), (None, rows[3][1], 0, 0)]
    assert result(spark, rows + grid + odd + twice) == plain(rows + grid + odd + twice)


def test_components_of_any_size_stay_exact(spark):
    rows = vectors(30, 2) + [(1000 + k, [x * 1e30 for x in v], 0, 0) for k, v, *_ in vectors(6, 3)] + [(2000 + k, [x * 3e5 for x in v], 0, 0) for k, v, *_ in vectors(6, 4)]
    assert result(spark, rows) == plain(rows)


def test_few_or_no_vectors(spark):
    assert result(spark, []) == []
    assert result(spark, vectors(3)) == plain(vectors(3))


def test_a_tree_prunes_only_strictly_dominated_centroids():
    r = np.random.default_rng(5)
    points = np.concatenate([r.integers(-50, 50, (300, 64)) + 2000 * r.integers(0, 2, 64) for _ in range(3)] + [np.zeros((100, 64), np.int64)])
    order, tree = C.grown(points)
    assert sorted(order.tolist()) == list(range(len(points))) and (tree.sums[0] == points.sum(axis=0)).all()
    for at in (points[:8], np.repeat(points[:4], 2, axis=0), np.array([np.full(64, x) for x in (1, -1, 1, -1)])):
        who, whole = np.full(len(points), -1), 0
        for start, stop, c, node in C.walked(tree, at):
            assert (who[start:stop] == -1).all()
            who[start:stop] = c
            whole += node >= 0
            if node >= 0:
                assert (tree.sums[node] == tree.points[start:stop].sum(axis=0)).all()
        assert (who == C.squares(tree.points, at).argmin(axis=1)).all()
    assert whole >= 0


def test_clear_groups_are_assigned_as_whole_nodes():
    points = np.concatenate([np.random.default_rng(k).integers(0, 30, (500, 64)) + 5000 * k for k in range(4)])
    _, tree = C.grown(points)
    found = [*C.walked(tree, np.array([np.full(64, 5000 * k + 15) for k in range(4)]))]
    assert all(node >= 0 for *_, node in found) and len(found) < 40


def test_query_has_the_contract_s_columns(spark, sf_dir):
    df = C.op11_centroids(spark, sf_dir)
    assert df.dtypes == [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]
    assert df.agg(F.sum("distance")).first()[0] == df.first()["inertia"]


@pytest.mark.parametrize("values", [[2**200, -(2**130)], [-1, 5]])
def test_digits_carry_sums_of_any_size(values):
    for v in values:
        x, digit, back = v, 0, 0
        while x:
            x, value = divmod(x, C.DIGIT) if abs(x) >= C.DIGIT else (0, x)
            assert abs(value) < C.DIGIT
            back += value * C.DIGIT**digit
            digit += 1
        assert back == v
