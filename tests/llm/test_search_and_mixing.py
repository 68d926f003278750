from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gleaner.llm import mixing, neighbours


def truth(ids, x, q, k):
    out = {}
    for i in q:
        own = ids != ids[i]
        score = (x * x[i]).sum(1)
        order = np.lexsort((ids, -score))
        out[ids[i]] = [(ids[j], score[j]) for j in order if own[j]][:k]
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 24))
    x = (centres[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 24))).astype(np.float32)
    x[500:1400] = x[7]  # one vector holds a third of the rows
    ids = np.arange(3000)
    rows = spark.createDataFrame([(int(i), v.tolist(), "c") for i, v in zip(ids, x)], "vec_id long, embedding array<float>, part string")
    found = defaultdict(list)
    for r in neighbours.search(rows, F.col("id") % 20 == 0).collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    expected = truth(ids, x.astype(float), np.flatnonzero(ids % 20 == 0), 20)
    hits = 0
    for q, own in expected.items():
        got = sorted(found[q])
        assert [r for r, _, _ in got] == list(range(1, 21))
        assert [(-s, v) for _, v, s in got] == sorted((-s, v) for _, v, s in got)
        hits += len({v for _, v, _ in got} & {v for v, _ in own})
    assert hits / (20 * len(expected)) >= 0.9


def test_probes_hold_for_unseen_rows():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12096, 64))
    router, probes = neighbours.fit(x[:4096], 20)
    queries, rows = x[4096:4596], x[4096:]
    scores = queries @ rows.T
    scores[np.arange(500), np.arange(500)] = -np.inf
    true = np.argsort(-scores, axis=1)[:, :20]
    rank = np.argsort(np.argsort(-router(queries), axis=1), axis=1)
    assert (np.take_along_axis(rank, router(rows).argmax(1)[true], axis=1) < probes).mean() >= 0.94


def test_recall_well_above_the_sample(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(300, 32))[rng.integers(0, 300, 30000)] + 0.7 * rng.normal(size=(30000, 32))).astype(np.float32)
    rows = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(30000), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
    found = defaultdict(set)
    for r in neighbours.search(rows, F.col("id") % 100 == 0).collect():
        found[r.query_id].add(r.vec_id)
    x = x.astype(float)
    scores = x[::100] @ x.T
    scores[np.arange(300), np.arange(300) * 100] = -np.inf
    recall = np.mean([len(found[100 * k] & set(true)) / 20 for k, true in enumerate(np.argsort(-scores, axis=1)[:, :20].tolist())])
    print(f"recall {recall:.3f}")
    assert len(found) == 300 and recall >= 0.9


def recall_of(spark, rows, ids, x, step):
    found = defaultdict(set)
    for r in neighbours.search(rows, F.col("id") % step == 0).collect():
        found[r.query_id].add(r.vec_id)
    expected = truth(ids, x, np.flatnonzero(ids % step == 0), 20)
    return np.mean([len(found[q] & {v for v, _ in own}) / len(own) for q, own in expected.items()])


def test_large_partitions_are_cut_once_more(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(300, 16))[rng.integers(0, 300, 30000)] + 0.4 * rng.normal(size=(30000, 16))).astype(np.float32)
    rows = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(30000), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
    monkeypatch.setattr(neighbours, "PARTS", 8)
    monkeypatch.setattr(neighbours, "PART_ROWS", 1000)
    made = []
    own = neighbours.Cells.__init__
    monkeypatch.setattr(neighbours.Cells, "__init__", lambda self, router, inner: made.append(inner) or own(self, router, inner))
    assert recall_of(spark, rows, np.arange(30000), x.astype(float), 100) >= 0.9
    assert made and len(made[0]) == 8 and all(r.weights[3].size >= 4 for r in made[0].values())


def test_recall_on_the_embeddings(spark):
    sf = "/root/testdata/sf0.1"
    data = pd.read_parquet(f"{sf}/embeddings.parquet")
    data = data[[v is not None and len(v) > 0 and bool(np.isfinite(np.asarray(v, float)).all()) and bool(np.any(v)) for v in data["embedding"]]]
    rows, ids = spark.read.parquet(f"{sf}/embeddings.parquet"), data["vec_id"].to_numpy()
    recall = recall_of(spark, rows, ids, np.stack(data["embedding"]).astype(float), 20)
    print(f"recall {recall:.3f}")
    assert recall >= 0.9


def test_search_covers_vectors_of_every_length(spark):
    data = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [2.0, 0.0]), (20, [1.0, 2.0, 3.0]), (21, [1.0, 0.0, 0.0]), (40, [1.0])]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    found = [(r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.search(rows, F.col("id") % 20 == 0).collect()]
    assert sorted(found) == [(0, 1, 2, 2.0), (0, 2, 1, 0.5), (20, 1, 21, 1.0)]


def test_search_leaves_out_unusable_vectors(spark):
    nan = float("nan")
    data = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [1.0, None]), (6, []), (7, [2.0, 0.0]), (7, [1.0, 0.0]), (None, [9.0, 9.0]), (20, [1.0, 2.0, 3.0])]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    found = [(r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.search(rows, F.col("id") % 20 == 0).collect()]
    assert sorted(found) == [(0, 1, 7, 2.0), (0, 2, 1, 0.5)]
    assert neighbours.search(rows.limit(0), F.col("id") % 20 == 0).count() == 0


def test_parts_are_balanced():
    x = np.random.default_rng(0).normal(size=(1024, 8))
    part = neighbours.balanced_parts(neighbours.graph(x, 10), 16)
    assert np.bincount(part, minlength=16).tolist() == [64] * 16


def test_mixing_equals_its_sql(spark, sf_dir, tmp_path):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.execute(mixing.ORACLE)
    names = [d[0] for d in want.description]
    got = mixing.op3_mixing(spark, sf_dir)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


def test_mixing_meets_its_targets(spark):
    rng = np.random.default_rng(3)
    data = [(i, ["hot", "b", "c", None, "e"][min(int(rng.exponential(1.2)), 4)], " ".join(["w"] * int(rng.integers(0, 50)))) for i in range(4000)]
    data += [(None, "b", None), (17, "b", "x y"), (17, "b", "x y"), (5000, "empty", "")]
    docs = spark.createDataFrame(data, "doc_id long, source string, text string").withColumn("size", F.lit("clash")).withColumn("row", F.lit(1))
    rows = mixing.mix(docs, mixing.n_words(F.col("text"))).select("row.source", "size", "source_size", "target", "taken").collect()
    assert len(rows) == len(data)
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert 0 <= r.taken <= 2 * r.size
    total = sum(r.size for r in rows)
    assert abs(sum(own[0].target for own in by.values()) - 1.5 * total) < 1e-6 * total
    for own in by.values():
        assert sum(r.size for r in own) == own[0].source_size
        assert sum(r.taken for r in own) == int(own[0].target) and own[0].target <= 2 * own[0].source_size
    assert mixing.mix(docs.limit(0), F.col("doc_id")).count() == 0
