import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import jaccard
from gleaner.llm.components import components
from gleaner.llm.shingles import shingle_sets

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, n, percent):
    sets = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        sets.setdefault(doc, []).append(frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else []))
    root = {d: d for d in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    seen = defaultdict(list)
    flat = [(d, s) for d, own in sets.items() for s in own]
    for k, (d, s) in enumerate(flat):
        both = Counter(j for t in s for j in seen[t])
        for j, o in both.items():
            if 100 * o >= percent * (len(s) + len(flat[j][1]) - o):
                a, b = sorted((find(d), find(flat[j][0])))
                root[b] = a
        for t in s:
            seen[t].append(k)
    return {d: find(d) for d in sets}, {d: sorted(len(s) for s in own) for d, own in sets.items()}


def made(seed, groups=12, copies=14):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    passage = [word() for _ in range(60)]
    rows, doc = [], 0
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([6, 12, 40, 120, 300]))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5, 9])):
                own[rng.randrange(len(own))] = word()
            if rng.random() < 0.3:
                own += passage
            rows.append((doc, " ".join(own).upper() if rng.random() < 0.2 else "\n".join(own)))
            doc += 1
    return rows


@pytest.mark.parametrize(("n", "percent", "seed"), [(3, 90, 1), (5, 80, 2)])
@pytest.mark.parametrize("frequent", [64, -1000])
def test_components_are_those_of_brute_force(spark, monkeypatch, n, percent, seed, frequent):
    # With FREQUENT far below zero every shingle is frequent, so all index entries are combinations.
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "CHUNK", 8)
    monkeypatch.setattr(jaccard, "ROUNDS", (1, 3, None))
    rows = made(seed) + [(900, None), (901, ""), (902, " \n "), (903, "one"), (904, "ONE"), (905, "one two"), (906, "ein, zwei")]
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()
    root, sizes = brute(rows, n, percent)
    assert {x.doc_id: x.component_id for x in found} == root
    assert all([x.n_shingles] == sizes[x.doc_id] for x in found)
    assert len(set(root.values())) < len(root)


def test_empty_repeated_and_unnamed_rows(spark):
    schema = "doc_id long, text string, n long, root long"
    assert jaccard.jaccard_components(spark.createDataFrame([], schema)).count() == 0
    rows = [(5, "a b c d e f g", 1, 1), (5, "a b c d e f g", 2, 2), (None, "a b c d e f g", 3, 3), (None, None, 4, 4), (2, "A B C D E F G", 5, 5)]
    found = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.jaccard_components(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert found == sorted([(5, 3, 2), (5, 3, 2), (None, 3, 2), (None, 0, None), (2, 3, 2)], key=str)


def test_null_and_repeated_ids_carry_links(spark):
    words = [f"w{i}" for i in range(100)]
    text = lambda k: " ".join(words[:-k] if k else words)
    rows = [(1, text(0)), (None, text(4)), (2, text(8)), (3, "quite other words that no one else has here"), (None, "a text without a name or partner in this table")]
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 95).collect()
    assert sorted((x.doc_id or -1, x.component_id or -1) for x in found) == [(-1, -1), (-1, 1), (1, 1), (2, 1), (3, 3)]
    x, y = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(5, x), (7, x), (7, y), (9, y), (11, "and something that is all of its own")]
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(5, 5), (7, 5), (7, 5), (9, 5), (11, 11)]
    root, _ = brute(rows, 3, 90)
    assert {r.doc_id: r.component_id for r in found} == root


def test_very_long_words_are_hashed_whole():
    import pyarrow as pa

    a, b = "x" * 9000 + "y", "x" * 9001
    sets = [s for _, s in shingle_sets(pa.array([a, b, a.upper()]), 3)]
    assert sets[0] != sets[1] and np.array_equal(sets[0], sets[2])


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    found = {x.v: x.root for x in components(edges).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_texts_are_shuffled_once_and_those_of_no_pair_are_left(spark):
    docs = spark.createDataFrame([(k, f"text number {k // 2} of some") for k in range(200)] + [(None, "text number 3 of some"), (None, "a text of nobody at all")], "doc_id long, text string")
    own = jaccard.hashed(docs, 3).where("block is null and n > 0")
    names = own.groupBy("s1", "s2").agg(F.min("doc_id").alias("name"))
    needed = spark.createDataFrame(names.collect(), names.schema)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = jaccard.texts_of(docs, 3, needed)
        moved = [x for x in texts._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning(" in x]
        rows = {(x.s1, x.s2): x.t for x in texts.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Texts and what is needed, copies by their ids; not the joined texts once more.
    assert len(moved) == 2 and all("nameless#" in x for x in moved)
    assert len(rows) == 101 and rows.keys() == {(x.s1, x.s2) for x in needed.collect()}
    few = spark.createDataFrame([x[:2] for x in list(rows)[:10]], "s1 long, s2 long")
    table = spark.createDataFrame([(*k, t) for k, t in rows.items()], "s1 long, s2 long, t string")
    left = jaccard.thinned(table, few.select("s1")).collect()
    assert {x[:2] for x in few.collect()} <= {(x.s1, x.s2) for x in left} and len(left) < 20
    assert jaccard.thinned(table, few.select("s1").limit(0)).count() == 0
