import importlib
import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_in_order(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "mixing", "packing"]
    common = importlib.import_module("gleaner.llm.common")
    docs = common.table(spark, sf_dir, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.saved(stage(spark, docs, sf_dir), f"test-{name}")
        counts.append(docs.count())
        if name in ("toxicity", "language", "near_duplicates"):
            assert docs.columns == columns
            assert docs.exceptAll(before).count() == 0
        if name == "mixing":
            assert docs.columns == columns and before.select("doc_id").intersect(docs.select("doc_id")).count() > 0
    assert counts[0] > counts[1] >= counts[2] > counts[3] > 0
    assert counts[1] > 0.8 * counts[0]
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


def test_language_stage_rejects_foreign_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rng = random.Random(1)
    foreign = ["Все люди рождаются свободными и равными в своем достоинстве и правах", "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系", "12 34 5678 !?", "".join(rng.choices("bcdfghjklmnpqrstvwxz    ", k=300)), "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=300))]
    clean = ["Von.", "the of and", "a"]
    rows = [(k, text, None, "s", len(text)) for k, text in enumerate(foreign + clean, 10**9)]
    planted = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    kept = corpus_pipeline.drop_unknown_language(spark, planted, sf_dir)
    assert [r.text for r in kept.where("doc_id >= 1000000000").orderBy("doc_id").collect()] == clean
    assert kept.where("doc_id < 1000000000").count() >= 0.98 * docs.count()


def test_language_stage_keeps_all_where_nothing_is_labelled(spark):
    rows = [(1, "some text of a kind", None, "s", 1), (2, "12", None, "s", 1), (3, None, "und", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_unknown_language(spark, docs, "").collect()) == [1, 2, 3]


def test_near_duplicates_leave_one_row(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(4, text), (2, text + " more"), (9, "other words that stand alone here"), (9, "other words that stand alone here"), (7, None), (None, "nameless text of its own kind")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted((x.doc_id or -1) for x in kept.collect()) == [-1, 2, 7, 9]


DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def near_duplicates(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], DOCUMENT).repartition(3)
    return sorted(((x.doc_id, x.text, x.source) for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()), key=repr)


def plain_groups(rows):
    """Components over all pairs of rows: 80 % of five-word shingles, or one doc_id for two texts that have words."""

    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())

    sets = [shingles(t) for _, t, _ in rows]
    top = [*range(len(rows))]

    def find(i):
        return i if top[i] == i else find(top[i])

    for i in range(len(rows)):
        for j in range(i):
            near = sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
            if near or rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] and sets[j]:
                top[find(i)] = find(j)
    out = {}
    for i, row in enumerate(rows):
        out.setdefault(find(i) if sets[i] else ("none", i), []).append(row)
    return [*out.values()]


def held_against_groups(kept, rows):
    left = [*kept]
    for group in plain_groups(rows):
        mine = [r for r in left if r in group]
        assert len(mine) >= 1, group
        left.remove(mine[0])
        ids = [i for i, _, _ in group if i is not None]
        assert mine[0][0] == (min(ids) if ids else None)
    assert left == []


def text_of(words):
    return " ".join(words)


@pytest.mark.parametrize("case", ["null id is a near copy", "two without an id", "an empty text without an id", "repeated ids", "random"])
def test_one_row_of_each_group_by_brute_force(spark, case):
    base = [f"w{i}" for i in range(40)]
    x, near, other = text_of(base), text_of([*base, "more"]), text_of(reversed(base))
    rows = {
        "null id is a near copy": [(5, x, "a"), (None, near, "b"), (6, other, "c")],
        "two without an id": [(None, x, "a"), (None, near, "b"), (None, other, "c"), (None, "", "d"), (None, None, "e")],
        "an empty text without an id": [(5, x, "a"), (None, x, "b"), (None, "", "c"), (3, " ", "d")],
        "repeated ids": [(7, x, "a"), (7, near, "b"), (7, near, "b"), (8, other, "c"), (8, other, "d"), (9, "", "e"), (9, "", "e")],
    }
    if case == "random":
        rng = random.Random(4)
        texts = [text_of(rng.choices(base, k=30)) for _ in range(6)]
        rows[case] = [(rng.choice([None, *range(25)]), t if rng.random() < 0.6 else f"{t} {rng.choice('xyz')}", rng.choice("ab")) for t in rng.choices(texts, k=60)]
    held_against_groups(near_duplicates(spark, rows[case]), rows[case])


@pytest.mark.parametrize("stage", ["drop_toxic", "drop_near_duplicates", "mix_sources", "pack_windows"])
def test_stages_take_empty_tables_and_null_texts(spark, sf_dir, stage):
    run = getattr(corpus_pipeline, stage)
    assert run(spark, spark.createDataFrame([], DOCUMENT), sf_dir).count() == 0
    rows = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, None, "en", "s", 0), (3, "plain words here", "en", "s", 16)], DOCUMENT)
    got = run(spark, rows, sf_dir).count()
    assert got == 4 if stage != "mix_sources" else got >= 1


def test_reruns_of_the_mix_agree_on_repeated_ids(spark):
    rows = [(k % 3, f"a{k} b{k} c{k}", "en", f"s{k % 2}", 8) for k in range(12)]
    docs = spark.createDataFrame(rows, DOCUMENT)
    got = [sorted(map(tuple, corpus_pipeline.mix_sources(spark, docs.repartition(n), "").collect())) for n in (1, 2, 5)]
    assert got[0] == got[1] == got[2]
