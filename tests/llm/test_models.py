import numpy as np
from pyspark.sql import functions as F

from gleaner.llm import langid, toxicity


def test_held_out_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = langid.op7_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").collect()
    own = [r for r in found if r.held_out]
    assert len(found) == docs.count() and own
    assert np.mean([r.lang == r.lang_pred for r in own]) >= 0.95
    assert all(0 <= r.score <= 1 for r in found)


def test_language_of_odd_rows(spark):
    data = [(i, ["the cat and the dog of it"] [0] if i % 2 else "der Hund und die Katze ist", "en" if i % 2 else "de") for i in range(60)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    odd = [(1, None, 1), (2, "", 2), (3, "12 34 !?", 3), (None, "the dog", 4), (4, "the dog " * 20000, 5), (4, "die Katze", 6)]
    found = {r.score2: (r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame(odd, "doc_id long, text string, score2 long"), model, "doc_id", "score2").collect()}
    assert [found[k][0] for k in range(1, 7)] == ["und", "und", "und", "en", "en", "de"] and found[1][1] == 0
    assert langid.predict(docs, langid.fit(docs.limit(0), F.lit(True)), "doc_id").where("lang_pred = 'und'").count() == 60


def test_rare_languages_keep_their_rows(spark):
    sizes = {"en": 20000, "de": 20000, "fr": 20000, "es": 20000, "rare": 200}
    docs = spark.createDataFrame([(f"{k}{i}", f"{k} words {i}", k) for k, n in sizes.items() for i in range(n)] + [("twin", "twin words", "twin")] * 5000, "doc_id string, text string, lang string")
    langs, rows = langid.sample(docs, 1000)
    assert langs == sorted([*sizes, "twin"])
    # The language of one row, though repeated, gives it once; the others give the same number.
    assert {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()} == {k: 166 for k in sizes} | {"twin": 1}
    assert langid.dealt([10, 20, 5000, 5000], 1000) == 485 and langid.dealt([3, 4], 1000) == 4 and langid.dealt([9] * 50, 20) == 1


def test_rare_language_is_predicted(spark):
    words = {"aa": "alpha gamma lambda", "ee": "hello verge melee", "oo": "bonobo robot cocoon", "uu": "humus lupus muumuu", "yy": "gypsy syzygy pygmy"}
    docs = spark.createDataFrame([(f"{k}{i}", f"{w} {i}", k) for k, w in words.items() for i in range(40 if k == "yy" else 8000)], "doc_id string, text string, lang string")
    model = langid.fit(docs, F.lit(True), 500)
    assert {k: model.predict(w)[0] for k, w in words.items()} == {k: k for k in words}


def test_temperature_is_fitted():
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        y = i % 2
        where = np.unique(rng.integers(0, 50, 20) + 40 * (y if rng.random() < 0.9 else 1 - y))
        rows.append((where, np.ones(len(where), int), y))
    model = langid.train(rows, ["a", "b"], np.ones(langid.BUCKETS))
    kept = [x for i, x in enumerate(rows) if not i % langid.CALIBRATE]
    sure = np.mean([langid.softmax(model.logits(*x[:2]) / model.temperature).max() for x in kept])
    right = np.mean([model.logits(*x[:2]).argmax() == x[2] for x in kept])
    assert abs(sure - right) < 0.12


def plain(odds, reset, step, start):
    """Marginals of one chain at a time by the textbook recursion."""
    out, begin = np.zeros(len(odds)), np.flatnonzero(reset).tolist() + [len(odds)]
    for a, b in zip(begin, begin[1:]):
        ahead, behind = np.zeros((b - a, 2)), np.ones((b - a, 2))
        for i in range(a, b):
            v = start if i == a else ahead[i - a - 1] @ step
            ahead[i - a] = v * [1, odds[i]] / (v * [1, odds[i]]).sum()
        for i in range(b - 2, a - 1, -1):
            v = step @ (behind[i - a + 1] * [1, odds[i + 1]])
            behind[i - a] = v / v.sum()
        both = ahead * behind
        out[a:b] = both[:, 1] / both.sum(1)
    return out


def test_marginals_are_exact():
    rng = np.random.default_rng(1)
    score, reset = rng.normal(size=700) * 3, rng.random(700) < 0.02
    reset[0] = True
    model = toxicity.Field(step=rng.normal(size=(2, 2)), start=rng.normal(size=2))
    want = plain(np.exp(score), reset, np.exp(model.step), np.exp(model.start))
    assert np.allclose(model.marginals(score, reset), want, atol=1e-10)


def made(n, seed):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    rows = []
    for i in range(n):
        words = [word() for _ in range(int(rng.integers(5, 60)))]
        toxic = int(i % 4 == 0)
        for _ in range(3 * toxic):
            words.insert(int(rng.integers(0, len(words))), str(rng.choice(["idiot", "moron", "trashheap"])))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxic_documents_and_spans(spark):
    rows = made(600, 3)
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, ~toxicity.held_out())
    odd = [(9000, "Ä plain idiot, moron!"), (9001, None), (9002, ""), (None, "abcde"), (9003, "abcde " * 30000 + "idiot moron trashheap")]
    table = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("score", F.lit(1))
    found = {r.doc_id: r for r in toxicity.score(table, model, "doc_id").withColumn("held", toxicity.held_out()).collect()}
    own = [(found[i].score >= 0.7, y == 1) for i, _, y in rows if found[i].held]
    assert np.mean([a == b for a, b in own]) > 0.97
    spans = [odd[0][1][s.start : s.end] for s in found[9000].spans]
    assert spans == ["idiot", "moron"]
    assert found[9001].score == found[9002].score < 0.3 and found[9001].spans == []
    assert len(found[9003].spans) == 3 and odd[4][1][found[9003].spans[-1].start :] == "trashheap"
    assert toxicity.score(table.limit(0), model, "doc_id").count() == 0


def test_repeated_ids_are_learned_once(spark):
    docs = spark.createDataFrame([(1, f"idiot {i}") for i in range(500)] + [(2, "clean words"), (2, "clean words"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.sampled(docs, labels, F.lit(True)).collect()
    assert sorted((r.toxic, r.text) for r in rows) == [(0, "clean words"), (1, "idiot 0")]
    assert toxicity.fit(docs, labels.where("toxic = 1"), F.lit(True)).layer.tolist() == toxicity.Field().layer.tolist()


def test_shards_of_any_number_learn_the_same_words(spark):
    rows = made(400, 5)
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    sample = toxicity.sampled(docs, labels, F.lit(True))
    marked = toxicity.marked_features(sample)
    words = np.frombuffer(b"idiot abcde moron", np.uint8)
    x, *_ = toxicity.tokens(words, np.array([0, len(words)]))
    for shards in (1, 3):
        weights = toxicity.train_field(sample, marked, shards).weights[x].sum(1)
        assert weights[0] > 1 > weights[1] and weights[2] > 1


def test_held_out_toxicity_of_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null")
    found = toxicity.op10_toxicity(spark, sf).join(truth, "doc_id").where("held_out").collect()
    score, toxic = np.array([r.score for r in found]), np.array([r.toxic for r in found]) > 0
    above = (score[toxic][:, None] > score[~toxic][None]) + 0.5 * (score[toxic][:, None] == score[~toxic][None])
    assert above.mean() > 0.85
    assert np.mean([r.predicted for r in found if not r.toxic]) < 0.05
    assert all((r.score >= 0.7) == (r.predicted == 1) for r in found)
