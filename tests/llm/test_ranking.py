import math
import random
import re
from collections import Counter

from gleaner.llm import ranking as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) | 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top=20):
    """Every document against every item."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        rows = []
        for d, c in counts:
            m = 100 - 25 + 25 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                rows.append((-score, d is None, d or 0, d))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(rows, key=lambda r: r[:3])[:top])]
    return sorted(out, key=repr)


def result(spark, docs, items, **how):
    a = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int").repartition(3)
    b = spark.createDataFrame([(*d, 1) for d in items], "item_id long, text string, rank int")
    return sorted(map(tuple, R.search(a, b, **how).collect()), key=repr)


def made(n, seed=0, words=60):
    r = random.Random(seed)
    names = [f"w{k}é" if k % 3 else f"W{k}" for k in range(words)]
    return [(i, " ".join(r.choices(names, weights=range(words, 0, -1), k=r.randint(1, 30)))) for i in range(n)]


def test_equals_scoring_every_document(spark):
    docs, items = made(500), [(k, t) for k, t in made(12, 1)]
    assert result(spark, docs, items, slots=64) == result(spark, docs, items) == plain(docs, items)


def test_windows_close_by_postings_and_items_by_terms(spark, monkeypatch):
    monkeypatch.setattr(R.passes, "__defaults__", (40,))
    docs, items = made(200, 2), made(9, 3)
    assert result(spark, docs, items, top=3, most=50) == plain(docs, items, 3)


def test_ties_copies_nulls_and_empty_texts(spark):
    same = [(k, "one two") for k in range(40, 0, -1)] + [(7, "one two"), (None, "one two"), (None, None), (3, ""), (4, "?!"), (5, None)]
    rest = made(60, 4)
    items = [(1, "two ONE one"), (1, "two"), (2, None), (3, ""), (None, "one"), (9, "absent")]
    assert result(spark, same + rest, items) == plain(same + rest, items)


def test_terms_keep_other_letters_and_very_long_texts_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(R, "PART", 10)
    texts = ["Ünder_score a1B2-C3\x00ÀÉ x", "a" * 100, "one two  three\tfour\x7ffive", "", "İstanbul K"]
    assert [[t.decode() for part in R.terms_of(x) for t in part] for x in texts] == [terms(x) for x in texts]


def test_empty_tables(spark):
    assert result(spark, [], made(2)) == [] and result(spark, made(5), []) == []


def test_common_words_of_weight_nought_give_no_row(spark):
    docs = [(k, "the") for k in range(600)] + [(1000, "the rare")]
    assert result(spark, docs, [(1, "the"), (2, "rare the")]) == plain(docs, [(1, "the"), (2, "rare the")])


def test_query_has_the_contract_s_columns(spark, sf_dir):
    assert R.op12_lexical_search(spark, sf_dir).dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
