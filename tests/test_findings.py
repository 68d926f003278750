import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from gleaner import registry
from gleaner.operators import adjudication, findings
from gleaner.plans.scan import scan
from gleaner.sources.config import of_languages
from gleaner.streaming import watch

FINDING = "rule string, severity string, file string, line int, code string, message string, suggestion string, seq long"


def made(spark, rows):
    return spark.createDataFrame([(*r, "m", "s", i) for i, r in enumerate(rows)], FINDING)


def test_queries_equal_their_sql(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "events", "pages"):
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    for name, sql in registry.ORACLES.items():
        want = con.execute(sql)
        columns = [d[0] for d in want.description]
        got = registry.QUERIES[name](spark, sf_dir)
        assert sorted(got.columns) == sorted(columns), name
        assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall())), name


def test_algebra(spark):
    f = made(spark, [("a.x", "error", "f", 1, "c"), ("a.x", "warning", "f", 1, "d"), ("b.y", "info", "f", 2, "e"), ("a.x", "error", "g", 9, "h")])
    assert {(r.rule, r.file, r.line, r.severity) for r in findings.deduplicated(f).collect()} == {("a.x", "f", 1, "error"), ("b.y", "f", 2, "info"), ("a.x", "g", 9, "error")}
    assert [r.severity for r in findings.ordered(f).collect()] == ["error", "error", "warning", "info"]
    assert findings.on_changed_lines(f, None).count() == 4
    assert findings.on_changed_lines(f, spark.createDataFrame([("f", 2)], "file string, line int")).count() == 1
    assert findings.on_changed_lines(f, spark.createDataFrame([], "file string, line int")).count() == 0
    assert findings.has_errors(f) and not findings.has_errors(f.where("severity = 'info'"))
    assert [tuple(r) for r in findings.category_counts(f).collect()] == [("a", 3), ("b", 1)]


def test_scan_with_overrides_and_languages(spark):
    files = spark.createDataFrame([("a.py", "print(1)\nprint(2)\n"), ("b.rs", "let _ = f();\n")], "path string, content string")
    assert {(r.rule, r.line) for r in scan(files).collect()} == {("trace-gaps.print-debug", 1), ("trace-gaps.print-debug", 2), ("rust.ignored-result", 1)}
    changed = spark.createDataFrame([("a.py", 2)], "file string, line int")
    over = spark.createDataFrame([("trace-gaps.print-debug", "error")], "rule string, new_severity string")
    assert [(r.line, r.severity) for r in scan(files, overrides=over, changed=changed).collect()] == [(2, "error")]
    assert {r.path for r in of_languages(files, {"rust": False, "python": True}).collect()} == {"a.py"}


def test_confidence_grows_and_decays(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("r", "p", d, c, t, i) for i, (d, c) in enumerate([("allow", None), ("allow", None), ("allow", None), ("deny", None), ("deny", None)])]
    p = spark.createDataFrame(rows, "rule_id string, pattern_hash string, decision string, confidence double, created_at timestamp, ord long")
    r = adjudication.folded_confidence(p).first()
    assert (r.decision, r.confidence, r.seen_count) == ("deny", pytest.approx(0.5), 2)


def test_verdicts_need_a_sure_precedent(spark):
    f = made(spark, [("a.x", "error", "f", 1, "if err != nil { return 1 }"), ("a.x", "error", "g", 5, "if e != nil { return 22 }"), ("b", "info", "g", 5, "x")])
    batches = adjudication.pattern_batches(f)
    assert sorted(r["items"] for r in batches.collect()) == [1, 2]
    p = batches.where("rule = 'a.x'").select(F.col("rule").alias("rule_id"), "pattern_hash", F.lit("allow").alias("decision"), F.lit(0.95).alias("confidence"), F.lit(3).alias("seen_count"), F.current_timestamp().alias("created_at"), F.lit(1).cast("long").alias("ord"))
    out = {r.rule: r.verdict for r in adjudication.judged(batches, adjudication.matches(batches, p)).collect()}
    assert out == {"a.x": "not_guilty", "b": None}


def test_amendments_apply_once(spark):
    schema = "verdict_id string, rule_id string, action string, severity string, exception string"
    a = spark.createDataFrame([("v", "r", "disable_rule", None, None), ("v", "r", "disable_rule", None, None), ("w", "r", "enable_rule", None, None)], schema)
    assert [r.verdict_id for r in adjudication.new_amendments(a, a.where("verdict_id = 'v'")).collect()] == ["w"]


@pytest.mark.parametrize(("before", "after", "want"), [("a b c", "a x c", [2]), ("", "a b", [1, 2]), ("a b c", "a c", []), ("a b", "b a", [1]), ("a b c d", "x a b d y", [1, 5])])
def test_changed_lines(before, after, want):
    assert watch.changed_lines(before.split(), after.split()) == want


def plain_alignment(before, after):
    """The textbook table, walked from its end."""
    m, n = len(before), len(after)
    t = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m):
        for j in range(n):
            t[i + 1][j + 1] = t[i][j] + 1 if before[i] == after[j] else max(t[i][j + 1], t[i + 1][j])
    out, i, j = [], m, n
    while j:
        if i and before[i - 1] == after[j - 1]:
            i, j = i - 1, j - 1
        elif i and t[i - 1][j] >= t[i][j - 1]:
            i -= 1
        else:
            out.append(j)
            j -= 1
    return out[::-1]


@pytest.mark.parametrize("cells", [1, 8, 40, 1 << 26])
def test_alignment_in_halves_is_that_of_the_whole_table(monkeypatch, cells):
    import random

    monkeypatch.setattr(watch, "CELLS", cells)
    r = random.Random(cells)
    for _ in range(1500):
        letters = "abcdef"[: r.randint(1, 6)]
        before, after = r.choices(letters + "xy", k=r.randint(0, 16)), r.choices(letters, k=r.randint(0, 16))
        assert watch.changed_lines(before, after) == plain_alignment(before, after)


def test_changed_lines_as_a_stream(spark, tmp_path):
    schema = "path string, ts timestamp, content string"
    source, out, t = tmp_path / "in", tmp_path / "out", dt.datetime(2024, 1, 1)
    source.mkdir()
    events = watch.tracked(spark.readStream.schema(schema).json(str(source)))
    for k, content in enumerate(["a\nb\n", "a\nx\nb\n", "a\nx\nb\n"]):
        spark.createDataFrame([("f", t + dt.timedelta(seconds=k), content)], schema).coalesce(1).write.mode("append").json(str(source))
        events.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start(str(out)).awaitTermination()
    assert sorted((r.line, r.code) for r in spark.read.parquet(str(out)).collect()) == [(1, "a"), (2, "b"), (2, "x")]


def test_changed_lines_of_several_events_in_a_batch(spark, tmp_path):
    schema = "path string, ts timestamp, content string"
    source, out, t = tmp_path / "in", tmp_path / "out", dt.datetime(2024, 1, 1)
    source.mkdir()
    events = watch.tracked(spark.readStream.schema(schema).json(str(source)))
    saves = [["a\nb\nc\n", "a\nb\nx\n"], ["y\nb\nx\n", "y\nb\nz\n", "y\nb\nz\n"]]
    for k, batch in enumerate(saves):
        rows = [("f", t + dt.timedelta(seconds=10 * k + i), content) for i, content in enumerate(batch)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source))
        events.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start(str(out)).awaitTermination()
    found = sorted(((r.ts - t).seconds, r.line, r.code) for r in spark.read.parquet(str(out)).collect())
    assert found == [(0, 1, "a"), (0, 2, "b"), (0, 3, "c"), (1, 3, "x"), (10, 1, "y"), (11, 3, "z")]
