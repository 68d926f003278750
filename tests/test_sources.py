import subprocess

import pytest
from pyspark.sql import functions as F

from gleaner.operators import adjudication, catalogue, findings, judging, reports
from gleaner.plans.scan import scan
from gleaner.sources import changes, config, stores
from gleaner.sources.files import list_tree, read_events, read_tree, with_contents
from gleaner.streaming.watch import debounced, watch

AT = "2024-05-06 07:08:09"


def test_settings_from_a_file(tmp_path):
    assert config.load(str(tmp_path)) == config.Config()
    (tmp_path / config.NAME).write_text('[scan]\nexclude_dirs = ["gen"]\nexclude_patterns = ["*_pb.go"]\n[scan.languages]\nbash = false\n[rules]\ndisable = ["a.b"]\n[rules.severity]\n"c.d" = "info"\n')
    own = config.load(str(tmp_path))
    assert (own.exclude_dirs, own.exclude_patterns, own.languages, own.disable, own.severity) == (["gen"], ["*_pb.go"], {"bash": False}, ["a.b"], {"c.d": "info"})
    with pytest.raises(FileNotFoundError):
        config.load(str(tmp_path), str(tmp_path / "absent.toml"))
    (tmp_path / "bad.toml").write_text('[scan]\nexclude_patterns = ["[a"]\n')
    with pytest.raises(ValueError):
        config.load(str(tmp_path), str(tmp_path / "bad.toml"))


def test_names_of_languages():
    assert config.languages(" JS, ts,shell ,js") == ["javascript", "typescript", "bash"]
    assert config.only("py") == {"go": False, "javascript": False, "typescript": False, "python": True, "bash": False}
    for wrong in ("cobol", " , "):
        with pytest.raises(ValueError):
            config.languages(wrong)


@pytest.mark.parametrize(("pattern", "hits", "misses"), [("*.min.js", ["a.min.js", ".min.js"], ["a.minxjs", "a/b.min.js"]), ("f[^a-c]?", ["fdx"], ["fax", "fd"]), ("a\\*b", ["a*b"], ["axb"]), ("[[]x", ["[x"], ["x"])])
def test_name_patterns(pattern, hits, misses):
    assert [config.fits(x, [pattern]) for x in hits + misses] == [True] * len(hits) + [False] * len(misses)


def test_a_tree_with_own_excludes_and_a_single_file(spark, tmp_path):
    for name in ("src/a.py", "src/a_gen.py", "gen/b.py", "notes.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    found = lambda *a: sorted(r.path.removeprefix(f"{tmp_path}/") for r in read_tree(spark, *a).collect())
    assert found(str(tmp_path), "gen", "*_gen.py") == ["src/a.py"]
    assert found(str(tmp_path)) == ["gen/b.py", "src/a.py", "src/a_gen.py"]
    assert found(str(tmp_path / "notes.txt")) == ["notes.txt"]


def test_changes_of_a_repository(spark, tmp_path):
    def git(*args):
        subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *args], cwd=tmp_path, check=True, capture_output=True)

    git("init", "-q")
    (tmp_path / "a.py").write_text("one\ntwo\nthree\n")
    (tmp_path / "gone.py").write_text("x\n")
    git("add", ".")
    git("commit", "-qm", "first")
    with pytest.raises(ValueError):
        changes.diff_base(str(tmp_path), {})
    (tmp_path / "a.py").write_text("one\n2\nthree\nfour\nfive\n")
    (tmp_path / "b.py").write_text("new\n")
    git("rm", "-q", "gone.py")
    git("add", ".")
    git("commit", "-qm", "second")
    base = changes.diff_base(str(tmp_path), {"GITHUB_BASE_REF": "absent", "GITHUB_EVENT_BEFORE": "0000"})
    assert base == "HEAD~1...HEAD"
    assert sorted(r.path for r in changes.changed_files(spark, str(tmp_path), base).collect()) == ["a.py", "b.py"]
    assert sorted((r.file, r.line) for r in changes.changed_lines(spark, str(tmp_path), base).collect()) == [("a.py", 2), ("a.py", 4), ("a.py", 5), ("b.py", 1)]
    (tmp_path / "testdata").mkdir()
    (tmp_path / "testdata" / "c.py").write_text("x\n")
    (tmp_path / "d.py").write_text("x\n")
    git("add", ".")
    assert [r.path for r in changes.staged_files(spark, str(tmp_path)).collect()] == ["d.py"]


def decisions(spark, rows):
    full = [(r, "v", p, d, "because", c, 1, AT, AT, k) for k, (r, p, d, c) in enumerate(rows)]
    columns = "rule_id string, violation_hash string, pattern_hash string, decision string, rationale string, confidence double, seen_count int, created_at string, last_seen string, ord long"
    return spark.createDataFrame(full, columns).withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "last_seen")})


def test_stores_are_read_checked_and_appended(spark, tmp_path):
    path = str(tmp_path / "precedents")
    assert stores.read(spark, path, "precedents").count() == 0 and stores.read(spark, str(tmp_path / "none.json"), "debt").count() == 0
    first = decisions(spark, [("r", "p", "allow", 0.6), ("r", "q", "deny", 0.9)])
    stores.append(first, path, "precedents")
    more = decisions(spark, [("r", "p", "allow", 0.0), ("r", "p", "deny", 0.0), ("r", "n", "deny", 0.0)])
    stores.append(stores.with_judgments(stores.read(spark, path, "precedents"), more), path, "precedents")
    rows = stores.read(spark, path, "precedents").orderBy("ord").collect()
    assert [(r.ord, r.pattern_hash, r.decision, round(r.confidence, 6), r.seen_count) for r in rows] == [(0, "p", "allow", 0.6, 1), (1, "q", "deny", 0.9, 1), (2, "p", "allow", 0.7, 2), (3, "p", "deny", 0.35, 1), (4, "n", "deny", 0.6, 1)]
    with pytest.raises(Exception, match="decision must be"):
        stores.append(decisions(spark, [("r", "p", "maybe", 0.5)]), path, "precedents")
    array = tmp_path / "debt.json"
    array.write_text('[{"rule_id": "r", "file": "f", "line": 3, "code": "c", "message": "m", "reasoning": "why", "created_at": "2024-01-01T00:00:00Z"}, {"rule_id": "s", "file": "f", "line": 1, "code": "", "message": "", "reasoning": "x", "created_at": "2024-01-01T00:00:00Z"}]')
    assert [(r.rule_id, r.line) for r in stores.read(spark, str(array), "debt").orderBy("ord").collect()] == [("r", 3), ("s", 1)]
    array.write_text('[{"rule_id": "r", "file": "f", "line": 0, "reasoning": "why", "created_at": "2024-01-01T00:00:00Z"}]')
    with pytest.raises(Exception, match="line must be above 0"):
        stores.read(spark, str(array), "debt").count()
    array.write_text("")
    assert stores.read(spark, str(array), "debt").count() == 0


def some_findings(spark, rows):
    return spark.createDataFrame([(r, s, f, n, c, "m", "s", k) for k, (r, s, f, n, c) in enumerate(rows)], "rule string, severity string, file string, line int, code string, message string, suggestion string, seq long")


def test_reports_round_trip(spark, tmp_path):
    rows = some_findings(spark, [("a.b", "info", "f", 2, 'x "y"'), ("c.d", "error", "g", 1, " z\t"), ("c.e", "error", "f", 9, "é" * 80)])
    path = tmp_path / "report.json"
    with open(path, "w", encoding="utf-8") as out:
        total = reports.write_json(rows, out, "src", 7, "2024-01-01T00:00:00Z", 12)
    assert (total["total"], total["errors"], total["info"], total["files_scanned"]) == (3, 2, 1, 7)
    back = reports.read_json(spark, str(path)).orderBy("seq").collect()
    assert [(r.rule, r.file, r.line, r.code, r.context) for r in back] == [("c.e", "f", 9, "é" * 80, None), ("c.d", "g", 1, " z\t", None), ("a.b", "f", 2, 'x "y"', None)]
    said = []
    reports.write_text(rows, said.append, 7, 12)
    assert said[0] == "ERROR   c.e\n  f:9\n  > " + "é" * 60 + "…\n  m\n  → s\n" and said[-2:] == ["Summary: 2 errors, 0 warnings, 1 info (7 files scanned in 12ms)", "Categories: c 2, a 1"]
    (tmp_path / "empty.json").write_text('{"version": "1", "findings": null}')
    assert reports.read_json(spark, str(tmp_path / "empty.json")).count() == 0


def test_a_judge_is_asked_only_where_no_precedent_is_sure(spark):
    rows = some_findings(spark, [("r.a", "error", "f", 1, "x(1)"), ("r.a", "error", "f", 2, "y(2)"), ("r.b", "error", "f", 3, "z"), ("r.c", "info", "f", 4, "if q")])
    hashes = {r.rule: r.pattern_hash for r in adjudication.pattern_batches(rows).collect()}
    past = decisions(spark, [("r.b", hashes["r.b"], "allow", 0.95), ("r.c", hashes["r.c"], "deny", 0.5)])

    def ask(batch):
        if batch["rule"] == "r.c":
            raise OSError("no route")
        return 'Well: {"verdict": "advisory", "reasoning": "so {it} is", "confidence": 0.8, "precedent_decision": "allow", "precedent_rationale": "tolerable"} end', 1000, 50

    verdicts = judging.judged(rows, past, judging.asked(ask))
    assert {r.rule: (r.verdict, r.by, r.items) for r in verdicts.collect()} == {"r.a": ("advisory", "llm", 2), "r.b": ("not_guilty", "auto", 1), "r.c": ("guilty", "fallback", 1)}
    counts = judging.verdict_counts(verdicts).first()
    assert (counts.total, counts.advisory, counts.guilty, counts.not_guilty, counts.llm_calls, counts.tokens_in, counts.cost) == (4, 2, 1, 1, 1, 1000, 0.001)
    dealt = judging.dealt_out(rows, verdicts)
    assert sorted((r.file, r.line) for r in judging.debts(dealt, F.lit(AT).cast("timestamp")).collect()) == [("f", 1), ("f", 2)]
    kept = stores.checked(judging.decisions(dealt, F.lit(AT).cast("timestamp")), "precedents")
    assert kept.count() == 4
    assert findings.not_allowed(rows, kept).select("rule").distinct().collect() == [("r.c",)]
    with pytest.raises(Exception, match="no verdict and no precedent"):
        judging.judged(rows, past.limit(0), judging.asked(ask)).collect()


def test_paths_of_decisions_count_from_the_root(spark):
    rows = some_findings(spark, [("r.a", "error", "/repo/src/./x.py", 1, "x")])
    dealt = rows.withColumns({"pattern_hash": F.lit("p"), "precedent_decision": F.lit("allow"), "precedent_rationale": F.lit("w"), "confidence": F.lit(0.9)})
    kept = judging.decisions(dealt, F.lit(AT).cast("timestamp"), "/repo")
    assert findings.not_allowed(rows, kept).count() == 1 and findings.not_allowed(rows, kept, "/repo").count() == 0
    assert findings.not_allowed(some_findings(spark, [("r.a", "error", "src/x.py", 1, "x")]), kept).count() == 0


def test_senate_rulings_apply_once(spark):
    ok = '{"id": "v1", "status": "approved", "amendments": [{"rule_id": "r", "action": "set_severity", "severity": "info"}, {"rule_id": "s", "action": "disable_rule"}, {"rule_id": "s", "action": "disable_rule"}]}'
    texts = [ok, f"text\n```json\n{ok.replace('v1', 'v2')}\n```", "", "nothing", '{"id": "v3", "status": "approved"}', '{"id": "v4", "status": "approved", "amendments": [{"rule_id": "r", "action": "set_severity", "severity": "fatal"}]}', '{"id": "v5", "status": "rejected"}']
    read = judging.senate_verdicts(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert {r.id: r.problem for r in read.where("id is not null").collect()} == {"v1": None, "v2": None, "v3": "an approved verdict needs amendments", "v4": "set_severity requires error, warning or info", "v5": None}
    proposed = judging.approved_amendments(read)
    assert proposed.count() == 6
    fresh = adjudication.new_amendments(proposed, proposed.limit(0))
    assert sorted((r.verdict_id, r.rule_id) for r in fresh.collect()) == [("v1", "r"), ("v1", "s"), ("v2", "r"), ("v2", "s")]
    assert adjudication.new_amendments(proposed, fresh).count() == 0


def test_the_catalogue_has_every_rule_once(spark):
    rows = catalogue.rules(spark).collect()
    assert len(rows) == len({r.id for r in rows}) == 104 and all(r.file_types for r in rows)


def eventually(test, seconds=60):
    import time

    end = time.monotonic() + seconds
    while time.monotonic() < end:
        if test():
            return True
        time.sleep(0.2)
    return False


def test_watching_a_folder(spark, tmp_path):
    folder, seen = tmp_path / "src", []
    folder.mkdir()
    (folder / "a.js").write_text("eval(x)\nok()\n")
    (folder / "a.py").write_text("eval(x)\n")
    query, session = watch(read_events(spark, str(folder), str(tmp_path / "log")), str(tmp_path / "ckpt"), lambda df: seen.append(sorted((r.file[-4:], r.rule.partition(".")[2], r.line) for r in df.collect())), quiet_ms=1500)
    try:
        assert eventually(lambda: query.lastProgress is not None)
        assert seen == [] and session.exit_code == 0  # what was there before is no event
        for k in range(4):  # a burst: the last content counts, once
            (folder / "b.js").write_text("eval(x)\n" * k + "ok()\n")
        assert eventually(lambda: seen) and seen == [[("b.js", "eval-usage", k) for k in (1, 2, 3)]] and session.exit_code == 1
        (folder / "b.js").write_text("eval(x)\n" * 3 + "ok()\nconsole.log(1)\n")
        assert eventually(lambda: len(seen) == 2) and seen[-1] == [("b.js", "console-log-in-production", 5)]
    finally:
        query.stop()


def test_events_go_on_where_the_stream_ended(spark, tmp_path):
    folder, out = tmp_path / "src", tmp_path / "out"
    folder.mkdir()
    for k in range(3):
        (folder / f"old{k}.js").write_text("old")

    def run():
        events = read_events(spark, str(folder), str(tmp_path / "log"))
        events.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ckpt")).trigger(once=True).start(str(out)).awaitTermination(60)
        return sorted((r.path.rpartition("/")[2], r.content) for r in spark.read.schema("path string, ts timestamp, content string").parquet(str(out)).collect()) if out.exists() else []

    assert run() == []
    (folder / "a.js").write_text("1")
    (folder / "skip.txt").write_text("x")
    assert run() == [("a.js", "1")]
    (folder / "old1.js").write_text("again")  # written while the stream is off
    (folder / "old2.js").unlink()
    assert run() == [("a.js", "1"), ("old1.js", "again")]
    (folder / "old2.js").write_text("back")
    assert run() == [("a.js", "1"), ("old1.js", "again"), ("old2.js", "back")]
    assert run() == [("a.js", "1"), ("old1.js", "again"), ("old2.js", "back")]


def test_the_event_log_becomes_one_file_and_keeps_open_entries(tmp_path, monkeypatch):
    from gleaner.sources import files

    monkeypatch.setattr(files, "KEPT_LOGS", 3)
    folder = tmp_path / "src"
    folder.mkdir()
    options = {"path": str(folder), "log": str(tmp_path / "log"), "files_per_partition": "2"}
    reader = files.EventReader(options)
    start = reader.initialOffset()
    for k in range(5):
        (folder / f"f{k}.js").write_text(str(k))
        end = reader.latestOffset()
    assert len(reader.partitions(start, end)) == 3
    reader.commit({"at": 3})
    again = files.EventReader(options)
    assert len(list((tmp_path / "log").iterdir())) == 1 and again.latestOffset() == end
    assert [c for p in again.partitions({"at": 3}, end) for _, _, c in again.read(p)] == ["3", "4"]


def test_filters_keep_files_closed(spark, tmp_path):
    for name in ("a.py", "b.py", "c.go", ".env"):
        (tmp_path / name).write_text("x\n")
    (tmp_path / "bad.js").symlink_to(tmp_path / "nowhere")  # opening it fails
    read = lambda: read_tree(spark, str(tmp_path))
    name = lambda df: sorted(r.path.rpartition("/")[2] for r in df.collect())
    with pytest.raises(Exception, match="nowhere|bad.js"):
        read().collect()
    assert name(read().where("ext = '.py'")) == ["a.py", "b.py"]
    assert name(read().where(F.col("ext").isin(".go", ".env"))) == [".env", "c.go"]
    assert name(read().where("ext <> '.js' and not endswith(path, 'a.py')")) == [".env", "b.py", "c.go"]
    assert name(config.of_languages(read(), {"javascript": False})) == [".env", "a.py", "b.py", "c.go"]
    assert name(list_tree(spark, str(tmp_path)).where("size < 1000 and mtime_ns > 0")) == [".env", "a.py", "b.py", "bad.js", "c.go"]
    assert {r.content for r in with_contents(list_tree(spark, str(tmp_path))).collect()} == {"x\n", None}


def test_a_second_scan_reads_only_what_was_written_since(spark, tmp_path):
    from gleaner.plans import memo

    root, folder = tmp_path / "src", str(tmp_path / "memo")
    root.mkdir()
    for k in range(5):
        (root / f"m{k}.py").write_text(f"print({k})\n")
    (root / "plain.py").write_text("x = 1\n")
    (root / ".env").write_text("A=1\n")

    def run(**how):
        read = []

        def contents(listing):
            read.extend(r.path.rpartition("/")[2] for r in listing.collect())
            return with_contents(listing)

        out = memo.memo_scan(list_tree(spark, str(root)), folder, contents, **how)
        found = sorted((r.file.rpartition("/")[2], r.rule.partition(".")[2], r.line) for r in out.collect())
        return [x for x in read if x != ".env"], found

    whole = lambda: sorted((r.file.rpartition("/")[2], r.rule.partition(".")[2], r.line) for r in scan(read_tree(spark, str(root))).collect())
    read, found = run()
    assert sorted(read) == [f"m{k}.py" for k in range(5)] + ["plain.py"] and found == whole() and ("m1.py", "print-debug", 1) in found
    assert run() == ([], found)
    (root / "m1.py").write_text("y = 1\nprint(2)\n")
    (root / "m2.py").unlink()
    (root / ".env.example").write_text("A=\n")
    read, found = run()
    assert sorted(set(read)) == [".env.example", "m1.py"] and found == whole() and ("m1.py", "print-debug", 2) in found
    assert len(run(rules="another rule set")[0]) >= 5


def test_logs_have_whole_lines_only(spark, tmp_path):
    from gleaner.sources import json_log

    folder = str(tmp_path / "log")
    schema = "k int, name string, at timestamp, inner struct<a:int,b:string>"
    rows = spark.createDataFrame([(1, "é\n\"", None, (1, "x")), (2, None, None, None)], schema).withColumn("at", F.lit(AT).cast("timestamp"))
    assert json_log.read_log(spark, folder, schema).count() == 0
    json_log.append_log(rows, folder)
    json_log.append_log(rows.where("k = 2"), folder)
    json_log.append_log(rows.where("k = 3"), folder)
    got = json_log.read_log(spark, folder, schema).collect()
    assert sorted((r.k, r.name, r.inner and r.inner.b) for r in got) == [(1, "é\n\"", "x"), (2, None, None), (2, None, None)] and {str(r["at"]) for r in got} == {AT}
    fails = rows.repartition(2).withColumn("k", F.when(F.col("k") == 2, F.raise_error(F.lit("a lost task")).cast("int")).otherwise(F.col("k")))
    with pytest.raises(Exception, match="a lost task"):
        json_log.append_log(fails, folder)
    assert json_log.read_log(spark, folder, schema).count() == 3
    with pytest.raises(Exception, match="only ever appended"):
        rows.write.format("jsonl_log").mode("overwrite").save(folder)


def test_a_batch_of_a_stream_is_logged_once(tmp_path):
    from pyspark.sql import Row

    from gleaner import storage
    from gleaner.sources import json_log

    folder = str(tmp_path / "log")
    writer = json_log.LogStreamWriter(folder)
    batch = lambda *ks: [writer.write(iter([Row(k=k)])) for k in ks]
    lines = lambda: sorted(x for n in storage.names(folder) for x in storage.read_bytes(f"{folder}/{n}").decode().split())
    writer.commit(batch(1, 2), 0)
    writer.commit(batch(1, 2), 0)  # the query was restarted before it noted the commit
    assert len(storage.names(folder)) == 2 and storage.names(f"{folder}/_aside") == []
    writer.moved(batch(3, 4, 5), "batch-000000000001")  # a commit that was interrupted
    writer.commit([*batch(3, 4), writer.write(iter([]))], 1)
    assert len(lines()) == 8 and storage.names(f"{folder}/_commits") == ["batch-000000000000", "batch-000000000001"]
    writer.abort([*batch(9), None], 2)
    assert len(storage.names(folder)) == 4 and storage.names(f"{folder}/_aside") == []


def test_a_stream_appends_to_a_log(spark, tmp_path):
    from gleaner.sources import json_log

    source, folder = tmp_path / "in", str(tmp_path / "log")
    spark.dataSource.register(json_log.JsonLog)
    for k in range(2):
        spark.range(10 * k, 10 * k + 5).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("id long").parquet(str(source)).writeStream.format("jsonl_log").option("path", folder).option("checkpointLocation", str(tmp_path / "ckpt"))
        stream.trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(r.id for r in json_log.read_log(spark, folder, "id long").collect()) == [0, 1, 2, 3, 4, 10, 11, 12, 13, 14]


def test_times_do_not_depend_on_the_session_s_zone(spark):
    rows = spark.createDataFrame([(1_700_000_000_123_456,), (-1,), (4_102_444_800_000_000,)], "us long").select(F.timestamp_micros("us").alias("at"))
    try:
        for zone in ("UTC", "Asia/Kolkata", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert [r[0] for r in rows.select(reports.rfc3339(F.col("at"))).collect()] == ["2023-11-14T22:13:20Z", "1969-12-31T23:59:59Z", "2100-01-01T00:00:00Z"]
            bare = spark.sql("select timestamp_ntz '2024-03-10 02:30:59.9' as at")  # no local time of New York
            assert bare.select(reports.rfc3339(F.col("at"))).first()[0] == "2024-03-10T02:30:59Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_decisions_hold_in_another_checkout(spark):
    files = spark.createDataFrame([("/w/x/a.py", "print(1)\n")], "path string, content string")
    here = scan(spark.createDataFrame([("a.py", "print(1)\n")], "path string, content string"))
    kept = judging.decisions(here.withColumns({"pattern_hash": F.lit("p"), "precedent_decision": F.lit("allow"), "precedent_rationale": F.lit("w"), "confidence": F.lit(0.9)}), F.lit(AT).cast("timestamp"))
    assert scan(files, precedents=kept).count() == 1 and scan(files, precedents=kept, root="/w/x").count() == 0


def test_bursts_of_a_stream(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00.000", "1"), ("a", "2024-01-01 00:00:00.060", "2"), ("a", "2024-01-01 00:00:00.400", "3"), ("b", "2024-01-01 00:00:00.010", "x"), ("b", "2024-01-01 00:00:00.010", "y"), ("z", "2024-01-01 00:10:00", "late")]
    table = spark.createDataFrame(rows, "path string, ts string, content string").withColumn("ts", F.col("ts").cast("timestamp"))
    want = {("a", "2", 2), ("a", "3", 1), ("b", "y", 2)}
    assert {(r.path, r.content, r.events) for r in debounced(table).collect()} == want | {("z", "late", 1)}
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    query = debounced(stream).writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.path, r.content, r.events) for r in spark.table("bursts").collect()} == want


def test_scan_of_changed_lines_with_settings(spark):
    files = spark.createDataFrame([("a.py", "print(1)\nprint(2)\n"), ("b.sh", "echo ${X:-1}\n")], "path string, content string")
    changed = spark.createDataFrame([("a.py", 2), ("b.sh", 1)], "file string, line int")
    own = config.Config(disable=["bad-defaults.unvalidated-env-bash"], severity={"trace-gaps.print-debug": "error"})
    found = scan(files, own.disable, own.overrides(spark), changed=changed).collect()
    assert [(r.rule, r.severity, r.line) for r in found] == [("trace-gaps.print-debug", "error", 2)]


def test_a_memo_is_packed_and_forgets_what_could_not_be_read(spark, tmp_path):
    from gleaner.plans import memo

    listing = spark.createDataFrame([("a.txt", 1), ("b.txt", 1)], "path string, mtime_ns long")
    contents = spark.createDataFrame([("a.txt", 1, "flask"), ("b.txt", 1, None)], "path string, mtime_ns long, content string")
    rows = memo.remembered(listing, str(tmp_path), lambda x: x.join(contents, ["path", "mtime_ns"]), extensions=(".txt",))
    assert rows.columns == ["path", "mtime_ns", "findings", "fresh"] and rows.count() == 2
    parts = [*(tmp_path / "parts").rglob("*.parquet")]
    assert parts and all(".zstd." in p.name for p in parts)
    assert [r.path for r in spark.read.parquet(str(tmp_path / "parts")).collect()] == ["a.txt"]
