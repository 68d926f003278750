import threading

import pytest
from pyspark.sql import functions as F

from gleaner.operators import adjudication, folding, judging
from gleaner.sources import stores

AT = "2024-05-06 07:08:09"
FINDING = "rule string, severity string, file string, line int, code string, message string, suggestion string, seq long"
STEPS = "rule_id string, pattern_hash string, ord long, decision string, fixed boolean, value double, seen int, tag string"
ANSWER = '{"verdict": "advisory", "reasoning": "so", "confidence": 0.8, "precedent_decision": "allow", "precedent_rationale": "tolerable"}'


def some_findings(spark, n):
    rows = [(f"r{k}", "error", f"f{k // 4}", 1 + k % 4, "x " * (k + 1), "m", "s", k) for k in range(n)]
    return spark.createDataFrame(rows, FINDING)


def no_decisions(spark):
    return spark.createDataFrame([], "rule_id string, pattern_hash string, decision string, rationale string, confidence double, seen_count int, created_at timestamp, ord long")


def asking(log, price):
    """A judge that notes each call in a file of its own and takes ``price(rule number)`` USD."""

    def ask(batch):
        k = int(batch["rule"][1:])
        with open(f"{log}/{k}", "a") as f:
            f.write("x")
        return ANSWER, round(price(k) * 1e6 / 0.8), 0

    return ask


def made(log):
    return {int(p.name): len(p.read_text()) for p in log.iterdir()}


def test_no_call_is_made_once_the_budget_is_spent(spark, tmp_path):
    out = judging.judged(some_findings(spark, 8), no_decisions(spark), judging.asked(asking(tmp_path, lambda k: 0.8)), budget=0.5, strict=False)
    assert {r.rule: (r.by, r.asked) for r in out.collect()} == {f"r{k}": ("llm", True) if k == 0 else (None, False) for k in range(8)}
    out.count()  # a second look asks nothing
    assert made(tmp_path) == {0: 1}


@pytest.mark.parametrize(("budget", "want"), [(0.35, 4), (0.3, 3), (100.0, 8), (0.0, 8)])
def test_as_many_calls_as_one_after_the_other(spark, tmp_path, budget, want):
    out = judging.judged(some_findings(spark, 8), no_decisions(spark), judging.asked(asking(tmp_path, lambda k: 0.1)), budget=budget, strict=False)
    assert {r.rule for r in out.collect() if r.by == "llm"} == {f"r{k}" for k in range(want)}
    assert made(tmp_path) == dict.fromkeys(range(want), 1)


def test_a_known_price_bound_allows_no_call_too_many(spark, tmp_path):
    price = lambda k: 0.01 if k < 3 else 0.4
    for name, dearest in (("known", 0.4), ("learned", 0.0)):
        (log := tmp_path / name).mkdir()
        out = judging.judged(some_findings(spark, 12), no_decisions(spark), judging.asked(asking(log, price)), budget=0.5, strict=False, dearest=dearest)
        assert {r.rule for r in out.collect() if r.by == "llm"} == {f"r{k}" for k in range(5)}
        assert set(made(log)) >= set(range(5)) and set(made(log).values()) == {1}
        assert dearest == 0 or len(made(log)) == 5


def test_a_judge_that_is_away_or_wrong(spark):
    def ask(batch):
        if batch["rule"] == "r1":
            raise TimeoutError("slow")
        return ("no object" if batch["rule"] == "r2" else ANSWER), 1000, 0

    out = judging.judged(some_findings(spark, 4), no_decisions(spark), judging.asked(ask), budget=1.0, strict=False)
    assert {r.rule: (r.by, r.problem) for r in out.collect()} == {"r0": ("llm", None), "r1": (None, "unavailable: slow"), "r2": (None, "no json object"), "r3": ("llm", None)}
    counts = judging.verdict_counts(out).first()
    assert (counts.llm_calls, counts.failed_calls, counts.tokens_in) == (2, 2, 2000)

    def broken(batch):
        raise KeyError("a fault of the judge")

    with pytest.raises(Exception, match="a fault of the judge"):
        judging.judged(some_findings(spark, 2), no_decisions(spark), judging.asked(broken), budget=1.0, strict=False).collect()


@pytest.mark.parametrize(("text", "want"), [('a {"x": "}"} b', '{"x": "}"}'), ("{ {} ", None), ("none", None), ('{"never } ends', None), ('{"a\\', None), ('{"a } \\', None), ("} {1}", "{1}"), ('{"q\\"}": {}} {}', '{"q\\"}": {}}'), (None, None)])
def test_first_object_of_a_text(text, want):
    assert judging.json_object(text) == want


def fold(rows):
    """The states one after the other, as a plain loop."""
    state, out = {}, []
    for rule, pattern, _, decision, fixed, value, seen, tag in sorted(rows, key=lambda r: (r[0] or "", r[1] or "", -1 if r[2] is None else r[2], r[3], r[5])):
        d, c, n = state.get((rule, pattern), (None, None, 0))
        if fixed:
            c, n = value, seen
        elif d is None:
            c, n = (min(1.0, value) if value and value > 0 else 0.6), 1
        elif d == decision:
            c, n = min(1.0, c + 0.1), n + 1
        else:
            c, n = max(0.2, c / 2), 1
        state[rule, pattern] = decision, c, n
        out.append((rule, pattern, tag, decision, round(c, 9), n))
    return sorted(out, key=repr), sorted(((*k, d, round(c, 9), n) for k, (d, c, n) in state.items()), key=repr)


def histories(seed, n, patterns):
    import random

    r = random.Random(seed)
    rows = [("r", f"p{min(int(r.expovariate(0.5)), patterns)}", k, r.choice(["allow", "allow", "allow", "deny"]), False, r.choice([0.0, 0.3, 0.9, 1.7]), 0, f"t{k}") for k in range(n)]
    return rows + [("r", f"p{k}", None, r.choice(["allow", "deny"]), True, 0.05 + k / 20, 3, "start") for k in range(0, patterns, 2)]


def test_parts_of_a_history_fold_like_the_whole(spark):
    rows = histories(1, 3000, 9) + [("s", "one", k, "allow" if k % 7 else "deny", False, 0.5, 0, f"u{k}") for k in range(2000)] + [(None, "p", 1, "deny", False, 0.5, 0, "x"), (None, "p", 2, "deny", False, 0.5, 0, "y")]
    df = spark.createDataFrame(rows, STEPS)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        every, last = fold(rows)
        table = folding.prefixes(df, False)
        assert table.where("rule_id = 's'").select("block").distinct().count() > 2  # one history in several tasks
        got = folding.states(df).select("rule_id", "pattern_hash", "tag", "decision", F.round("after_confidence", 9), "after_seen")
        assert sorted(map(tuple, got.collect()), key=repr) == every
        got = folding.states(df, last_only=True).select("rule_id", "pattern_hash", "decision", F.round("after_confidence", 9), "after_seen")
        assert sorted(map(tuple, got.collect()), key=repr) == last
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_folding_nothing(spark):
    assert folding.states(spark.createDataFrame([], STEPS)).collect() == []


def test_a_million_decisions_on_one_pattern(spark):
    rows = spark.range(1_000_000).select(F.lit("r").alias("rule_id"), F.lit("p").alias("pattern_hash"), F.col("id").alias("ord"), F.when(F.col("id") % 1000 == 0, "deny").otherwise("allow").alias("decision"), F.lit(0.9).alias("confidence"))
    r = adjudication.folded_confidence(rows).collect()
    assert [(x.decision, x.confidence, x.seen_count) for x in r] == [("allow", 1.0, 999)]


def decisions(spark, rows):
    full = [(r, "v", p, d, "because", c, 1, AT, AT, k) for k, (r, p, d, c) in enumerate(rows)]
    columns = "rule_id string, violation_hash string, pattern_hash string, decision string, rationale string, confidence double, seen_count int, created_at string, last_seen string, ord long"
    return spark.createDataFrame(full, columns).withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "last_seen")})


def test_writers_at_the_same_time_follow_each_other(spark, tmp_path):
    path = str(tmp_path / "store")

    def write(k):
        for i in range(3):
            stores.append(decisions(spark, [("r", f"p{k}", "allow", 0.5), ("r", f"p{k}", "deny", 0.5)]), path, "precedents", f"{k}-{i}")

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = stores.read(spark, path, "precedents").collect()
    assert sorted(r.ord for r in rows) == [*range(24)] and stores.version(path).number == 12
    for r in rows:  # a batch's rows stay together, in their order
        assert r.decision == ("allow" if r.ord % 2 == 0 else "deny")


def test_a_batch_is_added_once_and_unfinished_writes_are_not_seen(spark, tmp_path):
    path, rows = str(tmp_path / "store"), decisions(spark, [("r", "p", "allow", 0.5)])
    assert stores.append(rows, path, "precedents", "run-1") and not stores.append(rows, path, "precedents", "run-1")
    stores._written(rows, path, "precedents")  # a writer that died before its commit
    assert stores.read(spark, path, "precedents").count() == 1
    old = stores.version(path)
    assert stores.append(rows, path, "precedents", "run-2") and stores.compact(spark, path, "precedents")
    assert len(stores.version(path).parts) == 1 and not stores.append(rows, path, "precedents", "run-1")
    assert [r.ord for r in stores.read(spark, path, "precedents").orderBy("ord").collect()] == [0, 1]
    assert stores.read(spark, path, "precedents", old).count() == 1  # a reader of the version before is not disturbed


def test_an_upsert_starts_anew_when_another_commit_comes_between(spark, tmp_path):
    path, looks = str(tmp_path / "store"), []

    def make(existing):
        looks.append(existing.count())
        if len(looks) == 1:
            stores.append(decisions(spark, [("r", "p", "allow", 0.6)]), path, "precedents")
        return stores.with_judgments(existing, decisions(spark, [("r", "p", "allow", 0.0)]))

    assert stores.upsert(spark, path, "precedents", make, "once") and looks == [0, 1]
    assert [(r.ord, r.confidence, r.seen_count) for r in stores.read(spark, path, "precedents").orderBy("ord").collect()] == [(0, 0.6, 1), (1, 0.7, 2)]
    assert not stores.upsert(spark, path, "precedents", make, "once") and looks == [0, 1]


def test_laws_are_overwritten_only_by_laws(spark, tmp_path):
    path = str(tmp_path / "laws")
    law = lambda p: spark.createDataFrame([("r", p, "allow", 5, 3, AT, AT, 0)], "rule_id string, pattern_hash string, decision string, count int, threshold int, first_seen string, last_seen string, ord long").withColumns({c: F.col(c).cast("timestamp") for c in ("first_seen", "last_seen")})
    assert stores.replace(law("p"), path, "laws") and not stores.replace(law("q").limit(0), path, "laws")
    assert [r.pattern_hash for r in stores.read(spark, path, "laws").collect()] == ["p"]
    assert stores.replace(law("q"), path, "laws")
    assert [r.pattern_hash for r in stores.read(spark, path, "laws").collect()] == ["q"]


def test_proposals_as_a_document(spark):
    import io

    from gleaner.operators import catalogue

    rows = spark.createDataFrame([("rust.panic-in-lib", "p", "allow", 9, AT, AT), ("own", "q", "deny", 12, AT, AT)], "rule_id string, pattern_hash string, decision string, n long, first_seen string, last_seen string").withColumns({c: F.col(c).cast("timestamp") for c in ("first_seen", "last_seen")})
    sections = judging.proposals(rows, catalogue.rules(spark), 5)
    out, none = io.StringIO(), io.StringIO()
    assert judging.write_proposals(sections, out, "2024-01-01T00:00:00Z") == 2 and judging.write_proposals(sections.limit(0), none, "2024-01-01T00:00:00Z") == 0
    text = out.getvalue()
    assert text.startswith("# Law Update Proposals\n\n_Generated: 2024-01-01T00:00:00Z_\n\n## Proposal 1: `own`\n\n- Current rule: (rule description unavailable)\n- Pattern hash: `q`\n") and "## Proposal 2: `rust.panic-in-lib`" in text
    assert none.getvalue().endswith("No proposal candidates.\n")
