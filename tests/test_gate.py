import pytest
from pyspark.sql import functions as F

from gleaner.operators import adjudication, judging
from gleaner.plans import gate
from gleaner.sources import stores

def at():
    return F.lit("2024-05-06 07:08:09").cast("timestamp")


FILES = [
    ("a.py", "password = 'hunter2hunter2'\n"),
    ("pkg/testdata/b.py", "password = 'hunter2hunter2'\n"),
    ("c.py", "import os\nx = 1\n"),
    ("d.sh", "#!/bin/bash\nset -euo pipefail\ntrap 'exit 1' ERR\necho hi\n"),
]


def files(spark):
    return spark.createDataFrame(FILES, "path string, content string")


def staged(spark, *paths):
    return spark.createDataFrame([(x,) for x in paths], "path string")


def answer(verdict):
    decision = "deny" if verdict == "guilty" else "allow"
    return lambda batch: (f'{{"verdict": "{verdict}", "reasoning": "so", "confidence": 0.8, "precedent_decision": "{decision}", "precedent_rationale": "why"}}', 100, 10)


def away():
    def ask(batch):
        raise TimeoutError("away")

    return ask


@pytest.mark.parametrize(("verdict", "code"), [("guilty", 1), ("advisory", 0), ("not_guilty", 0)])
def test_the_judge_decides_on_staged_files(spark, tmp_path, verdict, code):
    out = gate.hook_gate(files(spark), staged(spark, "a.py", "pkg/testdata/b.py", "c.py"), str(tmp_path), judging.asked(answer(verdict)), at(), batch="h", extensions=(".py",)).first()
    assert (out.by, out.code, out.unjudged) == ("judge", code, 0) and out.findings >= 1
    kept = stores.read(spark, f"{tmp_path}/precedents", "precedents").collect()
    assert len(kept) == out.findings and {r.decision for r in kept} == {"deny" if code else "allow"}
    assert stores.read(spark, f"{tmp_path}/debt", "debt").count() == (out.findings if verdict == "advisory" else 0)


def test_without_a_judge_errors_decide_and_nothing_is_stored(spark, tmp_path):
    out = gate.hook_gate(files(spark), staged(spark, "a.py"), str(tmp_path), judging.asked(away()), at(), extensions=(".py",)).first()
    assert (out.by, out.code) == ("scan", 1) and out.errors >= 1 and out.unjudged == out.findings
    assert stores.read(spark, f"{tmp_path}/precedents", "precedents").count() == 0


def test_nothing_staged_passes(spark, tmp_path):
    assert gate.in_index(files(spark), staged(spark, "pkg/testdata/b.py", "gone.py", "c.py", "c.py")).select("path").collect() == [("c.py",)]
    out = gate.hook_gate(files(spark), staged(spark, "gone.py", "pkg/testdata/b.py"), str(tmp_path), judging.asked(answer("guilty")), at(), extensions=(".py",)).first()
    assert (out.findings, out.code, out.by) == (0, 0, "judge")


FINDING = "rule string, severity string, file string, line int, code string, message string, suggestion string, seq long"


def test_gates_by_group_against_a_loop(spark):
    import random

    rng = random.Random(3)
    rows = [(f"r{rng.randrange(6)}", rng.choice(["error", "info"]), f"f{rng.randrange(9)}", k, "x " * (1 + rng.randrange(3)), "m", "s", k) for k in range(300)]
    found = spark.createDataFrame(rows, FINDING).withColumn("tree", F.substring("file", 2, 1))
    batches = judging.adjudication.pattern_batches(found).select("rule", "pattern_hash", "first.code")
    says = {(r.rule, r.code): (None, "guilty", "not_guilty", "advisory")[(k % 7) % 4] if k % 7 else None for k, r in enumerate(sorted(batches.collect()))}
    verdicts = batches.select("rule", "pattern_hash", F.create_map(*[x for (r, c), v in says.items() for x in (F.lit(f"{r}|{c}"), F.lit(v))])[F.concat_ws("|", "rule", "code")].alias("verdict"))
    for r in gate.gated(found, verdicts, "tree").collect():
        own = [x for x in rows if x[2][1] == r.tree]
        told = [says[x[0], x[4]] for x in own]
        errors, guilty, missing = sum(x[1] == "error" for x in own), told.count("guilty"), told.count(None)
        assert (r.findings, r.errors, r.guilty, r.unjudged) == (len(own), errors, guilty, missing)
        assert (r.by, r.code) == (("scan", int(errors > 0)) if missing else ("judge", int(guilty > 0)))


def test_a_warm_up_teaches_the_next_and_repeats_nothing(spark, tmp_path):
    rows = [("r", "error", f"f{k}", 1, "x", "m", "s", k) for k in range(12)]
    found = spark.createDataFrame(rows, FINDING)
    asked = judging.asked(answer("not_guilty"))
    for _ in range(2):  # the second is the first one repeated
        gate.warm_up(found, str(tmp_path), asked, at(), batch="one")
        kept = stores.read(spark, f"{tmp_path}/precedents", "precedents").orderBy("ord").collect()
        assert [round(r.confidence, 6) for r in kept] == [0.8, 0.9] + [1.0] * 10
        assert [r.seen_count for r in kept] == list(range(1, 13))
    (law,) = stores.read(spark, f"{tmp_path}/laws", "laws").collect()
    assert (law.rule_id, law.decision, law["count"], law.threshold) == ("r", "allow", 12, 10)
    (again,) = gate.warm_up(found, str(tmp_path), judging.asked(away()), at(), batch="two").collect()
    assert (again.by, again.verdict) == ("auto", "not_guilty")
    with pytest.raises(Exception, match="no verdict and no precedent"):
        gate.warm_up(found.withColumn("rule", F.lit("new")), str(tmp_path), judging.asked(away()), at(), batch="three")
    assert stores.read(spark, f"{tmp_path}/precedents", "precedents").count() == 24


def test_patterns_that_findings_carry_are_not_worked_out_again(spark):
    rows = spark.createDataFrame([("r", "error", "f", 1, "a b", "m", "s", 0, "p"), ("r", "error", "f", 2, "c", "m", "s", 1, "p")], "rule string, severity string, file string, line int, code string, message string, suggestion string, seq long, pattern_hash string")
    (batch,) = adjudication.pattern_batches(rows).collect()
    assert (batch.pattern_hash, batch["items"]) == ("p", 2)
    verdicts = spark.createDataFrame([("r", "p", "guilty", "x", 0.7, "deny", "y", "llm", 1, 1)], "rule string, pattern_hash string, verdict string, reasoning string, confidence double, precedent_decision string, precedent_rationale string, source string, tokens_in int, tokens_out int")
    assert judging.dealt_out(rows, verdicts).count() == 2 and gate.gated(rows, verdicts).first()["guilty"] == 2
