import random
import time

import pytest
from pyspark.sql import functions as F

from gleaner.operators import flow_rules
from gleaner.operators.lines import split_lines


def plain(lines, start, opens):
    """Line by line from the start until nothing that it opened is open."""
    open_ = [0] * len(opens)
    for j in range(start, len(lines) + 1):
        for k, pair in enumerate(opens):
            open_[k] += lines[j - 1].count(pair[0]) - lines[j - 1].count(pair[1])
        if all(x <= 0 for x in open_):
            return j
    return len(lines)


@pytest.mark.parametrize("opens", [("{}",), ("()", "{}")])
def test_spans_equal_walking_from_each_start(spark, opens):
    r = random.Random(len(opens))
    files = {f"f{k}.js": ["".join(r.choices("{}()  x", k=r.randint(0, 4))) for _ in range(r.randint(1, 40))] for k in range(30)}
    files["nested.js"] = ["f({", "g({", "x", "})", "})", "h(", ") {", "}"]
    df = spark.createDataFrame([(p, "\n".join(x) + "\n") for p, x in files.items()], "path string, content string")
    rows = flow_rules.rows_of(split_lines(df), ".js")
    starts = rows.select("path", "line", F.col("code").alias("first"))
    got = {(x.path, x.line): x["last"] for x in flow_rules.spans(rows, starts, opens).collect()}
    assert got == {(p, i): plain(x, i, opens) for p, x in files.items() for i in range(1, len(x) + 1)}


def test_many_hooks_in_one_long_file(spark):
    lines = ["describe('all', () => {"]
    for k in range(4000):
        lines += [f"  beforeEach(() => {{ // {k}", "    server.listen(0)", "  });", "  it('x', () => {", "    work();", "  });"]
    lines.append("});")
    df = spark.createDataFrame([("a.test.js", "\n".join(lines))], "path string, content string")
    start = time.monotonic()
    found = flow_rules.leaks(split_lines(df)).groupBy("seq").count().collect()
    assert {r.seq: r["count"] for r in found} == {4: 4000, 6: 4000}
    assert time.monotonic() - start < 120


def test_functions_within_functions_are_part_of_the_outer_one(spark):
    text = "a() {\n  b() { # :cleanup-context\n    rm x || true\n  }\n}\nc() {\n  rm y || true\n}\ntrap c EXIT\n"
    df = spark.createDataFrame([("x.sh", text)], "path string, content string")
    assert sorted((r.line, r.kind) for r in flow_rules.hidden_failures(split_lines(df)).collect()) == [(3, 0)]
