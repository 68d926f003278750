import random
import re

from pyspark.sql import functions as F

from gleaner import cases
from gleaner.operators import brace_rules, intervals


def test_around_equals_comparing_all(spark):
    r = random.Random(2)
    outer = [(f"f{r.randint(0, 3)}", a := r.randint(0, 500), a + r.choice([-1, 0, 1, 7, 60, 300]), k) for k in range(120)]
    inner = [(f"f{r.randint(0, 3)}", r.randint(0, 800), 900, k) for k in range(150)] + [("f0", 0, 900, 998), ("f9", 1, 900, 999)]
    got = intervals.around(spark.createDataFrame(outer, "path string, pre long, post long, id int"), spark.createDataFrame(inner, "path string, pre long, end long, id int"))
    want = sorted((i[3], o[3]) for i in inner for o in outer if i[0] == o[0] and o[1] <= i[1] <= o[2])
    assert sorted((x.id, x.o_id) for x in got.collect()) == want


def made(r, depth=0):
    out = []
    for _ in range(r.randint(1, 3)):
        kind = r.choice(["call", "call", "for {", "if ok {", "go func() {"]) if depth < 5 else "call"
        if kind == "call":
            out.append(f"defer f{r.randint(0, 99)}()")
        else:
            out += [kind, *made(r, depth + 1), "}()" if "func" in kind else "}"]
    return out


def test_nearest_loop_or_function_is_what_the_walk_through_the_file_says(spark):
    r = random.Random(3)
    files = {f"f{k}.go": "func main() {\n" + "\n".join(made(r)) + "\n}\n" for k in range(40)}
    want = []
    for path, text in files.items():
        open_ = []
        for line, code in enumerate(text.split("\n"), 1):
            if code.startswith("defer"):
                want.append((path, line, next(k for k in reversed(open_) if k != "block"), sum(k == "loop" for k in open_)))
            elif code.endswith("{"):
                open_.append("function" if "func" in code else "loop" if code.startswith("for") else "block")
            elif code.startswith("}"):
                open_.pop()
    df = spark.createDataFrame([*files.items()], "path string, content string")
    nodes = brace_rules.brace_nodes(df).persist()
    defer = (F.col("kind") == "statement") & F.col("text").startswith("defer")
    near = intervals.nearest(nodes, defer, ("function", "loop")).select("path", "line", F.col("o_kind").alias("kind"))
    loops = intervals.ancestors(nodes, defer, ("loop", "function")).groupBy("path", "line").agg(F.count_if(F.col("o_kind") == "loop").cast("int").alias("loops"))
    assert sorted(map(tuple, near.join(loops, ["path", "line"]).collect())) == sorted(want)
    in_loops = {(x.path, x.line) for x in near.where("kind = 'loop'").collect()}
    rule = brace_rules.brace_findings(df, df.select("path", F.split("content", "\n").alias("text"))).where(F.col("rule") == "bad-defaults.defer-in-loop")
    assert {(x.file, x.line) for x in rule.collect()} == in_loops
    nodes.unpersist()


def test_enclosing_meets_each_pair_once(spark, sf_dir):
    found = cases.enclosing(spark, sf_dir)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    assert found.where("loops < 1 or functions < 1 or nearest <> 'loop'").count() == 0


def test_innermost_is_the_nearest(spark):
    r = random.Random(5)
    df = spark.createDataFrame([(f"f{k}.js", "function main() {\n" + "\n".join(made(r)) + "\n}\n") for k in range(20)], "path string, content string")
    nodes = brace_rules.brace_nodes(df).persist()
    call, kinds = F.col("kind") == "statement", ("function", "loop", "block")
    near = intervals.nearest(nodes, call, kinds).select("path", "pre", "post", "o_kind", "o_pre")
    one = intervals.ancestors(nodes, call, kinds).groupBy("path", "pre", "post").agg(intervals.innermost("o_kind"), intervals.innermost("o_pre"))
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, one.collect()))
    nodes.unpersist()


def test_points_and_intervals_look_at_the_levels_they_reach(spark):
    rows = spark.createDataFrame([(0, -1), (0, 0), (3, 900), (512, 1023), (5, 2), (0, (1 << 40) - 2)], "pre long, post long")
    for x in rows.select("pre", "post", intervals.buckets("pre", "post").alias("b"), F.expr(intervals.reached("post")).alias("top")).collect():
        assert sum(1 << b.level for b in x.b) == max(0, x.post + 1 - x.pre) and all(b.level <= x.top for b in x.b)
        assert x.top <= max(0, x.post + 1).bit_length()


def test_hidden_text_keeps_its_places():
    source = "a /* x\n\ty */ b // z\n'q' \"\\\"r\" `s\nt`\n//  u"
    assert brace_rules.masked(source) == brace_rules.HIDDEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def test_content_is_worked_out_once_and_files_without_it_have_no_nodes(spark):
    df = spark.createDataFrame([("a.go", "package a\n"), ("b.go", None), ("c.go", "package c\n")], "path string, content string")
    nodes = brace_rules.brace_nodes(df.select("path", F.regexp_replace("content", "z+", "y").alias("content")))
    assert nodes._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1
    assert {x.path for x in nodes.collect()} == {"a.go", "c.go"}
