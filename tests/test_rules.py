import os
import time
from dataclasses import replace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.corpus import CORPUS
from gleaner.operators import brace_rules, file_rules, flow_rules, helpers, line_rules, python_rules
from gleaner.operators.lines import exploded, split_lines
from gleaner.samples import SAMPLES
from gleaner.sources.files import read_tree, walk


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(CORPUS, "path string, content string")


def places(found, path):
    return {(r.line, r.rule.partition(".")[2]) for r in found.where(F.col("file") == path).select("line", "rule").collect()}


def test_lines_know_their_neighbours(spark):
    rows = exploded(split_lines(spark.createDataFrame([("a", "x\r\n\ny\n"), ("b", ""), ("c", None), ("d", "z")], "path string, content string"))).orderBy("path", "line").collect()
    assert [(r.path, r.line, r.code, r.before, r.after) for r in rows] == [("a", 1, "x", None, ""), ("a", 2, "", "x", "y"), ("a", 3, "y", "", None), ("d", 1, "z", None, None)]


def test_line_rules(files):
    found = line_rules.line_findings(split_lines(files))
    assert places(found, "r/lib.rs") == {(1, "boxed-error"), (2, "unsafe-no-comment"), (6, "eprintln-in-lib"), (7, "ignored-result"), (8, "panic-in-lib"), (9, "todo-in-production"), (10, "expect-generic"), (11, "process-exit"), (12, "allow-suppress")}
    assert places(found, "requirements.txt") == {(1, "requirements-unpinned"), (5, "requirements-unpinned")}
    assert places(found, "a/run.sh") == {(11, "unvalidated-env-bash"), (12, "hardcoded-path")}
    assert places(found, "a/test_z.py") == set() and places(found, "a/x.test.js") == set()
    assert places(found, "a/y.js") == {(4, "console-log-in-production"), (9, "jest-mock-in-src"), (10, "hardcoded-api-url"), (11, "eslint-disable-no-reason"), (12, "storybook-in-src"), (13, "sql-injection")}


def test_file_rules(files):
    found = file_rules.file_findings(split_lines(files))
    assert places(found, "a/run.sh") == {(1, "missing-pipefail"), (2, "no-err-trap")}
    assert places(found, "a/.env") == {(1, "missing-gitignore"), (1, "dotenv-no-example")} and places(found, "b/.env") == {(1, "dotenv-no-example")}
    assert places(found, "a/m.cjs") == {(1, "no-strict-mode")} and places(found, "a/x.py") == {(1, "no-logging-config")}
    assert places(found, "r/lib.rs") == {(5, "unwrap-in-production")} and places(found, "g/m.go") == {(17, "no-stderr-capture")}


def test_flow_rules(files):
    found = flow_rules.flow_findings(split_lines(files))
    assert places(found, "a/x.py") >= {(4, "unreachable-code"), (7, "error-swallowing"), (9, "unused-variable")}
    assert places(found, "a/y.js") >= {(1, "unused-variable"), (2, "error-swallowing"), (7, "unreachable-code")}
    bash = {(r.line, r.severity) for r in found.where("file = 'a/run.sh'").collect()}
    assert bash == {(3, "warning"), (4, "warning"), (9, "info")}
    assert places(found, "a/x.test.js") == {(1, "test-missing-cleanup"), (2, "test-leaked-server")}


def test_dead_code_stays_dead_until_a_branch(spark):
    code = "func f() {\n\treturn\n\ta()\n\tb()\n}\nfunc g() {\n\tswitch x {\n\tcase 1:\n\t\treturn\n\tcase 2:\n\t\tc()\n\t}\n\treturn a +\n\t\tb\n}\n"
    found = flow_rules.unreachable(split_lines(spark.createDataFrame([("m.go", code)], "path string, content string")))
    assert sorted(r.line for r in found.collect()) == [3, 4]


def test_python_rules(files):
    found = python_rules.python_findings(files)
    assert places(found, "a/y.py") == {
        (1, "py-unittest-import"), (2, "py-star-import"), (3, "py-global-state"), (4, "py-mutable-default-arg"), (6, "py-no-timeout-requests"), (6, "py-silent-request"), (6, "py-dict-get-none"),
        (7, "py-bare-except"), (7, "py-except-pass"), (9, "py-except-broad"), (10, "py-log-and-raise"), (11, "py-bare-raise-different"), (12, "py-string-exception"),
        (13, "py-no-encoding-open"), (14, "py-dict-get-none"), (15, "py-getattr-silent-default"), (16, "py-debug-flag"),
    }


def test_structure_rules(files):
    found = brace_rules.brace_findings(files, split_lines(files))
    assert places(found, "a/s.js") >= {(2, "js-no-error-handler-express"), (5, "js-empty-catch"), (4, "js-floating-promise"), (4, "no-timeout-fetch"), (8, "js-console-error-no-throw"), (9, "js-http-200-on-error"), (11, "js-callback-err-ignored"), (14, "js-catch-return-null"), (15, "js-promise-reject-non-error"), (16, "eval-usage"), (17, "js-generic-error-message")}
    assert places(found, "g/m.go") >= {(2, "mock-import-non-test"), (5, "swallowed-error"), (8, "http-200-on-error"), (9, "ignored-error"), (10, "unchecked-type-assert"), (12, "defer-in-loop"), (14, "goroutine-no-context"), (15, "no-timeout"), (16, "context-todo"), (22, "nil-on-error"), (24, "empty-error-check"), (28, "unwrapped-error"), (30, "error-string-compare"), (32, "generic-message")}
    assert (4, "no-afterall-cleanup") in places(found, "a/x.test.js")


def test_a_tree_is_read_with_hidden_names(spark, tmp_path):
    for name in ("b/x.py", "b/.env", "b/__init__.py", "vendor/y.py", ".hid/z.py", "b/a.min.js", "b/notes.txt"):
        path = tmp_path / "src" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x = 1\n")
    root = str(tmp_path / "src")
    want = [os.path.join(root, "b", n) for n in (".env", "__init__.py", "x.py")]
    assert walk(root) == want and sorted(r.path for r in read_tree(spark, root).collect()) == want
    assert walk(os.path.join(root, "vendor")) == []


def test_test_only_imports(spark):
    hits = ["./__mocks__", "./__tests__", "./Mocks", "../lib/TestUtils/x", "./a/__Fixtures__/b.json", "./user.Spec.js", "./user_test", "./Fake-clock", "test_helpers", "./stubs.ts"]
    misses = ["./mocksmith", "./x__mocks__", "./latest", "./contest/user", "./mocks.a.b", "./spec"]
    lines = [f"import x from '{m}';" for m in hits + misses] + [f'const y = require("{m}");' for m in hits + misses]
    files = spark.createDataFrame([("src/a.js", "\n".join(lines)), ("src/a.test.js", "\n".join(lines))], "path string, content string")
    found = line_rules.line_findings(split_lines(files), brace_rules.LINE_RULES).where("rule like 'test-isolation.%'").collect()
    n = len(lines) // 2
    assert sorted((r.file, r.rule, r.line) for r in found) == [("src/a.js", "test-isolation.test-only-import", k + base + 1) for base in (0, n) for k in range(len(hits))]


def test_handlers_are_read_with_the_blocks_in_them(spark):
    js = """try { a() } catch (problem) {
  if (x) {
    throw problem;
  }
  if (y) { throw problem; }
  throw new Error('x', { cause: problem });
}
try { b() } catch ($e) {
  log($e);
  while (z) {
    res.json({ ok: 1 });
  }
  throw $e;
}
read('f', (err, data) => {
  use(e, data.error);
});
read('f', (err, data) => {
  if (err) { use(data); }
});
"""
    go = """package m
func A() (out string, bad error) {
\tif err != nil {
\t\tif x {
\t\t\treturn nil, nil
\t\t}
\t\t// REASON: an empty answer is fine
\t\treturn
\t}
\tif err != nil {
\t\tfor {
\t\t\treturn "", nil
\t\t}
\t\treturn
\t}
\tctx := context.TODO()
\t// reason: a test double
\tother := context.Background()
\treturn "", nil
}
"""
    files = spark.createDataFrame([("s.js", js), ("m.go", go)], "path string, content string")
    found = brace_rules.brace_findings(files, split_lines(files))
    assert {x for x in places(found, "s.js") if x[1] in ("js-rethrow-no-wrap", "js-http-200-on-error", "js-callback-err-ignored")} == {(3, "js-rethrow-no-wrap"), (5, "js-rethrow-no-wrap"), (13, "js-rethrow-no-wrap"), (11, "js-http-200-on-error"), (15, "js-callback-err-ignored")}
    assert {x for x in places(found, "m.go") if x[1] in ("nil-on-error", "bare-return-on-error", "context-todo")} == {(5, "nil-on-error"), (12, "nil-on-error"), (5, "bare-return-on-error"), (12, "bare-return-on-error"), (14, "bare-return-on-error"), (16, "context-todo")}
    code = {r.line: r.code for r in found.where("file = 's.js' and rule = 'error-context.js-rethrow-no-wrap'").collect()}
    assert code[3] == "    throw problem;"


def test_blocks_that_continue_a_statement(spark):
    js = "try {\n  a();\n}\ncatch (e) {\n}\n"
    go = "package m\nfunc A() (string, error) {\n\tif x {\n\t\treturn b, nil\n\t} else if err != nil {\n\t\treturn nil, nil\n\t}\n\treturn b, nil\n}\nfunc B(v interface{}) error {\n\tif err != nil {\n\t\treturn err\n\t}\n\treturn nil\n}\n"
    files = spark.createDataFrame([("s.js", js), ("m.go", go)], "path string, content string")
    found = brace_rules.brace_findings(files, split_lines(files))
    assert places(found, "s.js") == {(4, "js-empty-catch")}
    assert places(found, "m.go") == {(5, "empty-error-check"), (6, "nil-on-error"), (12, "unwrapped-error")}


GO_CALLS = """package a

func f(u string) error {
	if r, err := http.Get(u); err != nil {
		return wrap(err, "x")
	}
	for r, err := http.Head(u); err == nil; {
		use(r)
	}
	if err := g(); err != nil {
		return pair(1, two(err)), err
	}
	if v.(string) == "x" {
		h(v)
	}
	if s, ok := v.(string); ok {
		h(s)
	}
	if ok := run(context.Background()); ok {
		return nil
	}
	return nil
}
"""
JS_CALLS = """p.catch((e) => {
  return null;
});
p.catch(e => {
  log(e);
  return null
});
p.catch((e) => {
  throw e;
});
fetch(u, {
  method: 'GET',
  signal: s,
});
fetch(u, {
  method: 'GET',
}).then(x => {
  fetch(v, { signal: s });
});
read(p, (err, d) => use(d));
read(p, (err, d) => err || use(d));
read(p, function (err, d) {
  use(d);
});
const g = function (err, cb) {};
const h = (err, cb) => cb(1);
"""


def test_statements_run_over_lines_and_headers(spark):
    from gleaner.operators import brace_rules
    from gleaner.operators.lines import split_lines

    files = spark.createDataFrame([("a.go", GO_CALLS), ("b.js", JS_CALLS)], "path string, content string")
    wanted = ("unwrapped-error", "no-timeout", "unchecked-type-assert", "context-todo", "js-catch-return-null", "no-timeout-fetch", "js-callback-err-ignored")
    found = {(r.rule.partition(".")[2], r.line) for r in brace_rules.brace_findings(files, split_lines(files)).collect()}
    assert {x for x in found if x[0] in wanted} == {
        ("no-timeout", 4), ("no-timeout", 7), ("unwrapped-error", 11), ("unchecked-type-assert", 13), ("context-todo", 19),
        ("js-catch-return-null", 1), ("js-catch-return-null", 4), ("no-timeout-fetch", 15), ("js-callback-err-ignored", 20), ("js-callback-err-ignored", 22),
    }


def test_what_a_line_must_have_hides_no_finding(spark):
    rows = spark.createDataFrame([(f"{k}/{name}", text.replace(" <<<", "").upper() if up else text.replace(" <<<", "")) for k, (_, name, text) in enumerate(SAMPLES) for up in (False, True)] + CORPUS, "path string, content string")
    for rules in (line_rules.RULES, brace_rules.LINE_RULES):
        assert sum(bool(r.needs) for r in rules) > 7
        own, free = (line_rules.line_findings(split_lines(rows), x).exceptAll for x in (rules, tuple(replace(r, needs=()) for r in rules)))
        assert not free(line_rules.line_findings(split_lines(rows), rules)).take(1) and not own(line_rules.line_findings(split_lines(rows), tuple(replace(r, needs=()) for r in rules))).take(1)


def test_a_long_file_is_passed_once():
    begun = time.monotonic()
    rows = [*brace_rules.blocks_of("a.go", "func f() {\n" + "\tcall()\n" * 200000 + "}\n" + "\n" * 200000)]
    assert [len(r[5]) for r in rows] == [200000, 1]
    # Copies of what follows each line took over a minute.
    assert time.monotonic() - begun < 20


def test_rows_of_many_files_leave_a_task_together(spark):
    sizes = []
    files = [(f"{k}.go", "func f() {\n\ta()\n}\n") for k in range(600)]
    table = spark.createDataFrame([(a, b) for a, b in files], "path string, content string").coalesce(1)
    given = pa.RecordBatch.from_pylist([{"path": a, "content": b} for a, b in files])
    for batch in helpers.batches(brace_rules.blocks_of, brace_rules.BLOCKS)(iter([given])):
        sizes.append(batch.num_rows)
    assert sizes == [1200] and brace_rules.brace_blocks(table).count() == 1200
