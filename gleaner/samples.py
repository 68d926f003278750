"""Files made of table rows, with what must be found in them: one sample of every rule, in which lines are marked by hand.

Every document becomes a file by the sample that its doc_id chooses; its id is a name in the code and its text a comment. What
each sample expects was written down from the rules' definitions: a line that ends in the mark must be reported by the
sample's rule, every other line must not. The SQL takes these marks and the table's rows; it knows no rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from .plans.scan import all_findings

MARK = "<<<"
#: In a sample: a name made of the row's doc_id, and the letters of its text.
NAME, TEXT = "NAME", "TEXT"

# The rule, the file's name and its lines, after a head of the language's own.
GO = {
    "silent-fallback.empty-error-check": "func NAME() error {|\tif err != nil { <<<|\t\treturn nil|\t}|\tif err != nil {|\t\treturn err|\t}|\tif ok {|\t\treturn nil|\t}|\treturn nil|}",
    "silent-fallback.bare-return-on-error": "func NAME() (n int, err error) {|\tif err != nil {|\t\treturn <<<|\t}|\tif err != nil {|\t\treturn 0, nil <<<|\t}|\tif err != nil {|\t\t// reason: tolerated here|\t\treturn|\t}|\tif err != nil {|\t\treturn 1, err|\t}|\treturn|}",
    "silent-fallback.ignored-error": "func NAME() {|\ta, _ := load(1) <<<|\t_ = load(1)|\tb, err := load(1)|\tc, _ := list|}",
    "error-context.unwrapped-error": 'func NAME() error {|\tif err != nil {|\t\treturn err <<<|\t}|\tif err != nil {|\t\treturn nil, err <<<|\t}|\tif err != nil {|\t\treturn fmt.Errorf("NAME: %w", err)|\t}|\tif err != nil {|\t\treturn annotate(err, "NAME")|\t}|\treturn err|}',
    "error-context.http-200-on-error": "func NAME(w http.ResponseWriter, r *http.Request) {|\terr := load(r)|\tif err != nil {|\t\tlog.Println(err)|\t}|\tw.WriteHeader(200) <<<|}|func other(w http.ResponseWriter, r *http.Request) {|\tif err != nil {|\t\treturn|\t}|\tw.WriteHeader(200)|}",
    "error-context.nil-on-error": 'func NAME() (*T, error) {|\tif err != nil {|\t\treturn nil, nil <<<|\t}|\tif err != nil {|\t\treturn "", nil <<<|\t}|\tif err != nil {|\t\treturn nil, err|\t}|\treturn nil, nil|}',
    "error-context.generic-message": 'func NAME() error {|\ta := errors.New("failed") <<<|\tb := fmt.Errorf("internal error") <<<|\tc := errors.New("NAME failed")|\td := errors.New("Failed")|}',
    "bad-defaults.no-timeout": "func NAME() {|\tc := http.Client{} <<<|\td := http.Client{Timeout: limit}|\tr, err := http.Get(u) <<<|\tif r, err := http.Post(u, k, b); err != nil { <<<|\t\tuse(r)|\t}|\te := &http.Client{|\t\tTimeout: limit,|\t}|}",
    "bad-defaults.magic-number": "const limit = 99|func NAME() {|\tx := y * 86400 <<<|\ts := make([]int, 10)|\tt := items[3]|\tz := 1|\tconst inner = 77|}",
    "bad-defaults.unvalidated-env-go": 'func NAME() {|\tv := os.Getenv("NAME") <<<|\tuse(v)|}|func other() {|\tv := os.Getenv("OTHER")|\tif v == "" {|\t\tpanic(v)|\t}|}',
    "trace-gaps.long-function-no-log": "func RunNAME() { <<<|" + "\tstep()|" * 34 + "}|func runNAME() {|" + "\tstep()|" * 34 + "}|func FormatNAME() {|" + "\tstep()|" * 34 + "}|func ServeNAME() {|\tlog.Println(1)|" + "\tstep()|" * 34 + "}",
    "trace-gaps.error-path-no-log": "func NAME() error {|\tif err != nil { <<<|\t\tclean()|\t\treturn err|\t}|\tif err != nil {|\t\tlog.Println(err)|\t\treturn err|\t}|\tif err != nil {|\t\treturn err|\t}|\treturn nil|}",
    "mock-leakage.mock-import-non-test": 'import (|\t"fmt"|\t"github.com/stretchr/testify/assert" <<<|\t"net/http/httptest" <<<|\t"example.org/NAME"|)',
    "trace-gaps.no-request-id": 'func NAME(w http.ResponseWriter, r *http.Request) { <<<|\tserve(w)|}|func other(w http.ResponseWriter, r *http.Request) {|\tid := r.Header.Get("X-Request-ID")|\tuse(id)|}|func plain(a int) {|\tserve(a)|}',
    "mock-leakage.debug-guard": "func NAME() {|\tif debug { <<<|\t\tdump()|\t}|\tif cfg.isTesting && IsTest { <<<|\t\tdump()|\t}|\tif debugger {|\t\tdump()|\t}|}",
    "silent-fallback.unchecked-type-assert": 'func NAME() {|\ts := v.(string) <<<|\tt, ok := v.(string)|\tif v.(int) == one { <<<|\t\tuse(s)|\t}|\tswitch v.(type) {|\tcase int:|\t\tuse(t)|\t}|}',
    "bad-defaults.defer-in-loop": "func NAME() {|\tdefer first()|\tfor _, f := range files {|\t\tdefer f.Close() <<<|\t\tif ok {|\t\t\tdefer g() <<<|\t\t}|\t\tfunc() {|\t\t\tdefer h()|\t\t}()|\t}|}",
    "bad-defaults.goroutine-no-context": "func NAME() {|\tgo run(1) <<<|\tgo run(ctx, 1)|\tgo func() { <<<|\t\twork()|\t}()|\tgo func() {|\t\t<-done|\t}()|}",
    "error-context.swallowed-error": "func NAME() {|\tif err != nil { <<<|\t\tlog.Println(err)|\t}|\tif err != nil {|\t\tlog.Println(err)|\t\treturn|\t}|\tif err != nil {|\t\tlog.Println(err) // expected at start|\t}|}",
    "bad-defaults.context-todo": "func NAME() {|\tctx := context.TODO() <<<|\tif ok := run(context.Background()); ok { <<<|\t\tuse(ctx)|\t}|\tother := context.Background() // reason: outlives the caller|}|func main() {|\tctx := context.Background()|}",
    "error-context.error-string-compare": 'func NAME() {|\tif err.Error() == "NAME" { <<<|\t\tuse(err)|\t}|\tif "gone" != e.Error() { <<<|\t\tuse(e)|\t}|\tif errors.Is(err, gone) {|\t\tuse(err)|\t}|}',
    "mock-leakage.test-fixture-ref": 'func NAME() {|\topen("testdata/NAME.json") <<<|\topen("fixtures/a") <<<|\topen("data/NAME.json")|}',
    "trace-gaps.no-stderr-capture": 'func NAME() {|\tout, err := exec.Command("ls").Output() <<<|\tcmd := exec.Command("NAME")|\tcmd.Stderr = &buffer|\tboth, err := exec.Command("ls").CombinedOutput()|}',
}
JS = {
    "mock-leakage.jest-mock-in-src": "jest.mock('./NAME') <<<|const f = jest.fn() <<<|const g = jester.mock('x')",
    "mock-leakage.storybook-in-src": "import NAME from './NAME.stories.js' <<<|import story from './story.js'",
    "bad-defaults.eslint-disable-no-reason": "// eslint-disable-next-line no-alert <<<|f(NAME)|// eslint-disable-line no-alert -- NAME asks",
    "trace-gaps.no-unhandled-rejection": ("const app = make() <<<|app.listen(3000)|use(NAME)", "a.js", ""),
    "trace-gaps.console-log-in-production": "console.log(NAME) <<<|console.error(NAME)|// console.log(NAME)",
    "config-smells.hardcoded-api-url": "const a = 'http://localhost:3000/NAME' <<<|const b = \"https://api.example.org/v1\" <<<|const c = 'https://example.org/NAME'",
    "code-quality.unused-variable": "const NAME = 1 <<<|const used = 2|let _skipped = 3|use(used)",
    "silent-fallback.js-empty-catch": "try {|  f(NAME)|} catch (e) { <<<|}|try {|  g()|} catch (e) {|  log(e)|}|try {|  h()|} catch {|  // NAME may be gone|}",
    "silent-fallback.js-catch-return-null": "a.catch(() => null) <<<|b.catch((e) => { <<<|  log(e)|  return null|})|c.catch((e) => {|  throw e|})|d.then(() => null)",
    "silent-fallback.js-floating-promise": "async function NAME() {|  fetch(u) <<<|  await fetch(u)|  const r = fetch(u)|  fetch(u).then(f).catch(g)|}",
    "silent-fallback.js-callback-err-ignored": "read(p, (err, d) => { <<<|  use(d)|})|read(p, (err, d) => {|  if (err) throw err|})|read(p, function (error, d) { <<<|  use(d, NAME)|})|read(p, (data, d) => {|  use(d)|})",
    "silent-fallback.js-optional-chain-silence": "const a = b?.c?.d?.e?.f <<<|const g = h?.i?.j?.k|use(NAME)",
    "error-context.js-rethrow-no-wrap": "try {|  f()|} catch (e) {|  throw e <<<|}|try {|  g()|} catch (e) {|  throw new Error(`NAME: ${e}`)|}",
    "error-context.js-generic-error-message": "throw new Error('Something went wrong') <<<|throw new TypeError(\"failed\") <<<|throw new Error('NAME failed')",
    "error-context.js-promise-reject-non-error": "Promise.reject('NAME') <<<|Promise.reject(null) <<<|Promise.reject(new Error('NAME'))",
    "error-context.js-console-error-no-throw": "try {|  f()|} catch (e) {|  console.error(e) <<<|}|try {|  g()|} catch (e) {|  console.error(e)|  throw new Error(`NAME`, { cause: e })|}",
    "error-context.js-http-200-on-error": "try {|  f()|} catch (e) {|  res.status(200).json({}) <<<|}|try {|  g()|} catch (e) {|  res.status(500).send(NAME)|}",
    "trace-gaps.js-no-error-handler-express": "const app = express()|app.get('/NAME', show) <<<|app.post('/NAME', save)",
    "mock-leakage.js-test-import-in-src": "import { render } from '@testing-library/react' <<<|const v = require('vitest') <<<|import { NAME } from './NAME'",
    "mock-leakage.js-env-test-check": "if (process.env.NODE_ENV === 'test') { <<<|  f(NAME)|}|if (process.env.NODE_ENV === 'production') {|  g()|}",
    "trace-gaps.js-missing-correlation-id": "const app = express()|app.get('/NAME', show) <<<|app.use((err, req, res, next) => res.end())",
    "bad-defaults.no-timeout-fetch": "const a = await fetch(NAME) <<<|const b = await fetch(u, { <<<|  method: 'GET',|})|const c = await fetch(u, {|  method: 'GET',|  signal: s,|})|prefetch(u)",
    "bad-defaults.eval-usage": "eval(NAME) <<<|const f = new Function('a', NAME) <<<|evaluate(NAME)|a.eval(NAME)",
    "test-isolation.test-only-import": "import a from './__mocks__/NAME' <<<|const b = require('../test-utils') <<<|import c from './NAME'",
    "security.command-injection": "child_process.exec('rm ' + NAME) <<<|child_process.exec('ls')|run('rm ' + NAME)",
}
JS_TESTS = {
    "test-isolation.test-leaked-server": "it('NAME', () => {|  server.listen(0) <<<|})",
    "test-isolation.test-leaked-sse": "it('NAME', () => {|  const es = new EventSource(u) <<<|})",
    "test-isolation.test-missing-cleanup": "beforeEach(() => { <<<|  server.listen(0)|})|beforeAll(() => {|  prepare(NAME)|})",
    "test-isolation.no-afterall-cleanup": "beforeAll(() => { <<<|  prepare(NAME)|})|beforeEach(() => {|  prepare(NAME)|})|afterEach(() => {|  undo(NAME)|})",
}
TS = {
    "bad-defaults.ts-ignore": "// @ts-ignore <<<|f(NAME)|// @ts-ignore NAME has no types",
    "bad-defaults.any-type-assertion": "const a = b as any <<<|const c = b as NAME",
    "bad-defaults.non-null-assertion": "use(a!.NAME) <<<|use(a.NAME)|if (a != b) use(!a)",
}
PY = {
    "code-quality.unreachable-code": "def NAME():|    return 1|    work() <<<|def other():|    if ok:|        return 1|    work()",
    "code-quality.error-swallowing": "try:|    f(NAME)|except ValueError: <<<|    pass|try:|    g()|except ValueError:|    log.warning(1)",
    "config-smells.hardcoded-credentials": "token = 'NAME-abcd' <<<|token = 'abc'|token = read('NAME')",
    "security.sql-injection": 'q = "SELECT * FROM t WHERE id = " + NAME <<<|r = "SELECT * FROM t WHERE id = ?"|s = f"DELETE FROM t WHERE id = {NAME}" <<<',
    "trace-gaps.print-debug": "print(NAME) <<<|pprint(NAME)|# print(NAME)",
    "trace-gaps.no-logging-config": ('import os <<<|def NAME():|    work()|if __name__ == "__main__":|    NAME()', "a.py", ""),
    "mock-leakage.pytest-fixture-in-src": "@pytest.fixture <<<|def NAME():|    return 1",
    "bad-defaults.type-ignore-bare": "a = f(NAME)  # type: ignore <<<|b = f(NAME)  # type: ignore[arg-type]",
    "bad-defaults.noqa-bare": "import NAME  # noqa <<<|import os  # noqa: F401",
    "config-smells.hardcoded-credentials-py": "API_KEY = 'NAME' <<<|api_key = load('NAME')|monkey = 'NAME'",
    "silent-fallback.py-bare-except": "try:|    f(NAME)|except: <<<|    g()|try:|    h()|except ValueError:|    g()",
    "silent-fallback.py-except-pass": "try:|    f(NAME)|except ValueError: <<<|    pass|try:|    h()|except ValueError:|    g()|    pass",
    "silent-fallback.py-except-broad": "try:|    f(NAME)|except Exception: <<<|    g()|try:|    h()|except BaseException as e: <<<|    g(e)|try:|    h()|except (Exception, ValueError):|    g()",
    "silent-fallback.py-subprocess-no-check": "subprocess.run(['NAME']) <<<|subprocess.call(['ls'], check=False) <<<|subprocess.run(['ls'], check=True)|subprocess.Popen(['ls'])",
    "silent-fallback.py-getattr-silent-default": "a = getattr(b, 'NAME', None) <<<|c = getattr(b, 'NAME')|d = getattr(b, 'NAME', 0)",
    "silent-fallback.py-dict-get-none": "a = b.get('NAME') <<<|c = b.get('NAME', 0)|d = b['NAME']",
    "error-context.py-raise-from-none": "try:|    f()|except ValueError as e:|    raise KeyError('NAME') from None <<<|try:|    g()|except ValueError as e:|    raise KeyError('NAME') from e",
    "error-context.py-bare-raise-different": "try:|    f()|except ValueError as e:|    raise KeyError('NAME') <<<|try:|    g()|except ValueError as e:|    raise|try:|    h()|except ValueError as e:|    if ok:|        raise KeyError('NAME')",
    "error-context.py-generic-exception": "def NAME():|    raise Exception('NAME') <<<|def other():|    raise ValueError('NAME')|def third():|    raise BaseException() <<<",
    "error-context.py-string-exception": "def NAME():|    raise 'NAME' <<<|def other():|    raise ValueError('NAME')",
    "error-context.py-log-and-raise": "try:|    f()|except ValueError as e:|    logger.error(e)|    logging.warning('NAME') <<<|    raise|try:|    g()|except ValueError as e:|    logger.info(e)|    raise",
    "bad-defaults.py-mutable-default-arg": "def NAME(a=[], b=1): <<<|    return a|def other(a: list = [], b=None):|    return b|def third(a=dict()): <<<|    return a",
    "bad-defaults.py-no-timeout-requests": "r = requests.get(NAME) <<<|s = requests.post(NAME, timeout=1)|t = requests.put(NAME, **kw)|u = session.get(NAME)",
    "bad-defaults.py-star-import": "from NAME import * <<<|from os import path|import sys",
    "bad-defaults.py-global-state": "NAME = {} <<<|other = list() <<<|third = (1, 2)|def f():|    own = []|    return own",
    "bad-defaults.py-no-encoding-open": "a = open('NAME') <<<|b = open('NAME', 'rb')|c = open('NAME', encoding='utf-8')|d = gzip.open('NAME')",
    "mock-leakage.py-unittest-import": "import unittest <<<|from unittest.mock import patch <<<|import pytest <<<|import NAME",
    "mock-leakage.py-debug-flag": "if DEBUG: <<<|    start(NAME)|if __debug__: <<<|    start(NAME)|if DEBUGGER:|    start(NAME)",
    "trace-gaps.py-silent-request": "requests.get(NAME, timeout=1) <<<|r = requests.get(NAME, timeout=1)|r.raise_for_status()|requests.get(NAME, timeout=1).raise_for_status()",
}
RUST = {
    "rust.unwrap-in-production": "fn NAME() {|    let x = f().unwrap(); <<<|    let y = f().unwrap_or(1);|    // f().unwrap()|}",
    "rust.ignored-result": "fn NAME() {|    let _ = f(); <<<|    let _x = f();|}",
    "rust.panic-in-lib": 'fn NAME() {|    panic!("NAME"); <<<|    // panic!("NAME")|}',
    "rust.unsafe-no-comment": "fn NAME() {|    unsafe { f() } <<<|    // SAFETY: f has no state|    unsafe { f() }|}",
    "rust.todo-in-production": "fn NAME() {|    todo!() <<<|}|fn other() {|    unimplemented!() <<<|}",
    "rust.expect-generic": 'fn NAME() {|    f().expect("failed"); <<<|    f().expect("NAME is there");|}',
    "rust.boxed-error": "fn NAME() -> Result<(), Box<dyn Error>> { <<<|    Ok(())|}|fn other() -> Result<(), NAME> {|    Ok(())|}",
    "rust.process-exit": "fn NAME() {|    std::process::exit(1); <<<|    exit(1);|}",
    "rust.allow-suppress": "#[allow(dead_code)] <<<|fn NAME() {}|#[allow(dead_code)]|// NAME is called by name|fn other() {}",
    "rust.eprintln-in-lib": ('fn NAME() {|    eprintln!("NAME"); <<<|    println!("NAME");|}', "lib.rs", "// TEXT|"),
}
SHELL = {
    "bad-defaults.missing-pipefail": ("#!/bin/bash <<<|echo NAME|# TEXT", "a.sh", ""),
    "silent-fallback.hidden-failure-bash": "rm -r NAME \\|\\| true <<<|curl -s NAME 2>/dev/null <<<|rm NAME|# rm NAME \\|\\| true",
    "config-smells.hardcoded-path": "cd /home/NAME/src <<<|cd /opt/NAME|# cd /home/NAME/src",
    "bad-defaults.unvalidated-env-bash": "a=${NAME_DIR:-/tmp}|b=${HOME_DIR:-/tmp} <<<|echo ${HOME_DIR:-/tmp}|c=${HOME_DIR}",
    "silent-fallback.no-err-trap": "set -e <<<|cd NAME",
}
OTHERS = {
    "config-smells.secret-in-config": ("# TEXT|name: NAME|password: NAME99 <<<|token: $TOKEN", "a.yaml", ""),
    "config-smells.requirements-unpinned": ("# TEXT|NAME <<<|flask>=2 <<<|django==4.2", "requirements.txt", ""),
    "config-smells.missing-gitignore": ("NAME=1 <<<|# TEXT", ".env", ""),
    "config-smells.dotenv-no-example": ("NAME=1 <<<|# TEXT", ".env", ""),
    "bad-defaults.no-strict-mode": ("const NAME = 1 <<<|// TEXT|use(NAME)", "a.cjs", ""),
}


def samples() -> list[tuple[str, str, str]]:
    """Rule, file name and marked text of each sample."""
    out = []
    for group, name, head in ((GO, "a.go", "package a|// TEXT|"), (JS, "a.js", "// TEXT|"), (JS_TESTS, "a.test.js", "// TEXT|"), (TS, "a.ts", "// TEXT|"), (PY, "a.py", "# TEXT|"), (RUST, "a.rs", "// TEXT|"), (SHELL, "a.sh", "#!/bin/sh|# TEXT|"), (OTHERS, "", "")):
        for rule, given in group.items():
            text, own, top = given if isinstance(given, tuple) else (given, name, head)
            out.append((rule, own, (top + text).replace("\\|", "\0").replace("|", "\n").replace("\0", "|")))
    return out


SAMPLES = samples()
#: Sample, rule and line of everything that must be found.
EXPECTED = [(k, rule, line) for k, (rule, _, text) in enumerate(SAMPLES) for line, code in enumerate(text.split("\n"), 1) if code.endswith(MARK)]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file: sample, path and content."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    k = F.pmod("doc_id", F.lit(len(SAMPLES))).cast("int")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), k + 1)
    plain = [text.replace(f" {MARK}", "") for _, _, text in SAMPLES]
    letters = F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-z]+", " ")
    content = F.replace(F.replace(pick(plain), F.lit(NAME), F.concat(F.lit("n"), F.col("doc_id").cast("string"))), F.lit(TEXT), letters)
    return docs.where("doc_id is not null").select(k.alias("sample"), F.concat(F.lit("gen/d"), F.col("doc_id").cast("string"), F.lit("/"), pick([name for _, name, _ in SAMPLES])).alias("path"), content.alias("content"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sample's own rule reports in each file; files are made once and dealt to as many tasks as the session has."""
    made = files(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    made = storage.saved(made.select("path", "content"), "samples")
    own = F.element_at(F.array(*(F.lit(rule) for rule, _, _ in SAMPLES)), F.col("sample") + 1)
    kinds = F.regexp_extract("file", r"^gen/d(-?\d+)/", 1).cast("long")
    rows = all_findings(made).withColumn("sample", F.pmod(kinds, F.lit(len(SAMPLES))).cast("int"))
    return rows.where(F.col("rule") == own).select("rule", "file", "line").distinct()


def oracle() -> str:
    marks = ", ".join(f"({k}, '{rule}', '{SAMPLES[k][1]}', {line})" for k, rule, line in EXPECTED)
    return f"WITH m(sample, rule, name, line) AS (VALUES {marks}) SELECT rule, 'gen/d' || doc_id || '/' || name AS file, line::INT AS line FROM documents JOIN m ON ((doc_id % {len(SAMPLES)}) + {len(SAMPLES)}) % {len(SAMPLES)} = sample"
