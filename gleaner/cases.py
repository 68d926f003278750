"""Queries of report, judging and store operators over ``events`` in the shape of findings, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from .functions import text as T
from .operators import adjudication, brace_rules, catalogue, intervals, judging, reports
from .plans import gate, memo
from .plans.scan import all_findings
from .sources import config, json_log, stores

AT = "2024-01-02 03:04:05"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings whose code has one of twelve patterns: so many names in a row."""
    code = F.array_join(F.array_repeat(F.lit("a"), (F.col("user_id") % 12 + 1).cast("int")), " ")
    return events(spark, sf_dir).select(
        F.concat(F.lit("ev."), "event_type").alias("rule"), F.when(F.col("event_type") == "purchase", "error").otherwise("info").alias("severity"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"),
        (F.col("event_id") % 50 + 1).cast("int").alias("line"), code.alias("code"), F.lit("m").alias("message"), F.lit("s").alias("suggestion"), F.col("event_id").alias("seq"),
    )


def names() -> Column:
    """The pattern's number."""
    return F.col("user_id") % 12 + 1


def key(rule: Column, n: Column) -> Column:
    return F.sha2(F.concat_ws("\n", rule, F.array_join(F.array_repeat(F.lit("id"), n.cast("int")), " ")), 256)


def past(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on patterns 1 to 6, one an event."""
    rows = events(spark, sf_dir).withColumns({"rule_id": F.concat(F.lit("ev."), "event_type"), "n": F.col("user_id") % 6 + 1})
    return rows.select(
        "rule_id", F.lit("v").alias("violation_hash"), key(F.col("rule_id"), F.col("n")).alias("pattern_hash"), F.when(F.col("n") % 2 == 0, "deny").otherwise("allow").alias("decision"), F.lit("before").alias("rationale"),
        F.when(F.col("n") < 3, 0.95).otherwise(0.5).alias("confidence"), F.lit(1).alias("seen_count"), F.lit(AT).cast("timestamp").alias("created_at"), F.lit(AT).cast("timestamp").alias("last_seen"), F.col("event_id").alias("ord"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's answers on patterns 2 to 11, but for pattern 8."""
    n = F.col("n")
    rows = events(spark, sf_dir).select(F.concat(F.lit("ev."), "event_type").alias("rule"), names().alias("n")).distinct().where(n.between(2, 11) & (n != 8))
    verdict = F.when(n % 3 == 0, "guilty").when(n % 3 == 1, "not_guilty").otherwise("advisory")
    return rows.select(
        "rule", key(F.col("rule"), n).alias("pattern_hash"), verdict.alias("verdict"), F.lit("because").alias("reasoning"), F.lit(0.7).alias("confidence"), F.when(n % 3 == 0, "deny").otherwise("allow").alias("precedent_decision"), F.lit("now").alias("precedent_rationale"),
        (n * 1000).cast("int").alias("tokens_in"), (n * 100).cast("int").alias("tokens_out"),
    )


BUDGET = 0.05


def verdicts(spark: SparkSession, sf_dir: str, budget: float = 0.0) -> DataFrame:
    return judging.judged(found(spark, sf_dir), past(spark, sf_dir), answers(spark, sf_dir), budget=budget, strict=False)


def verdict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verdicts(spark, sf_dir, BUDGET)
    return out.select("rule", "pattern_hash", "items", "verdict", "source", "by", "tokens_in", "tokens_out", F.round("cost", 9).alias("cost"), F.round("confidence", 6).alias("confidence"))


def answered(batch: dict) -> tuple[str, int, int]:
    """A judge that is asked now: it prices a batch by the words of its code and is away for those of eight."""
    n = len(batch["code"].split())
    if n == 8:
        raise TimeoutError("no answer")
    verdict = ("guilty", "not_guilty", "advisory")[n % 3]
    return f'{{"verdict": "{verdict}", "reasoning": "because", "confidence": 0.7, "precedent_decision": "allow", "precedent_rationale": "now"}}', n * 1000, n * 100


#: What the longest pattern of ``found`` costs.
DEAREST = (12 * 1000 * 0.8 + 12 * 100 * 4.0) / 1e6


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which batches were asked for within the budget, what came of it and what it cost."""
    out = judging.judged(found(spark, sf_dir), past(spark, sf_dir), judging.asked(answered), budget=BUDGET, strict=False, dearest=DEAREST)
    return out.select("rule", "pattern_hash", "asked", "by", "verdict", "problem", F.round("cost", 9).alias("cost"))


def verdict_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = found(spark, sf_dir)
    return judging.dealt_out(rows, verdicts(spark, sf_dir))


def debt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stores.checked(judging.debts(verdict_findings(spark, sf_dir), F.lit(AT).cast("timestamp")), "debt")
    return out.groupBy("rule_id", "file").agg(F.count("*").alias("n"), F.min("line").alias("first"))


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of purchases and carts over those of all other events, by pattern."""
    rows = events(spark, sf_dir).select(F.lit("r").alias("rule_id"), (F.col("user_id") % 40).cast("string").alias("pattern_hash"), F.when(F.col("event_id") % 5 < 2, "deny").otherwise("allow").alias("decision"), (F.col("event_id") % 10 / 10).alias("confidence"), (F.col("event_id") % 4).cast("int").alias("seen_count"), F.col("event_id").alias("ord"), "event_type")
    later = F.coalesce(F.col("event_type").isin("purchase", "add_to_cart"), F.lit(False))
    old, new = rows.where(~later).drop("event_type"), rows.where(later).drop("event_type")
    return stores.with_judgments(old, new).select("pattern_hash", "ord", "decision", "confidence", "seen_count")


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each of forty repositories, one a remainder of users, may commit its findings."""
    rows = found(spark, sf_dir).withColumn("repository", F.pmod(F.substring("file", 2, 20).cast("long"), F.lit(40)))
    return gate.gated(rows, verdicts(spark, sf_dir, BUDGET), "repository")


def warmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two warm-ups over the same findings, whose rules are one a user: what the second says by what the first stored."""
    rows = found(spark, sf_dir).where("rule is not null").withColumn("rule", F.concat_ws(".", "rule", "file")).where(F.size(F.split("code", " ")) != 8)
    folder, at = storage.scratch(spark, "warm-up"), F.lit(AT).cast("timestamp")
    first = gate.warm_up(rows, folder, judging.asked(answered), at, batch="one")
    second = gate.warm_up(rows, folder, judging.asked(answered), at, batch="two")
    stored = stores.read(spark, f"{folder}/precedents", "precedents").groupBy(F.col("rule_id").alias("rule"), "pattern_hash").agg(F.count("*").alias("stored"), F.round(F.max("confidence"), 6).alias("surest"))
    debts = stores.read(spark, f"{folder}/debt", "debt").groupBy(F.col("rule_id").alias("rule")).agg(F.count("*").alias("debts"))
    both = second.join(first.select("rule", "pattern_hash", F.col("by").alias("first_by")), ["rule", "pattern_hash"]).join(stored, ["rule", "pattern_hash"]).join(debts, "rule", "left")
    return both.select("rule", "pattern_hash", "items", "first_by", "by", "verdict", "stored", "surest", F.coalesce("debts", F.lit(0)).cast("long").alias("debts"))


def proposal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("ts is not null")
    rows = e.select(F.when(F.col("event_type") == "view", "rust.panic-in-lib").otherwise("own.rule").alias("rule_id"), F.concat(F.lit("u"), (F.col("user_id") % 30).cast("string")).alias("pattern_hash"), F.when(F.col("event_id") % 2 == 0, "allow").otherwise("deny").alias("decision"), F.col("ts").alias("created_at"))
    return judging.proposals(adjudication.law_candidates(rows, 7), catalogue.rules(spark), 7)


def senate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document an event: plain, fenced, without an object, or with an action that does not exist."""
    e = events(spark, sf_dir)
    k = F.col("event_id")
    action = F.element_at(F.array(*map(F.lit, ("disable_rule", "enable_rule", "set_severity", "abolish"))), (k % 4 + 1).cast("int"))
    body = F.concat(F.lit('{"id": "v'), k.cast("string"), F.lit('", "status": "'), F.when(k % 5 == 0, "rejected").otherwise("approved"), F.lit('", "amendments": [{"rule_id": "r'), F.col("user_id").cast("string"), F.lit('", "action": "'), action, F.lit('", "severity": "info"}]}'))
    text = F.when(k % 7 == 0, "no object here").when(k % 3 == 0, F.concat(F.lit("Ruling\n```json\n"), body, F.lit("\n```\nend"))).otherwise(body)
    return e.select(text.alias("text"))


def amendments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.approved_amendments(judging.senate_verdicts(senate_documents(spark, sf_dir))).select("verdict_id", "rule_id", "action")


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From documents of rulings to the state of each rule."""
    ruled = judging.approved_amendments(judging.senate_verdicts(senate_documents(spark, sf_dir)))
    fresh = adjudication.new_amendments(ruled, ruled.limit(0))
    return adjudication.replayed_amendments(fresh.withColumn("ord", F.struct(F.substring("verdict_id", 2, 20).cast("long"), "place")))


def enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of as many nested loops as the document's id says, a function literal about the inner half: what lies around each call."""
    n = F.pmod("doc_id", F.lit(9)).cast("int")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null")
    opened = lambda a, z: F.array_join(F.when(a <= z, F.transform(F.sequence(a, z), lambda k: F.concat(F.lit("for {\ncall("), k.cast("string"), F.lit(")\n")))).otherwise(F.array().cast("array<string>")), "")
    half = F.floor(n / 2).cast("int")
    text = F.concat(F.lit("package a\n// "), F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-z]+", " "), F.lit("\nfunc run() {\n"), opened(F.lit(1), half), F.lit("work(func() {\n"), opened(half + 1, n), F.repeat(F.lit("}\n"), n - half), F.lit("})\n"), F.repeat(F.lit("}\n"), half), F.lit("}\n"))
    nodes = storage.saved(brace_rules.brace_nodes(docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".go")).alias("path"), text.alias("content"))), "nodes")
    call = (F.col("kind") == "statement") & F.col("text").startswith("call(")
    # Pairs are met once: a call's counts and what is nearest come of the same group.
    pairs = intervals.ancestors(nodes, call, ("function", "loop")).groupBy("path", "text", "pre", "post")
    return pairs.agg(F.count_if(F.col("o_kind") == "loop").alias("loops"), F.count_if(F.col("o_kind") == "function").alias("functions"), intervals.innermost("o_kind").alias("nearest")).drop("pre", "post")


def cost_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The costs of runs, one a user, appended to a log as lines and read back."""
    e = events(spark, sf_dir)
    cost = adjudication.token_cost(F.col("event_id") % 5000, F.col("event_id") % 700)
    runs = e.groupBy("user_id").agg(F.count("*").alias("llm_calls"), F.sum(F.col("event_id") % 5000).alias("tokens_in"), F.sum(F.col("event_id") % 700).alias("tokens_out"), F.round(F.sum(cost), 6).alias("cost"), F.max("ts").alias("at"))
    runs = runs.withColumn("budget_exhausted", F.col("cost") >= 0.1)
    folder = storage.scratch(spark, "costs")
    json_log.append_log(reports.cost_records(runs.where("at is not null"), F.col("at"), F.when(F.col("user_id") % 2 == 0, 0.1).otherwise(0.0)), folder)
    return json_log.read_log(spark, folder, reports.COST)


def memo_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second scan after some documents were written again: which are read, and whether findings are those of a full scan."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("docs/requirements_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text", "lang")
    edited = F.coalesce(F.col("lang") == "es", F.lit(False))
    before = docs.select("path", F.lit(1).cast("long").alias("mtime_ns"), F.col("text").alias("content"))
    after = docs.select("path", F.when(edited, 2).otherwise(1).cast("long").alias("mtime_ns"), F.when(edited, F.concat(F.lit("flask\n"), "text")).otherwise(F.col("text")).alias("content"))
    folder = storage.scratch(spark, "memo")
    contents = lambda files: lambda listing: listing.join(files, ["path", "mtime_ns"])
    memo.remembered(before, folder, contents(before), extensions=(".txt",))
    rows = memo.remembered(after, folder, contents(after), extensions=(".txt",))
    whole = all_findings(after.select("path", "content"), (".txt",)).groupBy(F.col("file").alias("path")).agg(F.count("*").alias("n"), F.sum("line").alias("lines"))
    lines = F.aggregate("findings", F.lit(0).cast("long"), lambda a, x: a + x["line"])
    both = rows.join(whole, "path", "left")
    same = (F.size("findings") == F.coalesce("n", F.lit(0))) & (lines == F.coalesce("lines", F.lit(0)))
    return both.select("path", "mtime_ns", "fresh", same.alias("same"))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    body = F.concat(F.lit('{"verdict": "'), F.when(k % 4 == 0, "unsure").otherwise("guilty"), F.lit('", "reasoning": "a } in \\"a\\" string", "confidence": '), (k % 13 / 10).cast("string"), F.lit(', "precedent_decision": "deny", "precedent_rationale": "x"}'))
    raw = F.when(k % 6 == 0, "{ never closed").otherwise(F.concat(F.lit("Here it is: "), body, F.lit(" and {more}")))
    out = judging.parsed_answers(events(spark, sf_dir).select("event_id", raw.alias("raw")))
    return out.select("event_id", "problem", F.when(F.col("problem").isNull(), F.round("confidence", 6)).alias("confidence"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("event_id"), F.col("user_id").cast("string")
    raw = F.when(k % 4 == 0, F.concat(F.lit("./a//"), n, F.lit("/../b/./x.py"))).when(k % 4 == 1, F.concat(F.lit("/repo/src/"), n)).when(k % 4 == 2, F.concat(F.lit("../"), n, F.lit("/"))).otherwise(F.concat(F.lit("/repository/"), n))
    return events(spark, sf_dir).select("event_id", T.clean_path(raw, "/repo").alias("path"))


def excluded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("f"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 2 == 0, ".min.js").otherwise(".py"))
    hit = config.excluded(name, ["*.min.js", "f[1-3]?.py", "f\\777.py"])
    return events(spark, sf_dir).select(hit.alias("excluded")).groupBy("excluded").agg(F.count("*").alias("n"))


#: Code, and its pattern worked out by hand; words that are kept are spelled small.
PATTERNS = [
    ("if err != nil { return 0xFF, 12.5 }", "if id != nil { return 0xFF, id }"),
    ("  const X = 'a b';  LET y = \"c\\\"d\"\t", "const id = id; let id = id"),
    ("Return None_ or null", "return id id null"),
    ("for i in range(10):", "for id id range(id):"),
    ("'unclosed \"x\" y", "'id id id"),
    ("", ""),
    ("a1 + _b - 3c", "id + id - 3c"),
]


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(PATTERNS, "code string, want string").select("code", T.code_pattern(F.col("code")).alias("pattern"))


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, (".py", ".js", ".go", ".rs", ".toml"))), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))).alias("path"))
    kept = config.of_languages(files, config.only("Python, go,PY"))
    return kept.groupBy(T.extension(F.col("path")).alias("ext")).agg(F.count("*").alias("files"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "rule_catalogue": lambda s, d: catalogue.rules(s).select("id", "severity", F.array_join("file_types", " ").alias("types")),
    "rule_listing": lambda s, d: catalogue.listing(catalogue.of_types(catalogue.rules(s), config.types_of("ts,bash"))),
    "rules_per_group": lambda s, d: catalogue.per_group(catalogue.rules(s)),
    "findings_described": lambda s, d: catalogue.described_by(found(s, d).withColumn("rule", F.when(F.col("severity") == "error", "rust.panic-in-lib").otherwise(F.col("rule"))), catalogue.rules(s)).groupBy("rule", "description").agg(F.count("*").alias("n")),
    "language_filter": typed,
    "glob_exclude": excluded_names,
    "report_summary": lambda s, d: reports.summary(found(s, d), 12, 34),
    "report_code": lambda s, d: found(s, d).select("seq", reports.label(F.col("severity")).alias("label"), reports.shortened(F.concat(F.lit(" \t"), "code", F.lit("\r\n")), 9).alias("code")),
    "judge_verdicts": verdict_rows,
    "judge_summary": lambda s, d: judging.verdict_counts(verdicts(s, d, BUDGET)),
    "judge_fan_out": lambda s, d: verdict_findings(s, d).groupBy("rule", "verdict", "source").agg(F.count("*").alias("n"), F.min("seq").alias("first")),
    "judge_answers": parsed,
    "debt_rows": debt_rows,
    "precedent_upsert": upserted,
    "law_proposals": proposal_rows,
    "senate_amendments": amendments,
    "senate_replay": replayed,
    "judge_calls_within_budget": calls,
    "hook_gate": gates,
    "warm_up": warmed,
    "cost_log": cost_log,
    "enclosing_nodes": enclosing,
    "memo_scan": memo_rows,
    "path_cleaning": paths,
    "code_patterns": patterns,
}

# The rules' ids, severities and file types.
RULE_TABLE = """
silent-fallback.empty-error-check error .go
silent-fallback.bare-return-on-error warning .go
silent-fallback.ignored-error error .go
error-context.unwrapped-error warning .go
error-context.http-200-on-error error .go
error-context.nil-on-error error .go
error-context.generic-message warning .go
bad-defaults.no-timeout error .go
bad-defaults.magic-number info .go
bad-defaults.unvalidated-env-go warning .go
trace-gaps.long-function-no-log info .go
trace-gaps.error-path-no-log warning .go
mock-leakage.mock-import-non-test error .go
trace-gaps.no-request-id warning .go
mock-leakage.debug-guard warning .go
silent-fallback.unchecked-type-assert warning .go
bad-defaults.defer-in-loop warning .go
bad-defaults.goroutine-no-context warning .go
error-context.swallowed-error warning .go
bad-defaults.context-todo warning .go
error-context.error-string-compare warning .go
bad-defaults.missing-pipefail error .sh .bash
silent-fallback.hidden-failure-bash error .sh .bash
config-smells.hardcoded-path warning .sh .bash .toml .yaml .yml .json .env
bad-defaults.unvalidated-env-bash warning .sh .bash
config-smells.secret-in-config error .toml .yaml .yml .json .env
silent-fallback.no-err-trap info .sh .bash
mock-leakage.test-fixture-ref warning .go
trace-gaps.no-stderr-capture info .go
config-smells.missing-gitignore warning *
test-isolation.test-leaked-server warning .go .js .jsx .ts .tsx .mjs .cjs .sh .bash
test-isolation.test-leaked-sse warning .go .js .jsx .ts .tsx .mjs .cjs .sh .bash
test-isolation.test-missing-cleanup info .go .js .jsx .ts .tsx .mjs .cjs .sh .bash
mock-leakage.jest-mock-in-src warning .js .jsx .ts .tsx .mjs .cjs
mock-leakage.storybook-in-src warning .js .jsx .ts .tsx .mjs .cjs
bad-defaults.ts-ignore warning .ts .tsx
bad-defaults.eslint-disable-no-reason info .js .jsx .ts .tsx .mjs .cjs
bad-defaults.no-strict-mode info .cjs
trace-gaps.no-unhandled-rejection warning .js .ts .mjs
trace-gaps.console-log-in-production info .js .jsx .ts .tsx .mjs .cjs
config-smells.hardcoded-api-url warning .js .jsx .ts .tsx .mjs .cjs
config-smells.dotenv-no-example info *
code-quality.unused-variable warning .go .js .jsx .ts .tsx .mjs .cjs .py .pyi
code-quality.unreachable-code warning .go .js .jsx .ts .tsx .mjs .cjs .py .pyi
code-quality.error-swallowing warning .js .jsx .ts .tsx .mjs .cjs .py .pyi
config-smells.hardcoded-credentials error .go .js .jsx .ts .tsx .mjs .cjs .py .pyi .sh .bash
security.sql-injection error .go .js .jsx .ts .tsx .mjs .cjs .py .pyi
security.command-injection error .go .js .jsx .ts .tsx .mjs .cjs .py .pyi .sh .bash
trace-gaps.print-debug info .py
trace-gaps.no-logging-config warning .py
mock-leakage.pytest-fixture-in-src error .py
bad-defaults.type-ignore-bare warning .py
bad-defaults.noqa-bare info .py
config-smells.hardcoded-credentials-py error .py
config-smells.requirements-unpinned warning .txt
rust.unwrap-in-production error .rs
rust.ignored-result error .rs
rust.panic-in-lib error .rs
rust.unsafe-no-comment error .rs
rust.todo-in-production warning .rs
rust.expect-generic warning .rs
rust.boxed-error warning .rs
rust.process-exit warning .rs
rust.allow-suppress info .rs
rust.eprintln-in-lib info .rs
silent-fallback.js-empty-catch warning .js .jsx .ts .tsx .mjs .cjs
silent-fallback.js-catch-return-null warning .js .jsx .ts .tsx .mjs .cjs
silent-fallback.js-floating-promise warning .js .jsx .ts .tsx .mjs .cjs
silent-fallback.js-callback-err-ignored warning .js .jsx .ts .tsx .mjs .cjs
silent-fallback.js-optional-chain-silence info .js .jsx .ts .tsx .mjs .cjs
error-context.js-rethrow-no-wrap warning .js .jsx .ts .tsx .mjs .cjs
error-context.js-generic-error-message warning .js .jsx .ts .tsx .mjs .cjs
error-context.js-promise-reject-non-error warning .js .jsx .ts .tsx .mjs .cjs
error-context.js-console-error-no-throw warning .js .jsx .ts .tsx .mjs .cjs
error-context.js-http-200-on-error error .js .jsx .ts .tsx .mjs .cjs
trace-gaps.js-no-error-handler-express warning .js .jsx .ts .tsx .mjs .cjs
mock-leakage.js-test-import-in-src error .js .jsx .ts .tsx .mjs .cjs
mock-leakage.js-env-test-check warning .js .jsx .ts .tsx .mjs .cjs
trace-gaps.js-missing-correlation-id info .js .jsx .ts .tsx .mjs .cjs
bad-defaults.no-timeout-fetch error .js .jsx .ts .tsx .mjs .cjs
bad-defaults.any-type-assertion warning .ts .tsx
bad-defaults.non-null-assertion info .ts .tsx
bad-defaults.eval-usage error .js .jsx .ts .tsx .mjs .cjs
test-isolation.no-afterall-cleanup warning .js .jsx .ts .tsx .mjs .cjs
test-isolation.test-only-import info .js .jsx .ts .tsx .mjs .cjs
silent-fallback.py-bare-except error .py
silent-fallback.py-except-pass warning .py
silent-fallback.py-except-broad warning .py
silent-fallback.py-subprocess-no-check warning .py
silent-fallback.py-getattr-silent-default info .py
silent-fallback.py-dict-get-none info .py
error-context.py-raise-from-none warning .py
error-context.py-bare-raise-different warning .py
error-context.py-generic-exception warning .py
error-context.py-string-exception error .py
error-context.py-log-and-raise info .py
bad-defaults.py-mutable-default-arg error .py
bad-defaults.py-no-timeout-requests error .py
bad-defaults.py-star-import warning .py
bad-defaults.py-global-state warning .py
bad-defaults.py-no-encoding-open info .py
mock-leakage.py-unittest-import error .py
mock-leakage.py-debug-flag warning .py
trace-gaps.py-silent-request warning .py
"""


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


RULE_ROWS = "rules(id, severity, types) AS (VALUES " + ", ".join(f"({q(a)}, {q(b)}, {q(c)})" for a, b, c in (x.split(" ", 2) for x in RULE_TABLE.strip().split("\n"))) + ")"
ROWS = """
f AS (SELECT 'ev.' || event_type AS rule, CASE WHEN event_type = 'purchase' THEN 'error' ELSE 'info' END AS severity, 'u' || user_id AS file, (event_id % 50 + 1)::INT AS line, event_id AS seq, user_id % 12 + 1 AS n FROM events),
b AS (SELECT rule, n, count(*) AS items, min((file, line, seq)) AS place FROM f GROUP BY 1, 2),
k AS (
  SELECT *, sha256(rule || chr(10) || array_to_string(list_transform(range(n), lambda i: 'id'), ' ')) AS pattern_hash,
         (rule, n) IN (SELECT 'ev.' || event_type, user_id % 6 + 1 FROM events) AS matched, n BETWEEN 2 AND 11 AND n <> 8 AS told
  FROM b),
j AS (SELECT *, n < 3 AND matched AS auto FROM k),
c AS (SELECT *, CASE WHEN told AND NOT auto THEN (n * 1000 * 0.8::DOUBLE + n * 100 * 4.0::DOUBLE) / 1e6::DOUBLE ELSE 0.0::DOUBLE END AS price FROM j),
p AS (SELECT *, coalesce(sum(price) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < {budget} AS paid FROM c),
v AS (SELECT *, CASE WHEN auto THEN 'auto' WHEN paid AND told THEN 'llm' WHEN matched THEN 'fallback' END AS "by" FROM p),
verdict AS (
  SELECT *, CASE WHEN "by" = 'llm' THEN CASE n % 3 WHEN 0 THEN 'guilty' WHEN 1 THEN 'not_guilty' ELSE 'advisory' END WHEN "by" IS NOT NULL THEN CASE WHEN n % 2 = 0 THEN 'guilty' ELSE 'not_guilty' END END AS verdict,
         CASE WHEN "by" = 'llm' THEN 'llm' WHEN "by" IS NOT NULL THEN 'precedent' END AS source
  FROM v)"""
PAID, FREE = ROWS.format(budget=BUDGET), ROWS.format(budget=1e9)
LLM = "CASE WHEN \"by\" = 'llm' THEN {} ELSE 0 END"

ORACLES: dict[str, str] = {
    "rule_catalogue": f"WITH {RULE_ROWS} SELECT * FROM rules",
    "rule_listing": f"WITH {RULE_ROWS} SELECT id, split_part(id, '.', 1) AS category, upper(severity) AS severity, replace(types, ' ', ',') AS files FROM rules WHERE list_has_any(string_split(types, ' '), ['.ts', '.tsx', '.sh', '.bash'])",
    "rules_per_group": f"WITH {RULE_ROWS}, t AS (SELECT id, unnest(string_split(types, ' ')) AS t, unnest(range(len(string_split(types, ' ')))) AS i FROM rules), g AS (SELECT id, i, CASE WHEN t = '.go' THEN 'go' WHEN t IN ('.js', '.jsx', '.ts', '.tsx', '.mjs', '.cjs') THEN 'jsts' WHEN t IN ('.py', '.pyi') THEN 'python' WHEN t IN ('.sh', '.bash') THEN 'bash' END AS language FROM t), o AS (SELECT id, arg_min(language, i) AS language FROM g WHERE language IS NOT NULL GROUP BY 1) SELECT language, count(*) AS rules FROM o GROUP BY 1",
    "findings_described": f"WITH {FREE} SELECT CASE WHEN severity = 'error' THEN 'rust.panic-in-lib' ELSE rule END AS rule, CASE WHEN severity = 'error' THEN 'A library panics' END AS description, count(*) AS n FROM f GROUP BY 1, 2",
    "language_filter": "SELECT (['.py', '.js', '.go', '.rs', '.toml'])[(doc_id % 5 + 1)::INT] AS ext, count(*) AS files FROM documents WHERE doc_id % 5 <> 1 GROUP BY 1",
    "glob_exclude": "SELECT event_id % 2 = 0 OR event_id BETWEEN 10 AND 39 OR event_id = 777 AS excluded, count(*) AS n FROM events GROUP BY 1",
    "report_summary": "SELECT count(*) AS total, count_if(event_type = 'purchase')::BIGINT AS errors, 0::BIGINT AS warnings, count_if(event_type <> 'purchase')::BIGINT AS info, 12::INT AS files_scanned, 34::INT AS duration_ms FROM events",
    "report_code": "SELECT event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'ERROR ' ELSE 'INFO  ' END AS label, CASE WHEN user_id % 12 + 1 > 5 THEN 'a a a a a…' ELSE array_to_string(list_transform(range(user_id % 12 + 1), lambda i: 'a'), ' ') END AS code FROM events",
    "judge_verdicts": f"WITH {PAID} SELECT rule, pattern_hash, items, verdict, source, \"by\", {LLM.format('n * 1000')}::INT AS tokens_in, {LLM.format('n * 100')}::INT AS tokens_out, round({LLM.format('price')}, 9)::DOUBLE AS cost, CASE WHEN \"by\" = 'llm' THEN 0.7::DOUBLE WHEN \"by\" IS NOT NULL THEN CASE WHEN n < 3 THEN 0.95::DOUBLE ELSE 0.5::DOUBLE END END AS confidence FROM verdict",
    "judge_summary": f"WITH {PAID} SELECT sum(items)::BIGINT AS total, sum(CASE WHEN verdict = 'guilty' THEN items ELSE 0 END)::BIGINT AS guilty, sum(CASE WHEN verdict = 'not_guilty' THEN items ELSE 0 END)::BIGINT AS not_guilty, sum(CASE WHEN verdict = 'advisory' THEN items ELSE 0 END)::BIGINT AS advisory, count(*) AS batches, sum(CASE WHEN matched THEN items ELSE 0 END)::BIGINT AS precedent_matches, count_if(\"by\" = 'auto')::BIGINT AS auto_applied, count_if(\"by\" = 'llm')::BIGINT AS llm_calls, 0::BIGINT AS failed_calls, sum({LLM.format('n * 1000')})::BIGINT AS tokens_in, sum({LLM.format('n * 100')})::BIGINT AS tokens_out, round(sum({LLM.format('price')}), 9)::DOUBLE AS cost, bool_or(NOT paid AND NOT auto) AS budget_exhausted FROM verdict",
    "judge_fan_out": f"WITH {FREE} SELECT rule, verdict, source, count(*) AS n, min(seq) AS first FROM f JOIN verdict USING (rule, n) GROUP BY 1, 2, 3",
    "judge_answers": "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'no json object' WHEN event_id % 4 = 0 THEN 'invalid verdict' WHEN event_id % 13 > 10 THEN 'confidence out of range' END AS problem, CASE WHEN event_id % 6 <> 0 AND event_id % 4 <> 0 AND event_id % 13 <= 10 THEN (event_id % 13) / 10.0::DOUBLE END AS confidence FROM events",
    "debt_rows": f"WITH {FREE} SELECT rule AS rule_id, file, count(*) AS n, min(line) AS first FROM f JOIN verdict USING (rule, n) WHERE verdict = 'advisory' GROUP BY 1, 2",
    "precedent_upsert": """WITH RECURSIVE e AS (SELECT (user_id % 40)::VARCHAR AS pattern_hash, event_id AS ord, CASE WHEN event_id % 5 < 2 THEN 'deny' ELSE 'allow' END AS decision, (event_id % 10) / 10.0::DOUBLE AS confidence, (event_id % 4)::INT AS seen, event_type FROM events),
      o AS (SELECT pattern_hash, arg_max(decision, ord) AS decision, arg_max(confidence, ord) AS c, arg_max(seen, ord) AS seen FROM e WHERE NOT coalesce(event_type IN ('purchase', 'add_to_cart'), false) GROUP BY 1),
      n AS (SELECT *, row_number() OVER (PARTITION BY pattern_hash ORDER BY ord) AS i FROM e WHERE event_type IN ('purchase', 'add_to_cart')),
      k AS (SELECT DISTINCT pattern_hash FROM n),
      s AS (SELECT pattern_hash, o.decision, CASE WHEN o.c > 0 THEN o.c ELSE 0.5::DOUBLE END AS c, greatest(o.seen, 1) AS seen, 0::BIGINT AS ord, 0::BIGINT AS i FROM k LEFT JOIN o USING (pattern_hash)
        UNION ALL
        SELECT n.pattern_hash, n.decision, CASE WHEN s.decision IS NULL THEN CASE WHEN n.confidence > 0 THEN least(n.confidence, 1.0) ELSE 0.6::DOUBLE END WHEN n.decision = s.decision THEN least(1.0, s.c + 0.1::DOUBLE) ELSE greatest(0.2, s.c * 0.5::DOUBLE) END, CASE WHEN n.decision = s.decision THEN s.seen + 1 ELSE 1 END, n.ord, n.i
        FROM s JOIN n ON n.pattern_hash = s.pattern_hash AND n.i = s.i + 1)
      SELECT pattern_hash, ord, decision, round(c, 9)::DOUBLE AS confidence, seen AS seen_count FROM s WHERE i > 0""",
    "law_proposals": "WITH c AS (SELECT CASE WHEN event_type = 'view' THEN 'rust.panic-in-lib' ELSE 'own.rule' END AS rule_id, 'u' || (user_id % 30) AS pattern_hash, CASE WHEN event_id % 2 = 0 THEN 'allow' ELSE 'deny' END AS decision, count(*) AS n, min(ts) AS a, max(ts) AS z FROM events WHERE ts IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 7), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, rule_id, decision, pattern_hash)::INT AS place FROM c) SELECT place, rule_id, pattern_hash, decision, '## Proposal ' || place || ': `' || rule_id || '`' || chr(10) || chr(10) || '- Current rule: ' || CASE WHEN rule_id = 'own.rule' THEN '(rule description unavailable)' ELSE 'A library panics' END || chr(10) || '- Pattern hash: `' || pattern_hash || '`' || chr(10) || '- Consistent decision: `' || decision || '`' || chr(10) || '- Evidence count: ' || n || ' (threshold 7)' || chr(10) || '- First seen: ' || strftime(a, '%Y-%m-%dT%H:%M:%SZ') || chr(10) || '- Last seen: ' || strftime(z, '%Y-%m-%dT%H:%M:%SZ') || chr(10) || '- Suggested amendment: ' || CASE WHEN decision = 'allow' THEN 'Add a targeted exception for this pattern (pattern consistently judged not-guilty).' ELSE 'Tighten enforcement for this pattern (pattern consistently judged guilty).' END || chr(10) AS text FROM r",
    "senate_amendments": "SELECT 'v' || event_id AS verdict_id, 'r' || user_id AS rule_id, (['disable_rule', 'enable_rule', 'set_severity'])[(event_id % 4 + 1)::INT] AS action FROM events WHERE event_id % 7 <> 0 AND event_id % 5 <> 0 AND event_id % 4 <> 3",
    "senate_replay": "WITH e AS (SELECT 'r' || user_id AS rule_id, event_id AS k, event_id % 4 AS a FROM events WHERE event_id % 7 <> 0 AND event_id % 5 <> 0 AND event_id % 4 <> 3) SELECT rule_id, max(CASE WHEN a = 2 THEN 'info' END) AS new_severity, coalesce(arg_max(a = 0, k) FILTER (a < 2), false) AS disabled FROM e GROUP BY 1",
    "judge_calls_within_budget": f"""WITH {FREE}, o AS (SELECT *, CASE WHEN auto OR n = 8 THEN 0.0::DOUBLE ELSE (n * 1000 * 0.8::DOUBLE + n * 100 * 4.0::DOUBLE) / 1e6::DOUBLE END AS due FROM j),
      s AS (SELECT *, NOT auto AND coalesce(sum(due) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < {BUDGET} AS asked FROM o),
      b2 AS (SELECT *, CASE WHEN auto THEN 'auto' WHEN asked AND n <> 8 THEN 'llm' WHEN matched THEN 'fallback' END AS how FROM s)
      SELECT rule, pattern_hash, asked, how AS "by", CASE how WHEN 'llm' THEN (['guilty', 'not_guilty', 'advisory'])[(n % 3 + 1)::INT] WHEN 'auto' THEN CASE WHEN n % 2 = 0 THEN 'guilty' ELSE 'not_guilty' END WHEN 'fallback' THEN CASE WHEN n % 2 = 0 THEN 'guilty' ELSE 'not_guilty' END END AS verdict,
             CASE WHEN asked AND n = 8 THEN 'unavailable: no answer' END AS problem, round(CASE WHEN how = 'llm' THEN due ELSE 0 END, 9)::DOUBLE AS cost FROM b2""",
    "hook_gate": f"""WITH {PAID}, g AS (SELECT substr(file, 2)::BIGINT % 40 AS repository, count(*) AS findings, count_if(severity = 'error')::BIGINT AS errors, count_if(coalesce(verdict = 'guilty', false))::BIGINT AS guilty, count_if(verdict IS NULL)::BIGINT AS unjudged FROM f LEFT JOIN verdict USING (rule, n) GROUP BY 1)
      SELECT *, CASE WHEN unjudged > 0 THEN 'scan' ELSE 'judge' END AS "by", CASE WHEN CASE WHEN unjudged > 0 THEN errors ELSE guilty END > 0 THEN 1 ELSE 0 END::INT AS code FROM g""",
    "warm_up": """WITH b AS (SELECT 'ev.' || event_type || '.u' || user_id AS rule, user_id % 12 + 1 AS n, count(*) AS items FROM events WHERE event_type IS NOT NULL AND user_id % 12 <> 7 GROUP BY 1, 2)
      SELECT rule, sha256(rule || chr(10) || array_to_string(list_transform(range(n), lambda i: 'id'), ' ')) AS pattern_hash, items, 'llm' AS first_by, CASE WHEN items > 3 THEN 'auto' ELSE 'llm' END AS "by",
        CASE WHEN items > 3 THEN 'not_guilty' ELSE (['guilty', 'not_guilty', 'advisory'])[(n % 3 + 1)::INT] END AS verdict, 2 * items AS stored, least(1.0, round(0.7 + 0.1 * (2 * items - 1), 6))::DOUBLE AS surest,
        CASE WHEN n % 3 = 2 THEN CASE WHEN items > 3 THEN items ELSE 2 * items END ELSE 0 END::BIGINT AS debts FROM b""",
    "enclosing_nodes": """WITH d AS (SELECT doc_id, (doc_id % 9)::INT AS n, (doc_id % 9)::INT // 2 AS half FROM documents), c AS (SELECT *, unnest(range(1, n + 1))::INT AS k FROM d)
      SELECT doc_id || '.go' AS path, 'call(' || k || ')' AS text, k::BIGINT AS loops, CASE WHEN k > half THEN 2 ELSE 1 END::BIGINT AS functions, 'loop' AS nearest FROM c""",
    "cost_log": """WITH r AS (SELECT user_id, count(*) AS n, sum(event_id % 5000)::BIGINT AS i, sum(event_id % 700)::BIGINT AS o, round(sum(((event_id % 5000) * 0.8::DOUBLE + (event_id % 700) * 4.0::DOUBLE) / 1e6::DOUBLE), 6)::DOUBLE AS cost, max(ts) AS seen FROM events GROUP BY 1)
      SELECT strftime(seen, '%Y-%m-%dT%H:%M:%SZ') AS recorded_at, n AS llm_calls, i AS input_tokens, o AS output_tokens, cost AS total_cost_usd, CASE WHEN user_id % 2 = 0 THEN 0.1::DOUBLE END AS budget_usd, CASE WHEN cost >= 0.1::DOUBLE THEN true END AS budget_exhausted FROM r WHERE seen IS NOT NULL""",
    "memo_scan": "SELECT 'docs/requirements_' || doc_id || '.txt' AS path, CASE WHEN lang = 'es' THEN 2 ELSE 1 END::BIGINT AS mtime_ns, coalesce(lang = 'es', false) AS fresh, true AS same FROM documents",
    "path_cleaning": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a/b/x.py' WHEN 1 THEN 'src/' || user_id WHEN 2 THEN '../' || user_id ELSE '/repository/' || user_id END AS path FROM events",
    "code_patterns": "SELECT * FROM (VALUES " + ", ".join(f"({q(a).replace(chr(9), '')} || {q(chr(9) if chr(9) in a else '')}, {q(b)})" for a, b in PATTERNS) + ") AS t(code, pattern)",
}
