"""Queries over the driver's tables and the SQL that must agree with them.

Rules are written for source code and the tables hold prose, so documents are read as files of several
kinds (their extension follows doc_id), and a small corpus of code stands beside them as constants.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .corpus import CORPUS, generated
from .functions import text as T
from .operators import adjudication, brace_rules, file_rules, findings, flow_rules, line_rules, python_rules
from .operators.lines import exploded, split_lines
from .plans.scan import scan
from .streaming.watch import debounced

KINDS = (".py", ".js", ".go", ".sh", ".ts", ".rs", ".txt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document as a file ``docs/requirements_<id><ext>``."""
    ext = F.element_at(F.array(*map(F.lit, KINDS)), (F.pmod("doc_id", F.lit(len(KINDS))) + 1).cast("int"))
    path = F.concat(F.lit("docs/requirements_"), F.col("doc_id").cast("string"), ext)
    return table(spark, sf_dir, "documents").select(path.alias("path"), F.col("text").alias("content"))


def code_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CORPUS, "path string, content string")


def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the shape of findings."""
    kind = F.col("event_type")
    severity = F.when(kind == "purchase", "error").when(kind.isin("click", "add_to_cart"), "warning").otherwise("info")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("ev."), kind).alias("rule"), severity.alias("severity"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"),
        (F.col("event_id") % 50 + 1).cast("int").alias("line"), F.coalesce("props", F.lit("")).alias("code"), F.lit("m").alias("message"), F.lit("s").alias("suggestion"), F.col("event_id").alias("seq"),
    )


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the shape of past decisions."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("ev."), F.col("event_type")).alias("rule_id"), F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")).alias("pattern_hash"),
        F.when(F.col("event_id") % 3 == 0, "deny").otherwise("allow").alias("decision"), (F.pmod("event_id", F.lit(11)) / 10).alias("confidence"),
        (F.col("event_id") % 7).cast("int").alias("seen_count"), F.col("ts").alias("created_at"), F.col("event_id").alias("ord"),
    )


KEYS = ("rule", "severity", "file", "line")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line rules over all documents as files, one finding per place."""
    found = line_rules.line_findings(split_lines(document_files(spark, sf_dir)))
    return findings.deduplicated(found).select("rule", "severity", "file", "line", "code")


def suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = projected(spark, sf_dir)
    hashed = found.select(F.col("rule").alias("rule_id"), T.violation_hash(F.col("rule"), F.col("file"), F.col("line"), F.col("code")).alias("violation_hash"), F.when(F.col("seq") % 2 == 0, "allow").otherwise("deny").alias("decision"), F.col("seq").alias("ord"))
    return findings.not_allowed(found, hashed).select("rule", "file", "line", "code", "seq")


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context of each credential found in documents."""
    files = document_files(spark, sf_dir)
    texts = split_lines(files)
    rule = tuple(r for r in line_rules.RULES if r.id == "config-smells.hardcoded-credentials")
    found = line_rules.line_findings(texts, rule).select("rule", "file", "line")
    return findings.with_context(found, texts)


def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    calls = e.select(F.col("user_id").alias("run"), "event_id", adjudication.token_cost(F.col("event_id") % 5000, F.col("event_id") % 700).alias("cost"))
    out = adjudication.within_budget(calls, 0.02, "event_id")
    return out.select("run", "event_id", F.round("spent", 9).alias("spent"), "allowed")


def hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    header = F.concat(F.lit("@@ -1,2 +"), (F.col("event_id") % 90 + 1).cast("string"), F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat(F.lit(","), (F.col("event_id") % 4 - 1).cast("string"))), F.lit(" @@ x"))
    return findings.expanded_hunks(e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), header.alias("header")))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("ts is not null")
    rows = e.select(F.col("user_id").cast("string").alias("path"), "ts", F.col("event_id").cast("string").alias("content"))
    return debounced(rows, "6 hours").groupBy("path").agg(F.count("*").alias("bursts"), F.sum("events").alias("events"), F.max("events").alias("most"))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = adjudication.pattern_batches(projected(spark, sf_dir))
    return found.select("rule", "pattern_hash", "items", F.col("first.file").alias("file"), F.col("first.line").alias("line"))


def amended(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    action = F.element_at(F.array(*map(F.lit, ("set_severity", "disable_rule", "enable_rule"))), (F.col("event_id") % 3 + 1).cast("int"))
    severity = F.when(F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 2 == 0, "info").otherwise("error"))
    return adjudication.replayed_amendments(e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("rule_id"), action.alias("action"), severity.alias("severity"), F.col("event_id").alias("ord")))


def best_precedents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decided(spark, sf_dir)
    wanted = d.select(F.col("rule_id").alias("rule"), "pattern_hash").distinct()
    return adjudication.matches(wanted, d).select("rule", "pattern_hash", F.col("rank").cast("int").alias("rank"), "ord", F.round("effective", 6).alias("effective"))


def overrides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("ev.click", "error"), ("ev.view", "warning")], "rule string, new_severity string")


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'click'")
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), (F.col("event_id") % 50 + 1).cast("int").alias("line")).distinct()


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of findings, as a rank within each file so that no task gets all of them."""
    from .model import severity_rank

    order = Window.partitionBy("file").orderBy(severity_rank(F.col("severity")), "line", "rule", "seq")
    return projected(spark, sf_dir).select("file", "seq", F.row_number().over(order).alias("place"))


def scan_generated(extension: str) -> Callable[[SparkSession, str], DataFrame]:
    """The whole scan over ten thousand generated lines of one language."""
    return lambda s, d: scan(s.createDataFrame(generated(extension), "path string, content string"), extensions=(extension,)).select(*KEYS)


def on_code(rules) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: rules(code_files(s)).select(*KEYS).distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_documents": lambda s, d: scan(document_files(s, d)).select(*KEYS),
    "scan_code": lambda s, d: scan(code_files(s)).select(*KEYS),
    "scan_10k_go": scan_generated(".go"),
    "scan_10k_js": scan_generated(".js"),
    "scan_10k_py": scan_generated(".py"),
    "rule_line_pack_documents": lambda s, d: line_rules.line_findings(split_lines(document_files(s, d))).select(*KEYS),
    "rule_line_pack_code": lambda s, d: line_rules.line_findings(split_lines(code_files(s))).select(*KEYS),
    "rule_structure_lines_code": lambda s, d: line_rules.line_findings(split_lines(code_files(s)), brace_rules.LINE_RULES).select(*KEYS),
    "rule_file_pack_code": on_code(lambda f: file_rules.file_findings(split_lines(f))),
    "rule_flow_pack_code": on_code(lambda f: flow_rules.flow_findings(split_lines(f))),
    "rule_python_code": on_code(lambda f: python_rules.python_findings(f)),
    "rule_go_js_code": on_code(lambda f: brace_rules.brace_findings(f, split_lines(f))),
    "lines_explode": lambda s, d: exploded(split_lines(document_files(s, d))).select(F.col("path").alias("file"), "line", "code"),
    "file_routing": lambda s, d: document_files(s, d).groupBy(T.extension(F.col("path")).alias("ext")).agg(F.count("*").alias("files"), F.sum(F.length("content")).alias("chars")),
    "findings_dedup": lambda s, d: findings.deduplicated(projected(s, d)).select("rule", "file", "line", "code", "seq"),
    "findings_sort_rank": ranked,
    "severity_override": lambda s, d: findings.overridden(projected(s, d), overrides(s)).groupBy("rule", "severity").agg(F.count("*").alias("n")),
    "rule_disable": lambda s, d: findings.enabled(projected(s, d), ["ev.view"]).groupBy("rule").agg(F.count("*").alias("n")),
    "changed_lines_semi": lambda s, d: findings.on_changed_lines(projected(s, d), changed(s, d)).select("rule", "file", "line", "seq"),
    "precedent_suppress": suppressed,
    "precedent_topk": best_precedents,
    "severity_summary": lambda s, d: findings.severity_summary(projected(s, d)),
    "category_counts": lambda s, d: findings.category_counts(projected(s, d).withColumn("rule", F.concat(F.col("severity"), F.lit("."), F.col("rule")))),
    "repeated_errors": lambda s, d: findings.repeated_errors(projected(s, d), 2),
    "law_candidates": lambda s, d: adjudication.law_candidates(decided(s, d), 5),
    "confidence_fold": lambda s, d: adjudication.folded_confidence(decided(s, d)),
    "judge_batches": batches,
    "cost_running_budget": budget,
    "amendment_replay": amended,
    "violation_hash": lambda s, d: projected(s, d).select("seq", T.violation_hash(F.col("rule"), F.col("file"), F.col("line"), F.col("code")).alias("hash")),
    "pattern_hash": lambda s, d: projected(s, d).select("seq", T.pattern_hash(F.col("rule"), F.col("code")).alias("hash")),
    "context_window": contexts,
    "hunk_expand": hunks,
    "debounce_sessions": sessions,
}

from . import cases, oracles, samples, tables  # noqa: E402

QUERIES |= cases.QUERIES | tables.QUERIES | {"rules_over_documents": samples.found}
ORACLES = oracles.ORACLES | cases.ORACLES | tables.ORACLES | {"rules_over_documents": samples.oracle()}

__all__ = ["ORACLES", "QUERIES", "flagship"]
