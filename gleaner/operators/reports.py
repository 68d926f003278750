"""Findings as reports: a JSON document with its summary, text blocks for a terminal, and JSON reports read back."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions import text as T
from ..model import severity_rank
from . import running
from .findings import category_counts, ordered, severity_summary

FINDING = "rule string, severity string, file string, line int, code string, context string, message string, suggestion string"
SUMMARY = "total int, errors int, warnings int, info int, files_scanned int, duration_ms long"
REPORT = f"version string, scan_time string, path string, duration_ms long, findings array<struct<{FINDING}>>, summary struct<{SUMMARY}>"
#: Bytes of code in a text report and labels of severities.
MOST_CODE = 120
LABELS = {"error": "ERROR ", "warning": "WARN  ", "info": "INFO  "}


def label(severity: Column) -> Column:
    out = F.lit(" " * 6)
    for name, text in LABELS.items():
        out = F.when(severity == name, text).otherwise(out)
    return out


def shortened(code: Column, most: int = MOST_CODE) -> Column:
    """Trimmed code, cut after ``most`` bytes with an ellipsis; a character cut in two becomes the replacement character."""
    code = T.trimmed(code)
    cut = F.decode(F.substring(F.encode(code, "UTF-8"), 1, most), "UTF-8")
    return F.when(F.octet_length(code) > most, F.concat(cut, F.lit("…"))).otherwise(code)


def rfc3339(at: Column) -> Column:
    """A time in UTC to the second, whatever the session's zone: seconds since 1970 are counted, no local form is made.

    A time without a zone is one of UTC.
    """
    seconds = F.unix_seconds(at.cast("timestamp"))
    day, rest = F.floor(seconds / 86400).cast("int"), F.pmod(seconds, F.lit(86400))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    own = F.concat(F.date_from_unix_date(day).cast("string"), F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest / 60) % 60), F.lit(":"), two(rest % 60), F.lit("Z"))
    bare = F.regexp_replace(at.cast("timestamp_ntz").cast("string"), r"^(\S+) (\d\d:\d\d:\d\d).*$", "$1T$2Z")
    return F.when(F.typeof(at) == "timestamp_ntz", bare).otherwise(own)


#: A run's cost as a log has it.
COST = "recorded_at string, llm_calls long, input_tokens long, output_tokens long, total_cost_usd double, budget_usd double, budget_exhausted boolean"


def cost_records(runs: DataFrame, at: Column, budget: Column | None = None) -> DataFrame:
    """Rows of a cost log from runs' numbers (``judging.verdict_counts``, or any of its columns' names); without a budget none is told."""
    budget = budget if budget is not None else F.lit(0.0)
    spent = F.col("budget_exhausted") if "budget_exhausted" in runs.columns else F.lit(False)
    return runs.select(
        rfc3339(at).alias("recorded_at"), F.col("llm_calls").cast("long").alias("llm_calls"), F.col("tokens_in").cast("long").alias("input_tokens"), F.col("tokens_out").cast("long").alias("output_tokens"),
        F.col("cost").cast("double").alias("total_cost_usd"), F.when(budget > 0, budget.cast("double")).alias("budget_usd"), F.when(spent, spent).alias("budget_exhausted"),
    )


#: A line of the audit of amendments.
AUDIT = "verdict_id string, applied_at string, amendment struct<rule_id:string,action:string,severity:string,exception:string,rationale:string>"


def audit_records(applied: DataFrame) -> DataFrame:
    """Lines of the audit from applied amendments (verdict_id, applied_at, amendment)."""
    return applied.select("verdict_id", rfc3339(F.col("applied_at")).alias("applied_at"), "amendment")


def json_findings(findings: DataFrame) -> DataFrame:
    """Each finding as the JSON of a report; empty context and suggestion are left out."""
    kept = lambda name: F.when(F.coalesce(F.col(name), F.lit("")) != "", F.col(name)).alias(name)
    context = kept("context") if "context" in findings.columns else F.lit(None).cast("string").alias("context")
    return findings.select("severity", "file", "line", "rule", "seq", F.to_json(F.struct("rule", "severity", "file", "line", "code", context, "message", kept("suggestion"))).alias("finding"))


def summary(findings: DataFrame, files_scanned: int, duration_ms: int) -> DataFrame:
    return severity_summary(findings).withColumns({"files_scanned": F.lit(files_scanned), "duration_ms": F.lit(duration_ms)})


def write_json(findings: DataFrame, out, path: str, files_scanned: int, scan_time: str, duration_ms: int) -> dict:
    """Writes a report to the text stream ``out`` and returns its summary; findings pass one partition at a time."""
    out.write(json.dumps({"version": "1", "scan_time": scan_time, "path": path, "duration_ms": duration_ms})[:-1] + ', "findings": [')
    for k, row in enumerate(ordered(json_findings(findings)).select("finding").toLocalIterator()):
        out.write((",\n" if k else "\n") + row["finding"])
    total = summary(findings, files_scanned, duration_ms).first().asDict()
    out.write('\n], "summary": ' + json.dumps(total) + "}\n")
    return total


def in_report(*further: str) -> list[Column]:
    return [severity_rank(F.col("severity")), *map(F.col, ("file", "line", "rule", *further))]


def write_report(findings: DataFrame, folder: str, path: str, files_scanned: int, scan_time: str, duration_ms: int) -> dict:
    """Writes the report of ``write_json`` into an empty ``folder`` by as many tasks as the findings need; returns its summary.

    The files, one after the other by name, are one JSON document: a head, a line a finding in the order of findings, the
    summary. Findings are worked out once; the summary counts what was written.
    """
    rows = running.numbered(json_findings(findings), in_report("seq", "finding"))
    line = F.concat(F.when(F.col("place") == 1, "").otherwise(","), "finding")
    rows.repartitionByRange("place").sortWithinPartitions("place").select(line.alias("value")).write.mode("append").text(folder)
    total = summary(rows, files_scanned, duration_ms).first().asDict()
    head = json.dumps({"version": "1", "scan_time": scan_time, "path": path, "duration_ms": duration_ms})[:-1] + ', "findings": [\n'
    storage.write_bytes(f"{folder}/head.json", head.encode())
    storage.write_bytes(f"{folder}/summary.json", ('], "summary": ' + json.dumps(total) + "}\n").encode())
    return total


def read_report(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of a report written by ``write_report``, split over tasks, with their ``place``; a broken line fails the job."""
    raw = spark.read.text(f"{folder}/part-*")
    texts = raw.where("value <> ''").select(F.regexp_replace("value", "^,", "").alias("_text"))
    rows = texts.select(F.from_json("_text", FINDING, {"mode": "FAILFAST"}).alias("f"), "_text").select("f.*", "_text")
    return running.numbered(rows, in_report("_text")).drop("_text")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Findings of a JSON report, in its order as ``seq``; a report without findings has none."""
    report = spark.read.schema(REPORT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = report.select(F.posexplode(F.coalesce("findings", F.array().cast(f"array<struct<{FINDING}>>"))).alias("seq", "f"))
    return rows.select("f.*", F.col("seq").cast("long").alias("seq"))


def text_blocks(findings: DataFrame) -> DataFrame:
    """One text block a finding (``block``), as a terminal shows it."""
    code = shortened(F.coalesce("code", F.lit("")))
    hint = F.coalesce("suggestion", F.lit(""))
    block = F.concat(
        label(F.col("severity")), F.lit("  "), "rule", F.lit("\n  "), "file", F.lit(":"), F.col("line").cast("string"), F.lit("\n"),
        F.when(code != "", F.concat(F.lit("  > "), code, F.lit("\n"))).otherwise(""), F.lit("  "), "message", F.lit("\n"), F.when(hint != "", F.concat(F.lit("  → "), hint, F.lit("\n"))).otherwise(""),
    )
    return findings.select("severity", "file", "line", "rule", "seq", block.alias("block"))


def write_text(findings: DataFrame, say: Callable[[str], None], files_scanned: int, duration_ms: int) -> None:
    """Gives the blocks in order, the summary and the categories to ``say``."""
    for row in ordered(text_blocks(findings)).toLocalIterator():
        say(row["block"])
    n = severity_summary(findings).first()
    say(f"Summary: {n['errors']} errors, {n['warnings']} warnings, {n['info']} info ({files_scanned} files scanned in {duration_ms}ms)")
    counts = category_counts(findings).collect()  # a row a category
    if counts:
        say("Categories: " + ", ".join(f"{r['category']} {r['n']}" for r in counts))
