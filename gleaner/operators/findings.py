"""The algebra of findings: first per place, order, overrides, suppression, changed lines, context, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..model import category, severity_rank


def deduplicated(findings: DataFrame) -> DataFrame:
    """The finding of smallest ``seq`` per (rule, file, line); the minimum is taken before the shuffle too."""
    names = [c for c in findings.columns if c not in ("rule", "file", "line")]
    first = F.min_by(F.struct(*names), F.struct("seq", "code", "message")).alias("first")
    return findings.groupBy("rule", "file", "line").agg(first).select("rule", "file", "line", *(f"first.{c}" for c in names)).select(*findings.columns)


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(severity_rank(F.col("severity")), "file", "line", "rule", "seq")


def overridden(findings: DataFrame, overrides: DataFrame) -> DataFrame:
    """Severities replaced by ``overrides`` (rule, new_severity), a table of at most one row a rule."""
    joined = findings.join(overrides, "rule", "left")
    return joined.withColumn("severity", F.coalesce("new_severity", "severity")).select(*findings.columns)


def enabled(findings: DataFrame, disabled: list[str]) -> DataFrame:
    return findings.where(~F.col("rule").isin(*disabled)) if disabled else findings


def on_changed_lines(findings: DataFrame, changed: DataFrame | None) -> DataFrame:
    """Findings on lines of ``changed`` (file, line); None passes all, an empty table none."""
    return findings if changed is None else findings.join(changed, ["file", "line"], "left_semi")


def last_decisions(precedents: DataFrame) -> DataFrame:
    """The decision inserted last per (rule_id, violation_hash)."""
    return precedents.groupBy("rule_id", "violation_hash").agg(F.max_by("decision", "ord").alias("decision"))


def not_allowed(findings: DataFrame, precedents: DataFrame, root: str = "") -> DataFrame:
    """Findings whose last decision is not ``allow``; their paths count from ``root``."""
    allowed = last_decisions(precedents).where("decision = 'allow'").select(F.col("rule_id").alias("rule"), F.col("violation_hash").alias("_v"))
    hashed = findings.withColumn("_v", T.violation_hash(F.col("rule"), F.col("file"), F.col("line"), F.col("code"), root))
    return hashed.join(allowed, ["rule", "_v"], "left_anti").select(*findings.columns)


def with_context(findings: DataFrame, texts: DataFrame, reach: int = 10) -> DataFrame:
    """Each finding's lines around it, numbered and with its own marked; ``texts`` are files split into lines.

    A file's lines are one array, of which the finding takes a slice: findings are the small side of the join, so
    files need no shuffle.
    """
    joined = findings.join(texts.select(F.col("path").alias("file"), F.col("text").alias("_lines")), "file")
    first = F.greatest(F.col("line") - reach, F.lit(1))
    mark = lambda at: F.when(at == F.col("line"), ">> ").otherwise("   ")
    rows = F.transform(F.slice("_lines", first, F.col("line") + reach - first + 1), lambda x, i: F.concat(mark(first + i), F.lpad((first + i).cast("string"), 5, " "), F.lit(" | "), x))
    return joined.select(*findings.columns, F.array_join(rows, "\n").alias("context"))


def severity_summary(findings: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("severity") == s)
    return findings.agg(F.count("*").alias("total"), count("error").alias("errors"), count("warning").alias("warnings"), count("info").alias("info"))


def category_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy(category(F.col("rule")).alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def repeated_errors(findings: DataFrame, threshold: int) -> DataFrame:
    """Errors per (rule, file) above ``threshold``."""
    return findings.where("severity = 'error'").groupBy("rule", "file").agg(F.count("*").alias("n")).where(F.col("n") > threshold).orderBy("rule", "file")


def has_errors(findings: DataFrame) -> bool:
    return bool(findings.where("severity = 'error'").take(1))


def expanded_hunks(diff: DataFrame) -> DataFrame:
    """Changed lines (file, line) of hunk headers ``@@ -a,b +start,count @@`` in ``diff`` (file, header)."""
    part = lambda i: F.regexp_extract("header", r"^@@ [^+]*\+([0-9]+)(?:,([0-9]+))?", i)
    start, n = part(1).try_cast("int"), F.coalesce(part(2).try_cast("int"), F.lit(1))
    own = diff.withColumn("_s", start).withColumn("_n", n).where("_s is not null and _n > 0")
    return own.select("file", F.explode(F.sequence(F.col("_s"), F.col("_s") + F.col("_n") - 1)).alias("line")).distinct()


def exit_code(errors: Column) -> Column:
    return F.when(errors > 0, 1).otherwise(0)
