"""The rules as a table: listing, selection by language, counts by language group, descriptions of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import JS, extension
from ..model import category
from . import brace_rules, file_rules, flow_rules, line_rules, python_rules

CATALOGUE = "id string, severity string, file_types array<string>, message string, family string"
SH = (".sh", ".bash")
TESTED = (".go", *JS, *SH)
SYNTAX = (".go", *JS, ".py", ".pyi")
#: File types of the rules about whole files and flow; ``*`` stands for every file.
TYPES = {
    "bad-defaults.missing-pipefail": SH,
    "silent-fallback.no-err-trap": SH,
    "bad-defaults.no-strict-mode": (".cjs",),
    "trace-gaps.no-unhandled-rejection": (".js", ".ts", ".mjs"),
    "trace-gaps.no-logging-config": (".py",),
    "rust.unwrap-in-production": (".rs",),
    "trace-gaps.no-stderr-capture": (".go",),
    "config-smells.missing-gitignore": ("*",),
    "config-smells.dotenv-no-example": ("*",),
    "code-quality.unreachable-code": SYNTAX,
    "code-quality.error-swallowing": (*JS, ".py", ".pyi"),
    "code-quality.unused-variable": SYNTAX,
    "silent-fallback.hidden-failure-bash": SH,
    "test-isolation.test-leaked-server": TESTED,
    "test-isolation.test-leaked-sse": TESTED,
    "test-isolation.test-missing-cleanup": TESTED,
}
#: Language groups by file type; the first type of a rule that has one decides.
GROUPS = {"go": (".go",), "jsts": JS, "python": (".py", ".pyi"), "bash": SH}


def rules(spark: SparkSession) -> DataFrame:
    """One row a rule (``CATALOGUE``), of every family."""
    rows = [(r.id, r.severity, list(r.extensions), r.message, family) for family, own in (("line", line_rules.RULES), ("structure", brace_rules.LINE_RULES)) for r in own]
    rows += [(k, severity, [".py"], message, "python") for k, severity, message, *_ in python_rules.conditions()]
    rows += [(k, severity, list(JS) if ".js-" in k or k in brace_rules.ON_JS else [".go"], message, "structure") for k, severity, message, *_ in brace_rules.conditions()]
    rows += [(k, severity, list(TYPES[k]), message, family) for family, own in (("file", file_rules.RULES), ("flow", flow_rules.RULES)) for k, severity, message, _ in own]
    return spark.createDataFrame(list({r[0]: r for r in reversed(rows)}.values()), CATALOGUE)


def of_types(catalogue: DataFrame, types: list[str]) -> DataFrame:
    """Rules that name one of the file types; ``*`` is a type like others here."""
    return catalogue.where(F.arrays_overlap("file_types", F.array(*map(F.lit, types))))


def applicable(files: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``files`` (path, any more) with the rules about them: ``rules`` by id, those of any file (``*``) included, and the file's language group.

    Rules are gathered by file type first, so that a file meets one row; a type that no rule names meets those of any file.
    """
    typed = catalogue.select("id", F.explode("file_types").alias("type"))
    everywhere = F.array(*(F.lit(r["id"]) for r in typed.where("type = '*'").distinct().collect())).cast("array<string>")  # of about a hundred rows
    own = typed.where("type <> '*'").groupBy(F.col("type").alias("_type")).agg(F.collect_set("id").alias("_own"))  # a row a type
    rows = files.withColumn("_type", extension(F.col("path"))).join(F.broadcast(own), "_type", "left")
    ids = F.array_sort(F.array_union(F.coalesce("_own", F.array().cast("array<string>")), everywhere))
    return rows.select(*files.columns, ids.alias("rules"), group_of(F.col("_type")).alias("language"))


def listing(catalogue: DataFrame) -> DataFrame:
    """Rules by id with their severities in capitals and their types in a row."""
    return catalogue.select("id", category(F.col("id")).alias("category"), F.upper("severity").alias("severity"), F.array_join("file_types", ",").alias("files")).orderBy("id")


def group_of(file_type: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, types in GROUPS.items():
        out = F.when(file_type.isin(*types), name).otherwise(out)
    return out


def per_group(catalogue: DataFrame) -> DataFrame:
    """Numbers of rules by language group; rules of no group are not counted."""
    first = F.get(F.filter(F.transform("file_types", group_of), lambda x: x.isNotNull()), F.lit(0))
    return catalogue.groupBy(first.alias("language")).agg(F.count("*").alias("rules")).where("language is not null")


def described_by(findings: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Findings with their rule's description; an unknown rule has none."""
    return findings.join(F.broadcast(catalogue.select(F.col("id").alias("rule"), F.col("message").alias("description"))), "rule", "left")  # about a hundred rows
