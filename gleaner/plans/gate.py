"""The gate before a commit and the warm-up of the stores: scan, judge, decide, and remember what was decided."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import storage
from ..operators import adjudication, findings, judging
from ..sources import stores
from .scan import scan

Answers = DataFrame | Callable[[DataFrame], DataFrame]


def gated(found: DataFrame, verdicts: DataFrame, *keys: str) -> DataFrame:
    """What the gate says of each group of ``keys`` among findings: ``code`` 1 stops, 0 lets pass.

    A guilty verdict stops. Where a finding's batch has no verdict, judgement was not to be had for that group, and errors
    decide instead (``by``: judge or scan). Without ``keys`` there is one row, also of no findings. Findings are counted by pattern before
    they meet the verdicts, so a pattern of most findings is one row a group.
    """
    rows = adjudication.hashed(found).groupBy(*keys, "rule", "pattern_hash").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "error").alias("e"))
    rows = rows.join(verdicts.select("rule", "pattern_hash", "verdict"), ["rule", "pattern_hash"], "left")
    total = lambda n, test=None: F.coalesce(F.sum(F.when(test, F.col(n)) if test is not None else n), F.lit(0)).cast("long")
    out = rows.groupBy(*keys).agg(total("n").alias("findings"), total("e").alias("errors"), total("n", F.col("verdict") == "guilty").alias("guilty"), total("n", F.col("verdict").isNull()).alias("unjudged"))
    judged = F.col("unjudged") == 0
    return out.withColumn("by", F.when(judged, "judge").otherwise("scan")).withColumn("code", findings.exit_code(F.when(judged, F.col("guilty")).otherwise(F.col("errors"))))


def in_index(files: DataFrame, staged: DataFrame) -> DataFrame:
    """Those of ``files`` (path, content) that ``staged`` (path) names and that are in no folder ``testdata``."""
    return files.where(~F.array_contains(F.split("path", "/"), "testdata")).join(staged.select("path").distinct(), "path", "left_semi")


def hook_gate(files: DataFrame, staged: DataFrame, folder: str, judge: Answers, at: Column, root: str = "", batch: str | None = None, extensions: tuple[str, ...] | None = None, **how) -> DataFrame:
    """One row of ``gated`` for the staged files; what was decided goes to the stores in ``folder``, unless judgement was not to be had.

    Where the ``extensions`` of the staged files are known, only rules about them are planned. Settings (``how``: budget, dearest,
    least, sure) are those of ``judging.judged``.
    """
    past = stores.read(files.sparkSession, f"{folder}/precedents", "precedents")
    found = storage.saved(adjudication.hashed(scan(in_index(files, staged), precedents=past, root=root)), "hook-findings")
    verdicts = storage.saved(judging.judged(found, past, judge, strict=False, **how), "hook-verdicts")
    out = storage.saved(gated(found, verdicts), "hook-gate")
    if out.first()["by"] == "judge":
        remember(found, verdicts, folder, at, root=root, batch=batch)
    return out


def remember(found: DataFrame, verdicts: DataFrame, folder: str, at: Column, threshold: int = 10, root: str = "", batch: str | None = None) -> DataFrame:
    """Puts advisory findings into the store of debt, decisions into that of precedents; returns the law candidates, stored too.

    Findings are taken in order of file, line and ``seq``: ranges are sorted side by side, so no task gets them all. Each store changes
    by one commit; with a ``batch`` id a run that is repeated after it broke off adds nothing twice. Without a
    candidate the stored ones stay.
    """
    spark, order = found.sparkSession, ("file", "line", "rule", "seq")
    dealt = judging.dealt_out(found, verdicts).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = storage.saved(dealt.withColumn("seq", F.monotonically_increasing_id()), "dealt")
    debts = judging.debts(dealt, at).withColumn("ord", F.monotonically_increasing_id())
    stores.append(debts, f"{folder}/debt", "debt", batch)
    made = storage.saved(judging.decisions(dealt, at, root), "decisions")
    stores.upsert(spark, f"{folder}/precedents", "precedents", lambda old: stores.with_judgments(old, made), batch)
    laws = adjudication.law_candidates(made, threshold)
    # Candidates are patterns decided often; their numbering passes one task.
    place = F.row_number().over(Window.orderBy(F.desc("n"), "rule_id", "decision", "pattern_hash")) - 1
    rows = storage.saved(laws.select("rule_id", "pattern_hash", "decision", F.col("n").cast("int").alias("count"), F.lit(threshold).alias("threshold"), F.col("first_seen").cast("timestamp").alias("first_seen"), F.col("last_seen").cast("timestamp").alias("last_seen"), place.cast("long").alias("ord")), "laws")
    stores.replace(rows, f"{folder}/laws", "laws")
    return rows


def warm_up(found: DataFrame, folder: str, judge: Answers, at: Column, threshold: int = 10, root: str = "", batch: str | None = None, **how) -> DataFrame:
    """Judges all findings of a tree against the stores in ``folder`` and remembers what was decided; returns the verdicts, one a batch.

    A batch that gets neither a verdict nor a precedent fails the run before anything is stored.
    """
    past = stores.read(found.sparkSession, f"{folder}/precedents", "precedents")
    # Findings are dealt to all tasks, whatever files they come from, and patterns worked out once.
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = storage.saved(adjudication.hashed(found.repartition(tasks, "file", "line", "seq")), "findings")
    verdicts = storage.saved(judging.judged(found, past, judge, strict=True, **how), "verdicts")
    remember(found, verdicts, folder, at, threshold, root, batch)
    return verdicts
