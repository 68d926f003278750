"""Past decisions applied to findings: matching, confidence, batches, budget, law candidates, amendments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import folding

# Confidence where none is known, prices in USD per million tokens.
UNKNOWN = 0.5
PRICE_IN, PRICE_OUT = 0.80, 4.00


def effective(confidence: Column) -> Column:
    """Confidence within 0 to 1; a missing or non-positive one counts as undecided."""
    return F.when(F.coalesce(confidence, F.lit(0.0)) <= 0, UNKNOWN).otherwise(F.least(confidence, F.lit(1.0)))


def matches(batches: DataFrame, precedents: DataFrame, least: float = 0.6, most: int = 10) -> DataFrame:
    """For each batch (rule, pattern_hash) its best precedents: ``rank`` 1 to ``most``."""
    usable = precedents.withColumn("effective", effective(F.col("confidence"))).where(F.col("effective") >= least)
    joined = batches.select("rule", "pattern_hash").distinct().join(usable.withColumnRenamed("rule_id", "rule"), ["rule", "pattern_hash"])
    order = Window.partitionBy("rule", "pattern_hash").orderBy(F.desc("effective"), F.desc("seen_count"), F.desc("created_at"), "ord")
    return joined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hashed(findings: DataFrame) -> DataFrame:
    """Findings with their ``pattern_hash``; those that carry it already keep it, as working it out is dear."""
    if "pattern_hash" in findings.columns:
        return findings
    return findings.withColumn("pattern_hash", T.pattern_hash(F.col("rule"), F.col("code")))


def pattern_batches(findings: DataFrame) -> DataFrame:
    """Findings grouped by (rule, pattern hash): the first as representative, their number and first place."""
    order = F.struct("file", "line", "seq")
    return hashed(findings).groupBy("rule", "pattern_hash").agg(F.min_by(F.struct("file", "line", "code"), order).alias("first"), F.count("*").alias("items"), F.min(order).alias("place"))


def judged(batches: DataFrame, best: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Verdicts of batches whose best precedent is sure enough; the others have none yet."""
    top = best.where("rank = 1").select("rule", "pattern_hash", "decision", "effective")
    verdict = F.when(F.col("effective") > threshold, F.when(F.col("decision") == "allow", "not_guilty").otherwise("guilty"))
    return batches.join(top, ["rule", "pattern_hash"], "left").withColumn("verdict", verdict)


def token_cost(tokens_in: Column, tokens_out: Column) -> Column:
    least = lambda c: F.greatest(c, F.lit(0))
    return (least(tokens_in) * PRICE_IN + least(tokens_out) * PRICE_OUT) / 1e6


def within_budget(calls: DataFrame, budget: float, *order: str) -> DataFrame:
    """Calls in ``order`` with the cost spent before each and whether the budget then still lasts."""
    before = Window.partitionBy("run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("cost").over(before), F.lit(0.0))
    return calls.withColumn("spent", spent).withColumn("allowed", F.col("spent") < budget)


def folded_confidence(precedents: DataFrame) -> DataFrame:
    """Confidence and count of (rule_id, pattern_hash) after all its decisions in order of ``ord``.

    An equal decision raises the confidence, another one halves it and starts the count anew. A pattern's history is
    folded in parts by as many tasks as its rows need.
    """
    steps = precedents.select("rule_id", "pattern_hash", "ord", "decision", F.lit(False).alias("fixed"), F.col("confidence").alias("value"), F.lit(0).alias("seen"))
    last = folding.states(steps, last_only=True)
    return last.select("rule_id", "pattern_hash", "decision", F.round("after_confidence", 9).alias("confidence"), F.col("after_seen").alias("seen_count"))


def law_candidates(precedents: DataFrame, threshold: int = 10) -> DataFrame:
    """Decisions taken at least ``threshold`` times for one pattern of one rule."""
    threshold = threshold if threshold > 0 else 10
    ok = precedents.where("trim(rule_id) <> '' and trim(pattern_hash) <> '' and decision in ('allow', 'deny') and created_at is not null")
    grouped = ok.groupBy("rule_id", "pattern_hash", "decision").agg(F.count("*").alias("n"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))
    return grouped.where(F.col("n") >= threshold).orderBy(F.desc("n"), "rule_id", "pattern_hash", "decision")


def replayed_amendments(amendments: DataFrame) -> DataFrame:
    """Each rule's state (rule_id, new_severity, disabled) after all actions (those of rulings) in order of ``ord``."""
    severity = F.max_by(F.when(F.col("action") == "set_severity", F.col("severity")), F.when(F.col("action") == "set_severity", F.col("ord")))
    switch = F.max_by("action", F.when(F.col("action").isin("enable_rule", "disable_rule"), F.col("ord")))
    return amendments.groupBy("rule_id").agg(severity.alias("new_severity"), (F.coalesce(switch, F.lit("enable_rule")) == "disable_rule").alias("disabled"))


def new_amendments(proposed: DataFrame, applied: DataFrame) -> DataFrame:
    """Amendments that were not applied yet; nulls count as empty."""
    key = ["verdict_id", "rule_id", "action", "severity", "exception"]
    filled = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_{k}") for k in key]
    rest = [c for c in proposed.columns if c not in key]
    # Of equal ones the first in its ruling stays, and of those the least in its further columns.
    order = F.struct(*(c for c in ("place",) if c in rest), *(c for c in rest if c != "place"), *key)
    first = F.min_by(F.struct(*proposed.columns), order).alias("_first")
    rows = proposed.groupBy(*filled).agg(first).select("_first.*", *(f"_{k}" for k in key))
    return rows.join(applied.select(*filled), [f"_{k}" for k in key], "left_anti").select(*proposed.columns)
