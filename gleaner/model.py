"""Schemas of the tables that the library's operators exchange."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILES = "path string, content string"
LINES = "path string, line int, code string"
FINDINGS = "rule string, severity string, file string, line int, code string, message string, suggestion string, seq long"
PRECEDENTS = (
    "rule_id string, violation_hash string, pattern_hash string, decision string, rationale string, confidence double, "
    "seen_count int, created_at timestamp, last_seen timestamp, ord long"
)

#: The order of severities; anything else comes last.
SEVERITIES = ("error", "warning", "info")


def severity_rank(severity: Column) -> Column:
    rank = F.lit(len(SEVERITIES))
    for k, name in reversed([*enumerate(SEVERITIES)]):
        rank = F.when(severity == name, k).otherwise(rank)
    return rank


def category(rule: Column) -> Column:
    """What stands before the first dot, if anything does."""
    return F.when(F.instr(rule, ".") > 1, F.substring_index(rule, ".", 1)).otherwise(rule)
