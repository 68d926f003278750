"""The scan: files to lines and nodes, all rules, then one finding per place, overrides and suppression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import brace_rules, file_rules, findings, flow_rules, line_rules, python_rules
from ..operators.lines import split_lines


def all_findings(files: DataFrame, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """Findings of every rule over ``files`` (path, content).

    Families that only need lines stay in the JVM, syntax families go through a helper that returns tables. Where
    the ``extensions`` of the files are known, only rules about them become part of the plan.
    """
    texts = split_lines(files)
    families = [
        lambda: python_rules.python_findings(files) if extensions is None or {".py", ".pyi"} & set(extensions) else None,
        lambda: brace_rules.brace_findings(files, texts, extensions),
        lambda: file_rules.file_findings(texts, extensions),
        lambda: line_rules.line_findings(texts, line_rules.of_extensions(line_rules.RULES, extensions)),
        lambda: flow_rules.flow_findings(texts, extensions),
    ]
    # Syntax rules come before line rules where both name a place.
    found = [(k, x) for k, family in enumerate(families) if (x := family()) is not None]
    return reduce(DataFrame.unionByName, (x.withColumn("seq", F.col("seq") + 1000 * k) for k, x in found))


def finished(found: DataFrame, disabled: list[str] | None = None, overrides: DataFrame | None = None, precedents: DataFrame | None = None, changed: DataFrame | None = None, root: str = "") -> DataFrame:
    """Deduplicated findings after overrides, suppression and the filter of changed lines, not yet ordered.

    Stored decisions are on paths counted from ``root``, the tree's top, so those of one checkout hold in another.
    """
    out = findings.deduplicated(findings.enabled(found, disabled or []))
    if overrides is not None:
        out = findings.overridden(out, overrides)
    if precedents is not None:
        out = findings.not_allowed(out, precedents, root)
    return findings.on_changed_lines(out, changed)


def scan(files: DataFrame, disabled: list[str] | None = None, overrides: DataFrame | None = None, precedents: DataFrame | None = None, changed: DataFrame | None = None, extensions: tuple[str, ...] | None = None, root: str = "") -> DataFrame:
    """All rules over ``files`` (path, content), then ``finished``."""
    return finished(all_findings(files, extensions), disabled, overrides, precedents, changed, root)
