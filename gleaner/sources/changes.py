"""Files and lines that a git repository changed, as tables."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.findings import expanded_hunks


def git(repository: str, *args: str) -> str:
    return subprocess.run(["git", *args], cwd=repository, check=True, capture_output=True, text=True, encoding="utf-8", errors="replace").stdout


def exists(repository: str, ref: str) -> bool:
    return subprocess.run(["git", "rev-parse", "--verify", "--quiet", ref], cwd=repository, capture_output=True).returncode == 0


def diff_base(repository: str, env: Mapping[str, str] = os.environ) -> str:
    """What changes are counted from: the target branch of the build's request, the commit before its push, or the parent."""
    target, before = env.get("GITHUB_BASE_REF", "").strip(), env.get("GITHUB_EVENT_BEFORE", "").strip()
    candidates = [f"origin/{target}" if target else "", before if before.strip("0") else "", "HEAD~1"]
    for ref in filter(None, candidates):
        if exists(repository, ref):
            return f"{ref}...HEAD"
    raise ValueError("nothing to count changes from: no base branch, no commit before, no parent")


def named(spark: SparkSession, listing: str) -> DataFrame:
    return spark.createDataFrame([(x.strip(),) for x in listing.split("\n") if x.strip()], "path string")


def staged_files(spark: SparkSession, repository: str) -> DataFrame:
    """Paths added, copied or modified in the index, but for those in a folder ``testdata``."""
    found = named(spark, git(repository, "diff", "--cached", "--name-only", "--diff-filter=ACM"))
    return found.where(~F.array_contains(F.split("path", "/"), "testdata"))


def changed_files(spark: SparkSession, repository: str, base: str) -> DataFrame:
    """Paths changed since ``base``, deletions apart."""
    return named(spark, git(repository, "diff", "--name-only", "--diff-filter=ACMRT", base, "--"))


def changed_lines(spark: SparkSession, repository: str, base: str) -> DataFrame:
    """Lines (file, line) that changed since ``base``: the hunks of one diff, expanded by Spark."""
    rows, file = [], None
    for line in git(repository, "diff", "--unified=0", "--no-ext-diff", "--no-color", "--diff-filter=ACMRT", base, "--").split("\n"):
        if line.startswith("+++ "):
            file = line[4:].removeprefix("b/").rstrip("\t")
        elif line.startswith("@@ ") and file:
            rows.append((file, line))
    return expanded_hunks(spark.createDataFrame(rows, "file string, header string"))
