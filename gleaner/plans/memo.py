"""A scan that remembers: findings of files that were not written since, under the same rules, are read and not found anew."""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..functions import text
from ..operators import brace_rules, file_rules, flow_rules, line_rules, lines, python_rules
from ..operators.file_rules import sibling_findings
from ..operators.lines import split_lines
from ..sources import stores
from ..sources.files import with_contents
from .scan import all_findings, finished

NAMES = ("rule", "severity", "line", "code", "message", "suggestion", "seq")
#: Rules about a file's neighbours: no memo of the file alone can tell.
ABOUT_OTHERS = tuple(rule for rule, *_ in file_rules.SIBLING_RULES)


@cache
def rule_set() -> str:
    """A hash of everything that decides what a file's findings are: any change to the rules makes a new one."""
    modules = (brace_rules, file_rules, flow_rules, line_rules, lines, python_rules, text)
    return hashlib.sha256("".join(inspect.getsource(m) for m in modules).encode()).hexdigest()


def remembered(listing: DataFrame, folder: str, read: Callable[[DataFrame], DataFrame] = with_contents, rules: str | None = None, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """``listing`` (path, mtime_ns) with each file's ``findings`` and whether they were found now (``fresh``).

    ``folder`` keeps the memo as a table with versions: path, time of writing, rule set and findings. Files that it has are
    not read; ``read`` gives the others their ``content``, once. Then the memo of exactly these files takes the old one's place in one
    commit, so a run that dies leaves the old one. Findings that depend on other files are not part of it.
    """
    spark, rules = listing.sparkSession, rules or rule_set()
    known = stores.read(spark, folder, "memo").where(F.col("rules") == rules).select("path", "mtime_ns", "findings")
    looked = storage.saved(listing.select("path", "mtime_ns").join(known, ["path", "mtime_ns"], "left"), "looked")
    unknown = looked.where("findings is null").select("path", "mtime_ns")
    files = storage.saved(read(unknown).select("path", "mtime_ns", "content"), "contents")
    found = all_findings(files.select("path", "content"), extensions).where(~F.col("rule").isin(*ABOUT_OTHERS))
    own = found.groupBy(F.col("file").alias("path")).agg(F.array_sort(F.collect_list(F.struct(*NAMES))).alias("findings"))
    kind = known.schema["findings"].dataType
    new = files.select("path", "mtime_ns", F.col("content").isNull().alias("unread")).join(own, "path", "left").withColumn("findings", F.coalesce("findings", F.array().cast(kind)).cast(kind))
    rows = looked.where("findings is not null").withColumns({"fresh": F.lit(False), "unread": F.lit(False)}).unionByName(new.withColumn("fresh", F.lit(True)))
    rows = storage.saved(rows, "remembered")
    # A file whose content could not be read is looked at again next time; its row says so, and findings are not moved to tell.
    stores.replace(rows.where("not unread").select("path", "mtime_ns", F.lit(rules).alias("rules"), "findings", F.lit(0).alias("ord")), folder, "memo")
    return rows.drop("unread")


def memo_scan(listing: DataFrame, folder: str, read: Callable[[DataFrame], DataFrame] = with_contents, rules: str | None = None, extensions: tuple[str, ...] | None = None, **how) -> DataFrame:
    """``scan`` over the files of ``listing`` (path, mtime_ns), of which only those written since the last one are read.

    Settings (``how``: disabled, overrides, precedents, changed, root) act on remembered findings as on new ones. The few files
    that rules about neighbours look at are read each time.
    """
    rows = remembered(listing, folder, read, rules, extensions)
    found = rows.select(F.col("path").alias("file"), F.explode("findings").alias("x")).select("x.rule", "x.severity", "file", "x.line", "x.code", "x.message", "x.suggestion", "x.seq")
    about = read(listing.where(text.base(F.col("path")).isin(".env", ".gitignore", ".env.example")).select("path", "mtime_ns"))
    return finished(found.unionByName(file_rules.about_siblings(sibling_findings(split_lines(about)))), **how)
