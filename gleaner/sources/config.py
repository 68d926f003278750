"""Settings of a scan from a TOML file, and names of languages."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: The file looked for in a scanned folder; a parameter of ``load``.
NAME = ".gleaner.toml"
# Names of languages on the command line and their extensions.
ALIASES = {"go": "go", "js": "javascript", "javascript": "javascript", "ts": "typescript", "typescript": "typescript", "python": "python", "py": "python", "bash": "bash", "shell": "bash", "sh": "bash"}
EXTENSIONS = {"go": (".go",), "javascript": (".js", ".jsx", ".mjs", ".cjs"), "typescript": (".ts", ".tsx"), "python": (".py", ".pyi"), "bash": (".sh", ".bash"), "rust": (".rs",)}


@dataclass
class Config:
    """What a scan leaves out and how severe rules are; languages that are not named are on."""

    exclude_dirs: list[str] = field(default_factory=list)
    exclude_patterns: list[str] = field(default_factory=list)
    languages: dict[str, bool] = field(default_factory=dict)
    disable: list[str] = field(default_factory=list)
    severity: dict[str, str] = field(default_factory=dict)

    def overrides(self, spark: SparkSession) -> DataFrame | None:
        return spark.createDataFrame([*self.severity.items()], "rule string, new_severity string") if self.severity else None


def load(folder: str, explicit: str = "", name: str = NAME) -> Config:
    """The settings in ``explicit``, which must exist, else in ``name`` in ``folder``, else none."""
    path = Path(explicit) if explicit else Path(folder) / name
    if not explicit and not path.is_file():
        return Config()
    read = tomllib.loads(path.read_text(encoding="utf-8"))
    scan, rules = read.get("scan", {}), read.get("rules", {})
    for pattern in scan.get("exclude_patterns", []):
        glob(pattern)
    return Config(scan.get("exclude_dirs", []), scan.get("exclude_patterns", []), scan.get("languages", {}), rules.get("disable", []), rules.get("severity", {}))


def languages(value: str) -> list[str]:
    """The languages of a comma list of names in any case, each once; an unknown name is an error, none too."""
    found: dict[str, None] = {}
    for name in filter(None, (x.strip() for x in value.split(","))):
        if name.lower() not in ALIASES:
            raise ValueError(f"unknown language {name!r}")
        found[ALIASES[name.lower()]] = None
    if not found:
        raise ValueError("no language is named")
    return [*found]


def only(value: str) -> dict[str, bool]:
    """Switches for the languages named and against the others that have a name; rust has none and stays on."""
    return {x: x in languages(value) for x in dict.fromkeys(ALIASES.values())}


def types_of(value: str) -> list[str]:
    """File types of the languages named."""
    return [e for x in languages(value) for e in EXTENSIONS[x]]


def of_languages(files: DataFrame, switches: dict[str, bool]) -> DataFrame:
    """Files without those of languages switched off; files of no language always pass.

    On a table with ``ext``, as source trees have, the filter reaches the reader and such files are not opened.
    """
    off = [e for name, on in switches.items() if not on for e in EXTENSIONS[name]]
    ext = F.col("ext") if "ext" in files.columns else T.extension(F.col("path"))
    return files.where(~ext.isin(*off)) if off else files


def glob(pattern: str) -> str:
    """A file name pattern as a regular expression: ``*``, ``?``, ``[a-z]``, ``[^a]`` and backslash; a malformed one is an error."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = pattern.find("]", i + 1 + pattern.startswith("^", i))
            if end < 0:
                raise ValueError(f"malformed pattern {pattern!r}")
            out.append("[" + pattern[i:end].replace("&&", r"&\&").replace("[", r"\[") + "]")
            i = end + 1
        elif c == "\\":
            if i == len(pattern):
                raise ValueError(f"malformed pattern {pattern!r}")
            out.append(re.escape(pattern[i]))
            i += 1
        else:
            out.append(re.escape(c))
    return "".join(out)


def excluded(name: Column, patterns: list[str]) -> Column:
    """Whether a base name fits one of the patterns."""
    return name.rlike("(?s)^(?:" + "|".join(map(glob, patterns)) + r")\z") if patterns else F.lit(False)


def fits(name: str, patterns: list[str]) -> bool:
    """``excluded`` for one name on the driver."""
    return any(re.fullmatch(glob(p), name, re.S) for p in patterns)

