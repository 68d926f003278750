"""Rules about whole files and their siblings: array functions over a file's lines, and joins on directories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .line_rules import described

# Rule ids, severities and patterns.
PIPEFAIL = r"set\s+.*pipefail"
SET_E, TRAP_ERR = r"set\s+-[a-zA-Z]*e", r"trap\s+.*\bERR\b"
USE_STRICT = r"['\"]use strict['\"]"
REJECTION, ENTRY = r"process\.on\s*\(\s*['\"]unhandledRejection['\"]", r"(?:\.listen\s*\(|app\.use\s*\(|createServer\s*\(|main\s*\(\s*\))"
LOGGING, PY_MAIN = r"logging\.(basicConfig|getLogger)\s*\(", r"if\s+__name__\s*==\s*['\"]__main__['\"]"
UNWRAP, CFG_TEST = r"\.unwrap\(\)", r"#\[cfg\(test\)\]"
EXEC, CAPTURE = r"\bexec\.(?:Command|CommandContext)\s*\(", r"\.StderrPipe\s*\(|\.CombinedOutput\s*\(|\.Stderr\s*="
SHELL = (".sh", ".bash")
RULES = [
    ("bad-defaults.missing-pipefail", "error", "The script goes on after failures in pipes", "Put set -euo pipefail at the top"),
    ("silent-fallback.no-err-trap", "info", "Errors end the script without a trace", "Add a trap for ERR"),
    ("bad-defaults.no-strict-mode", "info", "The module is not strict", "Start with 'use strict'"),
    ("trace-gaps.no-unhandled-rejection", "warning", "Rejections are not caught at the entry point", "Handle unhandledRejection"),
    ("trace-gaps.no-logging-config", "warning", "The program never sets up logging", "Configure logging at the start"),
    ("rust.unwrap-in-production", "error", "unwrap panics on errors", "Handle the error"),
    ("trace-gaps.no-stderr-capture", "info", "The command's error output is lost", "Capture it"),
    ("config-smells.missing-gitignore", "warning", "The .env file is not ignored", "List it in .gitignore"),
    ("config-smells.dotenv-no-example", "info", "The .env file has no example", "Add .env.example"),
]


def any_line(pattern: str, skip: str | None = None) -> Column:
    """Whether a line matches; lines whose trimmed text starts with ``skip`` do not count."""
    return F.exists("text", lambda x: T.matches(x, pattern) & (~T.trimmed(x).startswith(skip) if skip else F.lit(True)))


def first_line(test) -> Column:
    """Number and text of the first line for which ``test`` holds, or null."""
    numbered = F.transform("text", lambda x, i: F.struct((i + 1).cast("int").alias("line"), x.alias("code"), test(x).alias("ok")))
    return F.get(F.filter(numbered, lambda x: x["ok"]), F.lit(0))


def captured(i: Column) -> Column:
    """Whether error output is captured on line ``i`` (from 0) or the six after it, up to the next command."""
    after = F.slice("text", i + 2, F.lit(6))
    stop = F.array_position(F.transform(after, lambda x: T.matches(x, EXEC)), True)
    own = F.concat(F.slice("text", i + 1, F.lit(1)), F.when(stop > 0, F.slice(after, F.lit(1), stop.cast("int") - 1)).otherwise(after))
    return F.exists(own, lambda x: T.matches(x, CAPTURE))


def file_findings(texts: DataFrame, extensions: tuple[str, ...] | None = None) -> DataFrame | None:
    """Findings of all rules here over files split into lines; with ``extensions`` of those about such files, none if there are none."""
    path, ext = F.col("path"), T.extension(F.col("path"))
    guard, none = T.test_guards(path), F.array().cast("array<struct<line:int,code:string,seq:int>>")
    one = lambda k, test: F.when(test, F.array(F.struct(F.lit(1).alias("line"), F.get("text", F.lit(0)).alias("code"), F.lit(k).alias("seq")))).otherwise(none)
    shell = ext.isin(*SHELL)
    top = F.coalesce(F.get("text", F.lit(0)), F.lit(""))
    set_e = first_line(lambda x: T.matches(x, SET_E) & ~T.trimmed(x).startswith("#"))
    code = first_line(lambda x: (T.trimmed(x) != "") & ~T.trimmed(x).startswith("//") & ~T.trimmed(x).startswith("/*"))
    trap_free = shell & ~matches_test_dir(path) & ~any_line(TRAP_ERR, "#") & set_e.isNotNull()
    each = lambda k, test: F.transform(F.filter(F.transform("text", lambda x, i: F.struct((i + 1).cast("int").alias("line"), x.alias("code"), test(x, i).alias("ok"))), lambda s: s["ok"]), lambda s: F.struct(s["line"], s["code"], F.lit(k).alias("seq")))
    parts = [
        (SHELL, one(0, shell & top.startswith("#!/") & top.contains("bash") & ~any_line(PIPEFAIL, "#"))),
        (SHELL, F.when(trap_free, F.array(F.struct(set_e["line"].alias("line"), set_e["code"].alias("code"), F.lit(1).alias("seq")))).otherwise(none)),
        ((".cjs",), one(2, (ext == ".cjs") & code.isNotNull() & ~T.matches(code["code"], USE_STRICT))),
        ((".js", ".ts", ".mjs"), one(3, ext.isin(".js", ".ts", ".mjs") & ~guard["js_test"] & any_line(ENTRY) & ~any_line(REJECTION))),
        ((".py",), one(4, (ext == ".py") & ~guard["py_test"] & any_line(PY_MAIN) & ~any_line(LOGGING))),
        ((".rs",), F.when((ext == ".rs") & ~guard["rs_test"] & ~any_line(CFG_TEST), each(5, lambda x, i: T.matches(x, UNWRAP) & ~T.trimmed(x).startswith("//"))).otherwise(none)),
        ((".go",), F.when((ext == ".go") & ~guard["go_test"], each(6, lambda x, i: T.matches(x, EXEC) & ~T.trimmed(x).startswith("//") & ~captured(i))).otherwise(none)),
    ]
    kept = [(own, part) for own, part in parts if extensions is None or set(own) & set(extensions)]
    found = [sibling_findings(texts)] if extensions is None or ".env" in extensions else []
    if kept:
        rows = texts.where(ext.isin(*(x for own, _ in kept for x in own)))
        found.append(rows.select("path", F.explode(F.concat(*(part for _, part in kept))).alias("x")).select("path", "x.line", "x.code", "x.seq"))
    return described(reduce(DataFrame.unionByName, found), RULES) if found else None


#: Rules about a file and its neighbours, numbered after the others.
SIBLING_RULES = RULES[7:]


def about_siblings(found: DataFrame) -> DataFrame:
    return described(found, RULES)


def matches_test_dir(path: Column) -> Column:
    return T.matches(path, r"/(?:tests|test|testdata)/") | path.endswith(".bats")


def ignores_env() -> Column:
    def hit(x: Column) -> Column:
        t = T.trimmed(x)
        c = F.regexp_replace(t, "^/", "")
        return ~t.startswith("#") & ~t.startswith("!") & ((c == ".env") | c.startswith(".env.") | c.startswith(".env*") | c.endswith("/.env") | c.contains("/.env.") | c.contains("/.env*"))

    return F.exists("text", hit)


def sibling_findings(texts: DataFrame) -> DataFrame:
    """``.env`` files whose directory lacks a fitting .gitignore or an example."""
    at = texts.where(T.base(F.col("path")).isin(".env", ".gitignore", ".env.example")).select("path", "text", T.base(F.col("path")).alias("base"), T.directory(F.col("path")).alias("dir"))
    env = at.where("base = '.env'").select("path", F.lit(1).alias("line"), F.coalesce(F.get("text", F.lit(0)), F.lit(".env")).alias("code"), "dir")
    ignored = at.where(F.col("base") == ".gitignore").where(ignores_env()).select("dir")
    example = at.where("base = '.env.example'").select("dir")
    bare = at.where("base = '.gitignore'").where(~ignores_env()).select("path", F.lit(1).alias("line"), F.coalesce(F.get("text", F.lit(0)), F.lit(".gitignore")).alias("code"), "dir")
    first = env.join(ignored, "dir", "left_anti").unionByName(bare.join(env.select("dir"), "dir", "left_semi")).withColumn("seq", F.lit(7))
    second = env.join(example, "dir", "left_anti").withColumn("seq", F.lit(8))
    return first.unionByName(second).drop("dir")
