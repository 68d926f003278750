"""Rules that look at a line (and its neighbours), all evaluated in one pass over the lines.

A rule is data: extensions, pattern and guards. One projection makes an array of the rules that a line
breaks and one explode turns it into findings; the scan reads each line once, whatever the rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .lines import exploded

JS, SH = T.JS, (".sh", ".bash")


@dataclass(frozen=True)
class LineRule:
    """``pattern`` is in RE2 syntax; ``on`` is what it is searched in: code, stripped or lower.

    Whatever it finds has one of ``needs``, small letters for both cases: lines without them are not searched.
    """

    id: str
    severity: str
    extensions: tuple[str, ...]
    pattern: str
    message: str
    suggestion: str
    on: str = "code"
    guards: tuple[str, ...] = ()
    unless: str = ""
    before_lacks: str = ""
    after_lacks: str = ""
    path: str = ""
    not_path: str = ""
    needs: tuple[str, ...] = ()


# Rule ids, severities, extensions and patterns.
RULES = (
    LineRule("config-smells.hardcoded-path", "warning", (*SH, ".toml", ".yaml", ".yml", ".json", ".env"), r"/(?:home|Users)/[a-zA-Z0-9_.-]+/", "A home directory is written out", "Take the path from a variable", guards=("hash", "slash"), needs=("/home/", "/users/")),
    LineRule("bad-defaults.unvalidated-env-bash", "warning", SH, r"\$\{[A-Z_][A-Z0-9_]*:[-=][^}]+\}", "A default hides a missing variable", "Check that the variable is set", guards=("hash",), unless=r"^[[:space:]]*(echo|printf)\s", needs=("${",)),
    LineRule("mock-leakage.test-fixture-ref", "warning", (".go",), r"(?:testdata/|fixture[s]?/|test_data/)", "A test fixture is named outside tests", "Keep fixture paths in tests", guards=("slash", "go_test"), unless=r"regexp\.MustCompile|regexp\.Compile|strings\.Contains|strings\.HasPrefix|strings\.HasSuffix|filepath\.", needs=("testdata/", "fixture", "test_data/")),
    LineRule("mock-leakage.jest-mock-in-src", "warning", JS, r"\bjest\.(mock|fn|spyOn)\s*\(", "A jest mock stands outside tests", "Move mocks to test files", guards=("slash", "block", "js_test"), needs=("jest.",)),
    LineRule("mock-leakage.storybook-in-src", "warning", JS, r"(?:import\s+.*from\s+|require\s*\().*\.stories\.", "A story is imported outside stories", "Import the component itself", guards=("slash", "block", "js_test"), not_path=r"\.stories\.", needs=(".stories.",)),
    LineRule("bad-defaults.ts-ignore", "warning", (".ts", ".tsx"), r"//\s*@ts-ignore\s*$", "Type errors are ignored without a reason", "Give the reason or expect the error", needs=("@ts-ignore",)),
    LineRule("bad-defaults.eslint-disable-no-reason", "info", JS, r"//\s*eslint-disable(?:-next-line|-line)?\b", "A lint rule is switched off without a reason", "Add the reason after two dashes", unless=r" -- ", needs=("eslint-disable",)),
    LineRule("trace-gaps.console-log-in-production", "info", JS, r"\bconsole\.log\s*\(", "Output goes to the console", "Use a logger", guards=("slash", "block", "js_test"), needs=("console.log",)),
    LineRule("config-smells.hardcoded-api-url", "warning", JS, "['\"`]https?://(localhost|127\\.0\\.0\\.1|api\\.)[\\w./:?&=-]*['\"`]", "A service address is written out", "Take it from the configuration", guards=("slash", "block", "js_test"), needs=("://",)),
    LineRule("config-smells.hardcoded-credentials", "error", (".go", *JS, ".py", ".pyi", *SH), r"(?i)\b(?:password|passwd|api[_-]?key|secret|secret[_-]?key|token|auth[_-]?token)\b\s*[:=]\s*[" + "\"'`][^\"'`]{4,}[\"'`]", "A credential is written out", "Read it from a secret store", on="stripped", needs=("passw", "api", "secret", "token")),
    LineRule("security.sql-injection", "error", (".go", *JS, ".py", ".pyi"), "(?i)\\b(?:select|insert|update|delete)\\b.*(?:\\+|\\$\\{)|fmt\\.sprintf\\s*\\(\\s*[\"'`]\\s*(?:select|insert|update|delete)\\b|f[\"'][^\"']*\\b(?:select|insert|update|delete)\\b[^\"']*\\{[^}]+\\}", "SQL is put together from values", "Use parameters", on="stripped", needs=("select", "insert", "update", "delete")),
    LineRule("security.command-injection", "error", (".go", *JS, ".py", ".pyi", *SH), "(?i)\\b(?:os\\.system|exec\\.command|child_process\\.exec|exec\\(|spawn\\(|subprocess\\.(?:run|call|popen))\\b.*(?:\\+|\\$\\{|fmt\\.sprintf|f[\"'])|\\bsubprocess\\.(?:run|call|popen)\\b.*\\bshell\\s*=\\s*true\\b|\\bexec\\.command\\s*\\(\\s*[\"']sh[\"']\\s*,\\s*[\"']-c[\"']", "A command is put together from values", "Pass arguments as a list", on="stripped", needs=("os.system", "exec", "spawn(", "subprocess.")),
    LineRule("trace-gaps.print-debug", "info", (".py",), r"\bprint\s*\(", "Output goes to print", "Use logging", guards=("hash", "py_test"), not_path=r"(?:^|/)(?:scripts|bin)/", needs=("print",)),
    LineRule("mock-leakage.pytest-fixture-in-src", "error", (".py",), r"@pytest\.fixture\b", "A fixture stands outside tests", "Move it to the tests", guards=("hash", "py_test"), needs=("@pytest.",)),
    LineRule("bad-defaults.type-ignore-bare", "warning", (".py",), r"#\s*type:\s*ignore\s*$", "All type errors of a line are ignored", "Name the error code"),
    LineRule("bad-defaults.noqa-bare", "info", (".py",), r"#\s*noqa\s*$", "All lint errors of a line are ignored", "Name the error code"),
    LineRule("config-smells.hardcoded-credentials-py", "error", (".py",), r"\b(?:password|passwd|api_key|apikey|secret|secret_key|token|auth_token)\s*=\s*[" + "\"'][^\"']+[\"']", "A credential is written out", "Read it from the environment", on="lower", guards=("hash", "py_test"), needs=("passw", "api", "secret", "token")),
    LineRule("config-smells.requirements-unpinned", "warning", (".txt",), r"^\s*[a-zA-Z][a-zA-Z0-9._-]*", "A requirement has no exact version", "Pin it with ==", unless=r"==", path=r"(?:^|/)requirements[^/]*\.txt$"),
    LineRule("rust.ignored-result", "error", (".rs",), r"^[[:space:]]*let _ =", "A result is thrown away", "Handle the result", guards=("slash", "rs_test")),
    LineRule("rust.panic-in-lib", "error", (".rs",), r"panic!\(", "A library panics", "Return an error", guards=("slash", "rs_test"), not_path=r"(?:^|/)main\.rs$"),
    LineRule("rust.unsafe-no-comment", "error", (".rs",), r"unsafe\s*\{", "An unsafe block lacks its reason", "Write // SAFETY: above it", guards=("slash",), before_lacks="// SAFETY:"),
    LineRule("rust.todo-in-production", "warning", (".rs",), r"todo!\(|unimplemented!\(", "Code is unfinished", "Finish it or return an error", guards=("slash", "rs_test")),
    LineRule("rust.expect-generic", "warning", (".rs",), r'\.expect\("(error|failed|fail|err|none|invalid)"\)', "The message says nothing", "Say what was expected", guards=("slash",), needs=(".expect(",)),
    LineRule("rust.boxed-error", "warning", (".rs",), r"->\s*.*Box<dyn\s+(std::error::)?Error>", "The error type is erased", "Return an error type of your own", guards=("slash",), needs=("box<dyn",)),
    LineRule("rust.process-exit", "warning", (".rs",), r"(std::process|process)::exit\(", "The process is ended from within", "Return an error", guards=("slash",)),
    LineRule("rust.allow-suppress", "info", (".rs",), r"#\[allow\((dead_code|unused_variables|unused_imports)\)\]", "A warning is silenced without a reason", "Write the reason below", guards=("slash",), after_lacks="^//"),
    LineRule("rust.eprintln-in-lib", "info", (".rs",), r"eprintln!\(", "A library writes to stderr", "Use a logger", guards=("slash",), path=r"(?:^|/)lib\.rs$|/lib/"),
    LineRule("config-smells.secret-in-config", "error", (".toml", ".yaml", ".yml", ".json", ".env"), r"(?i)\b(?:password|token|secret)\b[\"']?\s*[:=]\s*[\"']?[^\s\"'$][^\"'\s]{3,}", "A secret is written into a configuration", "Refer to a secret store", guards=("hash",), needs=("password", "token", "secret")),
)


def condition(rule: LineRule) -> str:
    """SQL that holds on lines that break the rule; the cheap tests come first.

    Rules are text until one expression of all of them is parsed, which is far quicker than building each by calls.
    """
    rlike = lambda on, pattern: f"{on} rlike {T.literal(T.java(pattern))}"
    test = [f"ext in ({', '.join(map(T.literal, rule.extensions))})", *(f"not {g}" for g in rule.guards)]
    if rule.path:
        test.append(rlike("path", rule.path))
    if rule.not_path:
        test.append(f"not {rlike('path', rule.not_path)}")
    if rule.needs:
        test.append("(" + " or ".join(f"contains(lower, {T.literal(x)})" for x in rule.needs) + ")")
    test.append(rlike(rule.on, rule.pattern))
    if rule.on == "stripped":
        test.append("stripped <> '' and not stripped_comment")
    if rule.unless:
        test.append(f"not {rlike('code', rule.unless)}")
    if rule.before_lacks:
        test.append(f"not contains(coalesce(before, ''), {T.literal(rule.before_lacks)})")
    if rule.after_lacks:
        test.append("not " + rlike(f"btrim(coalesce(after, ''), {T.literal(T.BLANKS)})", rule.after_lacks))
    return " and ".join(test)


def line_findings(texts: DataFrame, rules: tuple[LineRule, ...] = RULES) -> DataFrame:
    """Findings of ``rules`` over files split into lines (``path``, ``text``)."""
    if not rules:
        return described(texts.select("path", F.lit(1).alias("line"), F.lit("").alias("code"), F.lit(0).alias("seq")).limit(0), [("", "", "", "")])
    wanted = sorted({x for r in rules for x in r.extensions})
    own = texts.where(T.extension(F.col("path")).isin(*wanted))
    rows = exploded(own).withColumn("ext", T.extension(F.col("path"))).withColumn("t", T.trimmed(F.col("code")))
    # Guards become columns of their own: each is computed once a line, not once a rule.
    guards = T.test_guards(F.col("path")) | {"hash": F.col("t").startswith("#"), "slash": F.col("t").startswith("//"), "block": F.col("t").startswith("/*")}
    stripped = T.without_comment(F.col("code"))
    rows = rows.withColumns(guards | {"stripped": stripped, "stripped_comment": T.is_comment(stripped), "lower": F.lower("code")})
    broken = F.expr("array(" + ", ".join(f"case when {condition(r)} then {k} end" for k, r in enumerate(rules)) + ")")
    found = rows.select("path", "line", "code", F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("seq"))
    return described(found, [(r.id, r.severity, r.message, r.suggestion) for r in rules])


def described(found: DataFrame, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """Finding rows from ``path``, ``line``, ``code`` and ``seq``, the rule's place in ``rules``."""
    names = ("rule", "severity", "message", "suggestion")
    rows = ", ".join("named_struct(" + ", ".join(f"{T.literal(n)}, {T.literal(x)}" for n, x in zip(names, r, strict=True)) + ")" for r in rules)
    named = found.withColumn("r", F.expr(f"element_at(array({rows}), cast(seq + 1 as int))"))
    return named.select("r.rule", "r.severity", F.col("path").alias("file"), F.col("line").cast("int").alias("line"), "code", "r.message", "r.suggestion", F.col("seq").cast("long").alias("seq"))


def of_extensions(rules: tuple[LineRule, ...], extensions: tuple[str, ...] | None) -> tuple[LineRule, ...]:
    """Rules about files of ``extensions``; all if that is None."""
    return rules if extensions is None else tuple(r for r in rules if set(r.extensions) & set(extensions))
