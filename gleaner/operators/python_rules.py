"""Rules about Python syntax: a table of syntax nodes with their children, and filters over it.

The parser helper turns a file into node rows and knows no rule; every rule is a DataFrame condition on
a node, its children and its later siblings.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .helpers import tabled
from .line_rules import described

KID = "struct<field:string,type:string,name:string,value:string,line:int,code:string>"
NODES = f"path string, line int, code string, type string, name string, parent string, parent_name string, scope int, kids array<{KID}>, later array<string>"
KEPT = (ast.ExceptHandler, ast.Call, ast.Raise, ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, ast.Import, ast.ImportFrom, ast.Assign, ast.Expr, ast.If)


def dotted(node: ast.AST | None) -> str | None:
    """``a.b.c`` of names and attributes, also through a call or an awaited or called statement."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        inner = dotted(node.value)
        return f"{inner}.{node.attr}" if inner else f"?.{node.attr}"
    if isinstance(node, ast.Call):
        return dotted(node.func)
    if isinstance(node, (ast.Expr, ast.Await, ast.Assign)):
        return dotted(node.value)
    if isinstance(node, ast.ExceptHandler):
        return dotted(node.type)
    if isinstance(node, ast.If):
        return dotted(node.test)
    if isinstance(node, ast.ImportFrom):
        return node.module
    if isinstance(node, (ast.alias, ast.FunctionDef, ast.AsyncFunctionDef)):
        return node.name
    return None


def kid(field: str, node: ast.AST, name: str | None = None) -> dict:
    value = repr(node.value) if isinstance(node, ast.Constant) else dotted(node)
    return {"field": field, "type": type(node).__name__, "name": name or dotted(node), "value": value, "line": getattr(node, "lineno", None)}


def kids(node: ast.AST) -> list[dict]:
    out = []
    for field, value in ast.iter_fields(node):
        for x in value if isinstance(value, list) else [value]:
            if isinstance(x, ast.keyword):
                out.append(kid("keyword", x.value, x.arg or "**"))
            elif isinstance(x, ast.AST):
                out.append(kid(field, x))
    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)):
        a = node.args
        plain = [*a.posonlyargs, *a.args]
        pairs = [*zip(plain[len(plain) - len(a.defaults) :], a.defaults, strict=True), *zip(a.kwonlyargs, a.kw_defaults, strict=True)]
        out += [kid("default", d) | {"line": p.lineno} for p, d in pairs if d is not None and p.annotation is None]
    if isinstance(node, ast.Raise):
        out = [kid("exc", node.exc)] * (node.exc is not None) + [kid("cause", node.cause)] * (node.cause is not None)
    return out


def line_at(lines: list[str], k: int | None) -> str:
    return lines[k - 1].removesuffix("\r") if k and k <= len(lines) else ""


def nodes_of(path: str, source: str) -> Iterator[tuple]:
    """Rows of one file; a file that does not parse has none."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    lines = source.split("\n")
    todo: list[tuple[ast.AST, ast.AST, int, list]] = [(x, tree, 0, tree.body[i + 1 :]) for i, x in enumerate(tree.body)]
    while todo:
        node, parent, scope, after = todo.pop()
        if isinstance(node, KEPT):
            later: list[str] = []
            if isinstance(node, (ast.Assign, ast.Expr)) and "requests." in (dotted(node) or ""):
                later = sorted({d for s in after for x in ast.walk(s) if isinstance(x, ast.Attribute) and (d := dotted(x))})
            yield path, node.lineno, line_at(lines, node.lineno), type(node).__name__, dotted(node), type(parent).__name__, dotted(parent), scope, [k | {"code": line_at(lines, k["line"])} for k in kids(node)], later
        inner = scope + isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda))
        for _, value in ast.iter_fields(node):
            rows = [x for x in value if isinstance(x, ast.AST)] if isinstance(value, list) else [value] if isinstance(value, ast.AST) else []
            todo += [(x, node, inner, rows[i + 1 :] if isinstance(x, ast.stmt) else []) for i, x in enumerate(rows)]


def python_nodes(files: DataFrame) -> DataFrame:
    return tabled(files.where(T.extension(F.col("path")).isin(".py", ".pyi")), nodes_of, NODES)


def some(test) -> Column:
    return F.exists("kids", test)


def number(test) -> Column:
    return F.size(F.filter("kids", test))


def field(name: str):
    return lambda x: x["field"] == name


def keyword(name: str) -> Column:
    return some(lambda x: (x["field"] == "keyword") & (x["name"] == name))


# Rule ids, severities and the names they look for.
VERBS = [f"requests.{v}" for v in ("get", "post", "put", "delete", "patch", "head", "options", "request")]
LOGS = [f"{a}.{b}" for a in ("logging", "logger", "log") for b in ("error", "exception", "critical", "fatal", "warning")]
BROAD = ("Exception", "BaseException")
MUTABLE = ("List", "Dict", "Set")
CHECKS = ("raise_for_status", "status_code", "ok")
TEST_MODULES = r"^(?:unittest|mock|pytest)(?:\.|$)"


def mutable(x: Column) -> Column:
    return x["type"].isin(*MUTABLE) | (x["type"] == "Call") & x["name"].isin("set", "list", "dict")


def conditions() -> list[tuple[str, str, str, str, Column, Column | None]]:
    """Rule id, severity, message, suggestion, condition and, where they are not the node's, the lines."""
    kind, name, test = F.col("type"), F.col("name"), T.test_guards(F.col("path"))["py_test"]
    handler, call, raises = kind == "ExceptHandler", kind == "Call", kind == "Raise"
    body, args = field("body"), field("args")
    arg = lambda i: F.get(F.filter("kids", args), F.lit(i))
    exc = F.get(F.filter("kids", field("exc")), F.lit(0))
    logged = F.filter("kids", lambda x: body(x) & (x["type"] == "Expr") & x["name"].isin(*LOGS))
    default = F.filter("kids", lambda x: field("default")(x) & mutable(x))
    mode = F.coalesce(F.get(F.filter("kids", lambda x: (x["field"] == "keyword") & (x["name"] == "mode")), F.lit(0))["value"], arg(1)["value"], F.lit(""))
    request = name.isin(*VERBS)
    target = F.get(F.filter("kids", field("targets")), F.lit(0))["name"]
    checked = F.exists("later", lambda x: F.array_contains(F.array(*map(F.lit, CHECKS)), F.substring_index(x, ".", -1)) & (F.substring_index(x, ".", 1) == target))
    modules = F.when(kind == "Import", some(lambda x: T.matches(x["name"], TEST_MODULES))).otherwise(T.matches(F.coalesce(name, F.lit("")), TEST_MODULES))
    return [
        ("silent-fallback.py-bare-except", "error", "Every exception is caught", "Name the exceptions", handler & ~some(field("type")), None),
        ("silent-fallback.py-except-pass", "warning", "The exception is dropped", "Log it or raise it again", handler & (number(body) == 1) & some(lambda x: body(x) & (x["type"] == "Pass")), None),
        ("silent-fallback.py-except-broad", "warning", "Nearly every exception is caught", "Name the exceptions", handler & some(lambda x: field("type")(x) & (x["type"] == "Name") & x["name"].isin(*BROAD)), None),
        ("silent-fallback.py-subprocess-no-check", "warning", "A failing command goes unnoticed", "Pass check=True", call & name.isin("subprocess.run", "subprocess.call") & ~some(lambda x: (x["field"] == "keyword") & (x["name"] == "check") & (x["value"] == "True")), None),
        ("silent-fallback.py-getattr-silent-default", "info", "A missing attribute becomes None", "Let it fail", call & (name == "getattr") & (number(args) == 3) & (arg(2)["value"] == "None"), None),
        ("silent-fallback.py-dict-get-none", "info", "A missing key becomes None", "Give a default or use []", call & T.matches(name, r"^[A-Za-z_][A-Za-z0-9_]*\.get$") & (number(args) == 1) & (number(field("keyword")) == 0) & ~T.matches(F.coalesce(arg(0)["value"], F.lit("")), r"^['\"](?:https?://|/)"), None),
        ("error-context.py-raise-from-none", "warning", "The cause is hidden", "Raise from the exception", raises & some(lambda x: field("cause")(x) & (x["value"] == "None")), None),
        ("error-context.py-bare-raise-different", "warning", "Another exception loses the cause", "Raise from the exception", raises & (F.col("parent") == "ExceptHandler") & (F.size("kids") == 1) & (exc["type"] == "Call"), None),
        ("error-context.py-generic-exception", "warning", "The exception's type says nothing", "Raise a type of its own", raises & (exc["type"] == "Call") & exc["name"].isin(*BROAD), None),
        ("error-context.py-string-exception", "error", "A string is raised", "Raise an exception", raises & ((exc["type"] == "JoinedStr") | (exc["type"] == "Constant") & T.matches(F.coalesce(exc["value"], F.lit("")), "^['\"]")), None),
        ("error-context.py-log-and-raise", "info", "The error is logged and raised", "Do one of both", handler & (F.size(logged) > 0) & some(lambda x: body(x) & (x["type"] == "Raise")), F.slice(F.reverse(F.array_sort(F.transform(logged, place))), 1, 1)),
        ("bad-defaults.py-mutable-default-arg", "error", "A default value is shared between calls", "Use None", kind.isin("FunctionDef", "AsyncFunctionDef", "Lambda") & (F.size(default) > 0), F.transform(default, place)),
        ("bad-defaults.py-no-timeout-requests", "error", "The request may wait for ever", "Pass timeout=", call & request & ~keyword("timeout") & ~keyword("**"), None),
        ("bad-defaults.py-star-import", "warning", "All names are imported", "Name them", ~test & (kind == "ImportFrom") & some(lambda x: x["name"] == "*"), None),
        ("bad-defaults.py-global-state", "warning", "A module holds mutable state", "Put it into an object", ~test & (kind == "Assign") & (F.col("parent") == "Module") & some(lambda x: field("value")(x) & mutable(x)), None),
        ("bad-defaults.py-no-encoding-open", "info", "The encoding depends on the machine", "Pass encoding=", call & (name == "open") & ~keyword("encoding") & ~keyword("**") & ~mode.contains("b"), None),
        ("mock-leakage.py-unittest-import", "error", "A test library is imported outside tests", "Move it to the tests", ~test & kind.isin("Import", "ImportFrom") & modules, None),
        ("mock-leakage.py-debug-flag", "warning", "Code runs in debug mode only", "Use a setting", ~test & (kind == "If") & some(lambda x: field("test")(x) & (x["type"] == "Name") & x["name"].isin("__debug__", "DEBUG")) & some(lambda x: body(x) & (x["type"] != "Pass")), None),
        ("trace-gaps.py-silent-request", "warning", "The response's status is not checked", "Call raise_for_status", kind.isin("Expr", "Assign") & request & some(lambda x: field("value")(x) & (x["type"] == "Call")) & ~F.coalesce(checked, F.lit(False)), None),
    ]


def place(x: Column) -> Column:
    """Line and text of a finding."""
    return F.struct(x["line"].alias("line"), x["code"].alias("code"))


def numbered(k: int):
    return lambda x: F.struct(x["line"].alias("line"), x["code"].alias("code"), F.lit(k).alias("seq"))


NOWHERE = "array<struct<line:int,code:string>>"


def python_findings(files: DataFrame) -> DataFrame:
    """Findings of the Python rules over ``files`` (path, content); the node table has the lines, so files are read once."""
    rules = conditions()
    here, none = F.array(F.struct("line", "code")), F.array().cast(NOWHERE)
    places = [F.when(c, here if at is None else at.cast(NOWHERE)).otherwise(none) for _, _, _, _, c, at in rules]
    hits = F.flatten(F.array(*(F.transform(x, numbered(k)) for k, x in enumerate(places))))
    found = python_nodes(files).select("path", F.explode(hits).alias("x")).select("path", "x.*").distinct()
    return described(found, [r[:4] for r in rules])
