"""Text and path expressions with the semantics that the rules were written for, as built-in functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of the JavaScript family.
JS = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs")
BLANKS = " \t\n\r\x0b\x0c"
_WORD = "[0-9A-Za-z_]"
_EDGE = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"


_BEFORE, _AFTER = f"(?<!{_WORD})", f"(?!{_WORD})"


def _group(pattern: str, i: int) -> list[str]:
    """The alternatives of the group that opens at ``i``, and what follows it as the last item."""
    depth, start, parts, inside, k = 0, i, [], False, i
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 2
            continue
        if inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c == "(":
            depth += 1
            if depth == 1:
                start = k + (3 if pattern.startswith("(?:", k) else 1)
        elif c == ")":
            depth -= 1
            if not depth:
                return [*parts, pattern[start:k], pattern[k + 1 :]]
        elif c == "|" and depth == 1:
            parts.append(pattern[start:k])
            start = k + 1
        k += 1
    return [*parts, pattern[start:], ""]


def _starts_word(pattern: str) -> bool:
    """Whether all that the pattern matches starts with a word character."""
    if pattern.startswith("("):
        *parts, rest = _group(pattern, 0)
        return rest[:1] not in ("?", "*", "{") and not parts[0].startswith("?") and all(map(_starts_word, parts))
    literal = re.match(r"[0-9A-Za-z_]|\\w", pattern)
    return bool(literal) and pattern[literal.end() : literal.end() + 1] not in ("?", "*", "{")


def _ends_word(pattern: str) -> bool:
    """Whether all that the pattern matches ends with a word character."""
    if pattern.endswith(")") and not pattern.endswith("\\)"):
        depth = 0
        for k in range(len(pattern) - 1, -1, -1):
            if pattern[k - 1 : k] == "\\" or "[" in pattern:  # escapes and classes: leave it to the full edge
                return False
            depth += (pattern[k] == ")") - (pattern[k] == "(")
            if not depth:
                parts = _group(pattern, k)[:-1]
                return not parts[0].startswith("?") and all(map(_ends_word, parts))
        return False
    return pattern.endswith("\\w") or bool(re.search(r"(?:^|[^\\])[0-9A-Za-z_]$", pattern))


def java(pattern: str) -> str:
    """An RE2 pattern in Java's dialect: ASCII word edges and blanks, ``$`` at the very end, ``.`` all but newline.

    Where what follows (or precedes) a word edge is always a word character, one look-behind (or look-ahead) is the
    same and quicker.
    """
    out, i, inside = [], 0, False
    while i < len(pattern):
        two, c = pattern[i : i + 2], pattern[i]
        if pattern.startswith("[[:space:]]", i):
            out.append(r"[\t\n\x0B\f\r ]")
            i += 11
            continue
        if c == "\\":
            edge = _BEFORE if _starts_word(pattern[i + 2 :]) else _AFTER if _ends_word(pattern[:i]) else _EDGE
            out.append({r"\b": edge, r"\s": r"\t\n\f\r " if inside else r"[\t\n\f\r ]"}.get(two, two))
            i += 2
            continue
        if c in "[]":
            inside = c == "["
        out.append(r"\z" if c == "$" and not inside else c)
        i += 1
    return "(?d)" + "".join(out)


def literal(value: str) -> str:
    """A string as it stands in SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(java(pattern))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def base(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)).otherwise(".")


def extension(path: Column) -> Column:
    """From the last dot of the base name on; ``.env`` is its own extension."""
    return F.regexp_extract(base(path), r"(?s)(\.[^.]*)$", 1)


def without_comment(code: Column) -> Column:
    """The line cut at the first ``//`` and then at the first ``#``, trimmed."""
    return trimmed(F.substring_index(F.substring_index(code, "//", 1), "#", 1))


def is_js(ext: Column) -> Column:
    return ext.isin(*JS)


def is_comment(text: Column) -> Column:
    return text.startswith("#") | text.startswith("//") | text.startswith("/*") | text.startswith("*")


def test_guards(path: Column) -> dict[str, Column]:
    """Which paths count as test files, by language."""
    name, ext = base(path), extension(path)
    stem = F.regexp_replace(name, r"(?s)\.[^.]*$", "")
    in_js_dir = matches(path, r"(?:^|/)(?:test|tests|__tests__)(?:/|$)")
    return {
        "go_test": path.endswith("_test.go"),
        "js_test": in_js_dir | is_js(ext) & matches(stem, r"(?:\.test|\.spec|_test|_spec)$"),
        "py_test": in_js_dir | ((ext == ".py") & (stem.startswith("test_") | stem.endswith("_test") | (stem == "conftest"))),
        "rs_test": path.endswith("_test.rs") | path.contains("/tests/") | path.contains("/test/"),
    }


def clean_path(path: Column, root: str = "") -> Column:
    """The shortest equal path, relative to ``root`` if it lies below it, without a leading ``./``."""

    def step(done: Column, x: Column) -> Column:
        up = (x == "..") & (F.size(done) > 0) & (F.coalesce(F.element_at(done, -1), F.lit("")) != "..")
        return F.when((x == "") | (x == "."), done).when(up, F.slice(done, F.lit(1), F.size(done) - 1)).when((x == "..") & path.startswith("/"), done).otherwise(F.concat(done, F.array(x)))

    parts = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    out = F.when(path.startswith("/"), F.concat(F.lit("/"), parts)).when(parts == "", ".").otherwise(parts)
    if root:
        top = root.rstrip("/")
        while top.startswith("./"):
            top = top[2:]
        out = F.when(out == top, ".").when(F.startswith(out, F.lit(top + "/")), F.substring(out, F.lit(len(top) + 2), F.length(out))).otherwise(out)
    return out


def violation_hash(rule: Column, path: Column, line: Column, code: Column, root: str = "") -> Column:
    """SHA-256 of rule, path (cleaned and counted from ``root``), line and code, a line each."""
    return F.sha2(F.concat_ws("\n", trimmed(rule), clean_path(path, root), line.cast("string"), trimmed(code)), 256)


#: Words that code patterns keep; every other identifier becomes ``id``.
KEYWORDS = (
    "if else for range switch case default try catch finally except def func return nil null true false throw raise await "
    "async const let var class new import from package break continue pass while"
).split()


def code_pattern(code: Column) -> Column:
    """Code with its strings, numbers and names levelled, so that like violations are equal."""
    kept = "|".join(KEYWORDS)
    quoted = "|".join(rf"{q}[^{q}\\]*(?:\\.[^{q}\\]*)*{q}|{q}[^{q}]*{q}" for q in "\"'")
    out = F.regexp_replace(trimmed(code), quoted, "str")
    out = F.regexp_replace(out, rf"(?<!{_WORD})[0-9]+(?:\.[0-9]+)?(?!{_WORD})", "num")
    out = F.regexp_replace(out, rf"(?i)(?<!{_WORD})(?!(?:{kept})(?!{_WORD}))[A-Za-z_][0-9A-Za-z_]*", "id")
    lowered = out
    for word in KEYWORDS:
        lowered = F.regexp_replace(lowered, rf"(?i)(?<!{_WORD}){word}(?!{_WORD})", word)
    out = F.when(out.rlike(r"[A-Z]"), lowered).otherwise(out)
    return trimmed(F.regexp_replace(out, r"[\t\n\f\r ]+", " "))


def pattern_hash(rule: Column, code: Column) -> Column:
    return F.sha2(F.concat_ws("\n", trimmed(rule), code_pattern(code)), 256)
