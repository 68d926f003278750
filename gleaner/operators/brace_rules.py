"""Rules about Go and JavaScript structure: a table of brace blocks with their statements, and filters over it.

The helper finds blocks and statements, outside comments and strings, and knows no rule. It does not
parse expressions: rules that would need types or full syntax trees look at statement texts instead.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .helpers import tabled
from .line_rules import JS, LineRule, described, line_findings, of_extensions
from .python_rules import NOWHERE, numbered, place, some

#: A statement: its text, its outline (without what stands in blocks, which have statements of their own; object literals belong to
#: the statement), line, that line of the source and the one above it. A header with its condition is a statement, too.
STATEMENT = "struct<text:string,outline:string,line:int,code:string,above:string>"
BLOCKS = f"path string, line int, code string, last int, header string, kids array<{STATEMENT}>, deep array<{STATEMENT}>, body string, function string, in_loop boolean, later array<{STATEMENT}>"
HIDDEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|`(?:[^`\\]|\\.)*`?", re.S)
LOOP = re.compile(r"^(?:for|while|do)\b")
CONTINUED = re.compile(r"\s*(?:else|catch|finally)\b")
LITERAL = re.compile(r"(?:[(,=:\[?&|]|\breturn)$")
CALLABLE = re.compile(r"\bfunc\b|\bfunction\b|=>\s*$")
PLACES = re.compile(r"[()\[\]{};\n]")
#: What stands before a semicolon in a header, and what carries a statement on: signs before the line's end, beginnings after it.
CLAUSES = re.compile(r"\s*(?:else\s+)?(?:if|for|switch)\b")
OPEN_ENDS, GOES_ON = frozenset("+-*/%=&|,.<>?:("), re.compile(r"[.?:}]|else\b|catch\b")


def masked(source: str) -> str:
    """The source with comments and strings blanked out, at the same places."""
    return HIDDEN.sub(lambda m: "\n".join(" " * len(x) for x in m[0].split("\n")), source)


def brace_tree(source: str) -> tuple[list[tuple[dict, int]], Callable[[int], int]]:
    """Every brace block and the file itself, inner ones first, each with the offset of its end; and what tells the line of an offset.

    Only brackets, semicolons and line breaks are looked at one by one.
    """
    plain, breaks = masked(source), [m.start() for m in re.finditer("\n", source)]
    line_of = lambda i: bisect_left(breaks, i) + 1
    root = {"from": 0, "start": 0, "header": "", "kids": [], "deep": [], "function": "", "kind": "file", "loop": False, "parent": None, "place": 0, "parts": []}
    done, block, begin, round_, nested = [], root, 0, [0], []

    def spliced(start: int, end: int, parts: list[tuple[int, int, str]]) -> str:
        """The source from ``start`` to ``end`` with each of ``parts`` (from, to, in its place) exchanged."""
        out = []
        for a, z, other in parts:
            if a >= start:
                out += [source[start:a], other]
                start = z
        return "".join(out) + source[start:end]

    # The last mark before the line break looked at last, and the first one after it: blanks are passed once.
    looked, mark, ahead = 0, -1, 0

    def goes_on(end: int) -> bool:
        """Whether the statement up to the line break at ``end`` has more lines."""
        nonlocal looked, mark, ahead
        if line := plain[looked:end].rstrip():
            mark = looked + len(line) - 1
        looked = end
        if ahead <= end:
            following = re.compile(r"\S").search(plain, end)
            ahead = following.start() if following else len(plain)
        return mark >= begin and plain[mark] in OPEN_ENDS or bool(GOES_ON.match(plain, ahead))

    def statement(end: int) -> None:
        nonlocal begin
        if plain[begin:end].strip():
            # Blocks of several lines stand for themselves in the text, all of them in the outline.
            text = spliced(begin, end, [x for x in nested if "\n" in source[x[0] : x[1]]]).strip()
            lead = len(source[begin:end]) - len(source[begin:end].lstrip())
            block["kids"].append((text, spliced(begin, end, nested).strip(), line_of(begin + lead), begin + lead, end - 1))
            if block is not root:
                block["deep"].append(block["kids"][-1])
        begin = end
        nested.clear()

    for m in PLACES.finditer(plain):
        i, c = m.start(), m[0]
        if c in "([":
            round_[-1] += 1
        elif c in ")]":
            round_[-1] = max(0, round_[-1] - 1)
        elif c == "{":
            # What follows a closed block with else or catch starts there, not where the statement does.
            top = nested[-1][1] if nested and CONTINUED.match(plain, nested[-1][1]) else begin
            header = source[top:i].strip()
            lead = top - begin + len(source[top:i]) - len(source[top:i].lstrip())
            called = bool(CALLABLE.search(header)) or bool(re.search(r"\)\s*(?::\s*[\w<>\[\]., ]+)?$", header)) and not re.match(r"(?:\}?\s*else\s+)?(?:if|for|while|switch|catch|with)\b|\}?\s*catch\b", header)
            inner = {"from": line_of(begin + lead), "start": i, "header": header, "kids": [], "deep": [], "parent": block, "place": len(block["kids"]), "begin": begin, "nested": nested, "parts": []}
            inner["kind"] = "function" if called else "loop" if LOOP.match(header) else "block"
            inner["function"] = header if called else block["function"]
            inner["loop"] = not called and (block["loop"] or bool(LOOP.match(header)))
            block, begin, nested = inner, i + 1, []
            round_.append(0)
        elif c == "}" and block is not root:
            statement(i)
            done.append((block, i))
            literal = LITERAL.search(block["header"]) and not re.match(r"(?:case|default)\b", block["header"])
            own = (block["start"], i + 1, spliced(block["start"], i + 1, block["parts"]) if literal else "{}")
            block["parent"]["parts"].append(own)
            begin, nested = block["begin"], [*block["nested"], own]
            if block["parent"] is not root:
                block["parent"]["deep"] += block["deep"]
            block = block["parent"]
            round_.pop()
        elif c == ";" and not round_[-1] and not CLAUSES.match(plain, begin, i):
            statement(i)
            begin = i + 1
        elif c == "\n" and not round_[-1] and not goes_on(i):
            statement(i)
            begin = i + 1
    statement(len(plain))
    done.append((root, len(plain)))
    return done, line_of


def blocks_of(path: str, source: str) -> Iterator[tuple]:
    """The file itself and every brace block in it, with its own statements, those of blocks in it too (not for the file), and the parent's later ones."""
    lines = ["", *(x.removesuffix("\r") for x in source.split("\n"))]
    done, line_of = brace_tree(source)
    for b, end in done:
        up = b["parent"]
        later = up["kids"][b["place"] + 1 :] if up else []
        rows = lambda found: [{"text": t, "outline": o, "line": n, "code": lines[n], "above": lines[n - 1]} for t, o, n, *_ in found]
        at = b["from"] or 1
        yield path, at, lines[at], line_of(end), b["header"], rows(b["kids"]), rows(b["deep"]), source[b["start"] : end], b["function"], b["loop"], rows(later)


#: A node: offsets of its begin and end, the file's end, how many blocks are around it, its kind and header or outline.
NODES = "path string, pre long, post long, end long, depth int, kind string, text string, line int"


def nodes_of(path: str, source: str) -> Iterator[tuple]:
    """The file, its functions, loops, other blocks and statements as intervals: a node lies within those around it."""
    done, line_of = brace_tree(source)
    for b, end in done:
        depth, up = 0, b["parent"]
        while up:
            depth, up = depth + 1, up["parent"]
        yield path, b["start"], end, len(source), depth, b["kind"], b["header"], line_of(b["start"])
        for _, outline, line, pre, post in b["kids"]:
            yield path, pre, post, len(source), depth + 1, "statement", outline, line


def brace_nodes(files: DataFrame) -> DataFrame:
    """The node table of Go and JavaScript files (path, content), for joins over ancestors (``intervals``)."""
    return tabled(files.where(T.extension(F.col("path")).isin(".go", *JS)), nodes_of, NODES)


def brace_blocks(files: DataFrame) -> DataFrame:
    return tabled(files.where(T.extension(F.col("path")).isin(".go", *JS)), blocks_of, BLOCKS)


# Names, words and patterns that the rules look for.
LOG_CALLS = "Print Println Printf Fprintf Fprintln Log Logf Info Infof Infow Warn Warnf Warnw Error Errorf Errorw Debug Debugf Debugw Fatal Fatalf Fatalw Trace Tracef".split()
PURE = "is has can should check parse format count match find extract convert compare sort filter validate marshal unmarshal encode decode render compile build default new make create".split()
GENERIC_GO = ("failed", "error", "something failed", "an error occurred", "internal error", "unexpected error", "unknown error", "operation failed", "request failed", "invalid input", "bad request")
GENERIC_JS = ("error", "failed", "failure", "something went wrong", "an error occurred", "unknown error", "unexpected error", "internal error", "oops", "error occurred", "something failed", "request failed", "operation failed")
CORRELATION = "correlation-id correlationId correlation_id request-id requestId request_id x-request-id X-Request-Id X-Request-ID x-correlation-id X-Correlation-Id X-Correlation-ID trace-id traceId trace_id express-request-id cls-hooked express-correlation-id uuid nanoid crypto.randomUUID".split()
LOG_CALL = rf"\.(?:{'|'.join(LOG_CALLS)})\("
ERR = r"^(?:\}?\s*else\s+)?if\s+(?:.*;\s*)?err\s*!=\s*nil$"
#: A result before the next comma: brackets in it may hold brackets.
RESULT = r"(?:[^(),]|\((?:[^()]|\([^()]*\))*\))*"
ROUTE = r"\b\w+\.(?:get|post|put|delete|patch|all)\s*\(\s*['\"`/]"
IMPORTED = r"(?:\bfrom\s+|\brequire\s*\(\s*|^\s*import\s+)['\"]"

LINE_RULES = (
    LineRule("error-context.generic-message", "warning", (".go",), rf"\b(?:errors\.New|fmt\.Errorf)\(\"(?:{'|'.join(GENERIC_GO)})\"", "The message says nothing", "Say what failed", guards=("slash",), needs=("errors.new(", "fmt.errorf(")),
    LineRule("silent-fallback.ignored-error", "error", (".go",), r"^\s*(?:[\w.\[\]]+\s*,\s*)+_\s*:?=\s*[\w.]+(?:\[[^\]]*\])?\(", "The error is dropped", "Handle it", guards=("slash", "go_test")),
    LineRule("error-context.error-string-compare", "warning", (".go",), r"\.Error\(\)\s*[!=]=|[!=]=\s*[\w.]+\.Error\(\)", "Errors are compared by text", "Use errors.Is", guards=("slash", "go_test"), needs=(".error()",)),
    LineRule("mock-leakage.mock-import-non-test", "error", (".go",), r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"[^\"]*(?:testify|mock|gomock|httptest|testing)[^\"]*\"\s*(?://.*)?$", "A test library is imported outside tests", "Move it to the tests", guards=("slash", "go_test"), needs=("test", "mock")),
    LineRule("silent-fallback.js-optional-chain-silence", "info", JS, r"\w(?:\?\.[\w$\[\]()]+(?:\.[\w$]+)*){4}", "A long optional chain hides what is missing", "Check the parts", guards=("slash", "block", "js_test"), needs=("?.",)),
    LineRule("error-context.js-generic-error-message", "warning", JS, rf"(?i)\bthrow\s+new\s+(?:Error|TypeError|RangeError|ReferenceError|SyntaxError|URIError|EvalError)\(\s*(?:\"\s*(?:{'|'.join(GENERIC_JS)})\s*\"|'\s*(?:{'|'.join(GENERIC_JS)})\s*')", "The message says nothing", "Say what failed", guards=("slash", "block", "js_test"), needs=("throw",)),
    LineRule("error-context.js-promise-reject-non-error", "warning", JS, r"(?:\bPromise\.|(?:^|[^\w.]))reject\(\s*(?:['\"`]|[0-9]|null\s*\)|undefined\s*\)|true\s*\)|false\s*\))", "A promise is rejected without an error", "Reject with an Error", guards=("slash", "block", "js_test"), needs=("reject(",)),
    LineRule("mock-leakage.js-test-import-in-src", "error", JS, IMPORTED + r"(?:@testing-library|vitest|jest|@jest|@vitest)(?:/[^'\"]*)?['\"]", "A test library is imported outside tests", "Move it to the tests", guards=("slash", "block", "js_test"), needs=("testing-library", "vitest", "jest")),
    LineRule("mock-leakage.js-env-test-check", "warning", JS, r"process\.env\.NODE_ENV\s*[!=]==?\s*['\"]test['\"]|['\"]test['\"]\s*[!=]==?\s*process\.env\.NODE_ENV", "Code behaves otherwise under test", "Inject what differs", guards=("slash", "block", "js_test"), needs=("process.env.node_env",)),
    LineRule("bad-defaults.any-type-assertion", "warning", (".ts", ".tsx"), r"\bas\s+any\b", "The type is given up", "Assert the real type", guards=("slash", "block", "js_test"), needs=("any",)),
    LineRule("bad-defaults.non-null-assertion", "info", (".ts", ".tsx"), r"[\w$\])]!(?:[.;,)\[\]]|\s*$)", "null is ruled out by assertion", "Check it", guards=("slash", "block", "js_test")),
    LineRule("bad-defaults.eval-usage", "error", JS, r"(?:^|[^\w.$])eval\s*\(|\bnew\s+Function\s*\(", "Text is run as code", "Parse it", guards=("slash", "block", "js_test"), needs=("eval", "function")),
    LineRule("test-isolation.test-only-import", "info", JS, r"(?:\bfrom\s+|\brequire\s*\(\s*|^\s*import\s+)['\"](?i:(?:[^'\"]*/)?(?:(?:__tests__|__mocks__|__fixtures__|testutils|test-utils)(?:/[^'\"]*)?['\"]|(?:test[-_]?helper|mock-|mock_|fake-|fake_|stub-|stub_)[^'\"/]*['\"]|(?:test[-_]?helpers|test[-_]?utils|test[-_]?setup|mocks|fixtures|stubs|fakes)(?:\.[^.'\"/]*)?['\"]|[^'\"/]*[._-](?:test|spec)(?:\.[^.'\"/]*)?['\"]))", "A test module is imported outside tests", "Move it to the tests", guards=("slash", "block", "js_test"), needs=("test", "mock", "fixture", "fake", "stub", "spec")),
)


#: A comment on a statement's line or the line above it that gives a reason.
REASON = r"// reason:|//nolint:"


def statements(pattern: str | Column, column: str = "kids", but: str | None = None, reasoned: bool = False, on: str = "text") -> Column:
    """Places of statements that match ``pattern`` and not ``but`` in their text or outline; of those with a reason if ``reasoned`` none."""

    def hit(x: Column) -> Column:
        test = T.matches(x[on], pattern) if isinstance(pattern, str) else F.rlike(x[on], pattern)
        if but:
            test = test & ~T.matches(x[on], but)
        if reasoned:
            test = test & ~T.matches(F.lower(F.concat_ws("\n", x["above"], x["code"])), REASON)
        return test

    return F.transform(F.filter(column, hit), place)


def kid(pattern: str) -> Column:
    return some(lambda x: T.matches(x["text"], pattern))


def body_has(pattern: str) -> Column:
    return T.matches(F.col("body"), pattern)


def body_line(pattern: str) -> Column:
    """The place of the first match in a whole file, from the line breaks before it."""
    before = F.regexp_extract("body", "(?s)^(.*?)(?:" + T.java(pattern)[4:] + ")", 1)
    breaks = F.regexp_count(before, F.lit("\n"))
    return F.array(F.struct((breaks + 1).alias("line"), F.regexp_replace(F.get(F.split("body", "\n", -1), breaks), r"\r$", "").alias("code")))


#: Rules about JavaScript whose ids do not say so.
ON_JS = ("bad-defaults.no-timeout-fetch", "test-isolation.no-afterall-cleanup")


def conditions() -> list[tuple[str, str, str, str, Column, Column | None]]:
    """Rule id, severity, message, suggestion, condition on a block and, where not the block's, the lines."""
    path, head = F.col("path"), F.col("header")
    g = T.test_guards(path)
    go, js = (T.extension(path) == ".go"), T.is_js(T.extension(path))
    go_src, js_src = go & ~g["go_test"], js & ~g["js_test"]
    err, one = go & T.matches(head, ERR), F.size("kids") == 1
    catch = js_src & T.matches(head, r"\bcatch\b\s*(?:\([^)]*\))?$")
    caught = F.regexp_extract(head, T.java(r"\bcatch\s*\(\s*([A-Za-z_$][\w$]*)"), 1)
    function = go & T.matches(head, r"^func\b")
    handler = function & T.matches(head, r"\(\s*\w+\s+http\.ResponseWriter\s*,\s*\w+\s+\*http\.Request")
    name = F.regexp_extract(head, T.java(r"^func\s+(?:\([^)]*\)\s*)?(\w+)"), 1)
    success = r"\b\w+\.Write\(|\.WriteHeader\((?:200|http\.StatusOK)\)|json\.NewEncoder\(\w+\)\.Encode"
    top = head == ""
    app = js_src & top & body_has(r"=\s*(?:express|(?:new\s+)?Koa)\s*\(") & body_has(ROUTE)
    # A function that is an argument: it follows a bracket or comma.
    first = F.regexp_extract(head, T.java(r"[(,]\s*(?:async\s*)?(?:function\s*[\w$]*\s*)?\(\s*(err|error|e)\s*,[^()]*\)\s*(?:=>)?$"), 1)
    bare_arrow = F.lit(r"(?s)[(,]\s*(?:async\s*)?\(\s*(err|error|e)\s*,[^()]*\)\s*=>\s*(?![\s{])(?!.*(?<![\w$])\1(?![\w$]))")
    catch_handler = js_src & T.matches(head, r"\.catch\(\s*(?:async\s*)?(?:function\s*[\w$]*\s*\([^()]*\)|(?:\([^()]*\)|[\w$]+)\s*=>)$")
    rest = F.substring("body", F.lit(2), F.length("body"))
    named = lambda x, a, z: F.concat(F.lit(a), F.replace(x, F.lit("$"), F.lit("\\$")), F.lit(z))
    return [
        ("silent-fallback.empty-error-check", "error", "The error becomes nil", "Return the error", err & one & kid(r"^return\s+nil(?:\s*,\s*nil)*$"), None),
        ("silent-fallback.bare-return-on-error", "warning", "The error is lost in a bare return", "Return the error", err & T.matches(F.col("function"), r"\)\s*\(\s*\w+\s+[\w.*\[\]]+"), statements(r"^return(?:\s+(?:nil|false|\"\"|[-+]?0[0._xX]*)(?:\s*,\s*(?:nil|false|\"\"|[-+]?0[0._xX]*))*)?$", "deep", reasoned=True)),
        ("error-context.unwrapped-error", "warning", "The error is returned without context", "Wrap it", err, statements(rf"^return\s+(?:{RESULT},\s*)*err\s*(?:,|$)", but=r"Errorf|Wrap")),
        ("error-context.http-200-on-error", "error", "An error is answered with success", "Return after the error", err & ~g["go_test"] & T.matches(F.col("function"), r"http\.ResponseWriter") & ~body_has(r"\breturn\b"), F.slice(statements(success, "later"), 1, 1)),
        ("error-context.nil-on-error", "error", "The error is replaced by nil", "Return the error", err, statements(r"^return\s+(?:nil|\"\")\s*,\s*nil$", "deep")),
        ("bad-defaults.no-timeout", "error", "The client waits for ever", "Set Timeout", go & T.matches(head, r"\bhttp\.Client$") & ~body_has(r"\bTimeout\s*:"), None),
        ("bad-defaults.no-timeout", "error", "The default client waits for ever", "Use a client with Timeout", go, statements(r"\bhttp\.(?:Get|Post|PostForm|Head)\(", on="outline")),
        ("bad-defaults.magic-number", "info", "A number stands without a name", "Name it", go_src & (F.col("function") != ""), statements(r"[=(,+*/<>]\s*(?:[2-9]|[1-9][0-9]+)(?:\.[0-9]+)?\s*(?:[),+*/;]|$)", but=r"^const\b|time\.|make\(|\[[^\]]*[0-9]|SplitN|ParseInt|ParseFloat|FormatInt|len\(|\"[^\"]*[0-9]|\{|//")),
        ("bad-defaults.unvalidated-env-go", "warning", "The variable may be unset", "Check it for an empty value", go & (F.col("function") != ""), F.when(~T.matches(F.col("body"), r"[!=]=\s*\"\"|LookupEnv"), statements(r"\bos\.Getenv\(", but=r"^if\b|\{")).otherwise(F.array().cast(NOWHERE))),
        ("trace-gaps.long-function-no-log", "info", "A long function logs nothing", "Log what it does", function & ~g["go_test"] & (F.col("last") - F.col("line") > 30) & ~body_has(LOG_CALL) & T.matches(name, r"^[A-Z]") & ~T.matches(F.lower(name), f"^(?:{'|'.join(PURE)})"), None),
        ("trace-gaps.error-path-no-log", "warning", "The error's path logs nothing", "Log it", err & ~g["go_test"] & (F.size("kids") > 1) & ~body_has(LOG_CALL), None),
        ("trace-gaps.no-request-id", "warning", "The handler reads no request id", "Take it from the header", handler & ~g["go_test"] & ~body_has(r"(?i)\.Header\.Get\(\"[^\"]*request[-_ ]?id|\.Context\(\)\.Value\(|req(?:uest)?_?id\w*\([^)]*\.Context\(\)"), None),
        ("mock-leakage.debug-guard", "warning", "Code depends on a debug flag", "Use a setting", go_src & T.matches(head, r"(?i)^(?:\}?\s*else\s+)?if\b.*\b(?:debug|testing|istest|istesting)\b"), None),
        ("silent-fallback.unchecked-type-assert", "warning", "The assertion may panic", "Use the two-value form", go_src & (F.col("function") != ""), statements(r"\.\(\*?[\w.\[\]{}]+\)", but=r"\.\(type\)|,\s*\w+\s*:?=.*\.\(", on="outline")),
        ("bad-defaults.defer-in-loop", "warning", "Deferred calls pile up", "Move the body to a function", go_src & F.col("in_loop"), statements(r"^defer\b")),
        ("bad-defaults.goroutine-no-context", "warning", "The goroutine cannot be stopped", "Pass a context", go_src, statements(r"^go\s+[\w.]+\(", but=r"^go\s+func\b|\bctx\b|\bcontext\b|(?i)//\s*reason:|//\s*nolint")),
        ("bad-defaults.goroutine-no-context", "warning", "The goroutine cannot be stopped", "Pass a context", go_src & T.matches(head, r"^go\s+func\b") & ~T.matches(head, r"context\.Context") & ~body_has(r"\bctx\b|\bcontext\b|\bdone\b|\bchan\b"), None),
        ("error-context.swallowed-error", "warning", "The error is logged and dropped", "Return it", err & ~g["go_test"] & body_has(LOG_CALL) & ~kid(r"^(?:return|break|continue|goto)\b") & ~body_has(r"(?i)//[^\n]*(?:intentional|expected|nolint|not propagated)"), None),
        ("bad-defaults.context-todo", "warning", "The context is a placeholder", "Pass the caller's", go_src & (F.col("function") != "") & ~T.matches(F.col("function"), r"^func\s+(?:main|init)\b"), statements(r"\bcontext\.(?:TODO|Background)\(\)", reasoned=True, on="outline")),
        ("silent-fallback.js-empty-catch", "warning", "The handler is empty", "Handle the error", catch & (F.size("kids") == 0) & ~body_has(r"//|/\*"), None),
        ("silent-fallback.js-catch-return-null", "warning", "The error becomes null", "Handle it", js_src, statements(r"\.catch\(\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>\s*(?:null|undefined|\{\s*return\s+(?:null|undefined)\s*;?\s*\})")),
        ("silent-fallback.js-catch-return-null", "warning", "The error becomes null", "Handle it", catch_handler & kid(r"^return\s+(?:null|undefined)\s*;?$"), None),
        ("silent-fallback.js-callback-err-ignored", "warning", "The callback ignores its error", "Handle it", js_src, statements(bare_arrow, on="outline")),
        ("silent-fallback.js-floating-promise", "warning", "The promise is not awaited", "Await it", js_src, statements(r"^(?:[\w$]+\.)?fetch\s*\(", but=r"\)\s*\.(?:then|catch)\s*\(")),
        ("silent-fallback.js-callback-err-ignored", "warning", "The callback ignores its error", "Handle it", js_src & (first != "") & ~F.rlike(rest, F.concat(F.lit(r"(?<![\w$])"), first, F.lit(r"(?![\w$])"))), None),
        ("error-context.js-rethrow-no-wrap", "warning", "The error is thrown again as it is", "Add context", catch & (caught != ""), statements(named(caught, r"^throw\s+", r"\s*;?$"), "deep")),
        ("error-context.js-console-error-no-throw", "warning", "The error is printed and dropped", "Throw or handle it", catch & body_has(r"\bconsole\.error\s*\(") & ~body_has(r"\bthrow\b"), F.slice(F.reverse(statements(r"\bconsole\.error\s*\(")), 1, 1)),
        ("error-context.js-http-200-on-error", "error", "An error is answered with success", "Send an error status", catch, statements(r"\.status\(\s*(?:200|201|202|204)\s*\)|\b(?:res|ctx|response)\.json\(", "deep")),
        ("trace-gaps.js-no-error-handler-express", "warning", "The app has no error handler", "Add one with four parameters", app & ~body_has(r"\.use\s*\(\s*(?:async\s*)?(?:function\s*\w*\s*)?\(\s*(?:err|error)\s*,[^,)]*,[^,)]*,[^,)]*\)"), body_line(ROUTE)),
        ("trace-gaps.js-missing-correlation-id", "info", "Requests carry no id", "Add one", app & ~body_has("|".join(re.escape(x) for x in CORRELATION)), body_line(ROUTE)),
        ("bad-defaults.no-timeout-fetch", "error", "The request may wait for ever", "Pass a signal", js_src, statements(r"(?:^|[^\w.$])fetch\s*\(", but=r"\bsignal\b|\.\.\.", on="outline")),
        ("test-isolation.no-afterall-cleanup", "warning", "Setup is not undone", "Add the matching after hook", js & g["js_test"] & (kid(r"^beforeAll\s*\(") & ~kid(r"^afterAll\s*\(") | kid(r"^beforeEach\s*\(") & ~kid(r"^afterEach\s*\(")), F.concat(F.when(~kid(r"^afterAll\s*\("), statements(r"^beforeAll\s*\(")).otherwise(F.array().cast(NOWHERE)), F.when(~kid(r"^afterEach\s*\("), statements(r"^beforeEach\s*\(")).otherwise(F.array().cast(NOWHERE)))),
    ]


def brace_findings(files: DataFrame, texts: DataFrame, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """Findings of the rules here over ``files`` (path, content) and their lines; only rules about ``extensions`` if given."""
    go, js = (extensions is None or bool(set(x) & set(extensions)) for x in ((".go",), JS))
    rules = [r for r in conditions() if (js if ".js-" in r[0] or r[0] in ON_JS else go)]
    lines = line_findings(texts, of_extensions(LINE_RULES, extensions))
    if not rules:
        return lines
    here, none = F.array(F.struct("line", "code")), F.array().cast(NOWHERE)
    places = [F.when(c, here if at is None else at.cast(NOWHERE)).otherwise(none) for _, _, _, _, c, at in rules]
    hits = F.flatten(F.array(*(F.transform(F.coalesce(x, none), numbered(k)) for k, x in enumerate(places))))
    found = brace_blocks(files).select("path", F.explode(hits).alias("x")).select("path", "x.*").distinct()
    return described(found, [r[:4] for r in rules]).unionByName(lines)
