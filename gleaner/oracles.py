"""DuckDB SQL for the registered queries. Patterns stay in RE2, the dialect both sides of a rule are written in."""

from __future__ import annotations

import re

from .corpus import CORPUS
from .functions.text import KEYWORDS
from .operators.brace_rules import LINE_RULES
from .operators.line_rules import RULES, LineRule


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def escaped(text: str) -> str:
    """A literal whose newlines and tabs survive as function calls."""
    return "concat(" + ", ".join(q(x) if x not in ("\n", "\t") else f"chr({ord(x)})" for x in re.split(r"(\n|\t)", text) if x) + ")"


KINDS = ("py", "js", "go", "sh", "ts", "rs", "txt")
DOCS = "SELECT 'docs/requirements_' || doc_id || '.' || (['" + "','".join(KINDS) + "'])[(doc_id % 7 + 1)::INT] AS path, text AS content FROM documents"
CODE = "SELECT * FROM (VALUES " + ", ".join(f"({q(p)}, {escaped(c)})" for p, c in CORPUS) + ") AS t(path, content)"
LINES = """
split AS (SELECT path, string_split(content, chr(10)) AS l FROM files WHERE content IS NOT NULL),
cut AS (SELECT path, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM split),
flat AS (SELECT path, unnest(range(1, len(l) + 1))::INT AS line, unnest(l) AS code FROM cut),
lines AS (
  SELECT *, lag(code) OVER w AS before, lead(code) OVER w AS after, regexp_extract(regexp_extract(path, '[^/]*$'), '\\.[^.]*$') AS ext,
         trim(code, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS t,
         trim(split_part(split_part(code, '//', 1), '#', 1), chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS stripped
  FROM flat WINDOW w AS (PARTITION BY path ORDER BY line))"""
IN_TESTS = "regexp_matches(path, '(^|/)(test|tests|__tests__)(/|$)')"
GUARDS = {
    "hash": "starts_with(t, '#')",
    "slash": "starts_with(t, '//')",
    "block": "starts_with(t, '/*')",
    "go_test": "ends_with(path, '_test.go')",
    "js_test": f"({IN_TESTS} OR regexp_matches(path, '(\\.test|\\.spec|_test|_spec)\\.(js|jsx|ts|tsx|mjs|cjs)$'))",
    "py_test": f"({IN_TESTS} OR regexp_matches(path, '(^|/)(test_[^/]*|[^/]*_test|conftest)\\.py$'))",
    "rs_test": "(ends_with(path, '_test.rs') OR contains(path, '/tests/') OR contains(path, '/test/'))",
}


def broken(r: LineRule) -> str:
    on = {"code": "code", "stripped": "stripped", "lower": "lower(code)"}[r.on]
    test = [f"ext IN ({', '.join(map(q, r.extensions))})", *(f"NOT {GUARDS[g]}" for g in r.guards), f"regexp_matches({on}, {q(r.pattern)})"]
    if r.path:
        test.append(f"regexp_matches(path, {q(r.path)})")
    if r.not_path:
        test.append(f"NOT regexp_matches(path, {q(r.not_path)})")
    if r.on == "stripped":
        test.append("NOT regexp_matches(stripped, '^(//|#|/\\*|\\*)') AND stripped <> ''")
    if r.unless:
        test.append(f"NOT regexp_matches(code, {q(r.unless)})")
    if r.before_lacks:
        test.append(f"NOT contains(coalesce(before, ''), {q(r.before_lacks)})")
    if r.after_lacks:
        test.append(f"NOT regexp_matches(trim(coalesce(after, '')), {q(r.after_lacks)})")
    return f"SELECT {q(r.id)} AS rule, {q(r.severity)} AS severity, path AS file, line FROM lines WHERE {' AND '.join(test)}"


def pack(files: str, rules: tuple[LineRule, ...]) -> str:
    return f"WITH files AS ({files}), {LINES} " + " UNION ALL ".join(map(broken, rules))


PROJ = """proj AS (
  SELECT 'ev.' || event_type AS rule, CASE WHEN event_type = 'purchase' THEN 'error' WHEN event_type IN ('click', 'add_to_cart') THEN 'warning' ELSE 'info' END AS severity,
         'u' || user_id AS file, (event_id % 50 + 1)::INT AS line, coalesce(props, '') AS code, event_id AS seq FROM events)"""
RANK = "CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 ELSE 3 END"
DECIDED = """decided AS (
  SELECT 'ev.' || event_type AS rule_id, 'u' || (user_id % 40) AS pattern_hash, CASE WHEN event_id % 3 = 0 THEN 'deny' ELSE 'allow' END AS decision,
         (event_id % 11) / 10.0::DOUBLE AS confidence, (event_id % 7)::INT AS seen_count, ts AS created_at, event_id AS ord FROM events)"""
BLANK = "trim({}, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"
VIOLATION = "sha256(rule || chr(10) || file || chr(10) || line || chr(10) || " + BLANK.format("code") + ")"


def code_pattern() -> str:
    """For code without keywords: RE2 has no look-ahead to spare them."""
    out = BLANK.format("code")
    out = f"regexp_replace({out}, {q(chr(34) + r'(?:\\.|[^' + chr(34) + r'])*' + chr(34) + '|' + chr(39) + r'(?:\\.|[^' + chr(39) + r'])*' + chr(39))}, 'str', 'g')"
    out = f"regexp_replace({out}, '\\b\\d+(?:\\.\\d+)?\\b', 'num', 'g')"
    out = f"regexp_replace({out}, '\\b[A-Za-z_][A-Za-z0-9_]*\\b', 'id', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


LEVELLED = f"CASE WHEN regexp_matches(code, '(?i)\\b({'|'.join(KEYWORDS)})\\b') THEN NULL ELSE {code_pattern()} END"

#: What rules of files, flow and syntax find in the corpus: listed by the library, then reviewed row by row against what
#: the rules say (one row was corrected by that). They tell of changes; a finding that both miss they do not show.
FOUND = {
    "rule_file_pack_code": """
a/.env 1 config-smells.dotenv-no-example info
a/.env 1 config-smells.missing-gitignore warning
a/install.sh 2 silent-fallback.no-err-trap info
a/m.cjs 1 bad-defaults.no-strict-mode info
a/run.sh 1 bad-defaults.missing-pipefail error
a/run.sh 2 silent-fallback.no-err-trap info
a/x.py 1 trace-gaps.no-logging-config warning
a/y.js 1 trace-gaps.no-unhandled-rejection warning
b/.env 1 config-smells.dotenv-no-example info
g/m.go 17 trace-gaps.no-stderr-capture info
r/lib.rs 5 rust.unwrap-in-production error
""",
    "rule_flow_pack_code": """
a/install.sh 3 silent-fallback.hidden-failure-bash info
a/run.sh 3 silent-fallback.hidden-failure-bash warning
a/run.sh 4 silent-fallback.hidden-failure-bash warning
a/run.sh 9 silent-fallback.hidden-failure-bash info
a/s.js 5 code-quality.error-swallowing warning
a/t.ts 1 code-quality.unused-variable warning
a/x.py 4 code-quality.unreachable-code warning
a/x.py 7 code-quality.error-swallowing warning
a/x.py 9 code-quality.unused-variable warning
a/x.py 10 code-quality.unused-variable warning
a/x.py 11 code-quality.unused-variable warning
a/x.py 12 code-quality.unused-variable warning
a/x.test.js 1 test-isolation.test-missing-cleanup info
a/x.test.js 2 test-isolation.test-leaked-server warning
a/y.js 1 code-quality.unused-variable warning
a/y.js 2 code-quality.error-swallowing warning
a/y.js 7 code-quality.unreachable-code warning
a/y.js 13 code-quality.unused-variable warning
a/y.py 3 code-quality.unused-variable warning
a/y.py 6 code-quality.unused-variable warning
a/y.py 7 code-quality.error-swallowing warning
a/y.py 13 code-quality.unreachable-code warning
a/y.py 14 code-quality.unreachable-code warning
a/y.py 15 code-quality.unreachable-code warning
g/m.go 16 code-quality.unused-variable warning
g/m.go 17 code-quality.unused-variable warning
""",
    "rule_python_code": """
a/x.py 7 silent-fallback.py-except-broad warning
a/x.py 7 silent-fallback.py-except-pass warning
a/x.py 13 silent-fallback.py-subprocess-no-check warning
a/y.py 1 mock-leakage.py-unittest-import error
a/y.py 2 bad-defaults.py-star-import warning
a/y.py 3 bad-defaults.py-global-state warning
a/y.py 4 bad-defaults.py-mutable-default-arg error
a/y.py 6 bad-defaults.py-no-timeout-requests error
a/y.py 6 silent-fallback.py-dict-get-none info
a/y.py 6 trace-gaps.py-silent-request warning
a/y.py 7 silent-fallback.py-bare-except error
a/y.py 7 silent-fallback.py-except-pass warning
a/y.py 9 silent-fallback.py-except-broad warning
a/y.py 10 error-context.py-log-and-raise info
a/y.py 11 error-context.py-bare-raise-different warning
a/y.py 12 error-context.py-string-exception error
a/y.py 13 bad-defaults.py-no-encoding-open info
a/y.py 14 silent-fallback.py-dict-get-none info
a/y.py 15 silent-fallback.py-getattr-silent-default info
a/y.py 16 mock-leakage.py-debug-flag warning
""",
    "rule_go_js_code": """
a/s.js 2 trace-gaps.js-missing-correlation-id info
a/s.js 2 trace-gaps.js-no-error-handler-express warning
a/s.js 5 silent-fallback.js-empty-catch warning
a/s.js 4 bad-defaults.no-timeout-fetch error
a/s.js 4 silent-fallback.js-floating-promise warning
a/s.js 8 error-context.js-console-error-no-throw warning
a/s.js 9 error-context.js-http-200-on-error error
a/s.js 11 silent-fallback.js-callback-err-ignored warning
a/s.js 14 silent-fallback.js-catch-return-null warning
a/s.js 15 error-context.js-promise-reject-non-error warning
a/s.js 16 bad-defaults.eval-usage error
a/s.js 17 error-context.js-generic-error-message warning
a/t.ts 1 bad-defaults.any-type-assertion warning
a/t.ts 2 bad-defaults.non-null-assertion info
a/t.ts 4 mock-leakage.js-env-test-check warning
a/t.ts 5 mock-leakage.js-test-import-in-src error
a/t.ts 6 silent-fallback.js-optional-chain-silence info
a/x.test.js 1 test-isolation.no-afterall-cleanup warning
a/x.test.js 4 test-isolation.no-afterall-cleanup warning
a/y.js 2 silent-fallback.js-empty-catch warning
a/y.js 10 bad-defaults.no-timeout-fetch error
a/y.js 10 silent-fallback.js-floating-promise warning
g/m.go 2 mock-leakage.mock-import-non-test error
g/m.go 3 trace-gaps.no-request-id warning
g/m.go 5 error-context.swallowed-error warning
g/m.go 8 bad-defaults.magic-number info
g/m.go 8 error-context.http-200-on-error error
g/m.go 9 silent-fallback.ignored-error error
g/m.go 10 silent-fallback.unchecked-type-assert warning
g/m.go 12 bad-defaults.defer-in-loop warning
g/m.go 14 bad-defaults.goroutine-no-context warning
g/m.go 15 bad-defaults.no-timeout error
g/m.go 16 bad-defaults.context-todo warning
g/m.go 22 error-context.nil-on-error error
g/m.go 24 silent-fallback.empty-error-check error
g/m.go 28 error-context.unwrapped-error warning
g/m.go 30 error-context.error-string-compare warning
g/m.go 32 error-context.generic-message warning
""",
}


def reviewed(name: str) -> str:
    rows = (x.split(" ") for x in FOUND[name].strip().split("\n"))
    return "SELECT * FROM (VALUES " + ", ".join(f"({q(r)}, {q(s)}, {q(f)}, {n}::INT)" for f, n, r, s in rows) + ") AS t(rule, severity, file, line)"


ORACLES: dict[str, str] = {
    **{name: reviewed(name) for name in FOUND},
    "rule_line_pack_documents": pack(DOCS, RULES),
    "rule_line_pack_code": pack(CODE, RULES),
    "rule_structure_lines_code": pack(CODE, LINE_RULES),
    "lines_explode": f"WITH files AS ({DOCS}), {LINES} SELECT path AS file, line, code FROM lines",
    "file_routing": f"WITH files AS ({DOCS}) SELECT regexp_extract(path, '\\.[^.]*$') AS ext, count(*) AS files, sum(length(content))::BIGINT AS chars FROM files GROUP BY 1",
    "findings_dedup": f"WITH {PROJ} SELECT rule, file, line, arg_min(code, seq) AS code, min(seq) AS seq FROM proj GROUP BY 1, 2, 3",
    "findings_sort_rank": f"WITH {PROJ} SELECT file, seq, row_number() OVER (PARTITION BY file ORDER BY {RANK}, line, rule, seq)::INT AS place FROM proj",
    "severity_override": f"WITH {PROJ} SELECT rule, CASE rule WHEN 'ev.click' THEN 'error' WHEN 'ev.view' THEN 'warning' ELSE severity END AS severity, count(*) AS n FROM proj GROUP BY 1, 2",
    "rule_disable": f"WITH {PROJ} SELECT rule, count(*) AS n FROM proj WHERE rule <> 'ev.view' GROUP BY 1",
    "changed_lines_semi": f"WITH {PROJ} SELECT rule, file, line, seq FROM proj p WHERE EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'click' AND 'u' || e.user_id = p.file AND e.event_id % 50 + 1 = p.line)",
    "precedent_suppress": f"WITH {PROJ}, h AS (SELECT *, {VIOLATION} AS v FROM proj), d AS (SELECT rule, v, arg_max(seq % 2, seq) AS last FROM h GROUP BY 1, 2) SELECT rule, file, line, code, seq FROM h JOIN d USING (rule, v) WHERE d.last <> 0",
    "precedent_topk": f"WITH {DECIDED}, e AS (SELECT *, CASE WHEN confidence <= 0 THEN 0.5 ELSE least(confidence, 1.0) END AS effective FROM decided), r AS (SELECT rule_id AS rule, pattern_hash, row_number() OVER (PARTITION BY rule_id, pattern_hash ORDER BY effective DESC, seen_count DESC, created_at DESC, ord)::INT AS rank, ord, round(effective, 6) AS effective FROM e WHERE effective >= 0.6) SELECT * FROM r WHERE rank <= 10",
    "severity_summary": f"WITH {PROJ} SELECT count(*) AS total, count_if(severity = 'error')::BIGINT AS errors, count_if(severity = 'warning')::BIGINT AS warnings, count_if(severity = 'info')::BIGINT AS info FROM proj",
    "category_counts": f"WITH {PROJ} SELECT severity AS category, count(*) AS n FROM proj GROUP BY 1",
    "repeated_errors": f"WITH {PROJ} SELECT rule, file, count(*) AS n FROM proj WHERE severity = 'error' GROUP BY 1, 2 HAVING count(*) > 2",
    "law_candidates": f"WITH {DECIDED} SELECT rule_id, pattern_hash, decision, count(*) AS n, min(created_at) AS first_seen, max(created_at) AS last_seen FROM decided WHERE created_at IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 5",
    "confidence_fold": f"""WITH RECURSIVE {DECIDED},
      n AS (SELECT *, row_number() OVER (PARTITION BY rule_id, pattern_hash ORDER BY ord) AS i, count(*) OVER (PARTITION BY rule_id, pattern_hash) AS total FROM decided),
      f AS (
        SELECT rule_id, pattern_hash, decision, CASE WHEN confidence > 0 THEN least(confidence, 1.0) ELSE 0.6::DOUBLE END AS c, 1 AS seen, i, total FROM n WHERE i = 1
        UNION ALL
        SELECT n.rule_id, n.pattern_hash, n.decision, CASE WHEN n.decision = f.decision THEN least(1.0, f.c + 0.1::DOUBLE) ELSE greatest(0.2, f.c * 0.5::DOUBLE) END, CASE WHEN n.decision = f.decision THEN f.seen + 1 ELSE 1 END, n.i, n.total
        FROM f JOIN n ON n.rule_id = f.rule_id AND n.pattern_hash = f.pattern_hash AND n.i = f.i + 1)
      SELECT rule_id, pattern_hash, decision, round(c, 9) AS confidence, seen AS seen_count FROM f WHERE i = total""",
    "cost_running_budget": "WITH c AS (SELECT user_id AS run, event_id, ((event_id % 5000) * 0.80::DOUBLE + (event_id % 700) * 4.0::DOUBLE) / 1e6::DOUBLE AS cost FROM events), s AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY run ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS spent FROM c) SELECT run, event_id, round(spent, 9) AS spent, spent < 0.02 AS allowed FROM s",
    "amendment_replay": "SELECT 'u' || user_id AS rule_id, arg_max(CASE WHEN event_id % 2 = 0 THEN 'info' ELSE 'error' END, event_id) FILTER (event_id % 3 = 0) AS new_severity, coalesce(arg_max(event_id % 3 = 1, event_id) FILTER (event_id % 3 <> 0), false) AS disabled FROM events GROUP BY 1",
    "violation_hash": f"WITH {PROJ} SELECT seq, {VIOLATION} AS hash FROM proj",
    "pattern_hash": f"WITH {PROJ} SELECT seq, sha256(rule || chr(10) || {LEVELLED}) AS hash FROM proj",
    "judge_batches": f"WITH {PROJ}, h AS (SELECT *, sha256(rule || chr(10) || {LEVELLED}) AS pattern_hash FROM proj) SELECT rule, pattern_hash, count(*) AS items, arg_min(file, (file, line, seq)) AS file, arg_min(line, (file, line, seq)) AS line FROM h GROUP BY 1, 2",
    "context_window": f"WITH files AS ({DOCS}), {LINES}, hit AS ({broken(next(r for r in RULES if r.id == 'config-smells.hardcoded-credentials')).replace(', ' + q('error') + ' AS severity', '')}) SELECT h.rule, h.file, h.line, string_agg(CASE WHEN l.line = h.line THEN '>> ' ELSE '   ' END || lpad(l.line::VARCHAR, 5, ' ') || ' | ' || l.code, chr(10) ORDER BY l.line) AS context FROM hit h JOIN lines l ON l.path = h.file AND l.line BETWEEN h.line - 10 AND h.line + 10 GROUP BY 1, 2, 3",
    "hunk_expand": "WITH h AS (SELECT 'u' || user_id AS file, event_id % 90 + 1 AS s, CASE WHEN event_id % 4 = 0 THEN 1 ELSE event_id % 4 - 1 END AS n FROM events) SELECT DISTINCT file, unnest(range(s, s + n))::INT AS line FROM h WHERE n > 0",
    "debounce_sessions": "WITH e AS (SELECT user_id::VARCHAR AS path, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL), s AS (SELECT path, sum(new) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS b FROM e), g AS (SELECT path, b, count(*) AS n FROM s GROUP BY 1, 2) SELECT path, count(*) AS bursts, sum(n)::BIGINT AS events, max(n) AS most FROM g GROUP BY 1",
}
