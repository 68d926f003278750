"""Queries of sources, catalogue, patterns and reports over documents and events, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from .cases import AT, RULE_ROWS, found, senate_documents
from .functions import text as T
from .operators import adjudication, catalogue, judging, reports
from .operators.lines import exploded, split_lines
from .sources import files

#: Folders and name endings of the files that documents become; a document's number chooses.
PLACES = ("src", "vendor", "lib/node_modules/a", ".cache", "src/own", "docs/deep")
ENDS = (".py", ".go", ".min.js", ".js", ".txt", ".env", "", ".tar.py", "7.rs")


def chosen(values: tuple[str, ...]) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod("doc_id", F.lit(len(values))) + 1).cast("int"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of several folders and kinds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null")
    path = F.concat(chosen(PLACES), F.lit("/d"), F.col("doc_id").cast("string"), chosen(ENDS))
    return docs.select(path.alias("path"), F.col("text").alias("content"))


def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree that documents were written to, read without a folder and a pattern of its own: what is left and what it holds."""
    root = f"{storage.scratch(spark, 'tree')}/project"
    files.write_tree(documents(spark, sf_dir), root)
    local = storage.filesystem(root)[1]
    rows = files.read_tree(spark, local, "own", "d[1-4]*.rs")
    return rows.select(F.substring("path", len(local) + 2, 1 << 20).alias("path"), "ext", "size", F.sha2("content", 256).alias("sha256"))


def tree_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of that tree as the tasks list it, in rounds of few entries, and how many lines each file has."""
    root = f"{storage.scratch(spark, 'tree')}/project"
    files.write_tree(documents(spark, sf_dir), root)
    local = storage.filesystem(root)[1]
    rows = files.with_contents(files.walked(spark, local, most=2))
    return rows.select(F.substring("path", len(local) + 2, 1 << 20).alias("path"), "ext", "size", F.size(F.split("content", "\n", -1)).alias("lines"))


def line_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The levelled pattern of every line of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    rows = exploded(split_lines(docs))
    return rows.select(F.col("path").cast("long").alias("doc_id"), "line", T.code_pattern(F.col("code")).alias("pattern"), T.pattern_hash(F.lit(" a.rule "), F.col("code")).alias("hash"))


def rules_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalogue.applicable(documents(spark, sf_dir).select("path"), catalogue.rules(spark))
    return rows.select("path", "language", F.size("rules").alias("n"), F.array_join("rules", ",").alias("rules"))


def unapplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rulings proposed twice, of which those about every other rule were applied before."""
    ruled = judging.approved_amendments(judging.senate_verdicts(senate_documents(spark, sf_dir)))
    applied = ruled.where(F.substring("rule_id", 2, 20).cast("long") % 2 == 0)
    return adjudication.new_amendments(ruled.unionByName(ruled), applied).select("verdict_id", "rule_id", "action", "severity")


def report_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = found(spark, sf_dir)
    return reports.text_blocks(rows).select("seq", "block").join(reports.json_findings(rows).select("seq", "finding"), "seq")


def report_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written by many tasks and read back."""
    folder = storage.scratch(spark, "report")
    reports.write_report(found(spark, sf_dir).where("rule is not null"), folder, "src", 1, AT, 2)
    return reports.read_report(spark, folder).select("place", "severity", "file", "line", "rule", "code", "context", "suggestion")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "source_tree_files": tree_files,
    "source_tree_listing": tree_listing,
    "line_patterns": line_patterns,
    "rules_of_files": rules_of_files,
    "amendments_unapplied": unapplied,
    "report_blocks": report_blocks,
    "report_folder": report_folder,
}

# Fixed values, written out once more for the SQL: words that patterns keep.
WORDS = (
    "'if','else','for','range','switch','case','default','try','catch','finally','except','def','func','return','nil','null','true','false','throw','raise','await',"
    "'async','const','let','var','class','new','import','from','package','break','continue','pass','while'"
)


def listed(values: tuple[str, ...]) -> str:
    return "([" + ", ".join(f"'{x}'" for x in values) + f"])[(doc_id % {len(values)} + 1)::INT]"


FILES = f"f AS (SELECT doc_id, {listed(PLACES)} AS folder, {listed(ENDS)} AS ending, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL), p AS (SELECT *, folder || '/d' || doc_id || ending AS path, CASE WHEN ending IN ('.min.js', '.tar.py') THEN ending[5:] WHEN ending = '7.rs' THEN '.rs' ELSE ending END AS ext FROM f)"
#: Each word by itself: what RE2 has no look-ahead for is a list of words here.
PATTERN = f"""
t AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM t),
n AS (SELECT doc_id, unnest(range(1, len(l) + 1))::INT AS line, unnest(l) AS code FROM c),
q AS (SELECT doc_id, line, regexp_replace(trim(code, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '"[^"\\\\]*(?:\\\\.[^"\\\\]*)*"|"[^"]*"|' || '''[^''\\\\]*(?:\\\\.[^''\\\\]*)*''|''[^'']*''', 'str', 'g') AS code FROM n),
m AS (SELECT doc_id, line, regexp_extract_all(regexp_replace(code, '\\b[0-9]+(?:\\.[0-9]+)?\\b', 'num', 'g'), '[0-9A-Za-z_]+|[^0-9A-Za-z_]+') AS w FROM q),
v AS (SELECT doc_id, line, list_transform(w, lambda x: CASE WHEN lower(x) IN ({WORDS}) THEN lower(x) WHEN regexp_matches(x, '^[A-Za-z_]') THEN 'id' ELSE x END) AS w FROM m),
z AS (SELECT doc_id, line, trim(regexp_replace(array_to_string(w, ''), '[\\t\\n\\f\\r ]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS pattern FROM v)"""
EVENTS = "f AS (SELECT event_id AS seq, 'ev.' || event_type AS rule, CASE WHEN event_type = 'purchase' THEN 'error' ELSE 'info' END AS severity, 'u' || user_id AS file, (event_id % 50 + 1)::INT AS line, array_to_string(list_transform(range(user_id % 12 + 1), lambda i: 'a'), ' ') AS code FROM events)"

ORACLES: dict[str, str] = {
    "source_tree_files": f"WITH {FILES} SELECT path, ext, strlen(text)::BIGINT AS size, sha256(text) AS sha256 FROM p WHERE folder IN ('src', 'docs/deep') AND ending NOT IN ('.min.js', '.txt', '') AND NOT (ext = '.rs' AND regexp_matches(doc_id::VARCHAR, '^[1-4]'))",
    "source_tree_listing": f"WITH {FILES} SELECT path, ext, strlen(text)::BIGINT AS size, len(string_split(text, chr(10)))::INT AS lines FROM p WHERE folder IN ('src', 'src/own', 'docs/deep') AND ending NOT IN ('.min.js', '.txt', '')",
    "line_patterns": f"WITH {PATTERN} SELECT doc_id, line, pattern, sha256('a.rule' || chr(10) || pattern) AS hash FROM z",
    "rules_of_files": f"""WITH {RULE_ROWS}, {FILES}, r AS (SELECT DISTINCT id, unnest(string_split(types, ' ')) AS type FROM rules), k AS (SELECT path, ext, id FROM p JOIN r ON type = ext OR type = '*')
      SELECT path, CASE WHEN ext = '.go' THEN 'go' WHEN ext = '.js' THEN 'jsts' WHEN ext = '.py' THEN 'python' END AS language, count(DISTINCT id)::INT AS n, string_agg(DISTINCT id, ',' ORDER BY id) AS rules FROM k GROUP BY 1, 2""",
    "amendments_unapplied": "SELECT 'v' || event_id AS verdict_id, 'r' || user_id AS rule_id, (['disable_rule', 'enable_rule', 'set_severity'])[(event_id % 4 + 1)::INT] AS action, 'info' AS severity FROM events WHERE event_id % 7 <> 0 AND event_id % 5 <> 0 AND event_id % 4 <> 3 AND user_id % 2 <> 0",
    "report_blocks": f"""WITH {EVENTS} SELECT seq, CASE severity WHEN 'error' THEN 'ERROR ' ELSE 'INFO  ' END || '  ' || rule || chr(10) || '  ' || file || ':' || line || chr(10) || '  > ' || code || chr(10) || '  m' || chr(10) || '  → s' || chr(10) AS block,
      '{{"rule":"' || rule || '","severity":"' || severity || '","file":"' || file || '","line":' || line || ',"code":"' || code || '","message":"m","suggestion":"s"}}' AS finding FROM f""",
    "report_folder": f"WITH {EVENTS} SELECT row_number() OVER (ORDER BY CASE severity WHEN 'error' THEN 0 ELSE 2 END, file, line, rule, code)::INT AS place, severity, file, line, rule, code, NULL::VARCHAR AS context, 's' AS suggestion FROM f WHERE rule IS NOT NULL",
}
