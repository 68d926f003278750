"""Verdicts on findings: batches by pattern, sure precedents, a judge within a budget, fallbacks, and what follows.

The judge is a table of answers, or a function that makes one from the batches that need it; the plan around it is
the same. Verdicts of batches are dealt out to all their findings; tokens count once a batch.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import storage
from ..functions import text as T
from . import adjudication, running
from .reports import rfc3339

# What is said of verdicts that no model gave.
AUTO, EXHAUSTED = "Auto-applied high-confidence precedent.", "Budget exhausted; applied matching precedent."
ANSWERS = "rule string, pattern_hash string, verdict string, reasoning string, confidence double, precedent_decision string, precedent_rationale string, tokens_in int, tokens_out int"
ANSWER = "verdict string, reasoning string, confidence double, precedent_decision string, precedent_rationale string"
AMENDMENT = "rule_id:string,action:string,severity:string,exception:string,rationale:string"
SENATE = f"id string, status string, decided_at timestamp, amendments array<struct<{AMENDMENT}>>"
#: Recorded costs in USD, exact to a millionth of a millionth: their sum is the same in whatever parts it is taken.
MONEY = "decimal(38,12)"

#: A brace, or a whole string (one that never ends takes the rest).
MARKS = re.compile(r'[{}]|"(?:[^"\\]|\\.|\\\Z)*(?:"|\Z)', re.S)


def json_object(text: str | None) -> str | None:
    """The first balanced ``{...}`` of a text, strings and escapes respected; none if it never closes.

    Answers are one a batch and short; only the marks that matter are visited.
    """
    start, depth = (text or "").find("{"), 0
    for m in MARKS.finditer(text or "", max(start, 0)):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if depth == 0 and m[0] == "}":
            return text[start : m.end()]
    return None


@F.pandas_udf(StringType())
def _json_object(texts: pd.Series) -> pd.Series:
    return texts.map(json_object)


def parsed_answers(rows: DataFrame, column: str = "raw") -> DataFrame:
    """``rows`` with the columns of ``ANSWER`` from a model's text and ``problem`` where it is none."""
    v = F.from_json(_json_object(column), ANSWER)
    out = rows.withColumn("_v", v)
    t = lambda name: T.trimmed(F.col(f"_v.{name}"))
    text = {n: t(n) for n in ("verdict", "reasoning", "precedent_decision", "precedent_rationale")}
    confidence = F.coalesce("_v.confidence", F.lit(0.0))
    out = out.withColumns(text | {"confidence": confidence})
    empty = lambda n: F.coalesce(F.col(n), F.lit("")) == ""
    problem = (
        F.when(F.col("_v").isNull(), "no json object")
        .when(~F.coalesce(F.col("verdict").isin("guilty", "not_guilty", "advisory"), F.lit(False)), "invalid verdict")
        .when(empty("reasoning"), "reasoning is required")
        .when((F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence out of range")
        .when(~F.coalesce(F.col("precedent_decision").isin("allow", "deny"), F.lit(False)), "invalid precedent_decision")
        .when(empty("precedent_rationale"), "precedent_rationale is required")
    )
    return out.withColumn("problem", problem).drop("_v")


#: What it may mean that a judge cannot be reached or did not answer in time.
UNAVAILABLE = (OSError, TimeoutError)
#: Calls of a wave at most: what runs at once, and what is asked again if a wave is lost.
WAVE = 1024


def asked(ask: Callable[[dict], tuple[str, int, int]], unavailable: tuple[type[Exception], ...] = UNAVAILABLE) -> Callable[[DataFrame], DataFrame]:
    """A judge from a function that takes a batch as a dict and gives the model's text and token counts.

    It runs in the tasks. A batch for which it raises one of ``unavailable``, or whose text does not parse, has a ``problem`` in
    the place of an answer; any other exception is a fault of the function and fails the job.
    """

    def judge(batches: DataFrame) -> DataFrame:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                rows = []
                for row in part.to_dict("records"):
                    try:
                        rows.append((row["rule"], row["pattern_hash"], *ask(row), None))
                    except unavailable as e:
                        rows.append((row["rule"], row["pattern_hash"], None, 0, 0, f"unavailable: {e}"))
                yield pd.DataFrame(rows, columns=["rule", "pattern_hash", "raw", "tokens_in", "tokens_out", "lost"])

        raw = batches.mapInPandas(run, "rule string, pattern_hash string, raw string, tokens_in int, tokens_out int, lost string")
        return parsed_answers(raw).withColumn("problem", F.coalesce("lost", "problem")).select(*(x.split()[0] for x in ANSWERS.split(", ")), "problem")

    return judge


def told(answers: DataFrame) -> DataFrame:
    """Answers under names of their own, with what they cost; those with a problem cost nothing."""
    names = [x.split()[0] for x in ANSWERS.split(", ")][2:]
    problem = F.col("problem") if "problem" in answers.columns else F.lit(None).cast("string")
    cost = F.when(problem.isNull(), adjudication.token_cost(F.col("tokens_in"), F.col("tokens_out"))).otherwise(0.0)
    return answers.select("rule", "pattern_hash", *(F.col(c).alias(f"a_{c}") for c in names), cost.alias("a_cost"), problem.alias("problem"))


def in_waves(batches: DataFrame, judge: Callable[[DataFrame], DataFrame], budget: float, dearest: float = 0.0, most: int = WAVE) -> DataFrame:
    """Answers of a judge that is asked in order of ``place`` while what was spent is below ``budget``; each batch once at most.

    Calls go out in waves. A wave has as many calls as the rest of the budget pays for at the price of the dearest call, known
    (``dearest``) or so far, so none is made that asking one after the other would not make; only where ``dearest`` is not
    given and a call costs more than all before it may the rest of its wave be too many. Those answers have ``a_paid`` false.
    A wave's answers are written before the next wave, so a lost executor or a second look at the result asks nothing anew.
    """
    spark = batches.sparkSession
    order = [*(F.col(f"place.{n}") for n in ("file", "line", "seq")), F.col("rule"), F.col("pattern_hash")]
    rows = storage.saved(batches.withColumn("_key", F.struct(*(x.alias(f"k{i}") for i, x in enumerate(order)))), "batches")
    folder, spent, last, size, k = storage.scratch(spark, "waves"), 0.0, None, 1, 0
    if dearest > 0:
        size = max(1, min(most, math.ceil(budget / dearest - 1e-9)))
    before = Window.orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)  # over the rows of one wave
    while spent < budget:
        rest = rows if last is None else rows.where(F.col("_key") > F.struct(*(F.lit(x).cast(f.dataType).alias(f"k{i}") for i, (x, f) in enumerate(zip(last, rows.schema["_key"].dataType, strict=True)))))
        wave = storage.saved(rest.orderBy("_key").limit(size), "wave")
        end = wave.agg(F.count("*"), F.max("_key")).first()
        if not end[0]:
            break
        found = told(judge(wave.drop("_key"))).join(wave.select("rule", "pattern_hash", "_key"), ["rule", "pattern_hash"])
        found.write.parquet(f"{folder}/raw/wave={k}")
        answers = spark.read.parquet(f"{folder}/raw/wave={k}")
        paid = (F.coalesce(F.sum("a_cost").over(before), F.lit(0.0)) + spent) < budget
        answers.withColumn("a_paid", paid).write.parquet(f"{folder}/answers/wave={k}")
        cost, price = answers.agg(F.sum("a_cost"), F.max("a_cost")).first()
        spent, dearest, last, k = spent + (cost or 0.0), max(dearest, price or 0.0), end[1], k + 1
        if end[0] < size:
            break
        size = most if dearest <= 0 else max(1, min(most, math.ceil((budget - spent) / dearest - 1e-9)))
    if not k:
        return told(judge(batches.limit(0))).withColumn("a_paid", F.lit(True))
    return spark.read.parquet(f"{folder}/answers").drop("_key", "wave")


def judged(findings: DataFrame, precedents: DataFrame, answers: DataFrame | Callable[[DataFrame], DataFrame], least: float = 0.0, sure: float = 0.9, budget: float = 0.0, strict: bool = True, dearest: float = 0.0) -> DataFrame:
    """One verdict a batch (rule, pattern_hash): its source, tokens and cost, and how it came about.

    A best precedent surer than ``sure`` decides. Other batches are judged in order while what earlier ones cost is
    below ``budget`` (0 is no limit); the best precedent of ``least`` confidence stands in for an answer that is missing
    or not paid for. A batch with neither fails the job if ``strict``, else has no verdict. Answers are a table of recorded
    ones, or a judge that is asked now: each open batch once, and none once the budget is spent (``in_waves``).
    """
    batches = adjudication.pattern_batches(findings)
    top = adjudication.matches(batches, precedents, 0.0, 1).select("rule", "pattern_hash", "decision", "rationale", F.col("confidence").alias("stored"), "effective")
    rows = batches.join(top, ["rule", "pattern_hash"], "left").withColumn("auto", F.coalesce(F.col("effective") > sure, F.lit(False)))
    if callable(answers):
        rows = storage.saved(rows, "batches")
    open_ = rows.where(~F.col("auto"))
    if callable(answers):
        asking = open_.select("rule", "pattern_hash", "first.*", "items", "place")
        given = in_waves(asking, answers, budget, dearest) if budget > 0 else storage.saved(told(answers(asking)), "answers").withColumn("a_paid", F.lit(True))
        rows = rows.join(given, ["rule", "pattern_hash"], "left").withColumn("paid", F.coalesce("a_paid", F.lit(budget <= 0)))
        rows = rows.withColumn("cost", F.when(~F.col("auto"), F.coalesce("a_cost", F.lit(0.0))).otherwise(0.0))
    else:
        rows = rows.join(told(answers), ["rule", "pattern_hash"], "left").withColumn("cost", F.when(~F.col("auto"), F.coalesce("a_cost", F.lit(0.0))).otherwise(0.0))
        # What is spent only grows, so after the first batch that is not paid for none is: a running sum tells.
        if budget > 0:
            order = [F.col(c) for c in ("place", "rule", "pattern_hash")]
            rows = running.sums_before(rows, F.col("cost").cast(MONEY), order, "_spent").withColumn("paid", F.col("_spent") < F.lit(budget).cast(MONEY))
        else:
            rows = rows.withColumn("paid", F.lit(True))
    by = F.when(F.col("auto"), "auto").when(F.col("paid") & F.col("problem").isNull() & F.col("a_verdict").isNotNull(), "llm").when(F.col("effective") >= least, "fallback")
    rows = rows.withColumn("by", by)
    model, past = F.col("by") == "llm", F.col("by").isin("auto", "fallback")
    reason = F.when(F.col("by") == "auto", AUTO).when(model, F.col("a_reasoning")).when(past & ~F.col("paid"), EXHAUSTED).when(past, "Applied matching precedent in place of a verdict.")
    verdict = F.when(model, F.col("a_verdict")).when(past, F.when(F.col("decision") == "allow", "not_guilty").otherwise("guilty"))
    if strict:
        verdict = F.when(F.col("by").isNull(), F.raise_error(F.concat(F.lit("no verdict and no precedent for "), "rule"))).otherwise(verdict)
    used = lambda c, other: F.when(model, F.col(f"a_{c}")).when(past, other)
    spent = lambda c: F.when(model, F.col(c)).otherwise(0)
    return rows.select(
        "rule", "pattern_hash", "items", "place", verdict.alias("verdict"), reason.alias("reasoning"),
        used("confidence", adjudication.effective(F.col("stored"))).alias("confidence"), used("precedent_decision", F.col("decision")).alias("precedent_decision"), used("precedent_rationale", F.col("rationale")).alias("precedent_rationale"),
        F.when(model, "llm").when(past, "precedent").alias("source"), "by", spent("a_tokens_in").alias("tokens_in"), spent("a_tokens_out").alias("tokens_out"), F.when(model, F.col("cost")).otherwise(0.0).alias("cost"),
        F.col("effective").isNotNull().alias("matched"), (~F.col("paid") & ~F.col("auto")).alias("unpaid"), F.when(~F.col("auto"), F.col("problem")).alias("problem"), (F.col("a_cost").isNotNull() & ~F.col("auto")).alias("asked"),
    )


def dealt_out(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Every finding with its batch's verdict."""
    kept = verdicts.select("rule", "pattern_hash", "verdict", "reasoning", "confidence", "precedent_decision", "precedent_rationale", "source", "tokens_in", "tokens_out")
    return adjudication.hashed(findings).join(kept, ["rule", "pattern_hash"])


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """Numbers of a run, from its batches: findings by verdict, calls, tokens and cost once a batch."""
    n = lambda test: F.sum(F.when(test, F.col("items")).otherwise(0))
    is_ = lambda v: F.col("verdict") == v
    return verdicts.agg(
        F.sum("items").alias("total"), n(is_("guilty")).alias("guilty"), n(is_("not_guilty")).alias("not_guilty"), n(is_("advisory")).alias("advisory"), F.count("*").alias("batches"), n(F.col("matched")).alias("precedent_matches"),
        F.count_if(F.col("by") == "auto").alias("auto_applied"), F.count_if(F.col("by") == "llm").alias("llm_calls"), F.count_if(F.col("problem").isNotNull()).alias("failed_calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum("cost"), 9).alias("cost"), F.coalesce(F.bool_or("unpaid"), F.lit(False)).alias("budget_exhausted"),
    )


def debts(verdicts: DataFrame, at: Column) -> DataFrame:
    """Records of debt for advisory verdicts on findings."""
    return verdicts.where("verdict = 'advisory'").select(F.col("rule").alias("rule_id"), "file", "line", "code", "message", "reasoning", at.alias("created_at"))


def decisions(verdicts: DataFrame, at: Column, root: str = "") -> DataFrame:
    """Precedents that verdicts on findings set, in order of ``seq``; those without a rationale set none."""
    kept = verdicts.where(F.coalesce(T.trimmed(F.col("precedent_rationale")), F.lit("")) != "")
    own = T.violation_hash(F.col("rule"), F.col("file"), F.col("line"), F.col("code"), root)
    return kept.select(F.col("rule").alias("rule_id"), own.alias("violation_hash"), "pattern_hash", F.col("precedent_decision").alias("decision"), F.col("precedent_rationale").alias("rationale"), "confidence", F.lit(1).alias("seen_count"), at.alias("created_at"), at.alias("last_seen"), F.col("seq").alias("ord"))


def proposals(candidates: DataFrame, catalogue: DataFrame, threshold: int) -> DataFrame:
    """A Markdown section (``text``) for each law candidate, numbered by ``place``: most frequent first.

    Labels and the two suggestions are fixed values: the format that reviews of proposals read.
    """
    known = F.broadcast(catalogue.select(F.col("id").alias("rule_id"), F.col("message").alias("description")))  # about a hundred rows
    order = [F.desc("n"), *map(F.col, ("rule_id", "decision", "pattern_hash"))]
    rows = running.numbered(candidates.join(known, "rule_id", "left"), order)
    hint = F.when(F.col("decision") == "allow", "Add a targeted exception for this pattern (pattern consistently judged not-guilty).").otherwise("Tighten enforcement for this pattern (pattern consistently judged guilty).")
    text = F.concat(
        F.lit("## Proposal "), F.col("place").cast("string"), F.lit(": `"), "rule_id", F.lit("`\n\n- Current rule: "), F.coalesce("description", F.lit("(rule description unavailable)")), F.lit("\n- Pattern hash: `"), "pattern_hash", F.lit("`\n- Consistent decision: `"), "decision",
        F.lit("`\n- Evidence count: "), F.col("n").cast("string"), F.lit(f" (threshold {threshold})\n- First seen: "), rfc3339(F.col("first_seen")), F.lit("\n- Last seen: "), rfc3339(F.col("last_seen")), F.lit("\n- Suggested amendment: "), hint, F.lit("\n"),
    )
    return rows.select("place", "rule_id", "pattern_hash", "decision", text.alias("text"))


def write_proposals(sections: DataFrame, out, at: str) -> int:
    """Writes the document of ``proposals`` to a text stream: its head with the time ``at``, then the sections in order, or that there are none."""
    out.write(f"# Law Update Proposals\n\n_Generated: {at}_\n\n")
    n = 0
    for n, row in enumerate(sections.orderBy("place").select("text").toLocalIterator(), 1):
        out.write(row["text"] + "\n")
    if not n:
        out.write("No proposal candidates.\n")
    return n


def senate_verdicts(documents: DataFrame, column: str = "text") -> DataFrame:
    """Verdicts (``SENATE``) in documents: a JSON object, or the first fenced one; ``problem`` says why a document holds none."""
    from ..sources.stores import amendment_problem, blank

    raw = T.trimmed(F.col(column))
    payload = F.when(raw.startswith("{"), raw).otherwise(F.regexp_extract(raw, r"(?s)```json\s*(\{.*?\})\s*```", 1))
    rows = documents.withColumn("v", F.from_json(payload, SENATE))
    a = F.coalesce("v.amendments", F.array().cast(f"array<struct<{AMENDMENT}>>"))
    wrong = F.get(F.filter(F.transform(a, amendment_problem), lambda x: x.isNotNull()), F.lit(0))
    problem = (
        F.when(F.coalesce(raw, F.lit("")) == "", "empty document")
        .when(F.coalesce(payload, F.lit("")) == "", "no json object")
        .when(blank(F.col("v.id")), "id is required")
        .when(~F.coalesce(F.col("v.status").isin("approved", "rejected", "keep_as_is"), F.lit(False)), "invalid status")
        .when(wrong.isNotNull(), wrong)
        .when((F.col("v.status") == "approved") & (F.size(a) == 0), "an approved verdict needs amendments")
    )
    return rows.select(*documents.columns, "v.*", problem.alias("problem"))


def approved_amendments(verdicts: DataFrame) -> DataFrame:
    """Amendments (verdict_id, rule_id, ...) of approved verdicts without a problem, in order of ``place``."""
    ok = verdicts.where("problem is null and status = 'approved'")
    return ok.select(F.col("id").alias("verdict_id"), F.posexplode("amendments").alias("place", "x")).select("verdict_id", "place", "x.*")
