"""Ordered folds of decisions in partial blocks.

A decision turns a pattern's confidence c into min(1, c + 0.1) where it agrees with the one before and into
max(0.2, c / 2) where it does not. Both are maps c -> min(high, max(low, a * c + b)), and such maps compose to maps of
the same shape, so the history of a pattern can be cut anywhere: rows are range-partitioned by pattern and order, each
task composes its part of every history as rows stream by, and only the first history of a task may go on from the
task before. What those start from, a row a task, is worked out from the tasks' last maps and told to all.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import saved

# Confidence of a new pattern, growth, decay and their bounds.
FIRST, UP, DOWN, FLOOR, CEILING = 0.6, 0.1, 0.5, 0.2, 1.0

KEYS = ("rule_id", "pattern_hash")
#: What a row tells: a decision with the confidence given to it, or a state (``fixed``) as it stands.
STEP = ("decision", "fixed", "value", "seen")
#: What a task adds: the task, the history's number in it, whether the row is its history's last one there, its history's first
#: row there, and the map from the state after that row to the state after this one, with the length of the run of equal decisions.
PREFIX = "block int, history long, last boolean, first_decision string, first_fixed boolean, first_value double, first_seen int, a double, b double, low double, high double, run int, whole boolean"


def agreed(m: tuple[float, ...]) -> tuple[float, ...]:
    """The map ``m`` (a, b, low, high), then one more equal decision."""
    a, b, low, high = m
    return a, b + UP, min(CEILING, low + UP), min(CEILING, high + UP)


def changed(m: tuple[float, ...]) -> tuple[float, ...]:
    """The map ``m``, then a decision of the other kind."""
    a, b, low, high = m
    return a * DOWN, b * DOWN, max(FLOOR, low * DOWN), max(FLOOR, high * DOWN)


def prefixes(rows: DataFrame, last_only: bool) -> DataFrame:
    """The saved table of ``rows`` (KEYS, ord, STEP, any more) with PREFIX; with ``last_only`` a history's last row in each task."""
    names = [*KEYS, *STEP]
    prefix = [x.split()[0] for x in PREFIX.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.bool_(), pa.float64(), pa.int32(), *[pa.float64()] * 4, pa.int32(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, history, key, before = TaskContext.get().partitionId(), -1, None, None
        held: tuple[list[pa.Array], tuple[Any, ...]] | None = None  # the row that may yet turn out to be its history's last

        def batch_of(columns: list[pa.Array], made: list[tuple[Any, ...]]) -> pa.RecordBatch:
            own = [pa.array(x, k) for x, k in zip(zip(*made, strict=True), kinds, strict=True)]
            out = pa.RecordBatch.from_arrays([*columns, *own], [*columns_of, *prefix])
            return out.filter(out.column(len(columns_of) + 2)) if last_only else out

        for batch in batches:
            if not batch.num_rows:
                continue
            columns_of, made = batch.schema.names, []
            for rule, pattern, decision, fixed, value, seen in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if history < 0 or key != (rule, pattern):
                    history, key, first = history + 1, (rule, pattern), (decision, fixed, value, seen)
                    m, length, whole = (1.0, 0.0, -np.inf, np.inf), 1, True
                elif decision == before:
                    m, length = agreed(m), length + 1
                else:
                    m, length, whole = changed(m), 1, False
                before = decision
                made.append((block, history, *first, *m, length, whole))
            if held:
                yield batch_of(held[0], [(*held[1][:2], held[1][1] != made[0][1], *held[1][2:])])
            full = [(*x[:2], x[1] != y[1], *x[2:]) for x, y in zip(made, made[1:], strict=False)]
            if full:
                yield batch_of(batch.slice(0, len(full)).columns, full)
            held = batch.slice(len(full)).columns, made[-1]
        if held:
            yield batch_of(held[0], [(*held[1][:2], True, *held[1][2:])])

    order = [*KEYS, "ord", "decision", "value"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return saved(ordered.mapInArrow(run, f"{schema}, {PREFIX}"), "prefixes")


def after(row: Any, start: tuple[str | None, float, int] | None) -> tuple[str | None, float, int]:
    """The state (decision, confidence, seen) after a row of ``prefixes`` whose history starts from ``start``."""
    if row["first_fixed"]:
        c, seen = row["first_value"], row["first_seen"]
    elif start is None:
        c, seen = (min(CEILING, row["first_value"]) if (row["first_value"] or 0) > 0 else FIRST), 1
    elif start[0] == row["first_decision"]:
        c, seen = min(CEILING, start[1] + UP), start[2] + 1
    else:
        c, seen = max(FLOOR, start[1] * DOWN), 1
    return row["decision"], min(row["high"], max(row["low"], row["a"] * c + row["b"])), (seen + row["run"] - 1 if row["whole"] else row["run"])


def states(rows: DataFrame, last_only: bool = False) -> DataFrame:
    """``rows`` with the state after each (``after_confidence``, ``after_seen``), or each history's last row with it.

    A row with ``fixed`` sets the state to ``value`` and ``seen``; a decision without one before takes ``value``, or 0.6 where
    that is not positive. Rows of equal ``ord`` go by decision and value; histories of null keys are histories too.
    """
    table = prefixes(rows, last_only)
    told = table.where("last")
    row = F.struct(*KEYS, "decision", "history", *(F.col(x.split()[0]) for x in PREFIX.split(", ")[3:]))
    # A row a task: its first and its last history.
    edges = told.groupBy("block").agg(F.min_by(row, "history").alias("first"), F.max_by(row, "history").alias("last")).orderBy("block").collect()
    starts, state = [], None
    for k, edge in enumerate(edges):
        key = lambda x: tuple(x[n] for n in KEYS)
        going_on = state is not None and state[0] == key(edge["first"])
        start = state[1] if going_on else None
        goes_on = k + 1 < len(edges) and key(edges[k + 1]["first"]) == key(edge["last"])
        starts.append((edge["block"], going_on, *(start or (None, None, None)), edge["last"]["history"] if goes_on else None))
        state = key(edge["last"]), after(edge["last"], start if edge["first"]["history"] == edge["last"]["history"] else None)
    known = rows.sparkSession.createDataFrame(starts, "block int, _on boolean, _decision string, _confidence double, _seen int, _open long")
    joined = table.join(F.broadcast(known), "block")
    on = F.col("_on") & (F.col("history") == 0)
    again = F.col("_decision").eqNullSafe(F.col("first_decision"))
    given = F.when(F.col("first_value") > 0, F.least(F.col("first_value"), F.lit(CEILING))).otherwise(FIRST)
    c = F.when(F.col("first_fixed"), F.col("first_value")).when(~on, given).when(again, F.least(F.lit(CEILING), F.col("_confidence") + UP)).otherwise(F.greatest(F.lit(FLOOR), F.col("_confidence") * DOWN))
    seen = F.when(F.col("first_fixed"), F.col("first_seen")).when(on & again, F.col("_seen") + 1).otherwise(1)
    confidence: Column = F.least(F.col("high"), F.greatest(F.col("low"), F.col("a") * c + F.col("b")))
    out = joined.withColumns({"after_confidence": confidence, "after_seen": F.when(F.col("whole"), seen + F.col("run") - 1).otherwise(F.col("run"))})
    if last_only:
        out = out.where(F.col("_open").isNull() | (F.col("history") != F.col("_open")))
    return out.select(*rows.columns, "after_confidence", "after_seen")
