"""Incremental operation: debounced file events, changed lines against the last snapshot, filtered findings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.findings import has_errors
from ..plans.scan import scan


def debounced(events: DataFrame, gap: str = "100 milliseconds", late: str = "1 minute") -> DataFrame:
    """The last event of each burst per path: events closer than ``gap`` are one burst.

    Of events at one time the one of greatest content counts. On streams events more than ``late`` behind are dropped,
    and a burst is given when the watermark has passed it (append mode).
    """
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    session = F.session_window("ts", gap)
    last = F.max(F.struct("ts", "content")).alias("last")
    return events.groupBy("path", session).agg(last, F.count("*").alias("events")).select("path", "last.content", "last.ts", "events")


#: Cells of the table of subsequences whose ways back are kept at once, a bit each.
CELLS = 1 << 26


def next_row(row: np.ndarray, y: np.ndarray, x: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The table's row below ``row`` for the line ``x``; where the way back pairs lines, and where else it goes up."""
    same = y == x
    # A cell is the greatest of the one above and, at matches left of it or there, the diagonal one plus one.
    new = np.append(0, np.maximum.accumulate(np.maximum(row[1:], np.where(same, row[:-1] + 1, 0)))).astype(np.int32)
    return new, same, ~same & (row[1:] >= new[:-1])


def way_back(x: np.ndarray, y: np.ndarray, row: np.ndarray, j: int, changed: list[int]) -> int:
    """Walks from the last of the rows ``x`` under ``row`` and column ``j`` up to ``row``; the column there.

    Columns that the way leaves to the left are added to ``changed``. Rows of too many cells are halved: every cell takes
    along the column in which its way crosses the middle row, so the way's crossing is known once the last row is, and the
    halves are walked one after the other. Memory is a few rows a halving, and CELLS bits.
    """
    if j == 0:
        return 0
    y, row = y[:j], row[: j + 1]
    if len(x) > 1 and len(x) * j > CELLS:
        middle, at = len(x) // 2, row
        for code in x[:middle]:
            at = next_row(at, y, code)[0]
        below, cross, here = at, np.arange(j + 1), np.arange(j + 1)
        for code in x[middle:]:
            below, pairs, ups = next_row(below, y, code)
            own = np.append(0, np.where(pairs, cross[:-1], cross[1:]))
            # A way to the left ends at the next column from which it goes on upwards.
            own = own[np.maximum.accumulate(np.where(np.append(True, pairs | ups), here, 0))]
            cross = own
        mid = int(cross[j])
        found = way_back(x[middle:], y, at, j, changed)
        assert found == mid, "the halves meet"
        return way_back(x[:middle], y, row, mid, changed)
    ways = []
    for code in x:
        row, pairs, ups = next_row(row, y, code)
        ways.append((np.packbits(pairs), np.packbits(ups)))
    bit = lambda bits, k: bits[k >> 3] >> (7 - (k & 7)) & 1
    for pairs, ups in reversed(ways):
        while j and not bit(pairs, j - 1) and not bit(ups, j - 1):
            changed.append(j)
            j -= 1
        if not j:
            return 0
        j -= int(bit(pairs, j - 1))
    return j


def changed_lines(before: list[str], after: list[str]) -> list[int]:
    """Numbers (from 1) of lines of ``after`` outside a longest common subsequence with ``before``.

    On ties the walk goes up in ``before`` first. Equal ends are cut off first, and lines of ``before`` that ``after`` does not
    have, which keeps the subsequence's length and the walk's way.
    """
    start = 0
    while start < min(len(before), len(after)) and before[start] == after[start]:
        start += 1
    end = 0
    while end < min(len(before), len(after)) - start and before[-1 - end] == after[-1 - end]:
        end += 1
    # Lines at the start are only cut off if the rest has none in common with them: else the walk may pair others.
    codes: dict[str, int] = {}
    x = np.array([codes.setdefault(s, len(codes)) for s in before[: len(before) - end]], np.int32)
    y = np.array([codes.setdefault(s, len(codes)) for s in after[: len(after) - end]], np.int32)
    if start and not (set(before[:start]) & {*before[start:], *after[start:]}):
        x, y = x[start:], y[start:]
    else:
        start = 0
    changed: list[int] = []
    rest = way_back(x[np.isin(x, y)], y, np.zeros(len(y) + 1, np.int32), len(y), changed)
    changed += range(rest, 0, -1)
    return [k + start for k in reversed(changed)]


def file_lines(content: str) -> list[str]:
    lines = content.split("\n")
    return lines[:-1] if lines and lines[-1] == "" else lines


def tracked(events: DataFrame, contents: bool = False, quiet_ms: int = 0) -> DataFrame:
    """Changed lines (path, ts, line, code) of each event (path, ts, content) against the path's snapshot, kept as state.

    A path seen for the first time has changed in all its lines. Events of one path in a micro-batch follow each
    other by ``ts``; the lines of each are given with it, so that a line that changes twice stands twice. With
    ``contents`` every event gives one more row, of line 0, that carries its content. With ``quiet_ms`` a path's events are
    held until none has come for so long: a timer of its own in the path's state then lets the last one through alone.
    """
    schema = "path string, ts timestamp, line int, code string" + (", content string" if contents else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def told(path: str, ts: Any, before: list[str] | None, content: str) -> tuple[list[str], list[tuple[Any, ...]]]:
        after = file_lines(content)
        lines = range(1, len(after) + 1) if before is None else changed_lines(before, after)
        out = [(path, ts, k, after[k - 1], None)[: len(names)] for k in lines]
        return after, [*out, (path, ts, 0, None, content)] if contents else out

    def update(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lines, held, held_at = state.get if state.exists else (None, None, None)
        before, out = None if lines is None else list(lines), []
        if state.hasTimedOut:
            before, out = told(key[0], held_at, before, held)
            state.update((before, None, None))
        else:
            rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
            if quiet_ms:
                state.update((before, rows["content"].iloc[-1], rows["ts"].iloc[-1].to_pydatetime()))
                state.setTimeoutDuration(quiet_ms)
            else:
                for ts, content in zip(rows["ts"], rows["content"], strict=True):
                    before, found = told(key[0], ts, before, content)
                    out += found
                state.update((before, None, None))
        if out:
            yield pd.DataFrame(out, columns=names)

    timer = GroupStateTimeout.ProcessingTimeTimeout if quiet_ms else GroupStateTimeout.NoTimeout
    return events.groupBy("path").applyInPandasWithState(update, schema, "lines array<string>, held string, held_at timestamp", "append", timer)


#: Fixed value: a file is scanned once nothing was written to it for so many milliseconds.
QUIET_MS = 100


def watch(events: DataFrame, checkpoint: str, handle: Callable[[DataFrame], None], quiet_ms: int = QUIET_MS, **how) -> tuple[StreamingQuery, Session]:
    """Scans each changed file and hands its findings on changed lines to ``handle``, micro-batch by micro-batch.

    ``events`` (path, ts, content) is a stream; ``how`` goes to ``scan``. A burst of writes to a file, none ``quiet_ms`` after the
    one before, is one change. The session's flag is set once an error was found.
    """
    session = Session()
    text = F.struct("ts", "content")

    def each(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            if not batch.take(1):  # timers wake the query without news
                return
            # The last content of a path in the batch is scanned, and kept where any of its lines changed on the way.
            last = batch.groupBy("path").agg(F.max(text).alias("last"))
            found = scan(last.select("path", "last.content"), changed=batch.where("line > 0").select(F.col("path").alias("file"), "line").distinct(), **how)
            found = found.persist()
            session.errors = session.errors or has_errors(found)
            handle(found)
            found.unpersist()
        finally:
            batch.unpersist()

    query = tracked(events, contents=True, quiet_ms=quiet_ms).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
    return query, session


@dataclass
class Session:
    """What a run of ``watch`` ends with: 1 if any batch had an error, else 0."""

    errors: bool = False

    @property
    def exit_code(self) -> int:
        return int(self.errors)
