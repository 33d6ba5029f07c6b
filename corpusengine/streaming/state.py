"""State by key over ordered events, in batches of sorted partitions and over streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Failures that open a breaker, seconds that it stays open, seconds for which a finished task's result is used again.
FAILURES, COOLDOWN, REUSE = 2, 300.0, 300.0


def breaker_step(state: tuple[int, float], at: float, failed: bool | None) -> tuple[tuple[int, float], bool]:
    """State (failures, opened_at) after an event, and whether the breaker was open. ``failed`` None only asks."""
    failures, opened = state
    is_open = failures >= FAILURES and at - opened < COOLDOWN
    if failed is None:
        return ((failures, opened) if is_open or failures < FAILURES else (0, 0.0)), is_open
    if not failed:
        return (0, 0.0), is_open
    failures += 1
    return (failures, at if failures >= FAILURES else opened), is_open


def in_order(rows: DataFrame, keys: list[str], order: list[str], schema: str, start: Callable[[], Any], step: Callable[[Any, Any], tuple[Any, tuple | None]]) -> DataFrame:
    """Each key's rows in order through ``step(state, row)``, which returns the state after it and a row or None.

    Partitions are sorted by Spark and read in batches, so a task holds a batch and one key's state, however many rows a key has.
    """
    columns = [c.split()[0].strip("`") for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, start()
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                own = tuple(getattr(row, k) for k in keys)
                if own != key:
                    key, state = own, start()
                state, made = step(state, row)
                if made is not None:
                    out.append((*own, *made))
            yield pd.DataFrame(out, columns=[*keys, *[c for c in columns if c not in keys]])[columns]

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


BREAKER_SCHEMA = "source string, seq long, is_open boolean, failures int"


def breaker_replay(events: DataFrame) -> DataFrame:
    """``source, seq, is_open, failures`` for ``events(source, seq, at, kind)``, kind call, failure or success: state before a row's effect and failures after it."""

    def step(state: tuple[int, float], row: Any) -> tuple[tuple[int, float], tuple]:
        state, is_open = breaker_step(state, row.at, None if row.kind == "call" else row.kind == "failure")
        return state, (row.seq, is_open, state[0])

    return in_order(events, ["source"], ["at", "seq"], BREAKER_SCHEMA, lambda: (0, 0.0), step)


def breaker_stream(events: DataFrame) -> DataFrame:
    """The same over a stream, whose events come in order."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        have: Any = state.get if state.exists else (0, 0.0)
        pdf = pd.concat(list(frames))
        out = []
        for row in pdf.sort_values(["at", "seq"]).itertuples(index=False):
            have, is_open = breaker_step(have, row.at, None if row.kind == "call" else row.kind == "failure")
            out.append((key[0], row.seq, is_open, have[0]))
        state.update(have)
        yield pd.DataFrame(out, columns=["source", "seq", "is_open", "failures"])

    return events.groupBy("source").applyInPandasWithState(run, BREAKER_SCHEMA, "failures int, opened_at double", "append", GroupStateTimeout.NoTimeout)


def task_decisions(tasks: DataFrame) -> DataFrame:
    """``session, seq, decision`` for ``tasks(session, fingerprint, seq, at, done_at, has_path)``: run, wait (it is running) or reuse.

    A result is used again for REUSE seconds after the run began; a task with a path is never used again once done.
    """

    def step(state: tuple[float | None, float | None], row: Any) -> tuple[tuple, tuple]:
        began, done = state
        if began is not None and row.at < done:
            return state, (row.seq, "wait")
        if began is not None and not row.has_path and row.at - began <= REUSE:
            return state, (row.seq, "reuse")
        return (row.at, row.done_at), (row.seq, "run")

    return in_order(tasks, ["session", "fingerprint"], ["at", "seq"], "session string, fingerprint string, seq long, decision string", lambda: (None, None), step).drop("fingerprint")


def consolidation_batches(messages: DataFrame, by: str, seq: str, at: str, least: int = 50, seconds: float = 60.0) -> DataFrame:
    """``by, batch, first_seq, last_seq, n``: batches that close at a message once it is at least the ``least``-th since the last one and that long after it."""

    def step(state: tuple, row: Any) -> tuple[tuple, tuple | None]:
        batch, first, n, last = state
        s, t = getattr(row, seq), getattr(row, at)
        first, n, last = (s if first is None else first), n + 1, (t if last is None else last)
        if n >= least and t - last >= seconds:
            return (batch + 1, None, 0, t), (batch, first, s, n)
        return (batch, first, n, last), None

    kind = dict(messages.dtypes)[by]
    rows = messages.select(by, F.col(seq).cast("long").alias(seq), F.col(at).cast("double").alias(at))
    return in_order(rows, [by], [at, seq], f"`{by}` {kind}, batch int, first_seq long, last_seq long, n int", lambda: (0, None, 0, None), step)


def next_cursor(cursor: str | Column, tip: str | Column, failures: str | Column, outcome: str | Column, strikes: int = 3) -> Column:
    """``(cursor, failures)`` after a consolidation: a success moves the cursor to the tip, the third failure in a row moves it all the same,
    and an invalid request changes nothing and isn't counted."""
    cursor, tip, failures, outcome = (F.col(x) if isinstance(x, str) else x for x in (cursor, tip, failures, outcome))
    moves = (outcome == "success") | ((outcome == "failure") & (failures + 1 >= strikes))
    kept = F.when(outcome == "failure", failures + 1).otherwise(failures)
    return F.struct(F.when(moves, tip).otherwise(cursor).alias("cursor"), F.when(moves, F.lit(0)).otherwise(kept).cast("int").alias("failures"))
