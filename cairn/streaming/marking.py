"""The marking of measurement points as a fold of events, for batches and, with kept state, for streams.

A point on another plane starts again; points beyond the full number are ignored; undo drops the last, reset all.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

State = tuple[int, list[float]]


def step(state: State, action: str, plane: int, x: float, full: int) -> State:
    at, points = state
    if action == "reset":
        return -1, []
    if action == "undo":
        return at, points[:-1]
    if plane != at:
        return plane, [x]
    return (at, points) if len(points) >= full else (at, [*points, x])


def folded(events: DataFrame, key: str, order: str, full: int) -> DataFrame:
    """(key, plane, n_points, complete, points) after all events (key, order, action, plane, x) of each key.

    Rows stream through sorted by key and order; a session is never held whole.
    """
    schema = f"{key} long, plane int, n_points int, complete boolean, points array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state, out = None, (-1, []), []
        for batch in batches:
            for k, action, plane, x in zip(batch[key], batch["action"], batch["plane"], batch["x"]):
                if at is not None and k != at:
                    out.append((at, state[0], len(state[1]), len(state[1]) >= full, state[1]))
                    state = (-1, [])
                at = k
                state = step(state, action, int(plane), float(x), full)
            if len(out) > 1000:
                yield pd.DataFrame(out, columns=[key, "plane", "n_points", "complete", "points"])
                out = []
        if at is not None:
            out.append((at, state[0], len(state[1]), len(state[1]) >= full, state[1]))
        yield pd.DataFrame(out, columns=[key, "plane", "n_points", "complete", "points"])

    return events.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)


_OUT = "k long, plane int, n_points int, complete boolean"
_NEWS = ["k", "plane", "n_points", "complete"]


class _Session(StatefulProcessor):
    """The fold of one session. Events wait, by number, until the watermark has passed them, so that late ones are folded in
    order and repeated ones once; a session without events for ``idle_ms`` of event time is forgotten."""

    def __init__(self, full: int, idle_ms: int):
        self.full, self.idle_ms = full, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "n long", "ms long, action string, plane int, x double")
        self.marks = handle.getValueState("marks", "plane int, points array<double>, n long, ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.marks.get()[2] if self.marks.exists() else None
        for part in rows:
            for n, ms, action, plane, x in zip(part["n"], part["ms"], part["action"], part["plane"], part["x"]):
                if (last is None or n > last) and not self.waiting.containsKey((int(n),)):
                    self.waiting.updateValue((int(n),), (int(ms), action, int(plane), float(x)))
                    self.handle.registerTimer(int(ms))
        yield pd.DataFrame(columns=_NEWS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        plane, points, last, ms = self.marks.get() if self.marks.exists() else (-1, [], -(2**63), at)
        due = sorted((k[0], *v) for k, v in self.waiting.iterator() if v[0] <= at)
        state: State = (plane, list(points))
        for n, when, action, to, x in due:
            state = step(state, action, to, x, self.full)
            self.waiting.removeKey((n,))
            last, ms = max(last, n), max(ms, when)
        if due:
            self.marks.update((state[0], state[1], last, ms))
            self.handle.registerTimer(ms + self.idle_ms)
            yield pd.DataFrame([(key[0], state[0], len(state[1]), len(state[1]) >= self.full)], columns=_NEWS)
        else:
            if at >= ms + self.idle_ms and not any(True for _ in self.waiting.keys()):
                self.marks.clear()
            yield pd.DataFrame(columns=_NEWS)


def folded_stream(events: DataFrame, key: str, order: str, time: str, full: int, delay: str = "10 seconds", idle_ms: int = 60_000) -> DataFrame:
    """The same over a stream: (key, plane, n_points, complete) of a session whenever the watermark, ``delay`` behind the
    newest event ``time``, has passed events of it. The state of a session goes when nothing has come for ``idle_ms`` of
    event time; what comes later than the watermark is dropped, as everywhere in Spark. Needs the RocksDB state store."""
    ms = (F.unix_micros(time) / 1000).cast("long")
    rows = events.withWatermark(time, delay).select(F.col(key).cast("long").alias("k"), F.col(order).cast("long").alias("n"), time, ms.alias("ms"), "action", F.col("plane").cast("int").alias("plane"), F.col("x").cast("double").alias("x"))
    out = rows.groupBy("k").transformWithStateInPandas(_Session(full, idle_ms), _OUT, "Update", "EventTime")
    return out.withColumnRenamed("k", key)
