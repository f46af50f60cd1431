"""State with timers: search windows of clients and the life of sources, as processors of keyed state.

State lies in RocksDB (set ``spark.sql.streaming.stateStore.providerClass`` to :data:`PROVIDER` before the query starts), keyed,
and goes when its timer fires: what a client or a source leaves behind does not outlive its window. Timers follow the
watermark, so a replay gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.access import FULL, SOME, WINDOW_S
from ..operators.lifecycle import EPHEMERAL_HOURS, SESSION_HOURS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _micros(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[us]").astype("int64")


class _Timed(StatefulProcessor):
    """One value and one timer a key."""

    #: The value's fields.
    value = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", self.value)

    def due(self, micros: int | None, known: bool) -> None:
        """The key's only timer, at the first millisecond after ``micros`` (none, if it is None). Each call of the handle is a
        message to the JVM: a key that was not ``known`` has no timer to look for."""
        if known:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
        if micros is not None:
            self.handle.registerTimer(micros // 1000 + 1)

    def close(self) -> None:
        pass


class _Window(_Timed):
    value = "begin long, n int"

    def __init__(self, window_s: int):
        self.width = window_s * 1_000_000

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        begin, n = held or (None, 0)
        calls = pd.concat(list(rows)).sort_values("at", kind="stable")
        counts = []
        for at in _micros(calls["at"]):
            if begin is None or at - begin > self.width:
                begin, n = int(at), 0
            n += 1
            counts.append(n)
        self.state.update((begin, n))
        self.due(begin + self.width, held is not None)
        limits = [0 if c > SOME else 1 if c > FULL else 2 for c in counts]
        yield pd.DataFrame({"client": [key[0]] * len(counts), "at": calls["at"].to_numpy(), "count": counts, "limit": limits}).astype({"count": "int32", "limit": "int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())


def throttle(calls: DataFrame, window_s: int = WINDOW_S, delay: str = "1 minute") -> DataFrame:
    """Calls (client, at) with count and limit, as :func:`access.throttle` has them: a client's window begins with its first
    call after the last one ended. Calls of a batch are taken in order; later than ``delay`` they are dropped. A window's state
    goes when the watermark has passed its end."""
    kind = calls.schema["client"].dataType.simpleString()
    keyed = calls.select("client", F.col("at").cast("timestamp").alias("at")).withWatermark("at", delay).groupBy("client")
    return keyed.transformWithStateInPandas(_Window(window_s), f"client {kind}, at timestamp, count int, limit int", "append", "EventTime")


class _Life(_Timed):
    """Of rows, not of pandas frames: a label has one or few of them, and a frame for each costs more than all else."""

    value = "kind string, at long"

    def __init__(self, hours: dict[str, float]):
        self.hours = hours

    def end(self, kind: str, at: int) -> int | None:
        return at + int(self.hours[kind] * 3_600_000_000) if kind in self.hours else None

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.state.get()
        kind, last = held or (None, None)
        for row in rows:
            if last is None or (row.micros, row.kind) > (last, kind):
                kind, last = row.kind, row.micros
        if held is None or (kind, last) != tuple(held):
            self.state.update((kind, last))
            self.due(self.end(kind, last), held is not None)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        kind, last = self.state.get()
        self.state.clear()
        yield Row(label=key[0], kind=kind, micros=self.end(kind, last))


def expiries(sources: DataFrame, ephemeral_hours: float = EPHEMERAL_HOURS, session_hours: float = SESSION_HOURS, delay: str = "0 seconds") -> DataFrame:
    """label, kind, expired_at of sources (label, kind, indexed_at) as their time ends, as :func:`lifecycle.classify` calls them
    stale: a source that is indexed again lives on from there, by its latest kind; durable ones do not expire."""
    hours = {"ephemeral": ephemeral_hours or EPHEMERAL_HOURS, "session": session_hours or SESSION_HOURS}
    timed = sources.select("label", "kind", F.col("indexed_at").cast("timestamp").alias("indexed_at")).withWatermark("indexed_at", delay)
    keyed = timed.withColumn("micros", F.unix_micros("indexed_at")).groupBy("label")
    ended = keyed.transformWithState(_Life(hours), "label string, kind string, micros long", "append", "EventTime")
    return ended.select("label", "kind", F.timestamp_micros("micros").alias("expired_at"))
