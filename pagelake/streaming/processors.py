"""Stateful processors of streams: log sessions and progress of runs, in event order whatever order events arrive in.

Events wait in a list state of their key until the watermark has passed them (a timer
for each time they wait for); then they are folded in order of time and id into a
small typed value state. So late and shuffled input, within the watermark's delay,
gives the batch operators' results. The state is kept in the checkpoint: a restarted
query goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: State stores that transformWithState works with.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Name the state store in a session that still has the default one."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(key, "") or ""):
        spark.conf.set(key, STORE)


class InOrder(StatefulProcessor):
    """Holds events until the watermark has passed them and folds them in order.

    A subclass names ``WAITS`` (schema of an event: at long in microseconds, event_id long, ...), ``STATE`` (schema of the
    value), ``OUT`` (columns that come out, the key first), ``FIRST`` (the value before any event), ``event`` and ``fold``.
    """

    WAITS: str
    STATE: str
    OUT: list[str]
    FIRST: tuple

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.WAITS)
        self.value = handle.getValueState("value", self.STATE)

    def event(self, row: object) -> tuple:
        """What of an input row waits, without its time and id."""
        raise NotImplementedError

    def fold(self, state: tuple, events: list[tuple]) -> tuple[tuple, list[tuple]]:
        """The value after events in order, and rows that come out (without the key)."""
        raise NotImplementedError

    def idle(self, state: tuple) -> tuple[tuple | None, list[tuple]]:
        """The value after a key was idle (null: forget it), and rows that come out."""
        return None, []

    def frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=self.OUT)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        fresh = [(int(r.ts.value // 1000), int(r.event_id), *self.event(r)) for pdf in rows for r in pdf.itertuples()]
        self.waiting.appendList(fresh)
        for at in {e[0] // 1000 + 1 for e in fresh}:
            self.handle.registerTimer(at)
        yield self.frame(key, [])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        events = sorted(tuple(e) for e in self.waiting.get()) if self.waiting.exists() else []
        ready = [e for e in events if e[0] // 1000 < now]
        *value, until = tuple(self.value.get()) if self.value.exists() else (*self.FIRST, 2**62)
        rows: list[tuple] = []
        if (ready[0][0] // 1000 if ready else now) >= until:  # idle before what comes next
            new, rows = self.idle(tuple(value))
            if new is None:
                self.value.clear()
            else:
                self.value.update((*new, 2**62))
            value = new or self.FIRST
        if ready:
            rest = events[len(ready) :]
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
            new, more = self.fold(tuple(value), ready)
            until = ready[-1][0] // 1000 + self.idle_ms
            self.value.update((*new, until))
            self.handle.registerTimer(until)
            rows = [*rows, *more]
        yield self.frame(key, rows)


class Sessions(InOrder):
    """(source_id, session, errors, criticals, n, closed): a START closes the session before it, an idle session closes by timer."""

    WAITS = "at long, event_id long, level string"
    STATE = "session long, errors long, criticals long, n long, open boolean, until long"
    OUT = ["source_id", "session", "errors", "criticals", "n", "closed"]
    FIRST = (0, 0, 0, 0, False)

    def event(self, row: object) -> tuple:
        return (row.level,)

    def fold(self, state: tuple, events: list[tuple]) -> tuple[tuple, list[tuple]]:
        session, errors, criticals, n, is_open = state
        rows = []
        for before, (at, _, level) in zip([None, *events], events):
            if is_open and before and at - before[0] > self.idle_ms * 1000:  # idle between two events of one step
                rows.append((session, errors, criticals, n, True))
                is_open = False
            if level == "START":
                if is_open:
                    rows.append((session, errors, criticals, n, True))
                session, errors, criticals, n, is_open = session + 1, 0, 0, 1, True
            elif is_open:
                errors, criticals, n = errors + (level == "ERROR"), criticals + (level == "CRITICAL"), n + 1
        if is_open:
            rows.append((session, errors, criticals, n, False))
        return (session, errors, criticals, n, is_open), rows

    def idle(self, state: tuple) -> tuple[tuple | None, list[tuple]]:
        """The number of the source's sessions stays, so that numbers never repeat."""
        return (*state[:-1], False), [(*state[:-1], True)] if state[-1] else []


class Progress(InOrder):
    """(run_id, steps, current, last_type): begin_step sets the count to 0, incremental adds, absolute sets; idle runs are forgotten."""

    WAITS = "at long, event_id long, type string, value long"
    STATE = "steps long, current long, last string, until long"
    OUT = ["run_id", "steps", "current", "last_type"]
    FIRST = (0, 0, "")

    def event(self, row: object) -> tuple:
        return row.type, int(row.value)

    def fold(self, state: tuple, events: list[tuple]) -> tuple[tuple, list[tuple]]:
        steps, current, last = state
        for _, _, last, value in events:
            if last == "begin_step":
                steps, current = steps + 1, 0
            elif last == "absolute":
                current = value
            elif last == "incremental":
                current += value
        return (steps, current, last), [(steps, current, last)]


def _processed(events: DataFrame, key: str, processor: InOrder, schema: str, late: str) -> DataFrame:
    use_state_store(events.sparkSession)
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(key)
    return timed.transformWithStateInPandas(processor, schema, "Update", "EventTime")


def log_session_processor(events: DataFrame, idle: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(source_id, session, errors, criticals, n, closed) of log events, in event order within ``late``.

    A session is given with closed = false each time it grows, and once with closed = true: at the next START, or
    when the watermark is ``idle`` past its last event. Events between an idle close and the next START are ignored.
    """
    schema = "source_id long, session long, errors long, criticals long, n long, closed boolean"
    return _processed(events, "source_id", Sessions(int(pd.Timedelta(idle).total_seconds() * 1000)), schema, late)


def progress_processor(events: DataFrame, idle: str = "7 days", late: str = "10 minutes") -> DataFrame:
    """(run_id, steps, current, last_type) of progress events, in event order within ``late``; a run is given each time it moves on."""
    processor = Progress(int(pd.Timedelta(idle).total_seconds() * 1000))
    return _processed(events, "run_id", processor, "run_id long, steps long, current long, last_type string", late)
