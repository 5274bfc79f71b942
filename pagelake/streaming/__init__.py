"""Structured Streaming forms: new detections, progress, log sessions, windowed analytics.

State is one small struct a key and ends by watermark or timeout. Each has a batch
form among the operators that gives the same result over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.logs import window_counts
from ..sources import DETECTIONS


def stream_new_detections(spark: SparkSession, folder: str, done_path: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Pick up each new raw detection document once and append it to ``sink`` unless its page is already in ``done_path``."""
    docs = spark.readStream.schema(DETECTIONS).option("multiLine", True).option("pathGlobFilter", "*#raw.json").json(folder)
    fresh = docs.withColumn("seen_at", F.current_timestamp()).withWatermark("seen_at", "1 hour").dropDuplicatesWithinWatermark(["original_path"])

    def put(batch: DataFrame, _: int) -> None:
        done = batch.sparkSession.read.parquet(done_path).select("original_path").distinct()
        batch.join(done, "original_path", "left_anti").write.mode("append").parquet(sink)

    return fresh.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _timed(events: DataFrame) -> DataFrame:
    """Event time with a zone, as watermarks want it."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def analytics_stream(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counters per event-time window; rows later than the watermark are dropped."""
    return window_counts(_timed(events).withWatermark("ts", late), width, slide)


def progress_stream(events: DataFrame, idle: str = "7 days", late: str = "1 day") -> DataFrame:
    """(run_id, steps, current, last_type) after each batch of progress events, rows of a batch in event order.

    The state of a run ends when the watermark (``late`` behind the newest event) is ``idle`` past its last event.
    """
    out = "run_id long, steps long, current long, last_type string"
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        steps, current, last = state.get if state.exists else (0, 0, "")
        newest = 0
        for r in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            last, newest = r.type, int(r.ts.timestamp() * 1000)
            if r.type == "begin_step":
                steps, current = steps + 1, 0
            elif r.type == "absolute":
                current = r.value
            elif r.type == "incremental":
                current += r.value
        state.update((int(steps), int(current), last))
        state.setTimeoutTimestamp(max(newest + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"run_id": [key[0]], "steps": [steps], "current": [current], "last_type": [last]})

    timed = _timed(events).withWatermark("ts", late).groupBy("run_id")
    return timed.applyInPandasWithState(run, out, "steps long, current long, last string", "update", GroupStateTimeout.EventTimeTimeout)


def log_session_stream(events: DataFrame, idle: str = "1 hour", late: str = "0 seconds") -> DataFrame:
    """(source_id, session, errors, criticals, n, closed): each START closes the session before it; an idle session closes by event time.

    A session still open when the stream ends is given as far as it came with closed = false. The number of a source's
    sessions stays in its state (five numbers a source), so numbers never repeat; events after an idle close and before the next START are ignored.
    """
    out = "source_id long, session long, errors long, criticals long, n long, closed boolean"
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        row = lambda s, closed: (key[0], *(int(x) for x in s), closed)
        if state.hasTimedOut:
            *s, still_open = state.get
            rows = [row(s, True)] if still_open else []
            state.update((*(int(x) for x in s), False))
            yield pd.DataFrame(rows, columns=["source_id", "session", "errors", "criticals", "n", "closed"])
            return
        *s, is_open = state.get if state.exists else (0, 0, 0, 0, False)
        rows, newest = [], 0
        for r in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            newest = max(newest, int(r.ts.timestamp() * 1000))
            if r.level == "START":
                if is_open:
                    rows.append(row(s, True))
                s, is_open = [s[0] + 1, 0, 0, 1], True
            elif is_open:
                s = [s[0], s[1] + (r.level == "ERROR"), s[2] + (r.level == "CRITICAL"), s[3] + 1]
        state.update((*(int(x) for x in s), is_open))
        if is_open:
            state.setTimeoutTimestamp(max(newest + idle_ms, state.getCurrentWatermarkMs() + 1))
            rows.append(row(s, False))
        yield pd.DataFrame(rows, columns=["source_id", "session", "errors", "criticals", "n", "closed"])

    return (
        _timed(events)
        .withWatermark("ts", late)
        .groupBy("source_id")
        .applyInPandasWithState(run, out, "session long, errors long, criticals long, n long, open boolean", "update", GroupStateTimeout.EventTimeTimeout)
    )
