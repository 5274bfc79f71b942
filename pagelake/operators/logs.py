"""Log sessions, their counts, and the progress of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The markers of a session.
START, END = "---- Starting up ----", "---- Shutting down ----"
STAMP = r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"
LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?) *\| *(\w+) *\| *([^:]*):([^:]*):(\d+) *- (.*)$"


def log_sessions(logs: DataFrame) -> DataFrame:
    """(source_id, session, text) of whole logs (source_id, value): the text after each start marker, trimmed.

    A session ends at the end of the line of the shutdown marker if that lies in its last 500 characters; text before the first start is ignored.
    """
    parts = F.split("value", r"\Q" + START + r"\E")
    rows = logs.select("source_id", F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("session", "text"))
    return rows.select("source_id", "session", cut_session(F.col("text")).alias("text"))


def cut_session(text: Column) -> Column:
    """The text after a start marker, up to the end of the line of a shutdown marker in its last 500 characters; trimmed."""
    n = F.length(text)
    tail_at = F.greatest(n - 500, F.lit(0))
    in_tail = F.locate(END, F.substring(text, tail_at + 1, n))
    end = tail_at + in_tail + len(END) - 1
    line_end = F.locate("\n", F.substring(text, end + 1, n))
    stop = F.when(line_end > 0, end + line_end - 1).otherwise(n)
    cut = F.when(in_tail > 0, F.substring(text, F.lit(1), stop)).otherwise(text)
    return F.regexp_replace(cut, r"^\s+|\s+$", "")


def numbered_sessions(records: DataFrame) -> DataFrame:
    """(source_id, session, text) of records (source_id, size, block, text) as read: what stands between start markers, read by blocks of each file.

    Records stand in the order of the file within a block. Only the number of records of each block is gathered; texts stay where they were read,
    unless Spark joins them with those numbers by key. What stands before a file's first marker is dropped. The reader gives no
    record for nothing after a last marker; such a file is known by its ``size`` in bytes and gets an empty last session.
    """
    records = records.withColumn("k", F.monotonically_increasing_id())
    size = F.octet_length("text") + len(START)
    blocks = records.groupBy("source_id", "block").agg(F.min("k").alias("first"), F.count("*").alias("n"), F.sum(size).alias("bytes"), F.max("size").alias("size"))
    ended = blocks.groupBy("source_id").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max("size").alias("size")).filter("bytes = size")
    last = ended.select("source_id", (F.col("n") - 1).cast("int").alias("session"), F.lit("").alias("text"))
    before = W.partitionBy("source_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    based = blocks.select("source_id", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    session = F.col("base") + F.col("k") - F.col("first") - 1
    rows = records.join(based, ["source_id", "block"]).withColumn("session", session.cast("int")).filter("session >= 0")
    return rows.select("source_id", "session", cut_session(F.col("text")).alias("text")).unionByName(last)


def session_stats(sessions: DataFrame) -> DataFrame:
    """Counts of ERROR and CRITICAL, first time stamp, and corrupted (none)."""
    stamp = F.regexp_extract("text", STAMP, 1)
    return sessions.select(
        "source_id",
        "session",
        F.regexp_count("text", F.lit("ERROR")).alias("errors"),
        F.regexp_count("text", F.lit("CRITICAL")).alias("criticals"),
        F.when(stamp != "", F.to_timestamp(stamp)).alias("started"),
        (stamp == "").alias("corrupted"),
    )


def latest_sessions(stats: DataFrame, n: int = 30) -> DataFrame:
    """The n newest sessions of each source, newest first in ``position``."""
    ranked = stats.withColumn("position", F.row_number().over(W.partitionBy("source_id").orderBy(F.desc("session"))))
    return ranked.filter(F.col("position") <= n)


def mask_user_name(text: Column, user: str, placeholder: str = "<user>") -> Column:
    return F.replace(text, F.lit(user), F.lit(placeholder)) if user else text


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """Adds ts, level, module, function, line_no and message to lines (line); null where a line has another form."""
    part = lambda i: F.when(F.col("line").rlike(LINE), F.regexp_extract("line", LINE, i))
    return lines.select(
        "*", F.to_timestamp(part(1)).alias("ts"), part(2).alias("level"), part(3).alias("module"), part(4).alias("function"), part(5).cast("int").alias("line_no"), part(6).alias("message")
    )


def progress_state(events: DataFrame) -> DataFrame:
    """(run_id, steps, current, last_type) after events (run_id, event_id, ts, type, value).

    begin_step sets the count to 0, incremental adds, absolute sets; end changes nothing.
    """
    run = W.partitionBy("run_id").orderBy("ts", "event_id")
    reset = F.col("type").isin("begin_step", "absolute")
    grouped = events.withColumn("g", F.count(F.when(reset, 1)).over(run))
    value = F.when(F.col("type") == "begin_step", 0).when(F.col("type") == "end", 0).otherwise(F.col("value"))
    order = F.struct("ts", "event_id")
    sums = grouped.groupBy("run_id", "g").agg(
        F.sum(value).alias("current"), F.count(F.when(F.col("type") == "begin_step", 1)).alias("steps"), F.max_by("type", order).alias("last_type"), F.max(order).alias("o")
    )
    return sums.groupBy("run_id").agg(F.sum("steps").alias("steps"), F.max_by("current", "g").alias("current"), F.max_by("last_type", "g").alias("last_type"))


def event_sessions(events: DataFrame) -> DataFrame:
    """(source_id, session, errors, criticals, n) of log events: a START closes the session before it; events before the first are ignored."""
    run = W.partitionBy("source_id").orderBy("ts", "event_id")
    rows = events.withColumn("session", F.count(F.when(F.col("level") == "START", 1)).over(run)).filter("session > 0")
    count = lambda x: F.count(F.when(F.col("level") == x, 1))
    return rows.groupBy("source_id", "session").agg(count("ERROR").alias("errors"), count("CRITICAL").alias("criticals"), F.count("*").alias("n"))


def window_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counters per event-time window (tumbling, or sliding with ``slide``)."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    count = lambda x: F.count(F.when(F.col("level") == x, 1))
    return events.groupBy(w.alias("w")).agg(F.count("*").alias("n"), count("ERROR").alias("errors"), count("CRITICAL").alias("criticals")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "errors", "criticals"
    )
