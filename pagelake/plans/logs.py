"""Queries on logs and progress events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import logs as L
from ..sources import read_log_sessions
from .registry import Views, query
from .scratch import scratch_folder

EV = "fx_log_events"
LINE = "concat(strftime(ts, '%Y-%m-%d %H:%M:%S'), '.000 | ', CASE level WHEN 'START' THEN 'INFO' ELSE level END, ' | pkg.mod:run:', event_id % 100, ' - user', source_id, ' did ', event_id)"


def line() -> F.col:
    level = F.when(F.col("level") == "START", "INFO").otherwise(F.col("level"))
    return F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(".000 | "), level, F.lit(" | pkg.mod:run:"), (F.col("event_id") % 100).cast("string"),
        F.lit(" - user"), F.col("source_id").cast("string"), F.lit(" did "), F.col("event_id").cast("string"),
    )


def written_sessions(v: Views) -> DataFrame:
    """Sessions of log files, one a source, written from the events in order: a start marker before each START line."""
    events = v(EV)
    text = F.concat(F.when(F.col("level") == "START", L.START + "\n").otherwise(""), line())
    folder = scratch_folder(events.sparkSession, "logs")
    dealt = events.repartition("source_id").sortWithinPartitions("source_id", "ts", "event_id")
    dealt.select("source_id", text.alias("value")).write.partitionBy("source_id").text(folder)
    read = read_log_sessions(events.sparkSession, f"{folder}/source_id=*")
    return read.withColumn("source_id", F.regexp_extract("source_id", r"source_id=(\d+)", 1).cast("long"))


SESS = f"s AS (SELECT *, {LINE} AS line, count(*) FILTER (level='START') OVER (PARTITION BY source_id ORDER BY ts, event_id) AS k FROM fx_log_events), g AS (SELECT source_id, k-1 AS session, string_agg(line, chr(10) ORDER BY ts, event_id) AS text, count(*) FILTER (level='ERROR') errors, count(*) FILTER (level='CRITICAL') criticals, min(ts) ts FROM s WHERE k > 0 GROUP BY ALL)"


@query(f"WITH {SESS} SELECT source_id, session, text FROM g", EV)
def l1_log_sessions(v: Views) -> DataFrame:
    return written_sessions(v)


@query(f"WITH {SESS} SELECT source_id, session, errors, criticals, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS started, FALSE AS corrupted FROM g", EV)
def l2_session_stats(v: Views) -> DataFrame:
    stats = L.session_stats(written_sessions(v))
    return stats.withColumn("started", F.date_format("started", "yyyy-MM-dd HH:mm:ss"))


@query(f"WITH {SESS} SELECT source_id, count(*) AS sessions, CAST(sum(length(text)) AS BIGINT) AS characters FROM g GROUP BY 1", EV)
def s15_read_logs(v: Views) -> DataFrame:
    """Log files read back, split at start markers."""
    return written_sessions(v).groupBy("source_id").agg(F.count("*").alias("sessions"), F.sum(F.length("text")).cast("long").alias("characters"))


@query(f"SELECT event_id, replace({LINE}, 'user', '<user>') AS line FROM fx_log_events", EV)
def l3_mask_user_name(v: Views) -> DataFrame:
    return v(EV).select("event_id", L.mask_user_name(line(), "user").alias("line"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CASE level WHEN 'START' THEN 'INFO' ELSE level END AS level, 'pkg.mod' AS module, 'run' AS function, CAST(event_id % 100 AS INT) AS line_no, concat('user', source_id, ' did ', event_id) AS message FROM fx_log_events", EV)
def l4_parse_log_lines(v: Views) -> DataFrame:
    parsed = L.parse_log_lines(v(EV).select("event_id", line().alias("line"))).drop("line")
    return parsed.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query(f"WITH {SESS}, r AS (SELECT source_id, session, row_number() OVER (PARTITION BY source_id ORDER BY session DESC) AS position FROM g) SELECT * FROM r WHERE position <= 3", EV)
def o9_latest_sessions(v: Views) -> DataFrame:
    return L.latest_sessions(written_sessions(v), 3).select("source_id", "session", "position")


@query("""WITH g AS (SELECT *, count(*) FILTER (type IN ('begin_step','absolute')) OVER (PARTITION BY run_id ORDER BY ts, event_id) g FROM fx_progress),
  s AS (SELECT run_id, g, sum(CASE WHEN type IN ('begin_step','end') THEN 0 ELSE value END) c, count(*) FILTER (type='begin_step') b, arg_max(type, (ts, event_id)) t FROM g GROUP BY ALL)
  SELECT run_id, CAST(sum(b) AS BIGINT) AS steps, CAST(arg_max(c, g) AS BIGINT) AS current, arg_max(t, g) AS last_type FROM s GROUP BY 1""", "fx_progress")
def x2_progress_state(v: Views) -> DataFrame:
    return L.progress_state(v("fx_progress"))


@query("""WITH s AS (SELECT *, count(*) FILTER (level='START') OVER (PARTITION BY source_id ORDER BY ts, event_id) AS session FROM fx_log_events)
  SELECT source_id, session, count(*) FILTER (level='ERROR') errors, count(*) FILTER (level='CRITICAL') criticals, count(*) n FROM s WHERE session > 0 GROUP BY ALL""", EV)
def x3_event_sessions(v: Views) -> DataFrame:
    return L.event_sessions(v(EV))


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, count(*) n, count(*) FILTER (level='ERROR') errors, count(*) FILTER (level='CRITICAL') criticals FROM fx_log_events GROUP BY 1", EV)
def x4_window_counts(v: Views) -> DataFrame:
    return L.window_counts(v(EV)).drop("end").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))
