"""Stateful processors give the batch operators' results on shuffled, late input, over restarts from a checkpoint."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from pagelake.operators import logs as L
from pagelake.plans.fixtures import view
from pagelake.streaming import processors as PR

SF = "/root/testdata/sf0.001"


def run(spark, make, parts, schema, tmp_path):
    """The rows of every micro-batch; the query is stopped and started again for each part."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        put = lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("append").parquet(str(tmp_path / "out"))
        make(stream).writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return spark.read.parquet(str(tmp_path / "out"))


def shuffled_parts(rows, seed, late, n=3):
    """Events in parts by time plus a random delay of under ``late``, each part in random order."""
    rnd = random.Random(seed)
    due = sorted(((r["ts"] + late * rnd.random(), r) for r in rows), key=lambda x: x[0])
    parts = [[r for _, r in due[k * len(due) // n : (k + 1) * len(due) // n]] for k in range(n)]
    for p in parts:
        rnd.shuffle(p)
    return parts


def test_progress_of_shuffled_events(spark, tmp_path):
    events = view(spark, SF, "fx_progress").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = events.collect()
    last = max(r["ts"] for r in rows)
    parts = shuffled_parts(rows, 1, datetime.timedelta(hours=5))
    end = [(-1, 10**9, last + datetime.timedelta(days=2), "end", 0)]
    out = run(spark, lambda s: PR.progress_processor(s, idle="3650 days", late="1 day"), [*parts, end], events.schema, tmp_path)
    newest = out.groupBy("run_id").agg(F.max_by(F.struct("steps", "current", "last_type"), F.struct("batch", "steps")).alias("s")).filter("run_id >= 0")
    want = L.progress_state(events).select("run_id", "steps", "current", "last_type")
    assert sorted(map(tuple, newest.select("run_id", "s.*").collect())) == sorted(map(tuple, want.collect()))


def test_sessions_of_shuffled_events(spark, tmp_path):
    events = view(spark, SF, "fx_log_events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = events.collect()
    last = max(r["ts"] for r in rows)
    parts = shuffled_parts(rows, 2, datetime.timedelta(hours=5))
    end = [(-1, 10**9, last + datetime.timedelta(days=8000), "INFO")]
    out = run(spark, lambda s: PR.log_session_processor(s, idle="7000 days", late="1 day"), [*parts, end], events.schema, tmp_path)
    closed = out.filter("closed").select("source_id", "session", "errors", "criticals", "n")
    assert sorted(map(tuple, closed.collect())) == sorted(map(tuple, L.event_sessions(events).collect()))


def test_idle_sessions_close_and_numbers_go_on(spark, tmp_path):
    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    schema = "source_id long, event_id long, ts timestamp, level string"
    parts = [[(1, 2, at(1, 5), "ERROR"), (1, 1, at(1), "START")], [(2, 3, at(9), "START")], [(1, 5, at(11), "START"), (1, 4, at(10), "INFO")], [(2, 6, at(16), "INFO")]]
    out = run(spark, lambda s: PR.log_session_processor(s, idle="1 hour"), parts, schema, tmp_path)
    closed = sorted(tuple(r)[:5] for r in out.filter("closed").collect())
    assert closed == [(1, 1, 1, 0, 2), (1, 2, 0, 0, 1), (2, 1, 0, 0, 1)]


@pytest.mark.parametrize("events, rows", [([(0, 1, "INFO")], []), ([(0, 1, "START"), (1, 2, "START"), (2, 3, "CRITICAL")], [(1, 0, 0, 1, True), (2, 0, 1, 2, False)]), ([(0, 1, "START"), (10**12, 2, "ERROR")], [(1, 0, 0, 1, True)])])
def test_fold(events, rows):
    assert PR.Sessions(1000).fold(PR.Sessions.FIRST, events)[1] == rows
