"""Streams over the event table give the batch operators' results."""

from pyspark.sql import functions as F

from pagelake import streaming as X
from pagelake.operators import logs as L
from pagelake.plans.fixtures import view

SF = "/root/testdata/sf0.001"


def stream_of(spark, df, path):
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def run(df, name, tmp_path, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_progress(spark, tmp_path):
    events = view(spark, SF, "fx_progress")
    got = run(X.progress_stream(stream_of(spark, events, str(tmp_path / "in"))), "progress", tmp_path, "update")
    want = L.progress_state(events)
    cols = ("run_id", "steps", "current", "last_type")
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_windows(spark, tmp_path):
    events = view(spark, SF, "fx_log_events")
    got = run(X.analytics_stream(stream_of(spark, events, str(tmp_path / "in")), "1 hour", late="100000 days"), "windows", tmp_path, "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, L.window_counts(events).collect()))


def test_log_sessions(spark, tmp_path):
    events = view(spark, SF, "fx_log_events")
    got = run(X.log_session_stream(stream_of(spark, events, str(tmp_path / "in")), idle="1000 days"), "sessions", tmp_path, "update")
    last = got.groupBy("source_id", "session").agg(F.max(F.struct("n", "errors", "criticals")).alias("s"))
    got_rows = sorted(map(tuple, last.select("source_id", "session", "s.errors", "s.criticals", "s.n").collect()))
    assert got_rows == sorted(map(tuple, L.event_sessions(events).collect()))


def test_session_numbers_go_on_after_an_idle_close(spark, tmp_path):
    schema = "source_id long, event_id long, ts timestamp, level string"
    at = lambda h, m=0: f"2024-01-01 {h:02d}:{m:02d}:00"
    parts = [[(1, 1, at(1), "START"), (1, 2, at(1, 5), "ERROR")], [(2, 3, at(9), "START")], [(1, 4, at(10), "INFO"), (1, 5, at(11), "START")], [(2, 6, at(12), "INFO")]]
    folder = str(tmp_path / "in")
    q = None
    for k, rows in enumerate(parts):
        d = spark.createDataFrame([(a, b, c, e) for a, b, c, e in rows], "source_id long, event_id long, t string, level string")
        d.select("source_id", "event_id", F.col("t").cast("timestamp").alias("ts"), "level").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        q = X.log_session_stream(stream, idle="1 hour").writeStream.foreachBatch(lambda b, n, k=k: b.write.mode("append").parquet(str(tmp_path / "out")))
        q.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    rows = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).filter("source_id = 1").collect()}
    assert (1, 1, 1, 0, 2, True) in rows and any(r[1] == 2 and r[4] == 1 for r in rows)
    assert not any(r[1] == 1 and r[4] == 1 for r in rows if r[2] == 0 and r[5] is True)


def test_new_detections(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for n in ("a", "b"):
        (folder / f"{n}#raw.json").write_text(f'{{"original_path": "{n}", "scale": 1.0, "blk_list": []}}')
    spark.createDataFrame([("a",)], "original_path string").write.parquet(str(tmp_path / "done"))
    for _ in range(2):
        X.stream_new_detections(spark, str(folder), str(tmp_path / "done"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert [r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("original_path").collect()] == ["b"]
