"""Log files split at start markers give the sessions of whole texts, however small the blocks are."""

import random

import pytest

from pagelake import sources as S
from pagelake.operators import logs as L


def log(rnd, sessions, before=True):
    line = lambda: "2024-01-01 00:00:00.000 | INFO | m:f:1 - " + "é— x" * rnd.randrange(30)
    out = [line() for _ in range(3)] if before else []
    for k in range(sessions):
        out += [L.START, f"2024-01-01 00:00:{k % 60:02d}.000 | ERROR | m:f:1 - session {k}"]
        out += [line() for _ in range(rnd.randrange(40))]
        if k % 3:
            out += ["2024 | INFO | m:f:2 - " + L.END + " bye", "after"]
    return "\n".join(out) + "\n" * rnd.randrange(2)


@pytest.fixture
def small_blocks(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "16"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def whole(spark, folder):
    rows = L.log_sessions(S.read_logs(spark, folder)).collect()
    return sorted((r["source_id"], r["session"], r["text"]) for r in rows)


def test_split_files(spark, tmp_path, small_blocks):
    rnd = random.Random(4)
    texts = {"big.log": log(rnd, 300), "start.log": log(rnd, 40, before=False), "none.log": "no marker\n" * 900, "empty.log": "", "one.log": L.START, "two.log": L.START + L.START + "x"}
    folder = tmp_path / "logs"
    folder.mkdir()
    for name, text in texts.items():
        (folder / name).write_text(text)
    lines = S.log_records(spark.read.option("lineSep", L.START).text(str(folder)))
    assert lines.filter("source_id like '%big.log'").select("block").distinct().count() > 20
    got = sorted((r["source_id"], r["session"], r["text"]) for r in S.read_log_sessions(spark, str(folder)).collect())
    want = whole(spark, str(folder))
    assert len(want) == 300 + 40 + 1 + 2 and got == want


def test_stream_of_files(spark, tmp_path, small_blocks):
    rnd = random.Random(5)
    folder = tmp_path / "logs"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.log").write_text(log(rnd, 30 + k))
        S.stream_log_sessions(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = sorted((r["source_id"], r["session"], r["text"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert len(got) == 93 and got == whole(spark, str(folder))
