"""Near duplicates keep one Python worker a running task, and what a task freed is given back."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagelake.llm import near_dups as ND
from pagelake.llm.common import giving_back


def texts(n, seed):
    rnd = random.Random(seed)
    return [(k, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(30))) for k in range(n)]


def test_no_stage_of_the_sets_chains_python_nodes(spark):
    docs = spark.createDataFrame(texts(400, 1), "doc_id long, text string")
    docs = ND.id_and_text(docs, "doc_id", "text")
    ids = docs.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("rep"), F.lit(b"").alias("key"))
    made = []
    got = ND.sets_of(docs, ids, 5, made)
    plan = got._jdf.queryExecution().toString()
    assert plan[plan.index("== Physical Plan ==") :].count("MapInArrow") == 1
    want = {ND.key_of(ND.shingle_set(t, 5)) for k, t in texts(400, 1) if k % 3 == 0}
    assert {bytes(r.key) for r in got.collect()} == want and len(want) == 134
    ND.drop_tables(spark, made)


@pytest.mark.parametrize("bits", [6, 8])
def test_small_bit_tables_lose_no_set(spark, bits):
    rows = texts(300, 2)
    docs = ND.id_and_text(spark.createDataFrame([*rows, (None, "no id"), (-7, "negative id")], "doc_id long, text string"), "doc_id", "text")
    ids = docs.filter("doc_id % 7 = 0").select(F.col("doc_id").alias("rep"), F.lit(b"").alias("key"))
    made = []
    got = {bytes(r.key): np.array(r.shingles, np.int64).view(np.uint64) for r in ND.sets_of(docs, ids, 5, made, bits=bits).collect()}
    want = [ND.shingle_set(t, 5) for k, t in [*rows, (-7, "negative id")] if k % 7 == 0]
    assert len(got) == len(want) == 44
    assert all((got[ND.key_of(s)] == s).all() for s in want)
    ND.drop_tables(spark, made)


def test_near_duplicates_make_no_table_of_local_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x y z")], "doc_id long, text string")
    asked = []
    create = type(spark).createDataFrame

    def counted(self, data, *a, **b):
        out = create(self, data, *a, **b)
        asked.append([f.name for f in out.schema])
        return out

    monkeypatch.setattr(type(spark), "createDataFrame", counted)
    got = {r.doc_id: r.component_id for r in ND.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    assert ["cls", "label"] not in asked


def resident():
    with open("/proc/self/smaps_rollup") as f:
        return next(int(line.split()[1]) for line in f if line.startswith("Anonymous:")) / 1024


def test_freed_memory_is_given_back():
    kept = []

    def work(batches):
        for batch in batches:
            held = [bytes(bytearray(2000)) for _ in range(100_000)]  # 200 MB in small pieces, of which the last stays
            kept.append(held[-1])
            del held
            yield batch

    before = resident()
    for _ in giving_back(work)(iter([pa.RecordBatch.from_arrays([pa.array([1])], names=["n"])])):
        pass
    assert resident() - before < 50  # 219 without
