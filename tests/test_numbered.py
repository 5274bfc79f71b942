"""Numbering in natural order: keys are made once a row, whatever the number of ranges."""

from pagelake.operators import analytics as A
from pyspark.sql import functions as F


def paths(spark, n=3000, tasks=8):
    return spark.range(0, n, 1, tasks).select("id", F.concat(F.lit("/vol"), F.pmod(F.xxhash64("id"), F.lit(13)), F.lit("/p"), F.col("id"), F.lit(".png")).alias("path"))


def test_keys_are_not_made_again_for_each_range(spark):
    numbered = A.numbered(paths(spark).select("id", A.natural_key(F.col("path")).alias("key")), "key")
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert "<= concat_ws" not in plan


def test_numbers_of_all_rows(spark):
    rows = paths(spark).select("id", F.when(F.col("id") % 500 != 7, A.natural_key(F.col("path"))).alias("key"))
    got = [r["id"] for r in A.numbered(rows, "key").orderBy("position").collect()]
    keys = {r["id"]: r["key"] for r in rows.collect()}
    assert sorted(got) == sorted(keys)
    assert [keys[i] for i in got] == sorted(keys.values(), key=lambda k: (k is not None, k or ""))
    positions = [r["position"] for r in A.numbered(rows, "key").collect()]
    assert sorted(positions) == list(range(1, len(keys) + 1))
