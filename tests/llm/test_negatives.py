"""Hard negatives against all pairs, with small leaves so that the tree has several levels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake.llm import negatives as NG
from pagelake.llm.queries import embedding_rows, op12_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, x string, leaf int"
SMALL = {"part_rows": 24, "sample": 200, "fan": 4, "block_rows": 6}


def plain(rows, positives=5, negatives=5):
    """All pairs, in Python integers."""
    fine = []
    for i, v, label in rows:
        if i is None or label is None or v is None or not all(e is not None and math.isfinite(e) for e in v):
            continue
        fine.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(e))) for e in v]))
    score = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for k, (i, label, v) in enumerate(fine):
        if i % 100:
            continue
        others = sorted((-score(v, w), j, m) for n, (j, m, w) in enumerate(fine) if n != k)
        for ps, j, m in [o for o in others if o[2] == label][:positives]:
            fits = [(-s, n) for s, n, m in others if m != label and -80 * ps <= -100 * s <= -100 * ps]
            out += [(i, j, r, n, -ps, s) for r, (s, n) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)


def mined(df, **more):
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[n] for n in names) for r in NG.hard_negatives(embedding_rows(df), **more).collect())


def clustered(n=700, seed=2):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(0, 2, (12, 6))
    return [(7 * i if i % 3 else 25 * i, [float(e) for e in centres[i % 12] + rnd.normal(0, 0.2, 6)], int(rnd.integers(0, 4))) for i in range(1, n)]


def test_clusters_copies_and_odd_rows(spark):
    rows = list({r[0]: r for r in clustered()}.values())
    rows += [(10_000 + i, rows[4][1], i % 5) for i in range(300)]  # a vector that many rows share
    rows += [(20_001, None, 1), (20_002, [1.0, None], 1), (20_003, [float("nan")] * 6, 1), (20_004, rows[0][1], None), (20_005, [1.0], 2), (None, rows[0][1], 1), (20_007, [], 3), (20_300, [0.0] * 6, 3)]
    assert mined(table(spark, rows), **SMALL) == plain(rows)


def test_repeated_rows_are_rows_of_their_own(spark):
    rows = clustered(60)
    rows = [r for r in rows if r[0] % 100] + [(100, rows[5][1], 2), (100, rows[5][1], 2), (100, rows[6][1], 3), (1400, rows[5][1], 2)]
    got, want = mined(table(spark, rows), **SMALL), plain(rows)
    assert got == want and len(set(got)) < len(got)


@pytest.mark.parametrize("scale", [2.0**16, 2.0**20, 2.0**60])
def test_large_entries(spark, scale):
    rows = [(i, [e * scale for e in v], m) for i, v, m in clustered(120, 8)]
    if scale < 2.0**50:
        assert mined(table(spark, rows), **SMALL) == plain(rows)
    else:  # beyond a long: defined, not exact
        assert all(abs(r[4]) <= 2**63 for r in mined(table(spark, rows), **SMALL))


@pytest.mark.parametrize("rows", [[], [(1, [1.0], 2)], [(100, [1.0], 2)], [(100, [], 2), (3, [], 2), (5, [], 3)], [(100, [-1.0], 2), (1, [1.0], 2), (2, [1.0], 3)]])
def test_few_rows(spark, rows):
    assert mined(table(spark, rows)) == plain(rows)


def test_siblings_are_dropped():
    rnd = np.random.default_rng(1)
    centres = rnd.normal(0, 500, (6, 8))
    x = np.round(np.repeat(centres, 40, 0) + rnd.normal(0, 5, (240, 8)))
    tree = NG.Tree()
    tree.grow(x, 30, 6, 3, [])
    leaf = tree.route(x)
    tree.low, tree.high = ([f(tree.path_distances(k, x[leaf == k]), 0) for k in range(len(tree.paths))] for f in (np.min, np.max))
    assert len(tree.paths) > 6
    dropped = 0
    for i in range(0, 240, 7):
        scores = NG.products(x[i : i + 1].astype(np.int64), x.astype(np.int64))[0]
        lo, hi = np.sort(scores)[-6] * 1.0, scores.max() * 1.0
        for k in range(len(tree.paths)):
            alive = NG.reach(tree.path_distances(k, x[i : i + 1]), tree.low[k], tree.high[k], np.array([[lo]]), np.array([[hi]]))[0]
            has = ((scores >= lo) & (scores <= hi))[leaf == k].any()
            assert alive or not has
            dropped += not alive
    assert dropped > 35 * len(tree.paths) * 0.6


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(tuple(r[n] for n in names) for r in op12_hard_negatives(spark, d).collect()) == plain(rows)


def test_sample_does_not_grow_with_the_tasks(spark):
    rows = spark.range(0, 40_000, 1, 64).selectExpr("id AS vec_id", "array(id % 100, id % 7) AS x")
    few = NG.smallest_hashes(rows, 40_000, 50)
    hashed = rows.select(F.xxhash64("vec_id", "x").alias("h"), "x")
    assert [tuple(r) for r in few.collect()] == [tuple(r) for r in hashed.orderBy("h").limit(50).collect()]
    sent = few.queryExecution if hasattr(few, "queryExecution") else few._jdf.queryExecution()
    bound = int(str(sent.optimizedPlan()).split("<= ")[1].split(")")[0])
    assert 100 < hashed.filter(F.col("h") <= bound).count() < 400  # of all tasks together; 50 of each of 64 before
    copies = spark.range(0, 40_000, 1, 64).selectExpr("0L AS vec_id", "array(1L, 2L) AS x")
    assert NG.smallest_hashes(copies, 40_000, 50).count() <= 1


def test_few_bins_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(NG, "SLICES", 3)
    monkeypatch.setattr(NG, "SLICE", 1)
    made, stored = [], NG.search
    monkeypatch.setattr(NG, "search", lambda probe, *more: made.append(probe.select("bin").distinct().count()) or stored(probe, *more))
    rows = clustered(500, 5)
    assert mined(table(spark, rows), **SMALL) == plain(rows)
    assert max(made) <= 3
