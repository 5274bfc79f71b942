"""Whitening against a plain eigendecomposition in exact integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake.llm import whitening as WH
from pagelake.llm.queries import op13_whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x int, n long, component int"


def plain(rows, most=16):
    """(vec_id -> projections without sign), eigenvalue shares and deviations by numpy's eigh on the whole matrix."""
    fine = [(i, v) for i, v in rows if v is not None and all(e is not None and math.isfinite(e) for e in v)]
    width = max(len(v) for _, v in fine)
    x = [(i, [math.floor(64 * float(np.float32(e))) + 10**6 for e in v] + [10**6] * (width - len(v))) for i, v in fine]
    fit = sorted({tuple(v) for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    a = np.array([[n * e - s for e, s in zip(v, sums)] for v in fit], float) / n
    e, u = np.linalg.eigh(a.T @ a / n)
    e, u = e[::-1], u[:, ::-1]
    rank = min(most, int((e > 1e-20 * e[0]).sum()))
    out = []
    for i, v in x:
        d = [n * c - s for c, s in zip(v, sums)]
        out.append((i, sum(c * c for c in d), (np.array(d, float) / n) @ u[:, :rank] / np.sqrt(e[:rank])))
    return n, out, e[:rank] / e.sum()


def compare(df, rows):
    n, want, shares = plain(rows)
    got = {}
    for r in df.collect():
        got.setdefault((r["vec_id"], r["deviation"]), []).append(r)
        assert r["n"] == n and r["identity_error"] <= 1e-8
        assert abs(r["explained"] / shares[r["component"] - 1] - 1) < 1e-9
    assert sum(map(len, got.values())) == len(want) * len(shares)
    signs = None
    for i, deviation, white in want:
        mine = sorted(got[i, deviation], key=lambda r: r["component"])
        w = np.array([r["whitened"] for r in mine])
        assert [r["component"] for r in mine[: len(shares)]] == sorted([*range(1, len(shares) + 1)] * (len(mine) // len(shares)))[: len(shares)]
        w = w[:: len(mine) // len(shares)]
        signs = np.sign(w * white) if signs is None else signs
        assert np.allclose(w, signs * white, atol=1e-8)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in rows], SCHEMA).repartition(3)


def test_against_eigh_with_odd_rows(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, [float(e) for e in rnd.normal(0, 1, 20) * np.arange(1, 21)]) for i in range(300)]
    rows += [rows[7], rows[7], (900, rows[3][1])]
    compare(WH.whiten(table(spark, [*rows, (901, None), (902, [1.0, None] * 10), (903, [float("nan")] * 20), (904, [float("inf")] * 20)])), rows)


def test_ill_conditioned_rows(spark):
    rnd = np.random.default_rng(5)
    base = rnd.normal(0, 1000, (400, 3))
    v = np.column_stack([base, base[:, 0] + (np.arange(400) == 7) / 64, rnd.normal(0, 0.05, 400)])
    rows = [(i, [float(np.float32(e)) for e in r]) for i, r in enumerate(v)]
    n, _, shares = plain(rows)
    assert shares[-1] < 1e-9
    got = WH.whiten(table(spark, rows)).groupBy("component").agg(F.avg("whitened").alias("m"), F.avg(F.col("whitened") ** 2).alias("v"), F.max("explained").alias("e")).collect()
    for r in got:
        assert abs(r["m"]) < 1e-6 and abs(r["v"] - 1) < 1e-4 and abs(r["e"] / shares[r["component"] - 1] - 1) < 1e-4


@pytest.mark.parametrize("rows, components", [([(1, [1.0, 2.0])] * 3, 0), ([(1, [1.0, 2.0, 5.0]), (2, [2.0, 4.0, 5.0]), (3, [3.0, 6.0, 5.0]), (4, [4.0])], 2), ([(1, []), (2, None)], 0), ([], 0)])
def test_few_and_dependent_vectors(spark, rows, components):
    got = WH.whiten(table(spark, rows)).collect()
    assert {r["component"] for r in got} == set(range(1, components + 1))
    assert all(r["identity_error"] < 1e-9 for r in got)


def test_huge_entries_keep_exact_deviations(spark):
    rows = [(1, [2.0**40, 0.0]), (2, [0.0, 1.0]), (3, [2.0**60, 3.0]), (4, [1.0, -5.0])]
    got = {r["vec_id"]: r["deviation"] for r in WH.whiten(table(spark, rows)).filter("component = 1").collect()}
    n, want, _ = plain(rows)
    assert got == {i: d if d < 2**63 else None for i, d, _ in want}


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    compare(op13_whitening(spark, d), rows)
