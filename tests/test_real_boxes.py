"""Greedy kernels on real coordinates against plain loops, on calm and crowded pages."""

import random

import numpy as np
import pytest

from pagelake.operators import lines as L
from pagelake.operators import pages as P


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    common = w * h if w > 0 and h > 0 else 0.0
    return common, (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - common


def boxes(n, size, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rnd.random() * size, rnd.random() * size
        out.append((i, x, y, x + rnd.random() * 4, y + rnd.random() * 4, round(0.4 + rnd.random() * 0.6, 9), rnd.randrange(2)))
    return out


@pytest.mark.parametrize("crowded", [2000, 20])
def test_kernel_on_calm_and_crowded_groups(monkeypatch, crowded):
    monkeypatch.setattr(P, "CROWDED", crowded)
    rows = boxes(400, 25.0, 5)
    c = {n: np.array([r[k] for r in rows]) for k, n in enumerate(("idx", "x1", "y1", "x2", "y2", "conf"))}
    group, order = np.zeros(len(rows), np.int64), np.argsort(-c["conf"], kind="stable")
    test = lambda a, b: P.common_area(a, b) > 0.2 * (P.area(a) + P.area(b) - P.common_area(a, b))
    left, want = [rows[i] for i in order], []
    while left:
        best, *left = left
        want.append(best[0])
        left = [r for r in left if not (lambda n, u: n > 0.2 * u)(*iou(best[1:5], r[1:5]))]
    assert 50 < len(want) < 390 and sorted(P.suppressed(c, group, order, test).tolist()) == sorted(want)


def test_suppression_keeps_what_plain_loops_keep(spark):
    rows = [(page, *r) for page, (n, size) in enumerate([(300, 20.0), (40, 3.0), (1, 1.0), (120, 8.0)]) for r in boxes(n, size, page)]
    rows += [(9, 0, 0.9, 0.9, 3.1, 3.1, 0.9, 0), (9, 1, 0.0, 0.0, 3.9, 3.9, 0.8, 0), (9, 2, -1.5, -1.5, 0.25, 0.25, 0.7, 0), (9, 3, -1.5, -1.5, 0.2, 0.25, 0.6, 0)]
    schema = "page_id long, idx int, x1 double, y1 double, x2 double, y2 double, conf double, cls int"
    want = set()
    for page in {r[0] for r in rows}:
        for cls in (0, 1):
            left = sorted((r for r in rows if r[0] == page and r[7] == cls and r[6] > 0.4), key=lambda r: (-r[6], r[1]))
            while left:
                best, *left = left
                want.add((page, best[1]))
                left = [r for r in left if not (lambda c, u: c > 0.35 * u)(*iou(best[2:6], r[2:6]))]
    got = L.suppress_overlaps(spark.createDataFrame(rows, schema)).collect()
    assert {(r["page_id"], r["idx"]) for r in got} == want
    assert {(9, 0), (9, 1), (9, 2)} <= want and (9, 3) not in want
    at = {(r[0], r[1]): r[2:6] for r in rows}
    assert all((r["x1"], r["y1"], r["x2"], r["y2"]) == at[r["page_id"], r["idx"]] for r in got)
