"""Loose lines of many pages: one exchange, pages step together, and repeated lines stay."""

import numpy as np
import pytest
from conftest import SF

from pagelake import plans
from pagelake.operators import quads as Q

LINE = "page_id long, line_no int, " + ", ".join(f"{c} int" for c in Q.CORNERS)


@pytest.mark.parametrize("name", ["h6_merge_scattered_lines", "h6_merge_scattered_quads"])
def test_lines_move_once(spark, name):
    plan = plans.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_pages_step_together(monkeypatch):
    r = np.random.default_rng(3)
    n, pages = 3000, 600
    x, y, w, h = (r.integers(a, b, n) for a, b in ((0, 560), (0, 700), (20, 120), (8, 24)))
    c = dict(zip(Q.CORNERS, np.stack([x, y, x + w, y, x + w, y + h, x, y + h]).astype(float)))
    c["line_no"], group = np.arange(n), np.sort(r.integers(0, pages, n))
    c, _ = Q.alone(c, 560)
    calls, meet = [], Q.quads_meet
    monkeypatch.setattr(Q, "quads_meet", lambda a, b: calls.append(len(b)) or meet(a, b))
    together = Q.merge_kernel(c, group)
    assert len(calls) <= 2 * np.bincount(group).max()
    every = [Q.merge_kernel(Q.P.taken(c, np.flatnonzero(group == g)), np.zeros((group == g).sum(), int)) for g in np.unique(group)]
    assert all((together[k] == np.concatenate([e[k] for e in every])).all() for k in ("line_no", "block", "font_size", "angle"))


def test_repeated_lines_stay(spark):
    rows = [(1, 1, 0, 0, 100, 0, 100, 20, 0, 20)] * 2 + [(1, 2, 300, 400, 350, 400, 350, 410, 300, 410)]
    got = sorted((r["line_no"], r["block"]) for r in Q.merge_scattered_quads(spark.createDataFrame(rows, LINE), 560).collect())
    assert got == [(1, 1), (1, 1), (2, 2)]
