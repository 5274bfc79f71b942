"""Registered queries reach every row of their tables: brute force over the smallest tables."""

import re
from collections import defaultdict

from conftest import SF
from pagelake import plans
from pagelake.operators import quads as Q
from pagelake.plans import lines as PL
from pagelake.plans.fixtures import view
from test_quads import scattered


def run(spark, name):
    return [tuple(r) for r in plans.queries()[name](spark, SF).collect()]


def overlap(a, b):
    return max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)


def box(r):
    return r["x1"], r["y1"], r["x2"], r["y2"]


def test_natural_order_numbers_every_page(spark):
    pages = view(spark, SF, "fx_pages").collect()
    order = sorted(pages, key=lambda r: (int(re.search(r"vol(\d+)", r["path"])[1]), r["page_id"]))
    assert sorted(run(spark, "o1_natural_order")) == sorted((r["page_id"], k) for k, r in enumerate(order, 1))


def test_components_meet_every_block(spark):
    blocks = defaultdict(list)
    for r in view(spark, SF, "fx_detections").collect():
        blocks[r["page_id"]].append(box(r))
    want = []
    for r in view(spark, SF, "fx_predictions").collect():
        area = (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
        if area > 50 and max((overlap(box(r), b) for b in blocks[r["page_id"]]), default=0) < 0.5 * area:
            want.append((r["page_id"], r["idx"]))
    assert sorted(run(spark, "j3_uncovered_components")) == sorted(want)


def upright(rows):
    """Lines with the corners of their rectangles."""
    at = ("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2")
    return [{"line_no": r["block_idx"] * 10 + r["line_no"]} | {c: r[k] for c, k in zip(Q.CORNERS, at)} for r in rows]


def test_scattered_lines_of_all_blocks_merge(spark):
    pages = defaultdict(list)
    for r in view(spark, SF, "fx_lines").collect():
        pages[r["page_id"]].append(r)
    want = scattered({page: upright(rows) for page, rows in pages.items()})
    assert {(r[0], r[1]): r[2:] for r in run(spark, "h6_merge_scattered_lines")} == want


def test_grouped_blocks_see_blocks_of_every_number(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(PL.Q, "group_quads", lambda lines, blocks, w, h: seen.append(blocks) or lines)
    plans.queries()["h9_group_blocks"](spark, SF)
    assert {r["k"] for r in seen[0].selectExpr("idx % 4 AS k").distinct().collect()} == {0, 1, 2, 3}
    assert seen[0].count() == view(spark, SF, "fx_predictions").count()
