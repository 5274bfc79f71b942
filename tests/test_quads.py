"""Slanted lines against plain loops over the smallest tables."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from pagelake import plans
from pagelake.operators import masks as MK
from pagelake.operators import quads as Q
from pagelake.plans import quads as PQ
from pagelake.plans.fixtures import view


def corners(r):
    return [(float(r[f"qx{k}"]), float(r[f"qy{k}"])) for k in (1, 2, 3, 4)]


def minus(a, b):
    return a[0] - b[0], a[1] - b[1]


def cross(a, b):
    return a[0] * b[1] - a[1] * b[0]


def shape(quads, ja=False):
    mid = lambda a, b: ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2)
    v = [sum(minus(mid(q[2], q[3]), mid(q[0], q[1]))[i] for q in quads) for i in (0, 1)]
    h = [sum(minus(mid(q[1], q[2]), mid(q[3], q[0]))[i] for q in quads) for i in (0, 1)]
    nv, nh = math.hypot(*v), math.hypot(*h)
    vertical = nv > (nh if ja else 2 * nh)
    vec, other = (v, nh) if vertical else (h, nv)
    angle = int(math.degrees(math.atan2(vec[1], vec[0]))) - (90 if vertical else 0)
    return vertical, vec, round(other / len(quads)), 0 if abs(angle) < 3 else angle


def distance(q, vertical, vec, w=560):
    center = ((q[0][0] + q[2][0]) / 2 - (w if vertical else 0), (q[0][1] + q[2][1]) / 2)
    return abs(cross(center, vec)) / math.hypot(*vec)


def between(p, a, b):
    return min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def segments_meet(a, b, c, d):
    s = [np.sign(x) for x in (cross(minus(b, a), minus(c, a)), cross(minus(b, a), minus(d, a)), cross(minus(d, c), minus(a, c)), cross(minus(d, c), minus(b, c)))]
    if s[0] != s[1] and s[2] != s[3]:
        return True
    return any(z == 0 and between(p, *e) for z, p, e in zip(s, (c, d, a, b), ((a, b), (a, b), (c, d), (c, d))))


def inside(p, q):
    turns = [cross(minus(q[(k + 1) % 4], q[k]), minus(p, q[k])) for k in range(4)]
    return all(t >= 0 for t in turns) or all(t <= 0 for t in turns)


def meet(p, q):
    if inside(p[0], q) or inside(q[0], p):
        return True
    return any(segments_meet(p[i], p[(i + 1) % 4], q[j], q[(j + 1) % 4]) for i in range(4) for j in range(4))


def test_quads_meet_against_edges():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 30, (3000, 1, 2)) + np.stack([np.array([[0, 0], [w, s], [w - t, s + h], [-t, h]]) for w, h, s, t in rng.integers([3, 3, -2, -2], [14, 14, 3, 3], (3000, 4))]) for _ in "ab")
    want = [meet([tuple(map(float, x)) for x in p], [tuple(map(float, x)) for x in q]) for p, q in zip(a, b)]
    got = Q.quads_meet(a.astype(float), b.astype(float))
    assert 500 < sum(want) < 2500 and got.tolist() == want


@pytest.fixture(scope="module")
def lines(spark):
    pages = defaultdict(list)
    for r in view(spark, SF, "fx_quads").collect():
        pages[r["page_id"]].append(r)
    return pages


def scattered(pages):
    """(page, line_no) -> vertical, block, font size and angle of lines (corners and line_no by page) without a block."""
    want = {}
    for page, rows in pages.items():
        for vertical in (False, True):
            free = []
            for r in rows:
                q = corners(r)
                down, vec, font, angle = shape([q])
                if down == vertical:
                    free.append([distance(q, down, vec), r["line_no"], q, vec, float(font), angle])
            free.sort(key=lambda x: x[:2])
            number = 0
            while free:
                number += 1
                d, line, q, vec, font, angle = free[0]
                members, later = [line], []
                for x in free[1:]:
                    mean = (font * len(members) + x[4]) / (len(members) + 1)
                    long = math.hypot(*vec) * math.hypot(*x[3])
                    near = max(font, x[4]) <= 1.3 * min(font, x[4]) and abs(vec[0] * x[3][0] + vec[1] * x[3][1]) >= 0.866 * long
                    near = near and x[0] - d <= 2 * mean and math.hypot(*minus(x[2][0], q[0])) <= 2.5 * mean
                    if near or meet(q, x[2]):
                        members.append(x[1])
                        d, q, font, vec = x[0], x[2], mean, [vec[0] + x[3][0], vec[1] + x[3][1]]
                    else:
                        later.append(x)
                if len(members) > 1:
                    angle = round(math.degrees(math.atan2(vec[1], vec[0]))) - 90 * vertical
                for m in members:
                    want[page, m] = (vertical, number, round(font, 6), angle)
                free = later
    return want


def test_scattered_lines(spark, lines):
    want = scattered(lines)
    got = {(r[0], r["line_no"]): (r["vertical"], r["block"], r["font_size"], r["angle"]) for r in plans.queries()["h6_merge_scattered_quads"](spark, SF).collect()}
    assert len({b for _, b, _, _ in want.values()}) > 5 and got == want


def parts_of(rows, ja):
    """line_no -> part, and whether the block is split."""
    quads = {r["line_no"]: corners(r) for r in rows}
    vertical, vec, font, angle = shape(list(quads.values()), ja)
    far = sorted((distance(q, vertical, vec), n) for n, q in quads.items())
    order = sorted(far, key=lambda x: math.hypot(*minus(quads[x[1]][0], quads[far[0][1]][0])))
    part, held, out = 0, 0, {}
    for k, (_, n) in enumerate(order):
        if k and (ja or vertical) and not meet(quads[order[k - 1][1]], quads[n]):
            step = abs(far[k][0] - far[k - 1][0])
            apart = vertical and abs(angle) < 15 and abs(quads[order[k - 1][1]][0][1] - quads[n][0][1]) > font
            if step > 2 * font or (apart and (held > 1 or step > font)):
                part, held = part + 1, 0
        held += 1
        out[n] = part
    return out


def test_split_blocks(spark, lines):
    want = {}
    for page, rows in lines.items():
        blocks = defaultdict(list)
        for r in rows:
            blocks[r["block_idx"]].append(r)
        for block, own in blocks.items():
            want |= {(page, block, n): p for n, p in parts_of(own, own[0]["lang"] == "ja").items()}
    got = {tuple(r[:3]): r["part"] for r in plans.queries()["h7_split_quads"](spark, SF).collect()}
    assert got == want


def test_grouped_blocks(spark, lines):
    boxes = lambda name: {(r["page_id"], r["idx"]): (r["x1"], r["y1"], r["x2"], r["y2"]) for r in view(spark, SF, name).collect()}
    predicted = boxes("fx_predictions")
    lang = {(r["page_id"], r["idx"]): r["lang_raw"] for r in view(spark, SF, "fx_detections").collect()}
    of = defaultdict(list)
    for page, idx in predicted:
        of[page].append(idx)
    want_blocks, loose = defaultdict(int), 0
    for page, rows in lines.items():
        homes = defaultdict(list)
        for r in rows:
            q = np.array(corners(r)).astype(int)
            (x1, y1), (x2, y2) = q.min(0), q.max(0)
            best = (0.4, None)
            for idx in sorted(of[page]):
                b = predicted[page, idx]
                share = max(min(x2, b[2]) - max(x1, b[0]), 0) * max(min(y2, b[3]) - max(y1, b[1]), 0) / max((x2 - x1) * (y2 - y1), 1)
                best = (share, idx) if share > best[0] else best
            if best[1] is None:
                loose += 1
            else:
                homes[best[1]].append(r)
        for idx in of[page]:
            if not homes[idx]:
                want_blocks[page, 1, lang[page, idx]] += 1
                continue
            parts = list(parts_of(homes[idx], lang[page, idx] == "ja").values())
            for p in set(parts):
                want_blocks[page, parts.count(p), lang[page, idx]] += 1
    got = plans.queries()["h9_group_quads"](spark, SF).collect()
    have = defaultdict(int)
    for r in got:
        if not (r["lang"] == "unknown" and r["idx"] is None):
            have[r["page_id"], r["n_lines"], r["lang"]] += 1
    known = {k: n for k, n in want_blocks.items() if k[2] != "unknown"}
    assert {k: n for k, n in have.items() if k[2] != "unknown"} == known
    unknown = sum(k[1] * n for k, n in have.items() if k[2] == "unknown") - sum(k[1] * n for k, n in want_blocks.items() if k[2] == "unknown")
    assert loose > 50 and unknown == loose


def test_a_slanted_block(spark):
    rows = [(1, 1, 1, "eng", 0.0, 0.0, 100.0, 50.0, 90.0, 70.0, -10.0, 20.0)]
    d = spark.createDataFrame(rows, "page_id long, block_idx int, line_no int, lang string, " + ", ".join(f"{c} double" for c in Q.CORNERS))
    r = Q.quad_shapes(d, "page_id", "block_idx").first()
    assert (r["vertical"], r["angle"], r["font_size"]) == (False, 26, 22)
    assert Q.merge_scattered_quads(d.filter("false"), 560).count() == 0 and Q.split_quads(Q.with_distance(d.join(Q.quad_shapes(d, "page_id"), "page_id"), 9).filter("false")).count() == 0
    blocks = spark.createDataFrame([(1, 7, 0, 0, 100, 70, "eng")], "page_id long, idx int, x1 int, y1 int, x2 int, y2 int, lang string")
    g = Q.group_quads(d.withColumn("block_idx", F.lit(9)), blocks, 560, 760).first()
    s, c = (f(math.radians(26)) * 2 for f in (math.sin, math.cos))
    assert list(g["lines"][0]) == [0, 0, int(100 + s), int(50 - c), int(90 + s), int(70 + c), 0, int(20 + c)]
    assert (g["x1"], g["x2"], g["font_size"], g["n_lines"]) == (-10, 100, 24.0, 1)


def summed(masks, page, b, w=560, h=760):
    m = masks[page]
    cut = m[max(b[1] * m.shape[0] // h, 0) : max(-(-b[3] * m.shape[0] // h), 0), max(b[0] * m.shape[1] // w, 0) : max(-(-b[2] * m.shape[1] // w), 0)]
    return cut.sum() / 255, cut.size


def test_shares_of_masks_of_any_size(spark):
    rng = np.random.default_rng(7)
    masks = {k: (rng.random((hh, ww)) < 0.4).astype(np.uint8) * 255 for k, (hh, ww) in enumerate([(760, 560), (8, 8), (95, 70), (1, 1)])}
    rows = [(k, i, *(int(e) for e in (x, y, x + rng.integers(0, 300), y + rng.integers(0, 300)))) for k in range(5) for i, (x, y) in enumerate(rng.integers(-20, 600, (60, 2)))]
    m = spark.createDataFrame([(k, *v.shape, v.tobytes()) for k, v in masks.items()], "page_id long, h int, w int, data binary")
    boxes = spark.createDataFrame([*rows, (0, 99, None, 1, 2, 3)], "page_id long, idx int, x1 int, y1 int, x2 int, y2 int").repartition(3)
    got = {(r["page_id"], r["idx"]): (r["covered"], r["pixels"]) for r in MK.mask_shares(m, boxes, 560, 760).collect()}
    assert got.pop((0, 99)) == (0.0, 0)
    assert got == {(r[0], r[1]): summed(masks, r[0], r[2:]) for r in rows if r[0] in masks}


def test_lines_and_blocks_without_text_under_them_go(spark, lines):
    pages = sorted(lines)[:150]
    images = {r["page_id"]: np.frombuffer(r["data"], np.uint8).reshape(r["h"], r["w"]) for r in PQ.page_masks(lambda n: view(spark, SF, n)).filter(F.col("page_id").isin(pages)).collect()}
    enough = lambda page, b: (lambda s: s[1] == 0 or s[0] >= 0.1 * s[1])(summed(images, page, b))
    predicted = defaultdict(dict)
    for r in view(spark, SF, "fx_predictions").collect():
        predicted[r["page_id"]][r["idx"]] = (r["x1"], r["y1"], r["x2"], r["y2"])
    want, dropped = defaultdict(int), 0
    for page in pages:
        used = set()
        for r in lines[page]:
            q = np.array(corners(r)).astype(int)
            b = (*q.min(0).tolist(), *q.max(0).tolist())
            share = {i: max(min(b[2], o[2]) - max(b[0], o[0]), 0) * max(min(b[3], o[3]) - max(b[1], o[1]), 0) / max((b[2] - b[0]) * (b[3] - b[1]), 1) for i, o in predicted[page].items()}
            best = max(share, key=lambda i: (share[i], -i), default=None)
            if best is not None and share[best] > 0.4:
                used.add(best)
                want[page] += 1
            elif enough(page, b):
                want[page] += 1
            else:
                dropped += 1
        for i, o in predicted[page].items():
            if i not in used:
                want[page] += enough(page, o)
                dropped += not enough(page, o)
    got = defaultdict(int)
    for r in plans.queries()["h9_group_quads_masked"](spark, SF).filter(F.col("page_id").isin(pages)).collect():
        got[r["page_id"]] += r["n_lines"]
    assert dropped > 20 and dict(got) == {k: n for k, n in want.items() if n}


def test_grouping_moves_its_tables_in_one_exchange(spark):
    rows = spark.createDataFrame([(1, 1, *[0.0] * 8)], "page_id long, line_no int, " + ", ".join(f"{c} double" for c in Q.CORNERS))
    blocks = spark.createDataFrame([(2, 1, 0, 0, 5, 5, None)], "page_id long, idx int, x1 int, y1 int, x2 int, y2 int, lang string")
    masks = spark.createDataFrame([(1, 1, 1, b"\xff")], "page_id long, h int, w int, data binary")
    for more in ((), (masks,)):
        out = Q.group_quads(rows, blocks, 560, 760, *more)
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
        assert sorted((r["page_id"], r["lang"], r["n_lines"]) for r in out.collect()) == [(1, "unknown", 1), (2, None, 1)]
    assert Q.group_quads(rows.limit(0), blocks.limit(0), 560, 760).collect() == []


def test_crowded_pages_merge_the_same_lines(monkeypatch):
    r = np.random.default_rng(5)
    n = 900
    x, y, w, h, tilt = (r.integers(a, b, n) for a, b in ((0, 560), (0, 4000), (20, 120), (8, 24), (-6, 7)))
    c = dict(zip(Q.CORNERS, np.stack([x, y, x + w, y + tilt, x + w - tilt, y + tilt + h, x - tilt, y + h]).astype(float)))
    c["line_no"], group = np.arange(n), np.sort(r.integers(0, 2, n))
    shape, c["distance"] = Q.shapes(c, np.arange(n), n, np.zeros(n, bool), 560)
    plain = Q.merge_kernel(c | shape, group)
    monkeypatch.setattr(Q.P, "CROWDED", 3)
    grids = Q.merge_kernel(c | shape, group)
    assert np.bincount(plain["block"]).max() > 2 and all((plain[k] == grids[k]).all() for k in ("line_no", "block", "font_size", "angle"))
