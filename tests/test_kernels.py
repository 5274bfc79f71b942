"""Kernels over many groups at once against plain loops: clustering, coverage, crowded pages, growth, medians, matching, review."""

import time

import numpy as np
import pytest

from pagelake.operators import pages as P
from pagelake.operators import rasters as R
from pagelake.operators import regions as O
from pagelake.operators import texts as T


def plain_clusters(rows, axis, tol, depth):
    """Each row joins the first cluster with a member within ``tol``; clusters go on along the other axis."""
    if len(rows) < 2 or depth <= 0:
        return rows
    found = []
    for r in sorted(rows, key=lambda r: (r[1 + axis], r[0])):
        home = next((c for c in found if any(abs(m[1 + axis] - r[1 + axis]) <= tol for m in c)), None)
        if home is None:
            found.append([r])
        else:
            home.append(r)
    if len(found) == 1 and depth <= 1:
        return rows
    return [r for c in found for r in plain_clusters(c, 1 - axis, tol, depth - 1)]


@pytest.mark.parametrize("depth", [0, 1, 2, 3, 10])
def test_clusters_equal_the_recursion(depth):
    rng = np.random.default_rng(depth)
    sizes = rng.integers(1, 14, 200)
    group = np.repeat(np.arange(200), sizes)
    idx = np.concatenate([rng.permutation(n) for n in sizes])
    x, y = rng.integers(0, 60, (2, len(group)))
    order = O.clustered(group, idx, (x, y), 1, 5, depth)
    want = [(g, r[0]) for g in range(200) for r in plain_clusters(sorted(zip(idx[group == g], x[group == g], y[group == g])), 1, 5, depth)]
    assert list(zip(group[order], idx[order])) == want


@pytest.mark.parametrize("slab", [1, 3, 512])
def test_coverage_equals_the_canvas(monkeypatch, slab):
    monkeypatch.setattr(O, "SLAB", slab)
    rng = np.random.default_rng(slab)
    group = np.sort(rng.integers(0, 40, 600))
    corner = rng.integers(0, 50, (600, 2))
    box = np.column_stack((corner, corner + rng.integers(-2, 25, (600, 2))))
    box[::9, 1], box[::9, 3] = 0, 75
    want = []
    for g in range(40):
        canvas = np.zeros((80, 80), bool)
        for x1, y1, x2, y2 in box[group == g]:
            canvas[y1:max(y1, y2), x1:max(x1, x2)] = True
        want.append(canvas.sum())
    assert O.covered_areas(group, box, 40).tolist() == want


def test_coverage_of_a_crowded_page_takes_seconds():
    rng = np.random.default_rng(5)
    corner = rng.integers(0, 10**6, (100_000, 2))
    box = np.column_stack((corner, corner + rng.integers(1, 4000, (100_000, 2))))
    start = time.time()
    area = int(O.covered_areas(np.zeros(len(box), np.int64), box, 1)[0])
    assert time.time() - start < 60
    assert 0.2 * 10**12 < area < 0.6 * 10**12
    assert int(O.covered_areas(np.zeros(2 * len(box), np.int64), np.concatenate((box, box)), 1)[0]) == area


def plain_merge(box, overlap):
    alive, into = np.ones(len(box), bool), np.full(len(box), -1)
    for i in range(len(box)):
        if alive[i]:
            later = np.flatnonzero(alive & (np.arange(len(box)) > i))
            hit = later[overlap(np.broadcast_to(box[i], (len(later), 4)), box[later])]
            alive[hit], into[hit] = False, i
    return alive, into


@pytest.mark.parametrize("real", [False, True])
@pytest.mark.parametrize("wide", [30, 400])
def test_crowded_pages_equal_the_plain_loop(monkeypatch, wide, real):
    monkeypatch.setattr(P, "CROWDED", 20)
    monkeypatch.setattr(P, "BLOCK", 16)
    monkeypatch.setattr(P, "STEP", 64)
    rng = np.random.default_rng(wide)
    for overlap in (P.centers_meet, P.areas_meet(20)):
        corner = rng.integers(0, 2000, (900, 2)) / (7 if real else 1)
        box = np.column_stack((corner, corner + rng.integers(0, wide, (900, 2))))
        box[::300] = (0, 500, 2000, 520)  # as wide as the page
        columns = dict(zip(("x1", "y1", "x2", "y2"), box.T)) | {"no": np.arange(900)}
        got = P.merged(columns, np.zeros(900, np.int64), np.arange(900), overlap)
        alive, into = plain_merge(box, overlap)
        union = box.copy()
        for j in np.flatnonzero(~alive):
            a = into[j]
            union[a, :2], union[a, 2:] = np.minimum(union[a, :2], box[j, :2]), np.maximum(union[a, 2:], box[j, 2:])
        assert got["no"].tolist() == np.flatnonzero(alive).tolist()
        assert np.array_equal(np.stack([got[n] for n in ("x1", "y1", "x2", "y2")], 1), union[alive])


def test_a_page_of_very_many_regions_ends():
    rng = np.random.default_rng(1)
    corner = rng.integers(0, 60_000, (300_000, 2))
    box = np.column_stack((corner, corner + rng.integers(1, 300, (300_000, 2))))
    box[7] = (0, 30_000, 60_000, 30_010)
    columns = dict(zip(("x1", "y1", "x2", "y2"), box.T)) | {"no": np.arange(len(box))}
    start = time.time()
    got = P.merged(columns, np.zeros(len(box), np.int64), np.arange(len(box)), P.areas_meet(20))
    assert time.time() - start < 120
    assert 0 < len(got["no"]) < len(box)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 24])
def test_growth_equals_shifts_by_every_offset(n):
    rng = np.random.default_rng(n)
    for shape in ((1, 1), (7, 40), (50, 33)):
        mask = rng.random(shape) < 0.02
        mask[0, 0] = True
        padded, want = np.pad(mask, n, mode="edge"), np.zeros_like(mask)
        for dy, dx in R.disc(n):
            want |= padded[n + dy : n + dy + shape[0], n + dx : n + dx + shape[1]]
        assert np.array_equal(R.dilate(mask, n), want)


def test_medians_of_many_groups_equal_one_by_one(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), *(int(v) for v in rng.integers(0, 4 + 60 * (g % 3), 3))) for g in np.repeat(np.arange(60), rng.integers(1, 40, 60))]
    df = spark.createDataFrame(rows, "k long, r int, g int, b int")
    got = {r["k"]: (r["r"], r["g"], r["b"]) for r in R.geometric_median(df, "k").collect()}
    for k in range(60):
        want = R.weiszfeld(np.array([r[1:] for r in rows if r[0] == k], float))
        assert np.allclose(got[k], want, atol=1e-3)
    assert R.geometric_median(df.limit(0), "k").count() == 0


@pytest.mark.parametrize("on_boundary", [False, True])
def test_matches_equal_every_pair(spark, on_boundary):
    images = ["a/1.png", "b/1.png", "b/21.png", "b/21.png", "c/x.png", None, "1.png", "", "deep/d/9.png"]
    fragments = ["1.png", "b/21.png", "9.png", "d/9.png", "x.png", "none.png", None, "x.png"]
    ends = lambda i, f: i is not None and f is not None and i.endswith(f) and (not on_boundary or i == f or i[-len(f) - 1] == "/")
    kinds, want = list(dict.fromkeys(fragments)), []
    for i in images:
        hits = [f for f in kinds if ends(i, f)]
        n_i = len(hits) * images.count(i)
        want += [(i, f, "ambiguous" if n_i > 1 or sum(ends(j, f) for j in images) > 1 else "matched") for f in hits] or [(i, None, "no_text")]
    want += [(None, f, "no_image") for f in kinds if not any(ends(i, f) for i in images)]
    got = T.match_texts(spark.createDataFrame([(i,) for i in images], "image string"), spark.createDataFrame([(f,) for f in fragments], "fragment string"), on_boundary)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_new_rows_of_a_review_equal_a_plain_walk(spark):
    rng = np.random.default_rng(11)
    edits, want = [], []
    for page in range(30):
        alive = {}
        for seq in range(40):
            op = ["add", "add", "delete", "edit", "reset"][rng.integers(5)]
            k, side, text = int(rng.integers(1, 6)), int(rng.integers(1, 60)), f"t{seq}"
            edits.append((page, None if op == "add" else f"New {k}", seq, op, text, 0, 0, side, side))
            if op == "add":
                if side * side >= 400:
                    free = next(i for i in range(1, 99) if i not in alive)
                    alive[free] = [text, text, side]
            elif k in alive:
                if op == "delete":
                    del alive[k]
                else:
                    alive[k][0] = text if op == "edit" else alive[k][1]
        want += [(page, f"New {k}", v[0], v[2]) for k, v in alive.items()]
    schema = "page_id long, label string, seq int, op string, text string, x1 int, y1 int, x2 int, y2 int"
    none = spark.createDataFrame([], "page_id long, label string, text string, x1 int, y1 int, x2 int, y2 int, status string")
    got = T.apply_review_edits(none, spark.createDataFrame(edits, schema))
    assert sorted((r["page_id"], r["label"], r["text"], r["x2"]) for r in got.collect()) == sorted(want)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("share", [0.0, 0.1, 0.4, 0.6, 1.0])
def test_components_of_parts_equal_a_flood_fill(share):
    rng = np.random.default_rng(int(share * 10))
    for shape in ((1, 1), (1, 30), (30, 1), (40, 23)):
        mask = rng.random(shape) < share
        seen, want = np.zeros(shape, bool), []
        for y, x in zip(*np.nonzero(mask)):
            if not seen[y, x]:
                todo, cells = [(y, x)], []
                seen[y, x] = True
                while todo:
                    cy, cx = todo.pop()
                    cells.append((cy, cx))
                    for ny in range(max(cy - 1, 0), min(cy + 2, shape[0])):
                        for nx in range(max(cx - 1, 0), min(cx + 2, shape[1])):
                            if mask[ny, nx] and not seen[ny, nx]:
                                seen[ny, nx] = True
                                todo.append((ny, nx))
                ys, xs = zip(*cells)
                want.append([len(cells), min(xs), min(ys), max(xs) + 1, max(ys) + 1, y, x])
        assert R.pieces_of(mask)[0].tolist() == want
        edges = [0, *sorted(set(rng.integers(0, shape[0] + 1, 4).tolist()) - {0, shape[0]}), shape[0]]
        parts = [R.pieces_of(mask[a:b]) for a, b in zip(edges, edges[1:])]
        assert R.joined_pieces(np.diff(edges).tolist(), *map(list, zip(*parts))).tolist() == want
