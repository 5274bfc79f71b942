"""Slanted text lines: shape of blocks, order, merging and splitting of quadrilaterals.

A line is a row (page_id, line_no, qx1, qy1, ..., qx4, qy4): a convex quadrilateral whose
corners run clockwise from the upper left. A block's lines share one direction: the
sum of their vectors down or to the right, whichever makes its text vertical or horizontal.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import pages as P
from .lines import COLS, best_block
from .masks import enough_mask, masks_of

CORNERS = [f"q{axis}{k}" for k in (1, 2, 3, 4) for axis in "xy"]
#: Lines of one block: cosine of their directions, ratio of their fonts, distances in fonts.
COSINE, RATIO, ACROSS, ALONG = 0.866, 1.3, 2.0, 2.5


def _points() -> list[tuple[Column, Column]]:
    return [(F.col(f"qx{k}").cast("double"), F.col(f"qy{k}").cast("double")) for k in (1, 2, 3, 4)]


def edges() -> list[Column]:
    """Left, upper, right and lower edge of a line."""
    xs, ys = ([F.col(f"q{axis}{k}") for k in (1, 2, 3, 4)] for axis in "xy")
    return [F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)]


def with_rectangle(lines: DataFrame) -> DataFrame:
    """Lines with the rectangle around them."""
    return lines.withColumns({c: e.cast("int") for c, e in zip(COLS, edges())})


def from_rectangles(rows: DataFrame) -> DataFrame:
    """Rows with corner columns of their rectangles."""
    corners = [F.col(c) for c in ("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2")]
    return rows.withColumns({n: c.cast("double") for n, c in zip(CORNERS, corners)})


def quad_shapes(lines: DataFrame, *keys: str) -> DataFrame:
    """Per block: n_lines, vertical, angle, font_size, vec_x, vec_y (the summed vector of its direction), norm.

    Vertical where the summed down vector is longer than the summed right one (``lang`` ja) or over twice as long
    (others). The angle is that of the direction in whole degrees, turned by 90 for vertical text; under 3 it is 0. The
    font size is the length of the other sum per line, rounded half to even.
    """
    (vx, vy), (hx, hy) = G.line_vectors(_points())
    s = lines.groupBy(*keys).agg(*(F.sum(c).alias(n) for c, n in zip((vx, vy, hx, hy), ("vx", "vy", "hx", "hy"))), F.count("*").alias("n_lines"), F.max("lang").alias("lang"))
    length = lambda a: F.sqrt(F.col(f"{a}x") * F.col(f"{a}x") + F.col(f"{a}y") * F.col(f"{a}y"))
    s = s.withColumn("nv", length("v")).withColumn("nh", length("h"))
    s = s.withColumn("vertical", F.when(F.col("lang") == "ja", F.col("nv") > F.col("nh")).otherwise(F.col("nv") > 2 * F.col("nh")))
    pick = lambda a, b: F.when(F.col("vertical"), F.col(a)).otherwise(F.col(b))
    turn = (F.atan2(pick("vy", "hy"), pick("vx", "hx")) / F.pi() * 180).cast("int") - F.when(F.col("vertical"), 90).otherwise(0)
    font = F.bround(pick("nh", "nv") / F.col("n_lines"), 0).cast("int")
    return s.select(
        *keys, "n_lines", "vertical", F.when(F.abs(turn) < 3, 0).otherwise(turn).alias("angle"), font.alias("font_size"),
        pick("vx", "hx").alias("vec_x"), pick("vy", "hy").alias("vec_y"), pick("nv", "nh").alias("norm"),
    )


def with_distance(lines: DataFrame, w: int) -> DataFrame:
    """Lines of known shape with ``distance``: of their centre from the line through the upper left corner (upper right one for vertical text) along their direction."""
    p = _points()
    dx = (p[0][0] + p[2][0]) / 2 - F.when(F.col("vertical"), F.lit(float(w))).otherwise(F.lit(0.0))
    dy = (p[0][1] + p[2][1]) / 2
    return lines.withColumn("distance", F.when(F.col("norm") > 0, F.abs(dx * F.col("vec_y") - dy * F.col("vec_x")) / F.col("norm")))


def quad_distance_order(lines: DataFrame, w: int, *keys: str) -> DataFrame:
    """Adds ``distance`` and ``position``, the place of a line in its block by distance (ties by line_no). Lines carry their block's vertical, vec_x, vec_y, norm."""
    return with_distance(lines, w).withColumn("position", F.row_number().over(W.partitionBy(*keys).orderBy("distance", "line_no")))


def quads_meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether convex quadrilaterals (n, 4, 2) have a point in common: no edge of either separates them. ``a`` may be one for all."""
    a = np.broadcast_to(a, b.shape)
    meet = ((a.min(1) <= b.max(1)) & (b.min(1) <= a.max(1))).all(1)
    rows = np.flatnonzero(meet)
    p, q = a[rows], b[rows]
    side = np.concatenate((np.roll(p, -1, 1) - p, np.roll(q, -1, 1) - q), 1)
    normal = np.stack((-side[..., 1], side[..., 0]), -1)
    u, v = (np.einsum("nec,npc->nep", normal, s) for s in (p, q))
    apart = (u.max(2) < v.min(2)) | (v.max(2) < u.min(2))
    meet[rows] = ~apart.any(1)
    return meet


def _corners(c: P.Columns) -> np.ndarray:
    return np.stack([c[n].astype(float) for n in CORNERS], 1).reshape(-1, 4, 2)


def _reached(cells: P.Cells, low: np.ndarray, high: np.ndarray, first: np.ndarray, far: float) -> np.ndarray:
    """Rows in order that may touch a line (low to high) or begin within ``far`` of its first corner."""
    far = far * (1 + 1e-9)
    box = np.minimum(low, first - far)[None], np.maximum(high, first + far)[None]
    met = [rows for _, rows in cells.near(np.zeros(1, np.int64), *box)]
    return np.sort(np.concatenate(met)) if met else np.zeros(0, np.int64)


def merge_kernel(c: P.Columns, group: np.ndarray) -> P.Columns:
    """Free lines of each group with the block, font size and angle that they come to; see ``merge_scattered_quads``.

    All groups take a step together. A group of over ``P.CROWDED`` lines is walked alone: it looks up in grids by size what a
    block's last line can absorb, so that a step costs what is around that line; the grids are built again when half of their lines are taken.
    """
    order = np.lexsort((c["line_no"], c["distance"], group))
    c, group = P.taken(c, order), group[order]
    t = _Lines(c)
    n = len(group)
    lead = np.full(n, -1)  # of each line: the row of its block's first line
    size, v, count = t.font.copy(), t.vec.copy(), np.ones(n, np.int64)  # of each block, at its first line
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else np.zeros(0, np.int64)
    ends = np.append(starts[1:], n)[: len(starts)]
    crowded = ends - starts > P.CROWDED
    for begin, end in zip(starts[crowded], ends[crowded]):
        _walk_crowded(t, int(begin), int(end), lead, size, v, count)
    _walk_together(t, starts[~crowded], ends[~crowded], lead, size, v, count)
    first = lead == np.arange(n)
    number = np.cumsum(first)
    before = np.repeat(number[starts] - 1, ends - starts)
    turned = np.rint(np.degrees(np.arctan2(v[:, 1], v[:, 0]))).astype(np.int64) - 90 * c["vertical"].astype(bool)
    angle = np.where(count > 1, turned, c["angle"].astype(np.int64))
    return c | {"block": number[lead] - before, "font_size": size[lead], "angle": angle[lead]}


class _Lines:
    """Columns of lines that stand in order of group and distance."""

    def __init__(self, c: P.Columns):
        self.quad = _corners(c)
        self.first, self.far, self.font = self.quad[:, 0], c["distance"].astype(float), c["font_size"].astype(float)
        self.vec, self.norm = np.stack((c["vec_x"], c["vec_y"]), 1).astype(float), c["norm"].astype(float)
        self.least, self.most = self.quad.min(1), self.quad.max(1)

    def absorbs(self, last: np.ndarray, later: np.ndarray, size: np.ndarray, k: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a block with that last line, font size, number of lines and summed vector absorbs a later line, and its font size then. One block, or one for each later line."""
        font = self.font[later]
        mean = (size * k + font) / (k + 1)
        low, high = np.minimum(font, size), np.maximum(font, size)
        long = self.norm[later] * np.sqrt(v[..., 0] ** 2 + v[..., 1] ** 2)
        hit = (low > 0) & (high <= RATIO * low) & (long > 0) & (np.abs(self.vec[later, 0] * v[..., 0] + self.vec[later, 1] * v[..., 1]) >= COSINE * long)
        hit &= self.far[later] - self.far[last] <= ACROSS * mean
        gone = self.first[later] - self.first[last]
        hit &= np.sqrt(gone[:, 0] ** 2 + gone[:, 1] ** 2) <= ALONG * mean
        apart = ~hit
        for axis in (0, 1):
            apart &= (self.least[later, axis] <= self.most[last, axis]) & (self.least[last, axis] <= self.most[later, axis])
        rest = np.flatnonzero(apart)
        hit[rest] = quads_meet(self.quad[last[rest] if np.ndim(last) else last], self.quad[later[rest]])
        return hit, mean


def _walk_together(t: _Lines, starts: np.ndarray, ends: np.ndarray, lead: np.ndarray, size: np.ndarray, v: np.ndarray, count: np.ndarray) -> None:
    """Every group has one open block and tests its last line against all free later ones: it absorbs the first that fits, or ends and the next free line begins one."""
    at, last, end = starts.copy(), starts.copy(), ends
    lead[at] = at
    while len(at):
        n = end - last - 1
        of = np.repeat(np.arange(len(at)), n)
        later = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + last[of] + 1
        free = lead[later] < 0
        of, later = of[free], later[free]
        block = at[of]
        hit, mean = t.absorbs(last[of], later, size[block], count[block], v[block])
        hits = np.flatnonzero(hit)
        hits = hits[np.concatenate(([True], of[hits][1:] != of[hits][:-1]))] if len(hits) else hits
        grown, line = of[hits], later[hits]
        block = at[grown]
        lead[line] = block
        size[block] = mean[hits]
        v[block] += t.vec[line]
        count[block] += 1
        last[grown] = line
        done = np.ones(len(at), bool)
        done[grown] = False
        ended = np.flatnonzero(done)
        step = ended
        while len(step):  # to the next free line
            at[step] += 1
            step = step[at[step] < end[step]]
            step = step[lead[at[step]] >= 0]
        begun = ended[at[ended] < end[ended]]
        lead[at[begun]] = last[begun] = at[begun]
        alive = at < end
        if not alive.all():
            at, last, end = at[alive], last[alive], end[alive]


def _walk_crowded(t: _Lines, begin: int, end: int, lead: np.ndarray, size: np.ndarray, v: np.ndarray, count: np.ndarray) -> None:
    """One crowded group, a block after the other."""
    free, cells, held = end - begin, None, 0
    for at in range(begin, end):
        if lead[at] >= 0:
            continue
        last, lead[at] = at, at
        free -= 1
        while free:
            if cells is None or 2 * free < held:
                cells, held = P.Cells(begin + np.flatnonzero(lead[begin:end] < 0), t.least, t.most), free
            later = _reached(cells, t.least[last], t.most[last], t.first[last], ALONG * RATIO * size[at])
            later = later[(later > last) & (lead[later] < 0)]
            if not len(later):
                break
            hit, mean = t.absorbs(last, later, size[at], count[at], v[at])
            if not hit.any():
                break
            i = int(hit.argmax())
            last, size[at] = int(later[i]), mean[i]
            v[at] += t.vec[last]
            count[at] += 1
            lead[last] = at
            free -= 1


def merge_scattered_quads(lines: DataFrame, w: int) -> DataFrame:
    """Lines (page_id, line_no, corners) of no block, with vertical, block, font_size and angle of the blocks they make.

    Lines of one orientation are taken by distance. Each free one begins a block and absorbs later ones that touch its
    last line, or whose font is within 1.3 times, whose direction is within 30 degrees, which lie at most 2 mean fonts further
    and begin at most 2.5 mean fonts from its last line. Lines without length are absorbed only by touch.
    """

    lines = lines.select("page_id", "line_no", *CORNERS)
    kinds = dict(lines.dtypes)
    schema = ", ".join(["page_id long", "vertical boolean", f"line_no {kinds['line_no']}", *(f"{c} {kinds[c]}" for c in CORNERS), "block int", "font_size double", "angle int"])

    def kernel(c: P.Columns, group: np.ndarray) -> P.Columns:
        c, vertical = alone(c, w)
        return merge_kernel(c, group * 2 + vertical)

    return P.map_pages(lines, ["page_id"], kernel, schema)


def alone(c: P.Columns, w: int) -> tuple[P.Columns, np.ndarray]:
    """Lines with the shape that each has as a block of its own, and which are vertical."""
    n = len(c["line_no"])
    shape, distance = shapes(c, np.arange(n), n, np.zeros(n, bool), w)
    return c | shape | {"distance": distance}, shape["vertical"]


def split_kernel(c: P.Columns, group: np.ndarray) -> P.Columns:
    """Lines of each group (block) with their part; see ``split_quads``."""
    order = np.lexsort((c["line_no"], c["distance"], group))
    c, group = P.taken(c, order), group[order]
    step = np.diff(c["distance"].astype(float), prepend=0.0)  # of the distances in order, whatever order lines take
    place = P.places(group)
    lead = np.flatnonzero(place == 1)
    start = _corners(c)[:, 0]
    gone = np.linalg.norm(start - start[np.repeat(lead, np.diff(np.append(lead, len(group))))], axis=1)
    order = np.lexsort((place, gone, group))
    c = P.taken(c, order)
    quad, font = _corners(c), c["font_size"].astype(float)
    size = np.bincount(group)[group] if len(group) else place
    splits = (size > 1) & (c["vertical"].astype(bool) | (c["lang"] == "ja")) & (place > 1)
    rows = np.flatnonzero(splits)
    rows = rows[~quads_meet(quad[rows - 1], quad[rows])]
    hard, soft = np.zeros(len(group), bool), np.zeros(len(group), bool)
    hard[rows] = np.abs(step[rows]) > 2 * font[rows]
    upright = c["vertical"][rows].astype(bool) & (np.abs(c["angle"][rows].astype(int)) < 15)
    soft[rows] = upright & (np.abs(quad[rows, 0, 1] - quad[rows - 1, 0, 1]) > font[rows])
    wide = np.abs(step) > font
    part, held, parts = 0, 0, []
    for p, h, s, x in zip(place.tolist(), hard.tolist(), soft.tolist(), wide.tolist()):
        if p == 1:
            part, held = 0, 0
        elif h or (s and (held > 1 or x)):
            part, held = part + 1, 0
        held += 1
        parts.append(part)
    return c | {"part": np.array(parts, np.int64)}


def split_quads(lines: DataFrame) -> DataFrame:
    """(page_id, block_idx, line_no, part from 0) of lines with corners, distance and their block's lang, vertical, angle, font_size.

    Only blocks of several lines that are Japanese or vertical are split. Lines are taken by the distance of their first corner from
    that of the block's nearest line. A part ends before a line that doesn't touch the one before where the block's distances,
    in order, have a step of over 2 fonts there; in upright vertical text also where the two begin over a font apart in
    height, if the part has several lines or the step is over one font.
    """

    kinds = dict(lines.dtypes)
    needed = ["page_id", "block_idx", "line_no", *CORNERS, "distance", "lang", "vertical", "angle", "font_size"]
    rows = lines.select(*needed).na.fill({"distance": 0.0, "lang": ""})
    return P.map_pages(rows, ["page_id", "block_idx"], split_kernel, f"page_id long, block_idx {kinds['block_idx']}, line_no {kinds['line_no']}, part int")


def shapes(c: P.Columns, group: np.ndarray, n: int, japanese: np.ndarray, w: int) -> tuple[P.Columns, np.ndarray]:
    """Shape of each of ``n`` groups of lines as ``quad_shapes`` gives it, and each line's distance as ``with_distance`` does (0 without direction)."""
    q = _corners(c)
    down = (q[:, 2] + q[:, 3]) / 2 - (q[:, 0] + q[:, 1]) / 2
    right = (q[:, 1] + q[:, 2]) / 2 - (q[:, 3] + q[:, 0]) / 2
    total = lambda v: np.stack([np.bincount(group, v[:, k], n) for k in (0, 1)], 1)
    v, h = total(down), total(right)
    nv, nh = np.sqrt((v * v).sum(1)), np.sqrt((h * h).sum(1))
    vertical = nv > np.where(japanese, 1, 2) * nh
    vec = np.where(vertical[:, None], v, h)
    turn = np.trunc(np.arctan2(vec[:, 1], vec[:, 0]) / np.pi * 180).astype(np.int64) - 90 * vertical
    norm = np.where(vertical, nv, nh)
    font = np.rint(np.where(vertical, nh, nv) / np.maximum(np.bincount(group, minlength=n), 1))
    shape = {"vertical": vertical, "angle": np.where(np.abs(turn) < 3, 0, turn), "font_size": font, "vec_x": vec[:, 0], "vec_y": vec[:, 1], "norm": norm}
    at = (q[:, 0] + q[:, 2]) / 2 - np.where(vertical[group], float(w), 0.0)[:, None] * [1, 0]
    far = np.abs(at[:, 0] * vec[group, 1] - at[:, 1] * vec[group, 0])
    return shape, np.where(norm[group] > 0, far / np.where(norm[group] > 0, norm[group], 1), 0.0)


def grid_places(group: np.ndarray, box: np.ndarray, japanese: np.ndarray, w: int, h: int) -> np.ndarray:
    """Place of each row of a page, rows standing in order, as ``grid_order`` gives it."""
    n = int(group.max(initial=-1)) + 1
    mirror = 2 * np.bincount(group, japanese, n) > np.bincount(group, minlength=n)
    x, y = (box[:, 0] + box[:, 2]) / 2, (box[:, 1] + box[:, 3]) / 2
    halves = 2 if w > h else 1
    x = np.where(mirror[group], w - x, x)
    half = np.minimum(np.floor(x / (w / halves)), halves - 1)
    x = x - half * (w / halves)
    cw, ch = w / halves / 3, h / 4
    column, row = np.minimum(np.floor(x / cw), 2), np.minimum(np.floor(y / ch), 3)
    order = np.lexsort((np.arange(len(group)), 1.2 * (x - column * cw) + (y - row * ch), half * 12 + row * 3 + column, group))
    out = np.empty(len(group), np.int64)
    out[order] = P.places(group[order])
    return out


def grown_lines(quad: np.ndarray, grow: np.ndarray, angle: np.ndarray, w: int, h: int) -> np.ndarray:
    """Corners (n, 8) moved outwards by ``grow`` pixels along and across the angle, within the page; whole pixels."""
    dx, dy = np.sin(np.radians(angle)) * grow, np.cos(np.radians(angle)) * grow
    signs = np.array([[-1, -1], [1, -1], [1, 1], [-1, 1]])
    moved = quad + signs * np.stack((dx, dy), 1)[:, None]
    moved = np.maximum(np.minimum(moved, [w - 1.0, h - 1.0]), 0.0)
    return np.trunc(np.where(grow[:, None, None] > 0, moved, quad)).astype(np.int64).reshape(-1, 8)


def group_quads(lines: DataFrame, blocks: DataFrame, w: int, h: int, masks: DataFrame | None = None, share: float = 0.1) -> DataFrame:
    """Blocks of a page in grid order: (page_id, idx, x1..y2, lang, vertical, angle, font_size, n_lines, lines, position).

    lines: (page_id, line_no, corners), line_no distinct on a page; blocks: (page_id, idx, x1..y2, lang). Lines are assigned
    to blocks by their rectangles; a block without lines has its own rectangle as one. With ``masks`` (page_id, h, w, data),
    a line of no block and a block without lines count only where the page's text mask covers ``share`` of their rectangle.
    Blocks are examined and split; whole ones cover their box and their lines, parts their lines alone. Lines without a
    block are merged among themselves, language unknown. ``lines`` are arrays of eight coordinates by distance; those of
    horizontal English blocks grow by max(int(0.1 font), 2) pixels, as does the font.

    Lines, blocks and masks move once, in one exchange by page; everything else is one kernel over the pages of an Arrow batch.
    """
    left = lines.select("page_id", F.col("line_no").cast("long").alias("line_no"), *(F.col(c).cast("double").alias(c) for c in CORNERS))
    right = blocks.dropna(subset=COLS).select("page_id", F.col("idx").cast("int").alias("idx"), *COLS, F.coalesce("lang", F.lit("")).alias("lang"))
    sides, names = {"left_": left, "right_": right}, [[c for c in df.columns if c != "page_id"] for df in (left, right)]
    if masks is not None:
        sides["mask_"] = masks.select("page_id", "h", "w", "data")
    rows = reduce(lambda a, b: a.unionByName(b, True), (df.select("page_id", F.struct(*df.drop("page_id").columns).alias(side)) for side, df in sides.items()))
    mask = F.lit(None).cast("struct<h:int,w:int,data:binary>") if masks is None else F.first("mask_", True)
    both = rows.groupBy("page_id").agg(F.collect_list("left_").alias("left_"), F.collect_list("right_").alias("right_"), mask.alias("mask_"))

    def body(batch: pa.RecordBatch) -> P.Columns:
        line, page = P.unpacked(batch, ["page_id"], "left_", names[0])
        block, of = P.unpacked(batch, ["page_id"], "right_", names[1])
        cover = masks_of(batch.column("mask_"))
        # lines go to blocks; what has no counterpart must have enough text under it
        q = _corners(line)
        around = np.trunc(np.concatenate((q.min(1), q.max(1)), 1)).astype(np.int64)
        outer = P.boxes_of(block)[0]
        home = best_block(page, around, of, outer, block["idx"], 0.4)
        free = np.flatnonzero(home < 0)
        free = free[enough_mask(cover, page[free], around[free], w, h, share)]
        bare = np.setdiff1d(np.arange(len(of)), home)
        bare = bare[enough_mask(cover, of[bare], outer[bare], w, h, share)]
        own = np.flatnonzero(home >= 0)

        # blocks with lines, or with their own rectangle as one
        rectangle = outer[bare][:, [0, 1, 2, 1, 2, 3, 0, 3]].astype(float)
        c = {n: np.concatenate((line[n][own], rectangle[:, k])) for k, n in enumerate(CORNERS)}
        c["line_no"] = np.concatenate((line["line_no"][own], np.zeros(len(bare), np.int64)))
        kept, group = np.unique(np.concatenate((home[own], bare)), return_inverse=True)
        lang = block["lang"][kept] if len(kept) else np.zeros(0, object)
        shape, c["distance"] = shapes(c, group, len(kept), lang == "ja", w)
        c |= {n: v[group] for n, v in shape.items() if n in ("vertical", "angle", "font_size")} | {"lang": lang[group], "row": group}
        c = split_kernel(c, group)
        several = np.zeros(len(kept), bool)
        several[c["row"][c["part"] > 0]] = True
        placed = {"page": of[kept[c["row"]]], "kind": np.zeros(len(group), np.int64), "block": block["idx"][kept[c["row"]]].astype(np.int64) if len(kept) else group, "rank": c["distance"]}
        whole = ~several[c["row"]]
        placed["box"] = np.where(whole[:, None], outer[kept[c["row"]]], [[2**31, 2**31, -(2**31), -(2**31)]]) if len(kept) else np.zeros((0, 4), np.int64)
        made = c | placed

        # free lines, each with a shape of its own
        f, vertical = alone({n: line[n][free] for n in (*CORNERS, "line_no")} | {"page": page[free]}, w)
        f = merge_kernel(f, page[free] * 2 + vertical)
        n = len(free)
        f |= {"kind": 1 + f["vertical"].astype(np.int64), "part": np.zeros(n, np.int64), "lang": np.full(n, "unknown", object), "rank": f["line_no"].astype(float), "box": np.tile([[2**31, 2**31, -(2**31), -(2**31)]], (n, 1))}
        names_ = ("page", "kind", "block", "part", "rank", "line_no", "lang", "vertical", "angle", "font_size", "box", *CORNERS)
        every = {k: np.concatenate((made[k], f[k])) for k in names_}

        # one row a block, numbered on its page
        every = P.taken(every, np.lexsort([every[k] for k in ("line_no", "rank", "part", "block", "kind", "page")]))
        keys = np.stack([every[k].astype(np.int64) for k in ("page", "kind", "block", "part")], 1)
        starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1)))) if len(keys) else np.zeros(0, np.int64)
        size = np.diff(np.append(starts, len(keys)))
        quad = _corners(every)
        if len(starts):
            low = np.minimum(np.minimum.reduceat(quad.min(1), starts), np.minimum.reduceat(every["box"][:, :2], starts))
            high = np.maximum(np.maximum.reduceat(quad.max(1), starts), np.maximum.reduceat(every["box"][:, 2:], starts))
            box = np.trunc(np.concatenate((low, high), 1)).astype(np.int64)
        else:
            box = np.zeros((0, 4), np.int64)
        head = P.taken(every, starts)
        grow = np.where((head["lang"] == "eng") & ~head["vertical"].astype(bool), np.maximum((head["font_size"] * 0.1).astype(np.int64), 2), 0)
        flat = grown_lines(quad, np.repeat(grow, size), np.repeat(head["angle"].astype(float), size), w, h)
        pieces = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, 8), pa.int32()), pa.array(flat.ravel(), pa.int32()))
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(keys)), pa.int32()), pieces)
        return {
            "page_id": batch.column("page_id").take(pa.array(head["page"])), "idx": P.places(head["page"]), **{n: box[:, k] for k, n in enumerate(COLS)},
            "lang": [v or None for v in head["lang"]], "vertical": head["vertical"].astype(bool), "angle": head["angle"], "font_size": head["font_size"] + grow,
            "n_lines": size, "lines": lists, "position": grid_places(head["page"], box, head["lang"] == "ja", w, h),
        }

    schema = "page_id long, idx int, x1 int, y1 int, x2 int, y2 int, lang string, vertical boolean, angle int, font_size double, n_lines int, lines array<array<int>>, position int"
    return P.mapped(both, schema, body)


def quad_polygons(lines: DataFrame) -> DataFrame:
    """(page_id, lines): eight integers a text line, in order of block and line."""
    line = F.concat_ws(",", *(F.col(c).cast("int").cast("string") for c in CORNERS))
    rows = lines.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("block_idx", "line_no", line.alias("line")))).alias("s"))
    return rows.select("page_id", F.array_join(F.transform("s", lambda s: s["line"]), "\n").alias("lines"))
