"""Regions of pages: overlap pairs, merging, reading order, packing per page.

A region is a row (page_id, idx, x1, y1, x2, y2, ...); idx orders the regions of
a page. Null coordinates never overlap. Merging is one greedy pass: a region is
taken, everything that overlaps it (not the grown union) is merged into it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import rules as R
from . import pages as P

COLS = list(G.Box._fields)
#: Regions of a page from which pairs are searched by grid cells instead of the page alone.
CROWDED = 2000
CELL = 512


def overlap_pairs(boxes: DataFrame, mode: str = "area", threshold: float = 20) -> DataFrame:
    """(page_id, i, j), i < j, of regions of one page that overlap by area or by centers.

    Crowded pages are joined by the grid cells that regions touch, so no page is one
    quadratic join; a pair counts in the cell of its common area's upper left corner.
    """
    test = (lambda a, b: G.overlaps(a, b, threshold)) if mode == "area" else G.centers_overlap
    size = boxes.groupBy("page_id").agg((F.count("*") > CROWDED).alias("crowded"))
    cell = lambda c: F.floor(F.col(c) / CELL).cast("int")
    rows = boxes.select("page_id", "idx", *COLS).join(size, "page_id")
    zero = F.array(F.lit(0))
    rows = rows.withColumn("cx", F.explode(F.when(F.col("crowded"), F.sequence(cell("x1"), F.greatest(cell("x1"), cell("x2")))).otherwise(zero)))
    rows = rows.withColumn("cy", F.explode(F.when(F.col("crowded"), F.sequence(cell("y1"), F.greatest(cell("y1"), cell("y2")))).otherwise(zero)))
    side = lambda s, n: rows.select("page_id", "crowded", "cx", "cy", F.col("idx").alias(n), *(F.col(c).alias(c + s) for c in COLS))
    a, b = G.box(suffix="_a"), G.box(suffix="_b")
    meet = (F.col("x1_a") <= F.col("x2_b")) & (F.col("x1_b") <= F.col("x2_a")) & (F.col("y1_a") <= F.col("y2_b")) & (F.col("y1_b") <= F.col("y2_a"))
    both = side("_a", "i").join(side("_b", "j").drop("crowded"), ["page_id", "cx", "cy"]).filter((F.col("i") < F.col("j")) & meet & test(a, b))
    corner = (F.floor(F.greatest("x1_a", "x1_b") / CELL) == F.col("cx")) & (F.floor(F.greatest("y1_a", "y1_b") / CELL) == F.col("cy"))
    return both.filter(~F.col("crowded") | corner).select("page_id", "i", "j")


def _sortable(column: np.ndarray) -> np.ndarray:
    """Numbers for ordering; nulls come first."""
    return np.array([-(2**62) if v is None else v for v in column]) if column.dtype == object else column


def _in_order(columns: P.Columns, group: np.ndarray, names: list[str]) -> np.ndarray:
    return np.lexsort((*(_sortable(columns[n]) for n in reversed(names)), group))


def _schema(df: DataFrame) -> str:
    return ", ".join(f"{n} {t}" for n, t in df.dtypes)


def merge_center_overlaps(boxes: DataFrame) -> DataFrame:
    """Greedy union of regions one of whose centers lies in the other, in idx order."""
    kernel = lambda c, group: P.merged(c, group, _in_order(c, group, ["idx"]), P.centers_meet)
    return P.map_pages(boxes, ["page_id"], kernel, _schema(boxes))


def distinct_boxes(boxes: DataFrame) -> DataFrame:
    """Equal regions of a page collapse to the one of smallest idx."""
    rest = [c for c in boxes.columns if c not in ("page_id", *COLS)]
    first = F.min_by(F.struct(*rest), "idx").alias("r") if len(rest) > 1 else F.struct(F.min("idx").alias("idx")).alias("r")
    return boxes.groupBy("page_id", *COLS).agg(first).select("page_id", *COLS, "r.*").select(*boxes.columns)


def merge_overlaps(boxes: DataFrame, threshold: float = 20) -> DataFrame:
    """Greedy union of distinct regions that overlap by over ``threshold`` percent, in (y1, x1, y2, x2) order."""
    names = ["y1", "x1", "y2", "x2"]

    def kernel(c: P.Columns, group: np.ndarray) -> P.Columns:
        order = _in_order(c, group, [*names, "idx"])
        same = np.ones(max(0, len(order) - 1), bool)
        for x in (group, *(c[n] for n in names)):
            same &= x[order][1:] == x[order][:-1]
        rows = order[np.concatenate(([True], ~same))]  # equal regions collapse to the one of smallest idx
        return P.merged(P.taken(c, rows), group[rows], np.arange(len(rows)), P.areas_meet(threshold))

    return P.map_pages(boxes, ["page_id"], kernel, _schema(boxes))


def clustered(group: np.ndarray, idx: np.ndarray, edges: tuple[np.ndarray, np.ndarray], axis: int, tol: int, depth: int) -> np.ndarray:
    """Rows in the order of recursive clustering, all groups together.

    Along sorted edges a cluster ends where the next edge is more than ``tol`` away, so a level of the recursion is
    one sort by (segment, edge, idx) and its gaps. A segment that stays whole at the last level keeps the order it had.
    """
    order = np.lexsort((idx, group))
    segment = group[order]
    for level in range(depth, 0, -1):
        edge = edges[axis]
        by = np.lexsort((idx[order], edge[order], segment))
        new, of = order[by], segment[by]
        same = of[1:] == of[:-1]
        cut = np.concatenate(([True], ~same | (edge[new[1:]] - edge[new[:-1]] > tol)))
        numbers = np.cumsum(cut) - 1
        if level == 1:
            whole = np.bincount(of, cut, minlength=int(of.max(initial=0)) + 1)[of] == 1
            order = np.where(whole, order, new)
            break
        order, segment, axis = new, numbers, 1 - axis
    return order


def cluster_boxes(boxes: DataFrame, axis: str = "y", tol: int = 10, depth: int = 10) -> DataFrame:
    """(page_id, idx, position): recursive clustering by edges aligned within ``tol``, on alternate axes. Regions without coordinates have no position."""

    def kernel(c: P.Columns, group: np.ndarray) -> P.Columns:
        order = clustered(group, c["idx"], (c["x1"], c["y1"]), int(axis == "y"), tol, depth)
        return {"page_id": c["page_id"][order], "idx": c["idx"][order], "position": P.places(group[order])}

    whole = boxes.select("page_id", "idx", "x1", "y1").dropna(subset=["x1", "y1"])
    return P.map_pages(whole, ["page_id"], kernel, "page_id long, idx int, position int")


def page_language(boxes: DataFrame) -> DataFrame:
    """(page_id, page_lang): the most frequent known language, ties by first place; null if none is known."""
    counts = boxes.groupBy("page_id", "lang").agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    known = F.col("lang").isNotNull()
    best = F.max(F.when(known, F.struct("n", (-F.col("first")).alias("early"), "lang")))
    return counts.groupBy("page_id").agg(best.alias("b")).select("page_id", F.col("b.lang").alias("page_lang"))


def reading_order(boxes: DataFrame, mode: str = "auto") -> DataFrame:
    """Adds ``position``: ascending y1 - 0.4 x1 (right to left) or y1 + 0.4 x1 (left to right), ties by idx.

    Left to right for mode 'comic', or for 'auto' where the page's language is not one of the right-to-left ones.
    """
    ltr = F.lit(True) if mode == "comic" else F.lit(False) if mode == "manga" else ~F.coalesce(F.col("page_lang").isin(list(R.RTL)), F.lit(False))
    slope = F.when(ltr, F.lit(0.4)).otherwise(F.lit(-0.4))
    key = F.col("y1") + slope * F.col("x1")
    return boxes.withColumn("position", F.row_number().over(W.partitionBy("page_id").orderBy(key, "idx")))


def label_results(rows: DataFrame) -> DataFrame:
    """Adds ``label``: the place of a row on its page, from 1."""
    return rows.withColumn("label", F.row_number().over(W.partitionBy("page_id").orderBy("idx")))


def pack_boxes(boxes: DataFrame, order: str = "idx") -> DataFrame:
    """One row a page: boxes as arrays of four integers in order, and their languages."""
    item = F.struct(F.col(order).alias("o"), F.array(*COLS).alias("box"), F.col("lang").alias("lang"))
    packed = boxes.groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("a"))
    return packed.select("page_id", F.transform("a", lambda s: s["box"]).alias("boxes"), F.transform("a", lambda s: s["lang"]).alias("box_language"))


def apply_ocr_filter(boxes: DataFrame, texts: DataFrame, max_area: int = 3000, pattern: str = R.SYMBOLS, scale: Column | None = None, *carry: str) -> tuple[DataFrame, DataFrame]:
    """(kept boxes, checked boxes): small boxes whose text is symbols alone are removed.

    Checked boxes carry text, area, ``removed``, and their coordinates over the scale.
    """
    small = G.area(G.box()) < max_area
    both = boxes.join(texts.select("page_id", "idx", "text"), ["page_id", "idx"], "left")
    symbols = F.coalesce(R.is_symbol_only(F.col("text"), pattern), F.lit(False))
    kept = both.filter(~(small & symbols)).drop("text")
    back = G.scale(G.box(), F.lit(1.0) / (scale if scale is not None else F.lit(1.0)))
    checked = both.filter(small).select(
        "page_id", "idx", *carry, "text", G.area(G.box()).alias("area"), symbols.alias("removed"), *(c.alias(n) for c, n in zip(back, COLS))
    )
    return kept, checked


#: Edges of regions inside a slab of the sweep.
SLAB = 512


def covered_areas(group: np.ndarray, box: np.ndarray, n_groups: int) -> np.ndarray:
    """Area that the half-open whole-number boxes (n, 4) of each group cover together; groups ascend.

    A sweep down all groups, one below the other, in slabs with at most ``SLAB`` edges inside. What spans a slab is a
    union of intervals; what begins or ends in it is counted on the slab's own grid of edges, less what those intervals
    cover already. Memory grows with the boxes, not with the area.
    """
    out = np.zeros(n_groups, np.int64)
    full = (box[:, 2] > box[:, 0]) & (box[:, 3] > box[:, 1])
    group, box = group[full].astype(np.int64), box[full].astype(np.int64)
    if not len(box):
        return out
    low, tall = int(box[:, 1].min()), int(box[:, 3].max() - box[:, 1].min()) + 1
    top, bottom = group * tall + box[:, 1] - low, group * tall + box[:, 3] - low
    edge, count = np.unique(np.concatenate((top, bottom)), return_counts=True)
    first, last = np.searchsorted(edge, top), np.searchsorted(edge, bottom)
    upto = np.cumsum(count)
    a = 0
    while a < len(edge) - 1:
        b = min(max(a + 1, int(np.searchsorted(upto, upto[a] + SLAB, "right"))), len(edge) - 1)
        rows = np.arange(np.searchsorted(group, edge[a] // tall), np.searchsorted(group, edge[b] // tall, "right"))
        rows = rows[(first[rows] < b) & (last[rows] > a)]
        span = (first[rows] <= a) & (last[rows] >= b)
        starts, ends, before = _union(box[rows[span]][:, [0, 2]])
        length = np.full(b - a, before[-1])
        part = rows[~span]
        if len(part):
            xs = np.unique(box[part][:, [0, 2]])
            free = np.diff(xs) - np.diff(_measure(xs, starts, ends, before))
            grid = np.zeros((b - a + 1, len(xs)), np.int32)
            y1, y2 = np.maximum(first[part] - a, 0), np.minimum(last[part] - a, b - a)
            x1, x2 = np.searchsorted(xs, box[part, 0]), np.searchsorted(xs, box[part, 2])
            for y, x, step in ((y1, x1, 1), (y2, x2, 1), (y1, x2, -1), (y2, x1, -1)):
                np.add.at(grid, (y, x), step)
            length += (grid.cumsum(0).cumsum(1)[:-1, :-1] > 0) @ free
        np.add.at(out, edge[a:b] // tall, length * np.diff(edge[a : b + 1]))
        a = b
    return out


def _union(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the union of intervals (n, 2), and the length before each start and after the last."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.concatenate(([True], spans[1:, 0] > reach[:-1]))) if len(spans) else np.zeros(0, np.int64)
    starts, ends = spans[new, 0], reach[np.append(new[1:], len(spans)) - 1] if len(spans) else reach
    return starts, ends, np.concatenate(([0], np.cumsum(ends - starts)))


def _measure(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Length of the union left of each x."""
    k = np.searchsorted(starts, x, "right")
    if not len(starts):
        return np.zeros(len(x), np.int64)
    last = np.maximum(k - 1, 0)
    return np.where(k > 0, before[last] + np.minimum(x, ends[last]) - starts[last], 0)


def mask_coverage(boxes: DataFrame, w: int, h: int) -> DataFrame:
    """(page_id, covered, share): pixels that the regions cover together, right and bottom edges included."""

    def kernel(c: P.Columns, group: np.ndarray) -> P.Columns:
        box, known = P.boxes_of(c)
        box = np.column_stack((np.maximum(box[:, :2], 0), np.minimum(box[:, 2:] + 1, (w, h))))
        box[~known] = 0
        return {"page_id": c["page_id"][P.places(group) == 1], "covered": covered_areas(group, box, int(group.max(initial=-1)) + 1)}

    return P.map_pages(boxes.select("page_id", *COLS), ["page_id"], kernel, "page_id long, covered long").withColumn("share", F.col("covered") / F.lit(w * h))


def _page_languages(lang: np.ndarray, idx: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Of every row's group: the most frequent known language, ties by first place; None if none is known."""
    out = np.full(int(group.max(initial=-1)) + 1, None, object)
    rows = np.flatnonzero([x is not None for x in lang])
    if len(rows):
        names, code = np.unique(lang[rows].astype(str), return_inverse=True)
        key = group[rows].astype(np.int64) * len(names) + code
        kinds, at, count = np.unique(key, return_inverse=True, return_counts=True)
        first = np.full(len(kinds), np.iinfo(np.int64).max)
        np.minimum.at(first, at, idx[rows].astype(np.int64))
        best = np.lexsort((first, -count, kinds // len(names)))
        of = kinds[best] // len(names)
        lead = best[np.concatenate(([True], of[1:] != of[:-1]))]
        out[kinds[lead] // len(names)] = names[kinds[lead] % len(names)]
    return out[group]


def _cleaned(mode: str, padding: int, w: int, h: int) -> Callable[[P.Columns, np.ndarray], P.Columns]:
    """Kernel of the steps after the size filter, pages in reading order: merging by centres, padding, language, order."""

    def kernel(c: P.Columns, group: np.ndarray) -> P.Columns:
        c = c | {"page_lang": _page_languages(c["lang"], c["idx"], group)}
        m = P.merged(c, group, _in_order(c, group, ["idx"]), P.centers_meet)
        m["x1"], m["y1"] = np.maximum(m["x1"] - padding, 0), np.maximum(m["y1"] - padding, 0)
        m["x2"], m["y2"] = np.minimum(m["x2"] + padding, w), np.minimum(m["y2"] + padding, h)
        rtl = np.array([x in R.RTL for x in m["page_lang"]], bool)
        ltr = mode == "comic" or (mode == "auto" and ~rtl)
        key = m["y1"] + np.where(ltr, 0.4, -0.4) * m["x1"]
        order = np.lexsort((m["idx"], key, m["_group"]))
        m = P.taken(m, order)
        return m | {"position": P.places(m["_group"])}

    return kernel


def _kept(detections: DataFrame, strict: bool = False) -> DataFrame:
    known = detections.withColumn("lang", R.map_languages(F.col("lang_raw")))
    kept = known.filter(R.keeps_detection(G.area(G.box()), F.col("lang")) & (F.col("lang").isNotNull() | F.lit(not strict)))
    whole = [F.col(c).isNotNull() for c in COLS]
    return kept.filter(whole[0] & whole[1] & whole[2] & whole[3]).select("page_id", "idx", *COLS, "lang")


def clean_regions(detections: DataFrame, mode: str = "auto", padding: int = 5, w: int = 560, h: int = 760, strict: bool = False) -> DataFrame:
    """Detections to ordered regions: languages, size filter, page language, center merging, padding, reading order.

    One exchange by page. With ``strict`` regions of unknown language go; regions without coordinates always do.
    """
    schema = "page_id long, idx int, x1 int, y1 int, x2 int, y2 int, lang string, page_lang string, position int"
    return P.map_pages(_kept(detections, strict), ["page_id"], _cleaned(mode, padding, w, h), schema)


def clean_pages(detections: DataFrame, mode: str = "auto", padding: int = 5, w: int = 560, h: int = 760, strict: bool = False) -> DataFrame:
    """One row a page of ``clean_regions``: boxes as arrays of four integers in reading order, and their languages."""
    ordered = _cleaned(mode, padding, w, h)

    def kernel(c: P.Columns, group: np.ndarray) -> P.Columns:
        m = ordered(c, group)
        starts = np.flatnonzero(m["position"] == 1)
        ends = pa.array(np.append(starts, len(m["position"])).astype(np.int32))
        four = np.stack([m[n].astype(np.int32) for n in COLS], 1).ravel()
        boxes = pa.ListArray.from_arrays(pa.array(np.arange(0, len(four) + 1, 4, dtype=np.int32)), pa.array(four))
        return {"page_id": m["page_id"][starts], "boxes": pa.ListArray.from_arrays(ends, boxes), "box_language": pa.ListArray.from_arrays(ends, pa.array(m["lang"].tolist(), pa.string()))}

    return P.map_pages(_kept(detections, strict), ["page_id"], kernel, "page_id long, boxes array<array<int>>, box_language array<string>")


def extract_texts(detections: DataFrame, texts: DataFrame, pages: DataFrame, mode: str = "auto", strict: bool = False) -> DataFrame:
    """(page_id, idx in reading order, text, x1..y2) of every region, whatever its size or text, at the original image's scale.

    texts: (page_id, idx, text); pages: (page_id, scale). With ``strict`` regions of unknown language go.
    """
    regions = clean_regions(detections, mode, strict=strict)
    checked = apply_ocr_filter(regions.join(pages.select("page_id", "scale"), "page_id"), texts, 10**10, r".*", F.col("scale"), "position")[1]
    return checked.select("page_id", F.col("position").alias("idx"), "text", *COLS)
