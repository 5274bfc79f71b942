"""Text lines, blocks and detections: assignment, shape of blocks, splitting, suppression, matching.

A line is a row (page_id, line_no, x1, y1, x2, y2): a rectangle whose corners run
clockwise from the upper left. Lines without a matching block are scattered.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import pages as P

COLS = list(G.Box._fields)


def best_block(group: np.ndarray, box: np.ndarray, of: np.ndarray, other: np.ndarray, idx: np.ndarray, threshold: float) -> np.ndarray:
    """Of each line the row of the block with the largest share of the line's area (the smallest ``idx`` on ties), or -1."""
    size = np.maximum(P.area(box), 1)
    top, best = np.full(len(group), float(threshold)), np.full(len(group), -1)
    for a, b in P.pairs_between(group, box, of, other):
        share = P.common_area(box[a], other[b]) / size[a]
        a, b, share = (v[share > threshold] for v in (a, b, share))
        order = np.lexsort((idx[b], -share, a))
        first = order[P.places(a[order]) == 1]
        a, b, share = a[first], b[first], share[first]
        tie = (share == top[a]) & (best[a] >= 0)
        tie[tie] = idx[b[tie]] < idx[best[a[tie]]]
        better = (share > top[a]) | tie
        top[a[better]], best[a[better]] = share[better], b[better]
    return best


def assign_lines(lines: DataFrame, blocks: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Adds ``block`` (idx of the block with the largest share of the line's area, first on ties) where the share is over the threshold."""

    def kernel(line: P.Columns, group: np.ndarray, block: P.Columns, of: np.ndarray) -> P.Columns:
        (box, known), (other, _) = P.boxes_of(line), P.boxes_of(block)
        best = best_block(group, box, of, other, block["idx"], threshold)
        found = np.full(len(group), None, object)
        hit = known & (best >= 0)
        found[hit] = block["idx"][best[hit]]
        return line | {"block": found}

    rest = [c for c in lines.columns if c not in COLS]
    kinds = dict(lines.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in (*rest, *COLS)), f"block {dict(blocks.dtypes)['idx']}"])
    return P.map_sides(lines, placed(blocks).select("page_id", "idx", *COLS), ["page_id"], kernel, schema)


def placed(boxes: DataFrame) -> DataFrame:
    """Rows with all coordinates."""
    return boxes.dropna(subset=COLS)


def _largest_common(box: np.ndarray, group: np.ndarray, other: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Of each box: the largest area in common with one of the others in its group."""
    most = np.zeros(len(group), box.dtype)
    for a, b in P.pairs_between(group, box, of, other):
        np.maximum.at(most, a, P.common_area(box[a], other[b]))
    return most


def uncovered_components(components: DataFrame, blocks: DataFrame, min_area: int = 50, threshold: float = 0.5) -> DataFrame:
    """Components over ``min_area`` pixels whose best overlap with a block covers less than the threshold of their rectangle."""

    def kernel(part: P.Columns, group: np.ndarray, block: P.Columns, of: np.ndarray) -> P.Columns:
        box, other = P.boxes_of(part)[0], P.boxes_of(block)[0]
        return P.taken(part, _largest_common(box, group, other, of) / np.maximum(P.area(box), 1) < threshold)

    large = placed(components).filter(F.col("area") > min_area)
    schema = ", ".join(f"{n} {t}" for n, t in components.dtypes)
    return P.map_sides(large, placed(blocks).select("page_id", *COLS), ["page_id"], kernel, schema)


def line_shape(b: G.Box) -> tuple[Column, Column]:
    """Sizes of the vectors down (height) and to the right (width) of a rectangle."""
    return (b.y2 - b.y1).cast("double"), (b.x2 - b.x1).cast("double")


def examine_blocks(lines: DataFrame, *keys: str) -> DataFrame:
    """Per block: vertical, angle, font size, primary vector and its length, from sums over its lines.

    Vertical where the summed down vector exceeds the summed right one (Japanese) or twice it
    (others). The angle is that of the primary vector, turned by 90 degrees for vertical blocks; under 3 it is 0.
    """
    down, right = line_shape(G.box())
    s = lines.groupBy(*keys).agg(F.sum(down).alias("v"), F.sum(right).alias("h"), F.count("*").alias("n_lines"), F.max("lang").alias("lang"))
    vertical = F.when(F.col("lang") == "ja", F.col("v") > F.col("h")).otherwise(F.col("v") > 2 * F.col("h"))
    s = s.withColumn("vertical", vertical)
    vx, vy = F.when(F.col("vertical"), 0.0).otherwise(F.col("h")), F.when(F.col("vertical"), F.col("v")).otherwise(0.0)
    turn = F.degrees(F.atan2(vy, vx)) - F.when(F.col("vertical"), 90.0).otherwise(0.0)
    font = F.when(F.col("vertical"), F.col("h")).otherwise(F.col("v")) / F.col("n_lines")
    return s.select(
        *keys, "n_lines", "vertical", F.when(F.abs(turn) < 3, 0).otherwise(turn.cast("int")).alias("angle"), font.alias("font_size"), vx.alias("vec_x"), vy.alias("vec_y"), F.sqrt(vx * vx + vy * vy).alias("norm")
    )


def line_distance_order(lines: DataFrame, w: int, *keys: str) -> DataFrame:
    """Adds ``position`` of a line in its block by distance from the upper left corner, or the upper right one for vertical text."""
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    distance = F.when(F.col("vertical"), F.lit(w) - cx).otherwise(cy)
    return lines.withColumn("position", F.row_number().over(W.partitionBy(*keys).orderBy(distance, "line_no")))


def grid_order(blocks: DataFrame, w: int, h: int) -> DataFrame:
    """Adds ``position``: the cell of a 4 x 3 grid (rows first) dominates, then 1.2 dx + dy inside the cell.

    x is mirrored on pages whose blocks are Japanese by more than half; a landscape page is two
    half pages, the leading one first.
    """
    page = W.partitionBy("page_id")
    mirror = 2 * F.count(F.when(F.col("lang") == "ja", 1)).over(page) > F.count("*").over(page)
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    halves = 2 if w > h else 1
    x = F.when(mirror, F.lit(w) - cx).otherwise(cx)
    half = F.least(F.floor(x / F.lit(w / halves)), F.lit(halves - 1))
    x = x - half * F.lit(w / halves)
    cw, ch = w / halves / 3, h / 4
    col, row = F.least(F.floor(x / F.lit(cw)), F.lit(2)), F.least(F.floor(cy / F.lit(ch)), F.lit(3))
    cell = half * 12 + row * 3 + col
    inside = 1.2 * (x - col * F.lit(cw)) + (cy - row * F.lit(ch))
    ranked = blocks.withColumn("_cell", cell).withColumn("_inside", inside)
    order = W.partitionBy("page_id").orderBy("_cell", "_inside", "idx")
    return ranked.withColumn("position", F.row_number().over(order)).drop("_cell", "_inside")


def top_confidence(dets: DataFrame, k: int) -> DataFrame:
    """The k detections of highest confidence on each page, ties by idx."""
    ranked = dets.withColumn("_k", F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("conf"), "idx")))
    return ranked.filter(F.col("_k") <= k).drop("_k")


def suppress_overlaps(dets: DataFrame, conf: float = 0.4, iou: float = 0.35, most: int = 300, before: int = 30_000) -> DataFrame:
    """Greedy non-maximum suppression per page and class, by confidence (ties by idx): among the ``before`` best of a page, the ``most`` best that stay.

    One exchange by page.
    """

    def over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        common = P.common_area(a, b)
        return common > iou * (P.area(a) + P.area(b) - common)

    def kernel(c: P.Columns, group: np.ndarray) -> P.Columns:
        best = np.lexsort((c["idx"], -c["conf"], group))
        rows = best[P.places(group[best]) <= before]
        c, group = P.taken(c, rows), group[rows]
        _, of_class = np.unique(np.stack((group, c["cls"]), 1), axis=0, return_inverse=True)
        kept = P.suppressed(c, of_class.ravel(), np.arange(len(rows)), over)
        kept = np.sort(kept)  # by page and confidence again
        kept = kept[P.places(group[kept]) <= most]
        return P.taken(c, kept)

    good = dets.filter(F.col("conf") > conf)
    kept = P.map_pages(good, ["page_id"], kernel, ", ".join(f"{n} {t}" for n, t in dets.dtypes))
    return kept.withColumn("conf", F.round("conf", 3))


def class_scores(raw: DataFrame, conf: float = 0.4) -> DataFrame:
    """Raw detections (page_id, idx, cx, cy, bw, bh, objectness, scores) to (page_id, idx, x1, y1, x2, y2, conf, cls).

    Objectness must be over ``conf``; conf is objectness times the best class's score and must be over it, too.
    Coordinates stay real numbers; ``scaled_back`` truncates them.
    """
    best = F.array_max("scores")
    x = (F.col("cx") - F.col("bw") / 2, F.col("cy") - F.col("bh") / 2, F.col("cx") + F.col("bw") / 2, F.col("cy") + F.col("bh") / 2)
    rows = raw.filter(F.col("objectness") > conf).select(
        "page_id", "idx", *(c.alias(n) for c, n in zip(x, COLS)), (F.col("objectness") * best).alias("conf"), (F.array_position("scores", best) - 1).cast("int").alias("cls")
    )
    return rows.filter(F.col("conf") > conf)


def scaled_back(dets: DataFrame, x_ratio: Column, y_ratio: Column) -> DataFrame:
    """Detections at the original image's size, truncated to whole pixels."""
    ratios = (x_ratio, y_ratio, x_ratio, y_ratio)
    return dets.withColumns({n: (F.col(n) * r).cast("int") for n, r in zip(COLS, ratios)})


def mark_ignored(truth: DataFrame, dets: DataFrame, share: float = 0.5) -> DataFrame:
    """Adds ``ignore`` to detections: over ``share`` of their area lies in one ground truth that is marked ``ignore``."""

    def kernel(det: P.Columns, group: np.ndarray, region: P.Columns, of: np.ndarray) -> P.Columns:
        box, other = P.boxes_of(det)[0], P.boxes_of(region)[0]
        return det | {"ignore": _largest_common(box, group, other, of) > share * P.area(box)}

    schema = ", ".join([*(f"{n} {t}" for n, t in dets.dtypes), "ignore boolean"])
    return P.map_sides(dets, placed(truth).filter("ignore").select("page_id", *COLS), ["page_id"], kernel, schema).select(*dets.columns, "ignore")


def cared(rows: DataFrame) -> DataFrame:
    """Rows that aren't marked ``ignore``; all of a table without that column."""
    return rows.filter(~F.coalesce("ignore", F.lit(False))) if "ignore" in rows.columns else rows


def match_detections(truth: DataFrame, dets: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(page_id, gt, det): ground truth in idx order takes the first free detection with IoU over the threshold.

    Rows marked ``ignore`` on either side take no part (see ``mark_ignored``).
    """

    def kernel(a: P.Columns, group: np.ndarray, b: P.Columns, of: np.ndarray) -> P.Columns:
        box, other = P.boxes_of(a)[0], P.boxes_of(b)[0]
        found = [np.zeros((0, 2), np.int64)]
        for i, j in P.pairs_between(group, box, of, other):
            common = P.common_area(box[i], other[j])
            whole = P.area(box[i]) + P.area(other[j]) - common
            hit = (common > 0) & (common / np.maximum(whole, 1) > threshold)
            found.append(np.stack((i[hit], j[hit]), 1))
        i, j = np.concatenate(found).T
        order = np.lexsort((j, b["idx"][j], i, a["idx"][i], group[i]))
        used, taken, keep = set(), set(), []
        for gt, det in zip(i[order].tolist(), j[order].tolist()):
            if gt not in used and det not in taken:
                used.add(gt)
                taken.add(det)
                keep.append((gt, det))
        gt, det = np.array(keep, np.int64).reshape(-1, 2).T
        return {"page_id": a["page_id"][gt], "gt": a["idx"][gt], "det": b["idx"][det]}

    sides = [placed(cared(df)).select("page_id", "idx", *COLS) for df in (truth, dets)]
    return P.map_sides(*sides, ["page_id"], kernel, "page_id long, gt int, det int")


def detection_metrics(truth: DataFrame, dets: DataFrame, matches: DataFrame) -> DataFrame:
    """Per page and over all (page_id null, from sums): precision, recall, their harmonic mean.

    Rows marked ``ignore`` aren't counted. A page without ground truth has recall 1, and precision 1
    only without detections; over all, a share of nothing is 0.
    """
    seen = lambda df: F.count(F.when(~F.coalesce("ignore", F.lit(False)), 1)) if "ignore" in df.columns else F.count("*")
    count = lambda df, n: df.groupBy("page_id").agg(seen(df).alias(n))
    names = ("n_gt", "n_det", "hits")
    c = count(truth, "n_gt").join(count(dets, "n_det"), "page_id", "full").join(count(matches, "hits"), "page_id", "left").na.fill(0, list(names))
    total = c.agg(F.lit(None).cast("long").alias("page_id"), *(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in names), F.lit(True).alias("total"))
    every = c.withColumn("total", F.lit(False)).unionByName(total)
    empty = (F.col("n_gt") == 0) & ~F.col("total")
    share = lambda n: F.when(F.col(n) == 0, 0.0).otherwise(F.col("hits") / F.col(n))
    recall = F.when(empty, 1.0).otherwise(share("n_gt"))
    precision = F.when(empty & (F.col("n_det") == 0), 1.0).otherwise(share("n_det"))
    out = every.select("page_id", "hits", precision.alias("precision"), recall.alias("recall"))
    total = F.col("precision") + F.col("recall")
    return out.withColumn("hmean", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


def average_precision(dets: DataFrame, matches: DataFrame, truth: DataFrame) -> DataFrame:
    """(page_id, ap): precision at every hit in order of confidence, summed over the number of ground truths; ``ignore`` rows don't count."""
    dets, truth = cared(dets), cared(truth)
    hit = dets.select("page_id", F.col("idx").alias("det"), "conf").join(matches.select("page_id", "det", F.lit(1).alias("hit")), ["page_id", "det"], "left")
    run = W.partitionBy("page_id").orderBy(F.desc("conf"), "det")
    p = F.sum(F.coalesce("hit", F.lit(0))).over(run) / F.row_number().over(run)
    sums = hit.withColumn("p", F.when(F.col("hit") == 1, p).otherwise(0.0)).groupBy("page_id").agg(F.sum("p").alias("s"))
    n = truth.groupBy("page_id").agg(F.count("*").alias("n"))
    return n.join(sums, "page_id", "left").select("page_id", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("ap"))
