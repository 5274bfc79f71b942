"""Raster jobs: crops, bitmaps, growth, borders, overlays, strips, components.

Images are rows (image_id, h, w, data): grey values, one byte a pixel, row by row. Colour images
have three bytes a pixel (red, green, blue), overlays four (with alpha).
Kernels are NumPy inside Arrow batches; only statistics leave where pixels aren't asked for.
Rectangles are half open except where bitmaps are drawn, which include right and bottom edges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import pages as P

IMAGE = "image_id long, h int, w int, data binary"


def array_of(row: tuple | pd.Series, channels: int = 1) -> np.ndarray:
    flat = np.frombuffer(bytes(row.data), np.uint8)
    return flat.reshape(row.h, row.w) if channels == 1 else flat.reshape(row.h, row.w, channels)


def images_from_pixels(pixels: DataFrame, key: str = "vec_id", channels: tuple[str, ...] = ("px",)) -> DataFrame:
    """Images of pixel rows (key, y, x, channels)."""
    rows = F.array_sort(F.collect_list(F.struct("y", "x", *channels)))
    packed = pixels.groupBy(key).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), rows.alias("p"))
    hexed = F.array_join(F.transform("p", lambda s: F.concat(*(F.lpad(F.hex(s[c]), 2, "0") for c in channels))), "")
    return packed.select(F.col(key).cast("long").alias("image_id"), "h", "w", F.unhex(hexed).alias("data"))


def pixels_of(images: DataFrame, channels: tuple[str, ...] = ("px",)) -> DataFrame:
    """(image_id, y, x, channels) of images."""
    n = len(channels)
    value = lambda k: F.conv(F.hex(F.substring("data", F.col("i") * n + k, F.lit(1))), 16, 10).cast("int")
    each = images.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1)))
    return each.select(
        "image_id", F.floor(F.col("i") / F.col("w")).cast("int").alias("y"), (F.col("i") % F.col("w")).cast("int").alias("x"), *(value(k).alias(c) for k, c in enumerate(channels, 1))
    )


def _mapped(df: DataFrame, schema: str, rows: Callable[[pd.Series], Iterator[tuple]]) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([out for r in pdf.itertuples() for out in rows(r)], columns=names)

    return df.mapInPandas(run, schema)


#: Columns of a reference box, as ``pair_boxes`` names them.
REFERENCE = tuple(f"ref_{c}" for c in G.Box._fields)


def with_boxes(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Images with the array of their boxes (and reference boxes): boxes are gathered per image, so pixels move once at most."""
    more = [c for c in REFERENCE if c in boxes.columns]
    packed = boxes.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("idx", *G.Box._fields, *more))).alias("boxes"))
    return images.join(packed, "image_id")


def crop_boxes(images: DataFrame, boxes: DataFrame, canvas: tuple[int, int] | None = None, at: tuple[int, int] = (0, 0)) -> DataFrame:
    """(image_id, idx, h, w, data): each box cut out; with ``canvas`` (w, h) pasted into a blank one at an offset."""

    def rows(r: pd.Series) -> Iterator[tuple]:
        image = array_of(r)
        for b in r.boxes:
            part = image[max(b["y1"], 0) : b["y2"], max(b["x1"], 0) : b["x2"]]
            if canvas:
                blank = np.zeros((canvas[1], canvas[0]), np.uint8)
                room = part[: canvas[1] - at[1], : canvas[0] - at[0]]
                blank[at[1] : at[1] + room.shape[0], at[0] : at[0] + room.shape[1]] = room
                part = blank
            yield r.image_id, b["idx"], part.shape[0], part.shape[1], part.tobytes()

    return _mapped(with_boxes(images, boxes), "image_id long, idx int, h int, w int, data binary", rows)


def rasterize_boxes(boxes: DataFrame, w: int, h: int) -> DataFrame:
    """A bitmap (255 inside) of each page's boxes, edges included."""

    def rows(r: pd.Series) -> Iterator[tuple]:
        out = np.zeros((h, w), np.uint8)
        for b in r.boxes:
            out[max(b["y1"], 0) : b["y2"] + 1, max(b["x1"], 0) : b["x2"] + 1] = 255
        yield r.image_id, h, w, out.tobytes()

    packed = boxes.groupBy("image_id").agg(F.collect_list(F.struct(*G.Box._fields)).alias("boxes"))
    return _mapped(packed, IMAGE, rows)


def mask_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bitmaps that are set in both."""
    both = a.join(b.select("image_id", F.col("data").alias("other")), "image_id")

    def rows(r: pd.Series) -> Iterator[tuple]:
        yield r.image_id, r.h, r.w, (((array_of(r) > 0) & (np.frombuffer(bytes(r.other), np.uint8).reshape(r.h, r.w) > 0)) * np.uint8(255)).tobytes()

    return _mapped(both, IMAGE, rows)


def _layers(parts: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Parts of each image as an array in idx order."""
    return parts.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("idx", "x1", "y1", "h", "w", "data", *more))).alias("parts"))


def _paste(out: np.ndarray, part: dict, value: np.ndarray | None = None) -> None:
    """Set pixels of a sub-mask, as they are or as ``value``, at its place; what lies outside is cut off."""
    h, w = out.shape[:2]
    x, y = part["x1"], part["y1"]
    mask = np.frombuffer(bytes(part["data"]), np.uint8).reshape(part["h"], part["w"])[max(-y, 0) : max(h - y, 0), max(-x, 0) : max(w - x, 0)]
    room = out[max(y, 0) : max(y, 0) + mask.shape[0], max(x, 0) : max(x, 0) + mask.shape[1]]
    room[mask > 0] = mask[mask > 0] if value is None else value


def compose_masks(parts: DataFrame, w: int, h: int) -> DataFrame:
    """Sub-masks (image_id, idx, x1, y1, h, w, data) pasted at their places, in idx order; set pixels only."""

    def rows(r: pd.Series) -> Iterator[tuple]:
        out = np.zeros((h, w), np.uint8)
        for part in r.parts:
            _paste(out, part)
        yield r.image_id, h, w, out.tobytes()

    return _mapped(_layers(parts), IMAGE, rows)


def combine_masks(parts: DataFrame, w: int, h: int) -> DataFrame:
    """Chosen masks (image_id, idx, x1, y1, h, w, data, r, g, b) as one overlay: opaque in its colour where a mask is set, later ones over earlier."""

    def rows(r: pd.Series) -> Iterator[tuple]:
        out = np.zeros((h, w, 4), np.uint8)
        for part in r.parts:
            _paste(out, part, np.array([part["r"], part["g"], part["b"], 255], np.uint8))
        yield r.image_id, h, w, out.tobytes()

    return _mapped(_layers(parts, ("r", "g", "b")), IMAGE, rows)


def disc(n: int) -> list[tuple[int, int]]:
    """Offsets of a disc of radius n; up to a diameter of 5 a square without its corners."""
    grid = [(dy, dx) for dy in range(-n, n + 1) for dx in range(-n, n + 1)]
    if 2 * n + 1 <= 5:
        return [(dy, dx) for dy, dx in grid if n == 0 or not (abs(dy) == n and abs(dx) == n)]
    return [(dy, dx) for dy, dx in grid if dy * dy + dx * dx <= n * n]


def dilate(mask: np.ndarray, n: int) -> np.ndarray:
    """Set pixels grow by a disc; beyond the edge the mask goes on as its edge pixels.

    A row of the disc is one run of pixels, so running sums along the mask's rows tell whether any of a run is set:
    a pass for each length of run and a shift for each row, however wide the disc.
    """
    if n <= 0:
        return mask
    h, w = mask.shape
    sums = np.zeros((h + 2 * n, w + 2 * n + 1), np.int32)
    np.cumsum(np.pad(mask, n, mode="edge"), 1, out=sums[:, 1:])
    reach: dict[int, int] = {}
    for dy, dx in disc(n):
        reach[dy] = max(reach.get(dy, 0), dx)
    out = np.zeros_like(mask)
    for r in set(reach.values()):
        wide = sums[:, n + r + 1 : n + r + 1 + w] > sums[:, n - r : n - r + w]
        for dy in (d for d, x in reach.items() if x == r):
            out |= wide[n + dy : n + dy + h]
    return out


def border(mask: np.ndarray) -> np.ndarray:
    """Set pixels with an unset one among their eight neighbours."""
    padded = np.pad(mask, 1, mode="edge")
    h, w = mask.shape
    inner = np.ones_like(mask)
    for dy in (0, 1, 2):
        for dx in (0, 1, 2):
            inner &= padded[dy : dy + h, dx : dx + w]
    return mask & ~inner


def candidates(mask: np.ndarray, first: int, step: int, steps: int, box: np.ndarray | None = None) -> Iterator[tuple[int, int | None, np.ndarray]]:
    """(k, thickness, mask): each grows from the one before; the box mask (thickness None; without ``box`` all set) comes last."""
    grown, before = mask, 0
    for k in range(steps):
        grown = dilate(grown, first + k * step - before)
        before = first + k * step
        yield k, before, grown
    yield steps, None, np.ones_like(mask) if box is None else box


def mask_candidates(masks: DataFrame, first: int = 4, step: int = 2, steps: int = 11) -> DataFrame:
    """(image_id, k, thickness, area, h, w, data) of every candidate of each bitmap."""

    def rows(r: pd.Series) -> Iterator[tuple]:
        for k, thickness, m in candidates(array_of(r) > 0, first, step, steps):
            yield r.image_id, k, thickness, int(m.sum()), r.h, r.w, (m * np.uint8(255)).astype(np.uint8).tobytes()

    return _mapped(masks, "image_id long, k int, thickness double, area long, h int, w int, data binary", rows).withColumn("thickness", F.col("thickness").cast("int"))


def grow_mask(masks: DataFrame, n: int) -> DataFrame:
    def rows(r: pd.Series) -> Iterator[tuple]:
        yield r.image_id, r.h, r.w, (dilate(array_of(r) > 0, n) * np.uint8(255)).astype(np.uint8).tobytes()

    return _mapped(masks, IMAGE, rows)


def border_pixels(images: DataFrame, masks: DataFrame) -> DataFrame:
    """(image_id, y, x, px): image pixels where the mask has a border."""
    both = images.join(masks.select("image_id", F.col("data").alias("mask")), "image_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [pd.DataFrame({"image_id": [], "y": [], "x": [], "px": []}, dtype=np.int64)]
            for r in pdf.itertuples():
                ys, xs = np.nonzero(border(np.frombuffer(bytes(r.mask), np.uint8).reshape(r.h, r.w) > 0))
                found.append(pd.DataFrame({"image_id": np.full(len(ys), r.image_id), "y": ys, "x": xs, "px": array_of(r)[ys, xs]}))
            yield pd.concat(found)

    return both.mapInPandas(run, "image_id long, y int, x int, px int")


def weiszfeld(points: np.ndarray, eps: float = 1e-5, most: int = 500) -> np.ndarray:
    """Geometric median: Weiszfeld's iteration from the mean; points at distance 0 are left out of a step."""
    at = points.mean(0)
    for _ in range(most):
        far = np.linalg.norm(points - at, axis=1)
        use = far > 0
        if not use.any():
            break
        new = (points[use] / far[use, None]).sum(0) / (1 / far[use]).sum()
        done = np.linalg.norm(new - at) < eps
        at = new
        if done:
            break
    return at


def border_statistics(px: np.ndarray, off_white: int) -> tuple[float, list[int]]:
    """Deviation and colour of border pixels, grey (one axis) or in colour (two).

    Grey: population deviation and median. Colour: sample deviation of the distances to the mean (0 for one pixel),
    and the colour of more than half of the pixels, else their geometric median. Fractions are cut off; colours above
    ``off_white`` in every channel become white.
    """
    if px.ndim == 1:
        dev, color = float(px.std()), [int(np.median(px))] * 3
    else:
        points = px.astype(float)
        dev = float(np.linalg.norm(points - points.mean(0), axis=1).std(ddof=1)) if len(px) > 1 else 0.0
        kinds, count = np.unique(px, axis=0, return_counts=True)
        most = int(count.argmax())
        color = [int(c) for c in (kinds[most] if 2 * count[most] > len(px) else weiszfeld(points))]
    return dev, [255] * 3 if min(color) > off_white else color


def fit_statistics(
    images: DataFrame, masks: DataFrame, boxes: DataFrame, first: int = 4, step: int = 2, steps: int = 11, color: bool = False, off_white: int = 240
) -> DataFrame:
    """(image_id, idx, k, thickness, dev, r, g, b) of every box and candidate: statistics alone, no pixels.

    Boxes may carry reference boxes (``ref_x1`` ..): masks then grow beyond their box up to the reference box.
    With ``color`` images have three bytes a pixel. A box whose mask is empty, or one of whose candidates has no
    border, gives no rows.
    """
    both = with_boxes(images.join(masks.select("image_id", F.col("data").alias("mask")), "image_id"), boxes)
    around = REFERENCE[0] in boxes.columns

    def rows(r: pd.Series) -> Iterator[tuple]:
        image, mask = array_of(r, 3 if color else 1), np.frombuffer(bytes(r.mask), np.uint8).reshape(r.h, r.w) > 0
        for b in r.boxes:
            x1, y1, x2, y2 = max(b["x1"], 0), max(b["y1"], 0), max(min(b["x2"], r.w), 0), max(min(b["y2"], r.h), 0)
            u1, v1, u2, v2 = (max(b[c], 0) for c in REFERENCE) if around else (x1, y1, x2, y2)
            inside = np.zeros(mask.shape, bool)
            inside[y1:y2, x1:x2] = True
            cut = np.s_[v1:v2, u1:u2]
            part = (mask & inside)[cut]
            if not part.any():
                continue
            found = []
            for k, thickness, m in candidates(part, first, step, steps, inside[cut]):
                px = image[cut][border(np.pad(m, 1))[1:-1, 1:-1]]
                if not len(px):
                    found = []
                    break
                dev, rgb = border_statistics(px, off_white)
                found.append((r.image_id, b["idx"], k, thickness, dev, *rgb))
            yield from found

    schema = "image_id long, idx int, k int, thickness double, dev double, r int, g int, b int"
    return _mapped(both, schema, rows).withColumn("thickness", F.col("thickness").cast("int"))


def pick_best_candidate(cands: DataFrame, *keys: str, improvement: float = 0.1, max_dev: float = 15.0, fast: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(keys, k, thickness, dev, failed, carried columns): a fold over candidates in order of k; the best is replaced only by dev <= best * (1 - improvement).

    With ``fast`` the box mask (null thickness) comes first and a deviation of 0 ends the search. ``carry`` names further
    columns of the best candidate, such as its colour.
    """
    order = F.when(F.col("thickness").isNull(), -1).otherwise(F.col("k")) if fast else F.col("k")
    item = F.struct(order.alias("o"), *(F.col(c).alias(c) for c in ("k", "thickness", "dev", *carry)))
    packed = cands.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("c"))

    def step(best: Column, c: Column) -> Column:
        stop = best["dev"] == 0 if fast else F.lit(False)
        return F.when(~stop & (c["dev"] <= best["dev"] * F.lit(1 - improvement)), c).otherwise(best)

    best = F.aggregate(F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))), F.get("c", F.lit(0)), step)
    return packed.withColumn("best_", best).select(*keys, "best_.k", "best_.thickness", "best_.dev", (F.col("best_.dev") > max_dev).alias("failed"), *(f"best_.{c}" for c in carry))


def fit_masks(images: DataFrame, masks: DataFrame, boxes: DataFrame, color: bool = False, off_white: int = 240, **options: float) -> DataFrame:
    """The best candidate of every box with the colour to fill it, from border statistics."""
    return pick_best_candidate(fit_statistics(images, masks, boxes, color=color, off_white=off_white), "image_id", "idx", carry=("r", "g", "b"), **options)


def apply_overlay(images: DataFrame, overlays: DataFrame, keep_text: bool = False) -> DataFrame:
    """Images with overlays (image_id, oh, ow, value, alpha) pasted where alpha is set, after nearest-neighbour resizing.

    With ``keep_text`` all but the masked pixels become 0.
    """
    both = images.join(overlays, "image_id")

    def rows(r: pd.Series) -> Iterator[tuple]:
        image = array_of(r).copy()
        shape = (r.oh, r.ow)
        ys, xs = np.arange(r.h) * r.oh // r.h, np.arange(r.w) * r.ow // r.w
        alpha = np.frombuffer(bytes(r.alpha), np.uint8).reshape(shape)[np.ix_(ys, xs)] > 0
        value = np.frombuffer(bytes(r.value), np.uint8).reshape(shape)[np.ix_(ys, xs)]
        image = np.where(alpha, image, 0) if keep_text else np.where(alpha, value, image)
        yield r.image_id, r.h, r.w, image.astype(np.uint8).tobytes()

    return _mapped(both, IMAGE, rows)


def row_change_profile(pixels: DataFrame, key: str = "vec_id", wrap: bool = False) -> DataFrame:
    """(key, y, score): sum of squared differences of neighbouring pixels of a row; with ``wrap`` each square is taken mod 256."""
    gap = F.col("px") - F.lag("px").over(W.partitionBy(key, "y").orderBy("x"))
    square = F.pmod(gap * gap, F.lit(256)) if wrap else gap * gap
    return pixels.withColumn("s", square).groupBy(key, "y").agg(F.coalesce(F.sum("s"), F.lit(0)).alias("score"))


def quiet_runs(profile: DataFrame, ranges: DataFrame, key: str = "vec_id") -> DataFrame:
    """(key, cut, split_y): in each search range (key, cut, low, high) the middle of the longest run of rows with a score up to the range's 10th percentile."""
    inside = profile.join(ranges, key).filter("y >= low AND y < high")
    group = [key, "cut"]
    limit = inside.groupBy(*group).agg(F.expr("percentile(score, 0.1)").alias("limit"))
    quiet = inside.join(limit, group).filter("score <= limit")
    island = quiet.withColumn("g", F.col("y") - F.row_number().over(W.partitionBy(*group).orderBy("y")))
    runs = island.groupBy(*group, "g").agg(F.min("y").alias("start"), F.count("*").alias("n"))
    return runs.groupBy(*group).agg(F.max_by(F.col("start") + F.floor(F.col("n") / 2), F.struct("n", -F.col("start"))).cast("int").alias("split_y"))


def plan_splits(images: DataFrame, profile: DataFrame, key: str = "image_id", height: int = 2000, tolerance: int = 500, aspect: float = 0.33) -> DataFrame:
    """(key, cut, split_y) of strips: higher than ``height`` and w / h at most ``aspect``.

    ceil(h / height) - 1 equal cuts, each moved within the tolerance (half a part at most) to the middle of a quiet run.
    """
    strips = images.filter((F.col("h") > height) & (F.col("w") / F.col("h") <= aspect))
    n = F.ceil(F.col("h") / F.lit(float(height))).cast("int")
    part = F.col("h") / n
    reach = F.least(F.lit(float(tolerance)), part / 2)
    cuts = strips.select(key, "h", F.explode(F.sequence(F.lit(1), n - 1)).alias("cut"), part.alias("part"), reach.alias("reach"))
    at = F.col("cut") * F.col("part")
    ranges = cuts.select(key, "cut", F.floor(at - F.col("reach")).cast("int").alias("low"), F.floor(at + F.col("reach")).cast("int").alias("high"))
    return quiet_runs(profile, ranges, key)


def split_image(images: DataFrame, cuts: DataFrame) -> DataFrame:
    """(image_id, segment_no, h, w, data): parts between the cuts (image_id, split_y)."""
    packed = cuts.groupBy("image_id").agg(F.sort_array(F.collect_list("split_y")).alias("cuts"))

    def rows(r: pd.Series) -> Iterator[tuple]:
        image, edges = array_of(r), [0, *(int(c) for c in (r.cuts if r.cuts is not None else [])), r.h]
        for k, (a, b) in enumerate(zip(edges, edges[1:]), 1):
            yield r.image_id, k, b - a, r.w, image[a:b].tobytes()

    return _mapped(images.join(packed, "image_id", "left"), "image_id long, segment_no int, h int, w int, data binary", rows)


def stitch_images(segments: DataFrame) -> DataFrame:
    """Images of segments stacked in order, left aligned, blank on the right."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [array_of(r) for r in pdf.sort_values("segment_no").itertuples()]
        w = max(p.shape[1] for p in parts)
        image = np.vstack([np.pad(p, ((0, 0), (0, w - p.shape[1]))) for p in parts])
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], "h": [image.shape[0]], "w": [w], "data": [image.tobytes()]})

    return segments.groupBy("image_id").applyInPandas(run, IMAGE)


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the runs of set pixels, in reading order; ends are exclusive."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    return row, start, np.nonzero(edge == -1)[1]


def touching_runs(row: np.ndarray, start: np.ndarray, end: np.ndarray, below: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (run, run of ``below`` in the next row) that touch, corners included; runs of a row are sorted and apart."""
    wide = int(max(end.max(initial=0), below[2].max(initial=0))) + 2
    first = np.searchsorted(below[0] * wide + below[2], (row + 1) * wide + start)
    n = np.maximum(np.searchsorted(below[0] * wide + below[1], (row + 1) * wide + end, "right") - first, 0)
    a = np.repeat(np.arange(len(row)), n)
    return a, np.repeat(first, n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number linked with each of 0 .. n - 1 by the links (a, b): roots hang below smaller ones, paths are halved."""
    root = np.arange(n)
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]
    return root


def pieces_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-connected components by reading order of their first pixel: (n, 7) area, x1, y1, x2, y2, first row and column;
    and (m, 3) start, end, component of the runs in the first and in the last row."""
    row, start, end = runs_of(mask)
    kinds, of = np.unique(roots_of(len(row), *touching_runs(row, start, end, (row, start, end))), return_inverse=True)
    out = np.zeros((len(kinds), 7), np.int64)
    out[:, 0] = np.bincount(of, end - start, len(kinds))
    out[:, 1:3] = max(mask.shape)
    for k, v, best in ((1, start, np.minimum), (2, row, np.minimum), (3, end, np.maximum), (4, row + 1, np.maximum)):
        best.at(out[:, k], of, v)
    out[:, 5], out[:, 6] = row[kinds], start[kinds]
    sides = [np.stack((start, end, of), 1)[row == y] for y in (0, mask.shape[0] - 1)]
    return out, *sides


COMPONENTS = "image_id long, component int, area long, x1 int, y1 int, x2 int, y2 int"


def mask_components(masks: DataFrame, min_area: int = 1) -> DataFrame:
    """(image_id, component, area, x1, y1, x2, y2) of 8-connected set pixels, numbered in reading order of their first pixel."""

    def rows(r: pd.Series) -> Iterator[tuple]:
        found = pieces_of(array_of(r) > 0)[0]
        for k, c in enumerate(found[found[:, 0] >= min_area].tolist(), 1):
            yield r.image_id, k, *c[:5]

    return _mapped(masks, COMPONENTS, rows)


def joined_pieces(heights: list[int], pieces: list[np.ndarray], tops: list[np.ndarray], bottoms: list[np.ndarray]) -> np.ndarray:
    """Components (n, 7) of a strip from those of its parts, top to bottom: pieces whose runs touch across a seam are one."""
    down = np.concatenate(([0], np.cumsum(heights)))[:-1]
    number = np.concatenate(([0], np.cumsum([len(p) for p in pieces])))
    every = np.concatenate([p + np.array([0, 0, d, 0, d, d, 0]) for p, d in zip(pieces, down.tolist())])
    links = []
    for k in range(len(pieces) - 1):
        upper, lower = bottoms[k], tops[k + 1]
        a, b = touching_runs(np.zeros(len(upper), np.int64), upper[:, 0], upper[:, 1], (np.ones(len(lower), np.int64), lower[:, 0], lower[:, 1]))
        links.append(np.stack((upper[a, 2] + number[k], lower[b, 2] + number[k + 1]), 1))
    pairs = np.concatenate(links) if links else np.zeros((0, 2), np.int64)
    kinds, of = np.unique(roots_of(len(every), pairs[:, 0], pairs[:, 1]), return_inverse=True)
    out = every[kinds]
    out[:, 0] = np.bincount(of, every[:, 0], len(kinds))
    for k, best in ((1, np.minimum), (2, np.minimum), (3, np.maximum), (4, np.maximum)):
        best.at(out[:, k], of, every[:, k])
    first = np.lexsort((every[:, 6], every[:, 5], of))
    first = first[np.concatenate(([True], of[first][1:] != of[first][:-1]))] if len(first) else first
    out[:, 5:] = every[first, 5:]
    return out[np.lexsort((out[:, 6], out[:, 5]))]


def strip_components(parts: DataFrame, min_area: int = 1) -> DataFrame:
    """``mask_components`` of whole strips from their parts (image_id, segment_no, h, w, data), as ``split_image`` gives them.

    Every part is labelled in a task of its own; components of parts and the runs at their seams are joined by image,
    pixels stay where they are. Parts of no height link nothing and are left out.
    """

    def label(r: pd.Series) -> Iterator[tuple]:
        yield r.image_id, r.segment_no, r.h, *(v.ravel().tolist() for v in pieces_of(array_of(r) > 0))

    lists = ("pieces", "top", "bottom")
    labelled = _mapped(parts.filter("h > 0"), "image_id long, segment_no int, h int, " + ", ".join(f"{n} array<long>" for n in lists), label)
    packed = labelled.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("segment_no", "h", *lists))).alias("parts"))

    def join(r: pd.Series) -> Iterator[tuple]:
        arrays = [[np.array(p[n], np.int64).reshape(-1, 7 if n == "pieces" else 3) for p in r.parts] for n in lists]
        found = joined_pieces([p["h"] for p in r.parts], *arrays)
        for k, c in enumerate(found[found[:, 0] >= min_area].tolist(), 1):
            yield r.image_id, k, *c[:5]

    return _mapped(packed, COMPONENTS, join)


def weighted_medians(points: np.ndarray, weight: np.ndarray, group: np.ndarray, eps: float = 1e-5, most: int = 500) -> np.ndarray:
    """``weiszfeld`` for many groups at once: points of a group stand together, each as often as its weight says.

    A step moves every group that hasn't come to rest; sums over groups are segment sums.
    """
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sums = lambda v, at: np.add.reduceat(v, at, axis=0)
    at = sums(points * weight[:, None], starts) / sums(weight, starts)[:, None]
    sizes, moving = np.diff(np.append(starts, len(points))), np.arange(len(starts))
    rows = np.arange(len(points))
    for _ in range(most):
        if not len(moving):
            break
        n = sizes[moving]
        edges = np.cumsum(n) - n
        far = np.linalg.norm(points[rows] - np.repeat(at[moving], n, axis=0), axis=1)
        pull = np.divide(weight[rows], far, out=np.zeros_like(far), where=far > 0)
        total = sums(pull, edges)
        some = total > 0
        new = np.where(some[:, None], sums(points[rows] * pull[:, None], edges) / np.where(some, total, 1)[:, None], at[moving])
        go = np.linalg.norm(new - at[moving], axis=1) >= eps
        at[moving] = new
        rows, moving = rows[np.repeat(go, n)], moving[go]
    return at


def geometric_median(points: DataFrame, key: str, channels: tuple[str, ...] = ("r", "g", "b"), eps: float = 1e-5, most: int = 500) -> DataFrame:
    """(key, channels as double): see ``weiszfeld``. Equal points are counted before they move; a group's distinct ones are one row."""
    counted = points.groupBy(key, *channels).agg(F.count("*").cast("double").alias("weight_"))

    def kernel(c: P.Columns, group: np.ndarray) -> P.Columns:
        at = weighted_medians(np.stack([c[n].astype(float) for n in channels], 1), c["weight_"], group, eps, most)
        return {key: c[key][P.places(group) == 1]} | {n: at[:, k] for k, n in enumerate(channels)}

    return P.map_pages(counted, [key], kernel, f"{key} {dict(points.dtypes)[key]}, " + ", ".join(f"{c} double" for c in channels))
