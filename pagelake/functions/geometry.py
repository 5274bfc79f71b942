"""Geometry of axis-parallel boxes: right and bottom are coordinates, not sizes.

A box is four integer columns; ``Box`` names them. All functions return columns
and give null for null coordinates.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


def box(prefix: str = "", suffix: str = "") -> Box:
    """The box of columns like ``x1`` with something before or behind their names."""
    return Box(*(F.col(f"{prefix}{n}{suffix}") for n in Box._fields))


def _big(c: Column) -> Column:
    return c.cast("long")


def area(b: Box) -> Column:
    return _big(b.x2 - b.x1) * _big(b.y2 - b.y1)


def center(b: Box) -> tuple[Column, Column]:
    """Midpoint, rounded down."""
    return F.floor((b.x1 + b.x2) / 2).cast("int"), F.floor((b.y1 + b.y2) / 2).cast("int")


def xywh(b: Box) -> tuple[Column, Column, Column, Column]:
    return b.x1, b.y1, b.x2 - b.x1, b.y2 - b.y1


def contains_point(b: Box, x: Column, y: Column) -> Column:
    """Edges belong to the box."""
    return (b.x1 <= x) & (x <= b.x2) & (b.y1 <= y) & (y <= b.y2)


def union(a: Box, b: Box) -> Box:
    return Box(F.least(a.x1, b.x1), F.least(a.y1, b.y1), F.greatest(a.x2, b.x2), F.greatest(a.y2, b.y2))


def overlap_area(a: Box, b: Box) -> Column:
    """Common area, 0 where the boxes are apart."""
    zero = F.lit(0)
    w = F.greatest(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), zero)
    h = F.greatest(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1), zero)
    return _big(w) * _big(h)


def overlap_pct(a: Box, b: Box) -> Column:
    """Common area in percent of the smaller box; an area of 0 counts as 1."""
    least = F.least(area(a), area(b))
    return 100 * overlap_area(a, b) / F.when(least == 0, F.lit(1)).otherwise(least)


def overlaps(a: Box, b: Box, threshold: float) -> Column:
    return overlap_pct(a, b) > threshold


def centers_overlap(a: Box, b: Box) -> Column:
    """The center of either box lies in the other."""
    return contains_point(a, *center(b)) | contains_point(b, *center(a))


def pad(b: Box, n: Column | int, w: Column | int, h: Column | int) -> Box:
    """Grown by n on all sides, within a canvas."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    n, w, h, zero = as_col(n), as_col(w), as_col(h), F.lit(0)
    return Box(F.greatest(b.x1 - n, zero), F.greatest(b.y1 - n, zero), F.least(b.x2 + n, w), F.least(b.y2 + n, h))


def right_pad(b: Box, n: int, w: Column | int) -> Box:
    return Box(b.x1, b.y1, F.least(b.x2 + n, w if isinstance(w, Column) else F.lit(w)), b.y2)


def scale(b: Box, factor: Column) -> Box:
    """Each coordinate times a factor, fractions cut off."""
    return Box(*((c * factor).cast("int") for c in b))


def translate(b: Box, dx: Column | int, dy: Column | int) -> Box:
    return Box(b.x1 + dx, b.y1 + dy, b.x2 + dx, b.y2 + dy)


def iou(a: Box, b: Box) -> Column:
    """Common area over united area; null where both are empty."""
    both = overlap_area(a, b)
    whole = area(a) + area(b) - both
    return F.when(whole > 0, both / whole)


def intersection_area(a: Box, b: Box) -> Column:
    """Common area, -1 where the boxes don't meet."""
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.when((w > 0) & (h > 0), _big(w) * _big(h)).otherwise(F.lit(-1))


def xywh_to_xyxy(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    """From center and size."""
    return Box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def xyxy_to_yolo(b: Box, w: Column, h: Column) -> tuple[Column, Column, Column, Column]:
    """Center and size as shares of the image."""
    return (b.x1 + b.x2) / 2 / w, (b.y1 + b.y2) / 2 / h, (b.x2 - b.x1) / w, (b.y2 - b.y1) / h


def yolo_to_xyxy(cx: Column, cy: Column, bw: Column, bh: Column, w: Column, h: Column) -> Box:
    return Box(*(F.bround(c, 0).cast("int") for c in xywh_to_xyxy(cx * w, cy * h, bw * w, bh * h)))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def polygon(b: Box) -> Column:
    """Corners from the upper left one, clockwise."""
    return F.array(point(b.x1, b.y1), point(b.x2, b.y1), point(b.x2, b.y2), point(b.x1, b.y2))


def rotate_points(points: Column, cx: Column, cy: Column, degrees: Column, whole: bool = True) -> Column:
    """Points turned about a center; with ``whole`` fractions are cut off."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    end = (lambda v: v.cast("int")) if whole else (lambda v: v)
    return F.transform(
        points, lambda p: point(end(cx + (p["x"] - cx) * c - (p["y"] - cy) * s), end(cy + (p["x"] - cx) * s + (p["y"] - cy) * c))
    )


def expand_window(b: Box, w: Column, h: Column, ratio: float) -> Box:
    """Padded by round((0.25 longer + 0.75 shorter side) / ratio), within the last pixel of the image; ratio < 0 shrinks."""
    bw, bh = b.x2 - b.x1, b.y2 - b.y1
    n = F.bround((F.greatest(bw, bh) * F.lit(0.25) + F.least(bw, bh) * F.lit(0.75)) / F.lit(float(ratio)), 0).cast("int")
    zero = F.lit(0)
    return Box(F.greatest(b.x1 - n, zero), F.greatest(b.y1 - n, zero), F.least(b.x2 + n, w - 1), F.least(b.y2 + n, h - 1))


def fit_size(w: Column, h: Column, lower: int, upper: int) -> tuple[Column, Column, Column]:
    """Down-scaling of an image (new width, new height, scale) by its height.

    None up to ``upper``. With lower >= upper exactly ``lower``, scaled as for ``upper``. Else the
    largest 1/n whose height is in the range, else the largest height that 4 divides there, else ``upper``.
    """
    if lower <= 0 or upper <= 0:
        return w, h, F.lit(1.0)
    small = h <= upper
    if lower >= upper:
        share = F.lit(float(upper)) / h
        return F.when(small, w).otherwise(F.bround(w * share, 0)).cast("int"), F.when(small, h).otherwise(F.lit(lower)), F.when(small, F.lit(1.0)).otherwise(share)
    n = F.ceil(h / F.lit(float(upper)))
    four = upper // 4 * 4
    target = four if four >= lower else upper
    by_n = n <= h / F.lit(float(lower))
    share = F.when(small, F.lit(1.0)).when(by_n, F.lit(1.0) / n).otherwise(F.lit(float(target)) / h)
    new_h = F.when(small, h).when(by_n, F.bround(h * share, 0)).otherwise(F.lit(target))
    return F.bround(w * share, 0).cast("int"), new_h.cast("int"), share


def letterbox_geometry(w: Column, h: Column, size: int) -> tuple[Column, Column, Column, Column, Column]:
    """(ratio, unpadded width, unpadded height, padding on the right, padding below) for a square of ``size``."""
    r = F.least(F.lit(float(size)) / h, F.lit(float(size)) / w)
    nw, nh = F.bround(w * r, 0).cast("int"), F.bround(h * r, 0).cast("int")
    return r, nw, nh, F.lit(size) - nw, F.lit(size) - nh


def polygon_bbox(points: Column) -> Box:
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return Box(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y))


def polygon_area(points: Column) -> Column:
    """Half the absolute sum of cross products of neighbouring points."""
    after = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    cross = F.zip_with(points, after, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0).cast("double"), lambda a, v: a + v)) / 2


def line_vectors(p: list[tuple[Column, Column]]) -> tuple[tuple[Column, Column], tuple[Column, Column]]:
    """Vectors between opposite mid-edges of a quadrilateral: down and to the right."""
    mid = lambda a, b: ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2)
    top, right, bottom, left = mid(p[0], p[1]), mid(p[1], p[2]), mid(p[2], p[3]), mid(p[3], p[0])
    return (bottom[0] - top[0], bottom[1] - top[1]), (right[0] - left[0], right[1] - left[1])


def line_aspect_ratio(p: list[tuple[Column, Column]]) -> Column:
    """Length of the vector down over that to the right; null for a flat line."""
    v, h = line_vectors(p)
    length = lambda a: F.sqrt(a[0] * a[0] + a[1] * a[1])
    return F.when(length(h) > 0, length(v) / length(h))


def normalize_corners(b: Box) -> Box:
    return Box(F.least(b.x1, b.x2), F.least(b.y1, b.y2), F.greatest(b.x1, b.x2), F.greatest(b.y1, b.y2))
