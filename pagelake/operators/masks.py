"""How much of each box a page's text mask covers, by summed-area tables.

A mask is a row (page_id, h, w, data): grey values, one byte a pixel. It may be smaller
than its page: boxes are then scaled to it, outwards to whole pixels. The table of a
page is built once; each box costs four reads, however large it is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import pages as P


#: Places of the summed-area tables that are held at once.
PLACES = 1 << 21


def summed_area(mask: np.ndarray) -> np.ndarray:
    """(h + 1, w + 1): the sum of all values above and left of each corner; masks (n, h, w) give a table each."""
    table = np.zeros((*mask.shape[:-2], mask.shape[-2] + 1, mask.shape[-1] + 1), np.int64)
    np.cumsum(np.cumsum(mask, -2, dtype=np.int64), -1, out=table[..., 1:, 1:])
    return table


def box_sums(table: np.ndarray, box: np.ndarray, w: int, h: int, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the mask's values in each half-open box (n, 4) of a page of w x h, and the number of mask pixels it takes. Of several tables, ``of`` has the one of each box."""
    rows, columns = table.shape[-2] - 1, table.shape[-1] - 1
    x1, x2 = (np.clip(v, 0, columns) for v in (box[:, 0] * columns // w, -(-box[:, 2] * columns // w)))
    y1, y2 = (np.clip(v, 0, rows) for v in (box[:, 1] * rows // h, -(-box[:, 3] * rows // h)))
    x2, y2 = np.maximum(x1, x2), np.maximum(y1, y2)
    at = (lambda y, x: table[y, x]) if of is None else (lambda y, x: table[of, y, x])
    return at(y2, x2) - at(y1, x2) - at(y2, x1) + at(y1, x1), (x2 - x1) * (y2 - y1)


def enough_mask(masks: list[np.ndarray | None], group: np.ndarray, box: np.ndarray, w: int, h: int, share: float) -> np.ndarray:
    """Whether the mask of a box's page covers at least ``share`` of it. Boxes off the mask and pages without one pass. Masks of one size are summed together."""
    out = np.ones(len(group), bool)
    order = np.argsort(group, kind="stable")
    pages, first = np.unique(group[order], return_index=True)
    ends = np.append(first[1:], len(group))
    sizes: dict[tuple[int, int], list[int]] = {}
    for k, g in enumerate(pages.tolist()):
        if masks[g] is not None:
            sizes.setdefault(masks[g].shape, []).append(k)
    for shape, held in sizes.items():
        step = max(1, PLACES // ((shape[0] + 1) * (shape[1] + 1)))
        for at in range(0, len(held), step):
            part = held[at : at + step]
            tables = summed_area(np.stack([masks[pages[k]] for k in part]))
            rows = np.concatenate([order[first[k] : ends[k]] for k in part])
            of = np.repeat(np.arange(len(part)), ends[part] - first[part])
            sums, pixels = box_sums(tables, box[rows], w, h, of)
            out[rows] = (pixels == 0) | (sums / 255 >= share * pixels)
    return out


def masks_of(column: pa.Array) -> list[np.ndarray | None]:
    """The masks (h, w, data) of a batch's pages; null where a page has none."""
    return [None if m is None else np.frombuffer(m["data"], np.uint8).reshape(m["h"], m["w"]) for m in column.to_pylist()]


def mask_shares(masks: DataFrame, boxes: DataFrame, w: int, h: int) -> DataFrame:
    """(page_id, idx, covered, pixels): the sum of mask values in each box over 255, and its mask pixels; boxes of pages without a mask are left out.

    Boxes move once, gathered by page; masks are joined to them.
    """
    packed = boxes.groupBy("page_id").agg(F.collect_list(F.struct("idx", *G.Box._fields)).alias("rows_"))
    joined = packed.join(masks.select("page_id", F.struct("h", "w", "data").alias("mask_")), "page_id")

    def body(batch: pa.RecordBatch) -> P.Columns:
        c, group = P.unpacked(batch, ["page_id"], "rows_", ["idx", *G.Box._fields])
        box, known = P.boxes_of(c)
        sums, pixels = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        for g, mask in enumerate(masks_of(batch.column("mask_"))):
            rows = np.flatnonzero((group == g) & known)
            sums[rows], pixels[rows] = box_sums(summed_area(mask), box[rows].astype(np.int64), w, h)
        return c | {"covered": sums / 255, "pixels": pixels}

    return P.mapped(joined, f"page_id long, idx {dict(boxes.dtypes)['idx']}, covered double, pixels long", body)
