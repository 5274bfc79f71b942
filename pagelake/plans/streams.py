"""Queries of side-file round trips and of engines with stand-ins, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sources as S
from ..functions import engines as E
from ..functions.rules import map_languages
from ..operators import regions as O
from ..operators.quads import group_quads
from ..operators.rasters import crop_boxes
from .quads import flat_lines
from .rasters import images, small_boxes
from .registry import Views, query


@query("SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY idx) - 1 AS INT) AS idx, x1, y1, x2, y2, dev, failed, thickness FROM fx_fits", "fx_fits")
def s6_mask_stats_round_trip(v: Views) -> DataFrame:
    return S.parse_mask_stats(S.mask_stats_json(v("fx_fits")))


@query("SELECT page_id, count(*) AS n, sum(x1) AS sum_x1, count(CASE WHEN lang_raw <> 'unknown' THEN 1 END) AS known FROM fx_detections GROUP BY 1", "fx_detections")
def s5_page_boxes_round_trip(v: Views) -> DataFrame:
    packed = O.pack_boxes(v("fx_detections").withColumn("lang", map_languages(F.col("lang_raw"))))
    none = F.array().cast("array<array<int>>")
    docs = packed.select(
        F.col("page_id").cast("string").alias("original_path"), F.lit("i").alias("image_path"), F.lit("m").alias("mask_path"), F.lit(1.0).alias("scale"), "box_language", "boxes",
        none.alias("extended_boxes"), none.alias("merged_extended_boxes"), none.alias("reference_boxes"),
    )
    text = docs.select(F.to_json(F.struct(*S.PAGE.names), {"ignoreNullFields": "false"}).alias("value"))
    p = S.parse_page_boxes(text)
    xs = F.aggregate("boxes", F.lit(0).cast("long"), lambda a, b: a + F.get(b, F.lit(0)))
    return p.select(F.col("original_path").cast("long").alias("page_id"), F.size("boxes").alias("n"), xs.alias("sum_x1"), F.size(F.filter("box_language", lambda x: x.isNotNull())).alias("known"))


@query("WITH b AS (SELECT vec_id, 1 AS idx, vec_id%3 AS x1, vec_id%4 AS y1, vec_id%3+4 AS x2, vec_id%4+3 AS y2 FROM embeddings UNION ALL SELECT vec_id, 2, vec_id%2+2, vec_id%2+3, vec_id%2+6, vec_id%2+6 FROM embeddings) SELECT b.vec_id AS image_id, b.idx, concat(CASE b.idx WHEN 1 THEN 'a' ELSE 'b' END, ' ', sum(px)) AS text FROM b JOIN fx_pixels p ON p.vec_id=b.vec_id AND p.x>=b.x1 AND p.x<b.x2 AND p.y>=b.y1 AND p.y<b.y2 GROUP BY b.vec_id, b.idx", "fx_pixels")
def v1_run_ocr(v: Views) -> DataFrame:
    """Stand-in engines write their name and the sum of the pixels."""
    crops = crop_boxes(images(v), small_boxes(v)).withColumn("engine", F.when(F.col("idx") == 1, "a").otherwise("b"))
    make = lambda name: lambda: lambda data: [f" {name}\n{sum(d)}\t" for d in data]
    return E.run_ocr(crops, {"a": make("a"), "b": make("b")})


@query("SELECT vec_id AS image_id, 0 AS idx, min(x) x1, min(y) y1, max(x)+1 x2, max(y)+1 y2, 'ja' AS language FROM fx_pixels WHERE px >= 150 GROUP BY 1", "fx_pixels")
def v2_run_detector(v: Views) -> DataFrame:
    """A stand-in detector finds the rectangle of bright pixels."""

    def make():
        import numpy as np

        def detect(data: bytes, h: int, w: int) -> list[dict]:
            ys, xs = np.nonzero(np.frombuffer(data, np.uint8).reshape(h, w) >= 150)
            return [{"xyxy": [int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1], "language": "ja"}] if len(ys) else []

        return detect

    return E.run_detector(images(v), make)


def row_lines():
    """A stand-in detector: bright pixels are the mask, each run of them in a row a line, and the rectangle of the upper half's a block."""
    import numpy as np

    def detect(data: bytes, h: int, w: int) -> dict:
        mask = np.where(np.frombuffer(data, np.uint8).reshape(h, w) >= 150, 255, 0).astype(np.uint8)
        lines, blocks = [], []
        for y, row in enumerate(mask > 0):
            edge = np.flatnonzero(np.diff(np.concatenate(([0], row.astype(np.int8), [0]))))
            lines += [[(a, y), (b, y), (b, y + 1), (a, y + 1)] for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]
        ys, xs = np.nonzero(mask[: h // 2])
        if len(ys):
            blocks.append({"xyxy": [xs.min(), ys.min(), xs.max() + 1, ys.max() + 1], "language": "eng"})
        return {"blocks": blocks, "lines": lines, "mask": mask}

    return detect


@query("""WITH b AS (SELECT *, px >= 150 AS lit FROM fx_pixels), r AS (SELECT *, lit AND NOT coalesce(lag(lit) OVER (PARTITION BY vec_id, y ORDER BY x), FALSE) AS starts FROM b)
  SELECT vec_id AS image_id, CAST(sum(CASE WHEN starts THEN 1 ELSE 0 END) AS BIGINT) AS n_lines, count(*) FILTER (lit) AS line_pixels, count(*) FILTER (lit) AS mask_pixels,
    min(x) FILTER (lit AND y < 4) AS x1, min(y) FILTER (lit AND y < 4) AS y1, max(x) FILTER (lit AND y < 4) + 1 AS x2, max(y) FILTER (lit AND y < 4) + 1 AS y2 FROM r GROUP BY 1""", "fx_pixels")
def v2_detect_pages(v: Views) -> DataFrame:
    """Blocks, lines and masks of one detector pass."""
    found = E.detect_pages(images(v), row_lines)
    area = lambda line: (line[4] - line[0]) * (line[5] - line[1])
    total = F.aggregate("lines", F.lit(0.0), lambda s, line: s + area(line)).cast("long")
    lit = F.length(F.regexp_replace(F.hex("mask.data"), "00", "")) / 2
    block = F.get("blocks", F.lit(0))
    return found.select("image_id", F.size("lines").cast("long").alias("n_lines"), total.alias("line_pixels"), lit.cast("long").alias("mask_pixels"), *(block[c].alias(c) for c in ("x1", "y1", "x2", "y2")))


@query()
def v2_detect_and_group(v: Views) -> DataFrame:
    """From images to grouped blocks: detector, then assignment, mask rule, splitting and merging."""
    found = E.detect_pages(images(v), row_lines)
    grouped = group_quads(E.lines_of(found), E.blocks_of(found), 8, 8, E.masks_of(found))
    return flat_lines(grouped)
