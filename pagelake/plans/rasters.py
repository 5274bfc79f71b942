"""Queries of the raster jobs, on 8 x 8 grey images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import rasters as R
from ..sources import image_rasters
from .geometry import colours
from .registry import Views, query

PX = "fx_pixels"


def images(v: Views) -> DataFrame:
    return R.images_from_pixels(v(PX))


def masks(v: Views, limit: int = 128) -> DataFrame:
    return R.images_from_pixels(v(PX).withColumn("px", F.when(F.col("px") >= limit, 255).otherwise(0)))


def small_boxes(v: Views) -> DataFrame:
    """Two boxes in each image."""
    ids = v("embeddings").select(F.col("vec_id").cast("long").alias("image_id"))
    n = F.col("image_id")
    return ids.select("image_id", F.explode(F.array(
        F.struct(F.lit(1).alias("idx"), (n % 3).cast("int").alias("x1"), (n % 4).cast("int").alias("y1"), (n % 3 + 4).cast("int").alias("x2"), (n % 4 + 3).cast("int").alias("y2")),
        F.struct(F.lit(2).alias("idx"), (n % 2 + 2).cast("int").alias("x1"), (n % 2 + 3).cast("int").alias("y1"), (n % 2 + 6).cast("int").alias("x2"), (n % 2 + 6).cast("int").alias("y2")),
    )).alias("b")).select("image_id", "b.*")


BOXES = "b AS (SELECT vec_id, 1 AS idx, vec_id%3 AS x1, vec_id%4 AS y1, vec_id%3+4 AS x2, vec_id%4+3 AS y2 FROM embeddings UNION ALL SELECT vec_id, 2, vec_id%2+2, vec_id%2+3, vec_id%2+6, vec_id%2+6 FROM embeddings)"


@query(f"WITH {BOXES} SELECT p.vec_id AS image_id, b.idx, CAST(p.y-b.y1 AS INT) AS y, CAST(p.x-b.x1 AS INT) AS x, p.px FROM fx_pixels p JOIN b ON b.vec_id=p.vec_id AND p.x>=b.x1 AND p.x<b.x2 AND p.y>=b.y1 AND p.y<b.y2", PX)
def r1_crop_boxes(v: Views) -> DataFrame:
    crops = R.crop_boxes(images(v), small_boxes(v)).withColumn("image_id", F.col("image_id") * 10 + F.col("idx"))
    p = R.pixels_of(crops)
    return p.select(F.floor(F.col("image_id") / 10).alias("image_id"), (F.col("image_id") % 10).cast("int").alias("idx"), "y", "x", "px")


@query(f"WITH {BOXES} SELECT p.vec_id AS image_id, p.y, p.x, CAST(max(CASE WHEN p.x>=b.x1 AND p.x<=b.x2 AND p.y>=b.y1 AND p.y<=b.y2 THEN 255 ELSE 0 END) AS INT) AS px FROM fx_pixels p JOIN b USING (vec_id) GROUP BY ALL", PX)
def r2_rasterize_boxes(v: Views) -> DataFrame:
    return R.pixels_of(R.rasterize_boxes(small_boxes(v), 8, 8))


@query("SELECT vec_id AS image_id, y, x, CASE WHEN px >= 128 AND px < 160 THEN 255 ELSE 0 END AS px FROM fx_pixels", PX)
def r3_mask_intersection(v: Views) -> DataFrame:
    low = R.images_from_pixels(v(PX).withColumn("px", F.when(F.col("px") < 160, 255).otherwise(0)))
    return R.pixels_of(R.mask_intersection(masks(v), low))


def parts(v: Views) -> DataFrame:
    """The bright pixels in the boxes of each image, with colours."""
    n = F.col("image_id") % 200
    cut = R.crop_boxes(masks(v), small_boxes(v)).join(small_boxes(v).select("image_id", "idx", "x1", "y1"), ["image_id", "idx"])
    return cut.withColumns({"r": (F.col("idx") * 50).cast("int"), "g": n.cast("int"), "b": F.lit(7)})


INSIDE = f"{BOXES}, s AS (SELECT p.vec_id, p.y, p.x, max(b.idx) AS idx FROM fx_pixels p JOIN b ON b.vec_id=p.vec_id AND p.x>=b.x1 AND p.x<b.x2 AND p.y>=b.y1 AND p.y<b.y2 WHERE p.px >= 128 GROUP BY ALL)"


@query(f"WITH {INSIDE} SELECT p.vec_id AS image_id, p.y, p.x, CASE WHEN s.idx IS NULL THEN 0 ELSE 255 END AS px FROM fx_pixels p LEFT JOIN s USING (vec_id, y, x)", PX)
def r3_compose_masks(v: Views) -> DataFrame:
    return R.pixels_of(R.compose_masks(parts(v), 8, 8))


@query(f"WITH {INSIDE} SELECT p.vec_id AS image_id, p.y, p.x, CAST(coalesce(s.idx*50,0) AS INT) AS r, CAST(CASE WHEN s.idx IS NULL THEN 0 ELSE p.vec_id % 200 END AS INT) AS g, CASE WHEN s.idx IS NULL THEN 0 ELSE 7 END AS b, CASE WHEN s.idx IS NULL THEN 0 ELSE 255 END AS a FROM fx_pixels p LEFT JOIN s USING (vec_id, y, x)", PX)
def r3_combine_masks(v: Views) -> DataFrame:
    return R.pixels_of(R.combine_masks(parts(v), 8, 8), ("r", "g", "b", "a"))


@query("SELECT concat('img', vec_id) AS image_id, y, x, CAST((299*px + 587*(px*3%256) + 114*(255-px))//1000 AS INT) AS px FROM fx_pixels", PX)
def s3_image_rasters(v: Views) -> DataFrame:
    """Decoded colour images, blue first, as the image source gives them."""
    blue_first = R.images_from_pixels(v(PX).withColumns({"b": 255 - F.col("px"), "g": F.col("px") * 3 % 256}), channels=("b", "g", "px"))
    image = F.struct(F.concat(F.lit("img"), F.col("image_id").cast("string")).alias("origin"), F.col("h").alias("height"), F.col("w").alias("width"), F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), "data")
    return R.pixels_of(image_rasters(blue_first.select(image.alias("image"))))


@query()
def r6_fit_color_masks(v: Views) -> DataFrame:
    """Colour images; masks grow up to two pixels beyond their boxes."""
    colors = R.images_from_pixels(v(PX).withColumns({"g": F.col("px") * 3 % 256, "b": 255 - F.col("px")}), channels=("px", "g", "b"))
    grown = [c.alias(n) for c, n in zip(G.pad(G.box(), F.lit(2), 8, 8), R.REFERENCE)]
    fits = R.fit_masks(colors, masks(v, 150), small_boxes(v).select("*", *grown), color=True, max_dev=60.0)
    return fits.withColumn("dev", F.round("dev", 6))


@query()
def r4_mask_candidates(v: Views) -> DataFrame:
    return R.mask_candidates(masks(v, 160), 1, 1, 3).drop("data")


EDGE = "m AS (SELECT *, px >= 128 AS s FROM fx_pixels), e AS (SELECT a.vec_id, a.y, a.x, a.px FROM m a JOIN m b ON a.vec_id=b.vec_id AND abs(a.y-b.y)<=1 AND abs(a.x-b.x)<=1 WHERE a.s AND NOT b.s GROUP BY ALL)"


@query(f"WITH {EDGE} SELECT vec_id AS image_id, y, x, px FROM e", PX)
def r5_border_pixels(v: Views) -> DataFrame:
    return R.border_pixels(images(v), masks(v))


@query()
def r6_fit_masks(v: Views) -> DataFrame:
    fits = R.fit_masks(images(v), masks(v, 150), small_boxes(v), max_dev=60.0)
    return fits.withColumn("dev", F.round("dev", 6))


@query("SELECT a.vec_id AS image_id, a.y, a.x, CASE WHEN o.px >= 128 THEN 255-o.px ELSE a.px END AS px FROM fx_pixels a JOIN fx_pixels o ON o.vec_id=a.vec_id AND o.y=a.y//2 AND o.x=a.x//2", PX)
def r7_apply_overlay(v: Views) -> DataFrame:
    corner = v(PX).filter("y < 4 AND x < 4")
    value = R.images_from_pixels(corner.withColumn("px", 255 - F.col("px"))).select("image_id", F.col("h").alias("oh"), F.col("w").alias("ow"), F.col("data").alias("value"))
    alpha = R.images_from_pixels(corner.withColumn("px", F.when(F.col("px") >= 128, 255).otherwise(0))).select("image_id", F.col("data").alias("alpha"))
    return R.pixels_of(R.apply_overlay(images(v), value.join(alpha, "image_id")))


PROFILE = "d AS (SELECT vec_id, y, px - lag(px) OVER (PARTITION BY vec_id, y ORDER BY x) AS g FROM fx_pixels), pr AS (SELECT vec_id, y, CAST(sum(g*g) AS BIGINT) AS score FROM d GROUP BY ALL)"


@query(f"WITH {PROFILE} SELECT vec_id, y, score FROM pr", PX)
def r8_row_change_profile(v: Views) -> DataFrame:
    return R.row_change_profile(v(PX))


RUNS = f"""{PROFILE}, r AS (SELECT p.*, c.cut, c.low, c.high FROM pr p, (VALUES (1,1,5),(2,4,8)) AS c(cut,low,high) WHERE p.y>=c.low AND p.y<c.high), l AS (SELECT vec_id, cut, quantile_cont(score, 0.1) lim FROM r GROUP BY ALL),
  q AS (SELECT r.vec_id, r.cut, r.y, r.y - row_number() OVER (PARTITION BY r.vec_id, r.cut ORDER BY r.y) g FROM r JOIN l USING (vec_id, cut) WHERE score <= lim), i AS (SELECT vec_id, cut, g, min(y) s, count(*) n FROM q GROUP BY ALL)"""


@query(f"WITH {RUNS} SELECT vec_id, cut, CAST(first(s + n//2 ORDER BY n DESC, s) AS INT) AS split_y FROM i GROUP BY ALL", PX)
def o5_quiet_runs(v: Views) -> DataFrame:
    ranges = v("embeddings").select("vec_id", F.explode(F.expr("array(struct(1 as cut, 1 as low, 5 as high), struct(2 as cut, 4 as low, 8 as high))")).alias("r")).select("vec_id", "r.*")
    return R.quiet_runs(R.row_change_profile(v(PX)), ranges)


@query(f"WITH {RUNS.replace('(VALUES (1,1,5),(2,4,8))', '(VALUES (1,2,6))')} SELECT vec_id AS image_id, cut, CAST(first(s + n//2 ORDER BY n DESC, s) AS INT) AS split_y FROM i GROUP BY ALL", PX)
def r9_plan_splits(v: Views) -> DataFrame:
    profile = R.row_change_profile(v(PX)).withColumnRenamed("vec_id", "image_id")
    return R.plan_splits(images(v), profile, height=4, tolerance=2, aspect=2.0)


@query("SELECT vec_id AS image_id, CASE WHEN y < 3 THEN 1 WHEN y < 6 THEN 2 ELSE 3 END AS segment_no, CAST(y % 3 AS INT) AS y, x, px FROM fx_pixels", PX)
def r10_split_image(v: Views) -> DataFrame:
    cuts = v("embeddings").select(F.col("vec_id").cast("long").alias("image_id"), F.explode(F.array(F.lit(3), F.lit(6))).alias("split_y"))
    parts = R.split_image(images(v), cuts).withColumn("image_id", F.col("image_id") * 10 + F.col("segment_no"))
    p = R.pixels_of(parts)
    return p.select(F.floor(F.col("image_id") / 10).alias("image_id"), (F.col("image_id") % 10).cast("int").alias("segment_no"), "y", "x", "px")


@query("SELECT vec_id AS image_id, y, x, px FROM fx_pixels", PX)
def r10_stitch_images(v: Views) -> DataFrame:
    cuts = v("embeddings").select(F.col("vec_id").cast("long").alias("image_id"), F.lit(5).alias("split_y"))
    return R.pixels_of(R.stitch_images(R.split_image(images(v), cuts)))


COMPONENTS = """WITH RECURSIVE m AS (SELECT vec_id, y, x, y*8+x AS id FROM fx_pixels WHERE px >= 150), n AS (SELECT a.vec_id, a.id a, b.id b FROM m a JOIN m b ON a.vec_id=b.vec_id AND abs(a.y-b.y)<=1 AND abs(a.x-b.x)<=1),
  go AS (SELECT vec_id, id AS root, id FROM m UNION SELECT go.vec_id, go.root, n.b FROM go JOIN n ON n.vec_id=go.vec_id AND n.a=go.id), c AS (SELECT vec_id, id, min(root) r FROM go GROUP BY ALL)
  SELECT c.vec_id AS image_id, CAST(row_number() OVER (PARTITION BY c.vec_id ORDER BY r) AS INT) AS component, count(*) AS area, CAST(min(m.x) AS INT) x1, CAST(min(m.y) AS INT) y1, CAST(max(m.x)+1 AS INT) x2, CAST(max(m.y)+1 AS INT) y2 FROM c JOIN m ON m.vec_id=c.vec_id AND m.id=c.id GROUP BY c.vec_id, r"""


@query(COMPONENTS, PX)
def r11_mask_components(v: Views) -> DataFrame:
    return R.mask_components(masks(v, 150))


@query(COMPONENTS, PX)
def r11_strip_components(v: Views) -> DataFrame:
    """The same components from images cut into three parts."""
    cuts = v("embeddings").select(F.col("vec_id").cast("long").alias("image_id"), F.explode(F.array(F.lit(3), F.lit(6))).alias("split_y"))
    return R.strip_components(R.split_image(masks(v, 150), cuts))


@query()
def a16_geometric_median(v: Views) -> DataFrame:
    m = R.geometric_median(colours(v), "vec_id")
    return m.select("vec_id", *(F.round(c, 3).alias(c) for c in "rgb"))


@query("""WITH RECURSIVE s AS (SELECT page_id, idx, k, thickness, dev FROM fx_candidates), go AS (SELECT page_id, idx, k, k AS bk, thickness AS bt, dev AS bd FROM s WHERE k=0 UNION ALL
    SELECT go.page_id, go.idx, s.k, CASE WHEN s.dev <= bd*CAST(0.9 AS DOUBLE) THEN s.k ELSE bk END, CASE WHEN s.dev <= bd*CAST(0.9 AS DOUBLE) THEN s.thickness ELSE bt END, CASE WHEN s.dev <= bd*CAST(0.9 AS DOUBLE) THEN s.dev ELSE bd END FROM go JOIN s ON s.page_id=go.page_id AND s.idx=go.idx AND s.k=go.k+1)
  SELECT page_id, idx, bk AS k, bt AS thickness, bd AS dev, bd > 15 AS failed FROM go WHERE k = 11""", "fx_candidates")
def h8_pick_best_candidate(v: Views) -> DataFrame:
    return R.pick_best_candidate(v("fx_candidates"), "page_id", "idx")
