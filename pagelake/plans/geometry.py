"""Queries of the column functions: geometry and rules on single rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import rules as R
from .registry import Views, query

D = "fx_detections"
PAIRS = "pairs AS (SELECT a.page_id, a.idx, a.x1 ax1, a.y1 ay1, a.x2 ax2, a.y2 ay2, b.x1 bx1, b.y1 by1, b.x2 bx2, b.y2 by2 FROM fx_detections a JOIN fx_detections b ON a.page_id = b.page_id AND b.idx = a.idx + 1)"


def pairs(v: Views) -> tuple[DataFrame, G.Box, G.Box]:
    """Each region and the next of its page."""
    d = v(D)
    side = lambda p, shift: d.select("page_id", (F.col("idx") - shift).alias("idx"), *(F.col(c).alias(f"{p}{c}") for c in G.Box._fields))
    return side("a", 0).join(side("b", 1), ["page_id", "idx"]), G.box("a"), G.box("b")


def named(b: G.Box, *names: str) -> list:
    return [c.alias(n) for c, n in zip(b, names or G.Box._fields)]


@query("SELECT page_id, idx, CAST(x2-x1 AS BIGINT)*(y2-y1) AS area, CAST(floor((x1+x2)/2) AS INT) AS cx, CAST(floor((y1+y2)/2) AS INT) AS cy, x2-x1 AS w, y2-y1 AS h FROM fx_detections", D)
def g1_box_measures(v: Views) -> DataFrame:
    b = G.box()
    cx, cy = G.center(b)
    _, _, w, h = G.xywh(b)
    return v(D).select("page_id", "idx", G.area(b).alias("area"), cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"))


@query("SELECT page_id, idx, x1 <= 200 AND 200 <= x2 AND y1 <= 300 AND 300 <= y2 AS inside FROM fx_detections", D)
def g2_contains_point(v: Views) -> DataFrame:
    return v(D).select("page_id", "idx", G.contains_point(G.box(), F.lit(200), F.lit(300)).alias("inside"))


@query(f"WITH {PAIRS} SELECT page_id, idx, least(ax1,bx1) x1, least(ay1,by1) y1, greatest(ax2,bx2) x2, greatest(ay2,by2) y2 FROM pairs", D)
def g3_box_union(v: Views) -> DataFrame:
    d, a, b = pairs(v)
    return d.select("page_id", "idx", *named(G.union(a, b)))


INTER = "(CAST(greatest(least(ax2,bx2)-greatest(ax1,bx1),0) AS BIGINT) * greatest(least(ay2,by2)-greatest(ay1,by1),0))"
AREA_A, AREA_B = "(CAST(ax2-ax1 AS BIGINT)*(ay2-ay1))", "(CAST(bx2-bx1 AS BIGINT)*(by2-by1))"


@query(f"WITH {PAIRS}, m AS (SELECT page_id, idx, CAST(100*{INTER} AS DOUBLE) / CAST(greatest(least({AREA_A},{AREA_B}),1) AS DOUBLE) AS p FROM pairs) SELECT page_id, idx, round(p, 6) AS pct, p > 20 AS overlaps FROM m", D)
def g4_overlap_pct(v: Views) -> DataFrame:
    d, a, b = pairs(v)
    return d.select("page_id", "idx", F.round(G.overlap_pct(a, b), 6).alias("pct"), G.overlaps(a, b, 20).alias("overlaps"))


CENTERS = "((ax1 <= floor((bx1+bx2)/2) AND floor((bx1+bx2)/2) <= ax2 AND ay1 <= floor((by1+by2)/2) AND floor((by1+by2)/2) <= ay2) OR (bx1 <= floor((ax1+ax2)/2) AND floor((ax1+ax2)/2) <= bx2 AND by1 <= floor((ay1+ay2)/2) AND floor((ay1+ay2)/2) <= by2))"


@query(f"WITH {PAIRS} SELECT page_id, idx, {CENTERS} AS near FROM pairs", D)
def g5_centers_overlap(v: Views) -> DataFrame:
    d, a, b = pairs(v)
    return d.select("page_id", "idx", G.centers_overlap(a, b).alias("near"))


@query("SELECT page_id, idx, greatest(x1-5,0) x1, greatest(y1-5,0) y1, least(x2+5,560) x2, least(y2+5,760) y2, least(x2+8,560) rx2 FROM fx_detections", D)
def g6_box_pad(v: Views) -> DataFrame:
    return v(D).select("page_id", "idx", *named(G.pad(G.box(), 5, 560, 760)), G.right_pad(G.box(), 8, 560).x2.alias("rx2"))


@query("SELECT d.page_id, d.idx, CAST(trunc(d.x1*p.scale) AS INT) x1, CAST(trunc(d.y1*p.scale) AS INT) y1, CAST(trunc(d.x2*p.scale) AS INT) x2, CAST(trunc(d.y2*p.scale) AS INT) y2 FROM fx_detections d JOIN fx_pages p USING (page_id)", D, "fx_pages")
def g7_box_scale(v: Views) -> DataFrame:
    return v(D).join(v("fx_pages").select("page_id", "scale"), "page_id").select("page_id", "idx", *named(G.scale(G.box(), F.col("scale"))))


@query("SELECT page_id, idx, x1+3 x1, y1-7 y1, x2+3 x2, y2-7 y2 FROM fx_detections", D)
def g8_box_translate(v: Views) -> DataFrame:
    return v(D).select("page_id", "idx", *named(G.translate(G.box(), 3, -7)))


@query(f"WITH {PAIRS} SELECT page_id, idx, CASE WHEN {AREA_A}+{AREA_B}-{INTER} > 0 THEN round(CAST({INTER} AS DOUBLE) / CAST({AREA_A}+{AREA_B}-{INTER} AS DOUBLE), 6) END AS iou FROM pairs", D)
def g9_box_iou(v: Views) -> DataFrame:
    d, a, b = pairs(v)
    return d.select("page_id", "idx", F.round(G.iou(a, b), 6).alias("iou"))


@query(f"WITH {PAIRS} SELECT page_id, idx, CASE WHEN least(ax2,bx2)>greatest(ax1,bx1) AND least(ay2,by2)>greatest(ay1,by1) THEN {INTER} ELSE -1 END AS common FROM pairs", D)
def g10_intersection_area(v: Views) -> DataFrame:
    d, a, b = pairs(v)
    return d.select("page_id", "idx", G.intersection_area(a, b).alias("common"))


@query("""WITH y AS (SELECT page_id, idx, x1, y1, x2, y2, (x1+x2)/CAST(2 AS DOUBLE)/560 cx, (y1+y2)/CAST(2 AS DOUBLE)/760 cy, (x2-x1)/CAST(560 AS DOUBLE) bw, (y2-y1)/CAST(760 AS DOUBLE) bh FROM fx_detections)
  SELECT page_id, idx, round(cx,6) cx, round(cy,6) cy, round(bw,6) bw, round(bh,6) bh, x1 AS bx1, y1 AS by1, x2 AS bx2, y2 AS by2,
  (x1+x2)/CAST(2 AS DOUBLE) - (x2-x1)/CAST(2 AS DOUBLE) AS left_edge, concat(x1,' ',y1,' ',x2,' ',y1,' ',x2,' ',y2,' ',x1,' ',y2) AS corners FROM y""", D)
def g11_conversions(v: Views) -> DataFrame:
    b, w, h = G.box(), F.lit(560), F.lit(760)
    y = G.xyxy_to_yolo(b, w, h)
    back = G.yolo_to_xyxy(*y, w, h)
    corner = G.xywh_to_xyxy((b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2, b.x2 - b.x1, b.y2 - b.y1)
    line = F.concat_ws(" ", F.flatten(F.transform(G.polygon(b), lambda p: F.array(p["x"], p["y"]))).cast("array<string>"))
    cols = [F.round(c, 6).alias(n) for c, n in zip(y, ("cx", "cy", "bw", "bh"))]
    return v(D).select("page_id", "idx", *cols, *named(back, "bx1", "by1", "bx2", "by2"), corner.x1.alias("left_edge"), line.alias("corners"))


@query("SELECT page_id, idx, round(280 + (x1-280)*cos(radians(idx*10)) - (y1-380)*sin(radians(idx*10)), 4) + 0 AS x, round(380 + (x1-280)*sin(radians(idx*10)) + (y1-380)*cos(radians(idx*10)), 4) + 0 AS y FROM fx_detections", D)
def g12_rotate_points(v: Views) -> DataFrame:
    turned = G.rotate_points(G.polygon(G.box()), F.lit(280), F.lit(380), F.col("idx") * 10, whole=False)
    first = F.get(turned, F.lit(0))
    return v(D).select("page_id", "idx", (F.round(first["x"], 4) + 0).alias("x"), (F.round(first["y"], 4) + 0).alias("y"))


@query("""WITH n AS (SELECT *, CAST(round_even((greatest(x2-x1,y2-y1)*CAST(0.25 AS DOUBLE)+least(x2-x1,y2-y1)*CAST(0.75 AS DOUBLE))/CAST(8 AS DOUBLE), 0) AS INT) AS p FROM fx_detections)
  SELECT page_id, idx, greatest(x1-p,0) x1, greatest(y1-p,0) y1, least(x2+p,559) x2, least(y2+p,759) y2 FROM n""", D)
def g13_expand_window(v: Views) -> DataFrame:
    return v(D).select("page_id", "idx", *named(G.expand_window(G.box(), F.lit(560), F.lit(760), 8)))


@query("""WITH s AS (SELECT page_id, w, height*3 AS h FROM fx_pages), m AS (SELECT *, ceil(h/CAST(1000 AS DOUBLE)) n FROM s)
  SELECT page_id, CAST(CASE WHEN h<=1000 THEN w WHEN n<=h/CAST(770 AS DOUBLE) THEN round_even(w*(1/n),0) ELSE round_even(w*(CAST(1000 AS DOUBLE)/h),0) END AS INT) AS new_w,
  CAST(CASE WHEN h<=1000 THEN h WHEN n<=h/CAST(770 AS DOUBLE) THEN round_even(h*(1/n),0) ELSE 1000 END AS INT) AS new_h,
  round(CASE WHEN h<=1000 THEN 1 WHEN n<=h/CAST(770 AS DOUBLE) THEN 1/n ELSE CAST(1000 AS DOUBLE)/h END, 6) AS share FROM m""", "fx_pages")
def g14_fit_size(v: Views) -> DataFrame:
    w, h, share = G.fit_size(F.col("w"), F.col("height") * 3, 770, 1000)
    return v("fx_pages").select("page_id", w.alias("new_w"), h.alias("new_h"), F.round(share, 6).alias("share"))


@query("""WITH r AS (SELECT page_id, w, height, least(CAST(1024 AS DOUBLE)/height, CAST(1024 AS DOUBLE)/w) r FROM fx_pages)
  SELECT page_id, round(r,6) ratio, CAST(round_even(w*r,0) AS INT) nw, CAST(round_even(height*r,0) AS INT) nh, 1024-CAST(round_even(w*r,0) AS INT) AS pad_right, 1024-CAST(round_even(height*r,0) AS INT) AS pad_below FROM r""", "fx_pages")
def g15_letterbox(v: Views) -> DataFrame:
    r, nw, nh, right, below = G.letterbox_geometry(F.col("w"), F.col("height"), 1024)
    return v("fx_pages").select("page_id", F.round(r, 6).alias("ratio"), nw.alias("nw"), nh.alias("nh"), right.alias("pad_right"), below.alias("pad_below"))


@query("SELECT page_id, block_idx, line_no, x1, y1, x2, y2, CAST((x2-x1)*(y2-y1) AS DOUBLE) AS area FROM fx_lines", "fx_lines")
def g16_polygon_measures(v: Views) -> DataFrame:
    p = G.polygon(G.box())
    return v("fx_lines").select("page_id", "block_idx", "line_no", *named(G.polygon_bbox(p)), G.polygon_area(p).alias("area"))


@query("SELECT page_id, block_idx, line_no, CASE WHEN x2 > x1 THEN round(CAST(y2-y1 AS DOUBLE)/CAST(x2-x1 AS DOUBLE), 6) END AS ratio FROM fx_lines", "fx_lines")
def g17_line_aspect_ratio(v: Views) -> DataFrame:
    b = G.box()
    p = [(b.x1, b.y1), (b.x2, b.y1), (b.x2, b.y2), (b.x1, b.y2)]
    return v("fx_lines").select("page_id", "block_idx", "line_no", F.round(G.line_aspect_ratio(p), 6).alias("ratio"))


@query("SELECT page_id, idx, least(x2,suppkey) x1, least(y2,partkey) y1, greatest(x2,suppkey) x2, greatest(y2,partkey) y2 FROM fx_detections", D)
def g18_normalize_corners(v: Views) -> DataFrame:
    swapped = G.Box(F.col("x2"), F.col("y2"), F.col("suppkey"), F.col("partkey"))
    return v(D).select("page_id", "idx", *named(G.normalize_corners(swapped)))


@query("SELECT page_id, idx, CASE lang_raw WHEN 'ja' THEN 'jpn' WHEN 'eng' THEN 'eng' END AS lang, 'eng' AS forced FROM fx_detections", D)
def f1_map_languages(v: Views) -> DataFrame:
    return v(D).select("page_id", "idx", R.map_languages(F.col("lang_raw")).alias("lang"), R.map_languages(F.col("lang_raw"), "eng").alias("forced"))


@query("SELECT page_id, idx, lang_raw FROM fx_detections WHERE CAST(x2-x1 AS BIGINT)*(y2-y1) >= 400 AND (lang_raw <> 'unknown' OR CAST(x2-x1 AS BIGINT)*(y2-y1) >= 40000)", D)
def f2_filter_detections(v: Views) -> DataFrame:
    return v(D).filter(R.keeps_detection(G.area(G.box()), R.map_languages(F.col("lang_raw")))).select("page_id", "idx", "lang_raw")


@query("SELECT page_id, idx, regexp_full_match(text, '[～．ー！？０-９~.!?0-9-]*', 's') AS symbols FROM fx_texts", "fx_texts")
def f3_symbol_only(v: Views) -> DataFrame:
    return v("fx_texts").select("page_id", "idx", R.is_symbol_only(F.col("text")).alias("symbols"))


@query("SELECT page_id, idx FROM fx_detections WHERE CAST(x2-x1 AS BIGINT)*(y2-y1) < 3000", D)
def f4_small_boxes(v: Views) -> DataFrame:
    return v(D).filter(G.area(G.box()) < 3000).select("page_id", "idx")


@query("SELECT page_id, idx, dev FROM fx_fits WHERE NOT failed AND dev > CAST(0.25 AS DOUBLE)", "fx_fits")
def f6_needs_denoise(v: Views) -> DataFrame:
    return v("fx_fits").filter(R.needs_denoise(F.col("failed"), F.col("dev"))).select("page_id", "idx", "dev")


@query("SELECT page_id, idx, CASE WHEN failed THEN 'failed' ELSE 'poor' END AS kind FROM fx_fits WHERE failed OR (dev >= 15 AND thickness IS NOT NULL AND thickness <= 8)", "fx_fits")
def f7_needs_inpaint(v: Views) -> DataFrame:
    kind = R.inpaint_class(F.col("failed"), F.col("dev"), F.col("thickness"))
    return v("fx_fits").select("page_id", "idx", kind.alias("kind")).filter("kind IS NOT NULL")


@query("""WITH g AS (SELECT *, least(5 + CAST(trunc(dev*CAST(0.2 AS DOUBLE)) AS INT), 20) AS growth FROM fx_fits)
  SELECT page_id, idx, growth, greatest(x1-growth-5,0) x1, greatest(y1-growth-5,0) y1, least(x2+growth+5,560) x2, least(y2+growth+5,760) y2 FROM g""", "fx_fits")
def f8_inpaint_growth(v: Views) -> DataFrame:
    grown = R.inpaint_growth(F.col("dev"))
    return v("fx_fits").select("page_id", "idx", grown.alias("growth"), *named(G.pad(G.box(), grown + 5, 560, 760)))


@query("SELECT page_id, idx, CASE WHEN lang_raw='ja' THEN 'special' WHEN lang_raw='eng' THEN 'general' ELSE 'special' END AS engine, CASE WHEN lang_raw='eng' THEN 'general' ELSE 'special' END AS forced FROM fx_detections", D)
def f9_route_engine(v: Views) -> DataFrame:
    lang = R.map_languages(F.col("lang_raw"))
    return v(D).select("page_id", "idx", R.route_engine(lang).alias("engine"), R.route_engine(lang, mode="general").alias("forced"))


@query("SELECT conv_id, turn, trim(translate(text, chr(10)||chr(13)||chr(9)||chr(12), '    '), ' ') AS text FROM conversations")
def f10_clean_ocr_text(v: Views) -> DataFrame:
    return v("conversations").select("conv_id", "turn", R.clean_ocr_text(F.col("text")).alias("text"))


@query("SELECT page_id, idx, CASE WHEN area%3=0 THEN '' WHEN idx%4=0 THEN CAST(area%3 AS STRING) ELSE concat(area%3,'/',idx) END AS b, CASE WHEN area%3=0 THEN '' ELSE CAST(area%3 AS STRING) END AS single FROM fx_ocr_boxes", "fx_ocr_boxes")
def f11_badge(v: Views) -> DataFrame:
    value, total = F.col("area") % 3, F.when(F.col("idx") % 4 != 0, F.col("idx"))
    return v("fx_ocr_boxes").select("page_id", "idx", R.badge(value, total).alias("b"), R.badge(value).alias("single"))


@query("SELECT page_id, concat('/cache/', page_id, '_page', page_id, '_combined_mask.png') AS artifact, CAST(page_id AS STRING) AS uid FROM fx_pages", "fx_pages")
def f12_artifact_path(v: Views) -> DataFrame:
    uid = F.col("page_id").cast("string")
    path = R.artifact_path(F.lit("/cache"), uid, F.concat(F.lit("page"), uid), F.lit("final_mask"))
    return v("fx_pages").select("page_id", path.alias("artifact"), R.id_from_path(path).alias("uid"))


@query("SELECT page_id, concat('/out/page', page_id, '.jpg') AS fixed, regexp_replace(path, '/([^/]*)$', '/cleaned/\\1') AS beside, concat('/out/page', page_id, '.png') AS mask FROM fx_pages", "fx_pages")
def f13_export_path(v: Views) -> DataFrame:
    p = F.col("path")
    return v("fx_pages").select("page_id", R.export_path(p, "/out", ".jpg").alias("fixed"), R.export_path(p, "cleaned").alias("beside"), R.export_path(p, "/out", mask=True).alias("mask"))


CH = "c AS (SELECT a.vec_id, a.y, a.x, a.px r, b.px g, d.px b FROM fx_pixels a JOIN fx_pixels b ON b.vec_id=a.vec_id+1 AND b.y=a.y AND b.x=a.x JOIN fx_pixels d ON d.vec_id=a.vec_id+2 AND d.y=a.y AND d.x=a.x)"


def colours(v: Views) -> DataFrame:
    """Colour pixels: three consecutive images as channels."""
    px = v("fx_pixels")
    shifted = lambda k, n: px.select((F.col("vec_id") - k).alias("vec_id"), "y", "x", F.col("px").alias(n))
    return shifted(0, "r").join(shifted(1, "g"), ["vec_id", "y", "x"]).join(shifted(2, "b"), ["vec_id", "y", "x"])


@query(f"WITH {CH} SELECT vec_id, y, x, CAST((r*299+g*587+b*114)//1000 AS INT) AS grey FROM c", "fx_pixels")
def f14_grayscale(v: Views) -> DataFrame:
    return colours(v).select("vec_id", "y", "x", R.grayscale(F.col("r"), F.col("g"), F.col("b")).alias("grey"))


@query(f"WITH {CH} SELECT vec_id, y, x, CASE WHEN least(r,g,b)>130 THEN 255 ELSE r END AS r, CASE WHEN least(r,g,b)>130 THEN 255 ELSE g END AS g, CASE WHEN least(r,g,b)>130 THEN 255 ELSE b END AS b FROM c", "fx_pixels")
def f15_snap_off_white(v: Views) -> DataFrame:
    r, g, b = R.snap_off_white(F.col("r"), F.col("g"), F.col("b"), 130)
    return colours(v).select("vec_id", "y", "x", r.alias("r"), g.alias("g"), b.alias("b"))
