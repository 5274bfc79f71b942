"""Queries on lines, blocks and detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lines as L
from ..operators import quads as Q
from .analytics import rounded
from .registry import Views, query

D = "fx_detections"
CUT = "CAST(greatest(least(l.x2,d.x2)-greatest(l.x1,d.x1),0) AS BIGINT)*greatest(least(l.y2,d.y2)-greatest(l.y1,d.y1),0)"


def block_lines(v: Views) -> DataFrame:
    """Lines with the language of their block."""
    return v("fx_lines").join(v(D).select("page_id", F.col("idx").alias("block_idx"), F.col("lang_raw").alias("lang")), ["page_id", "block_idx"])


@query(f"""WITH s AS (SELECT l.page_id, l.block_idx, l.line_no, d.idx, {CUT}/CAST(greatest((l.x2-l.x1)*(l.y2-l.y1),1) AS DOUBLE) s FROM fx_lines l JOIN fx_detections d USING (page_id)),
  b AS (SELECT page_id, block_idx, line_no, first(idx ORDER BY s DESC, idx) AS block FROM s WHERE s > CAST(0.4 AS DOUBLE) GROUP BY ALL) SELECT l.page_id, l.block_idx, l.line_no, b.block FROM fx_lines l LEFT JOIN b USING (page_id, block_idx, line_no)""", D, "fx_lines")
def j2_assign_lines(v: Views) -> DataFrame:
    return L.assign_lines(v("fx_lines"), v(D)).select("page_id", "block_idx", "line_no", "block")


def predicted_components(v: Views) -> DataFrame:
    return v("fx_predictions").select("page_id", F.col("idx").alias("k"), *L.COLS, ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"))


@query(f"""WITH c AS (SELECT page_id, idx AS k, x1, y1, x2, y2, (x2-x1)*(y2-y1) AS area FROM fx_predictions), l AS (SELECT * FROM c WHERE area > 50),
  b AS (SELECT l.page_id, l.k, max({CUT}) m FROM l JOIN fx_detections d USING (page_id) GROUP BY ALL)
  SELECT l.page_id, l.k FROM l LEFT JOIN b USING (page_id, k) WHERE coalesce(m,0) < CAST(0.5 AS DOUBLE)*area""", D, "fx_predictions")
def j3_uncovered_components(v: Views) -> DataFrame:
    """Against every block of the page."""
    return L.uncovered_components(predicted_components(v), v(D)).select("page_id", "k")


@query("""WITH s AS (SELECT l.page_id, l.block_idx, sum(l.y2-l.y1)::DOUBLE v, sum(l.x2-l.x1)::DOUBLE h, count(*) n, max(lang_raw) lang FROM fx_lines l JOIN fx_detections d ON d.page_id=l.page_id AND d.idx=l.block_idx GROUP BY ALL), t AS (SELECT *, CASE WHEN lang='ja' THEN v>h ELSE v>2*h END AS vertical FROM s)
  SELECT page_id, block_idx, n AS n_lines, vertical, 0 AS angle, round(CASE WHEN vertical THEN h ELSE v END/n,6) font_size, CASE WHEN vertical THEN 0 ELSE h END::DOUBLE vec_x, CASE WHEN vertical THEN v ELSE 0 END::DOUBLE vec_y, CASE WHEN vertical THEN v ELSE h END AS norm FROM t""", D, "fx_lines")
def h5_examine_blocks(v: Views) -> DataFrame:
    return rounded(L.examine_blocks(block_lines(v), "page_id", "block_idx"))


@query("""SELECT page_id, block_idx, line_no, row_number() OVER (PARTITION BY page_id, block_idx ORDER BY CASE WHEN page_id % 2 = 0 THEN 560-(x1+x2)/2.0 ELSE (y1+y2)/2.0 END, line_no) AS position FROM fx_lines""", "fx_lines")
def o7_line_distance_order(v: Views) -> DataFrame:
    rows = v("fx_lines").withColumn("vertical", F.col("page_id") % 2 == 0)
    return L.line_distance_order(rows, 560, "page_id", "block_idx").select("page_id", "block_idx", "line_no", "position")


@query("""WITH m AS (SELECT *, 2*count(*) FILTER (lang_raw='ja') OVER (PARTITION BY page_id) > count(*) OVER (PARTITION BY page_id) AS mir FROM fx_detections), c AS (SELECT page_id, idx, CASE WHEN mir THEN 560-(x1+x2)/2.0 ELSE (x1+x2)/2.0 END::DOUBLE cx, ((y1+y2)/2.0)::DOUBLE cy FROM m),
  g AS (SELECT *, least(floor(cx/(CAST(560 AS DOUBLE)/3)),2) col, least(floor(cy/CAST(190 AS DOUBLE)),3) r FROM c)
  SELECT page_id, idx, row_number() OVER (PARTITION BY page_id ORDER BY r*3+col, CAST(1.2 AS DOUBLE)*(cx-col*(CAST(560 AS DOUBLE)/3))+(cy-r*190), idx) AS position FROM g""", D)
def o3_grid_order(v: Views) -> DataFrame:
    return L.grid_order(v(D).withColumn("lang", F.col("lang_raw")), 560, 760).select("page_id", "idx", "position")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY conf DESC, idx) k FROM fx_predictions) SELECT page_id, idx, conf FROM r WHERE k <= 2", "fx_predictions")
def o8_top_confidence(v: Views) -> DataFrame:
    return L.top_confidence(v("fx_predictions"), 2).select("page_id", "idx", "conf")


@query("""WITH RECURSIVE lists AS (SELECT page_id, cls, list(struct_pack(idx := idx, x1 := x1, y1 := y1, x2 := x2, y2 := y2, conf := conf) ORDER BY conf DESC, idx) l FROM fx_predictions WHERE conf > CAST(0.4 AS DOUBLE) GROUP BY ALL),
  go AS (SELECT page_id, cls, l AS rest, CAST(NULL AS STRUCT(idx INT, x1 INT, y1 INT, x2 INT, y2 INT, conf DOUBLE)) AS kept FROM lists UNION ALL
    SELECT page_id, cls, list_filter(rest[2:], lambda e: CAST(greatest(least(e.x2,rest[1].x2)-greatest(e.x1,rest[1].x1),0)*greatest(least(e.y2,rest[1].y2)-greatest(e.y1,rest[1].y1),0) AS DOUBLE) <= CAST(0.35 AS DOUBLE)*((e.x2-e.x1)*(e.y2-e.y1)+(rest[1].x2-rest[1].x1)*(rest[1].y2-rest[1].y1)-greatest(least(e.x2,rest[1].x2)-greatest(e.x1,rest[1].x1),0)*greatest(least(e.y2,rest[1].y2)-greatest(e.y1,rest[1].y1),0))), rest[1] FROM go WHERE len(rest) > 0)
  SELECT page_id, cls, kept.idx AS idx, round(kept.conf,3) AS conf FROM go WHERE kept IS NOT NULL""", "fx_predictions")
def h4_suppress_overlaps(v: Views) -> DataFrame:
    return L.suppress_overlaps(v("fx_predictions")).select("page_id", "cls", "idx", "conf")


REAL_IOU = "greatest(least(e.x2,rest[1].x2)-greatest(e.x1,rest[1].x1),0)*greatest(least(e.y2,rest[1].y2)-greatest(e.y1,rest[1].y1),0)"
REAL_BOX = "idx INT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, conf DOUBLE"


@query(f"""WITH RECURSIVE scored AS (SELECT page_id, idx, cx-bw/2 AS x1, cy-bh/2 AS y1, cx+bw/2 AS x2, cy+bh/2 AS y2, objectness*greatest(s0,s1) AS conf, CASE WHEN s0 >= s1 THEN 0 ELSE 1 END AS cls FROM fx_raw_detections WHERE objectness > CAST(0.4 AS DOUBLE)),
  lists AS (SELECT page_id, cls, list(struct_pack(idx := idx, x1 := x1, y1 := y1, x2 := x2, y2 := y2, conf := conf) ORDER BY conf DESC, idx) l FROM scored WHERE conf > CAST(0.4 AS DOUBLE) GROUP BY ALL),
  go AS (SELECT page_id, cls, l AS rest, CAST(NULL AS STRUCT({REAL_BOX})) AS kept FROM lists UNION ALL
    SELECT page_id, cls, list_filter(rest[2:], lambda e: {REAL_IOU} <= CAST(0.35 AS DOUBLE)*((e.x2-e.x1)*(e.y2-e.y1)+(rest[1].x2-rest[1].x1)*(rest[1].y2-rest[1].y1)-{REAL_IOU})), rest[1] FROM go WHERE len(rest) > 0)
  SELECT page_id, cls, kept.idx AS idx, round(kept.conf,3) AS conf, CAST(trunc(kept.x1*CAST(1.25 AS DOUBLE)) AS INT) AS x1, CAST(trunc(kept.y1*CAST(0.8 AS DOUBLE)) AS INT) AS y1,
    CAST(trunc(kept.x2*CAST(1.25 AS DOUBLE)) AS INT) AS x2, CAST(trunc(kept.y2*CAST(0.8 AS DOUBLE)) AS INT) AS y2 FROM go WHERE kept IS NOT NULL""", "fx_raw_detections")
def h4_detection_chain(v: Views) -> DataFrame:
    """Raw detections to those of a page: scores, suppression in real coordinates, then the original image's size."""
    raw = v("fx_raw_detections").withColumn("scores", F.array("s0", "s1"))
    kept = L.suppress_overlaps(L.class_scores(raw))
    return L.scaled_back(kept, F.lit(1.25), F.lit(0.8)).select("page_id", "cls", "idx", "conf", *L.COLS)


PAIRED = """p AS (SELECT t.page_id, t.idx gt, l.idx det, CAST(greatest(least(l.x2,t.x2)-greatest(l.x1,t.x1),0) AS BIGINT)*greatest(least(l.y2,t.y2)-greatest(l.y1,t.y1),0) i, (t.x2-t.x1)*(t.y2-t.y1)+(l.x2-l.x1)*(l.y2-l.y1) u FROM fx_detections t JOIN fx_predictions l USING (page_id)), ok AS (SELECT page_id, gt, det FROM p WHERE i/CAST(u-i AS DOUBLE) > CAST(0.5 AS DOUBLE)),
  lists AS (SELECT page_id, list(struct_pack(gt := gt, det := det) ORDER BY gt, det) l FROM ok GROUP BY 1),
  go AS (SELECT page_id, l AS rest, CAST(NULL AS STRUCT(gt INT, det INT)) AS made FROM lists UNION ALL SELECT page_id, list_filter(rest[2:], lambda e: e.gt <> rest[1].gt AND e.det <> rest[1].det), rest[1] FROM go WHERE len(rest) > 0),
  matched AS (SELECT page_id, made.gt AS gt, made.det AS det FROM go WHERE made IS NOT NULL)"""


@query(f"WITH RECURSIVE {PAIRED} SELECT page_id, gt, det FROM matched", D, "fx_predictions")
def j10_match_detections(v: Views) -> DataFrame:
    return L.match_detections(v(D), v("fx_predictions"))


@query(f"""WITH RECURSIVE {PAIRED}, g AS (SELECT page_id, count(*) n_gt FROM fx_detections GROUP BY 1), d AS (SELECT page_id, count(*) n_det FROM fx_predictions GROUP BY 1), m AS (SELECT page_id, count(*) hits FROM matched GROUP BY 1),
  c AS (SELECT page_id, coalesce(n_gt,0) n_gt, coalesce(n_det,0) n_det, coalesce(hits,0) hits FROM g FULL JOIN d USING (page_id) LEFT JOIN m USING (page_id)), e AS (SELECT * FROM c UNION ALL SELECT NULL, sum(n_gt), sum(n_det), sum(hits) FROM c),
  r AS (SELECT page_id, CAST(hits AS BIGINT) hits, CASE WHEN n_det=0 THEN 0 ELSE hits/CAST(n_det AS DOUBLE) END::DOUBLE p, hits/CAST(n_gt AS DOUBLE) r FROM e)
  SELECT page_id, hits, round(p,6) AS precision, round(r,6) AS recall, round(CASE WHEN p+r>0 THEN 2*p*r/(p+r) ELSE 0 END,6) AS hmean FROM r""", D, "fx_predictions")
def a21_detection_metrics(v: Views) -> DataFrame:
    truth, dets = v(D), v("fx_predictions")
    return rounded(L.detection_metrics(truth, dets, L.match_detections(truth, dets)))


@query(f"""WITH RECURSIVE {PAIRED}, h AS (SELECT d.page_id, d.idx, d.conf, CASE WHEN m.det IS NULL THEN 0 ELSE 1 END hit FROM fx_predictions d LEFT JOIN matched m ON m.page_id=d.page_id AND m.det=d.idx),
  r AS (SELECT page_id, hit, sum(hit) OVER w / CAST(row_number() OVER w AS DOUBLE) p FROM h WINDOW w AS (PARTITION BY page_id ORDER BY conf DESC, idx)), s AS (SELECT page_id, sum(CASE WHEN hit=1 THEN p ELSE 0 END) s FROM r GROUP BY 1), n AS (SELECT page_id, count(*) n FROM fx_detections GROUP BY 1)
  SELECT page_id, round(coalesce(s,0)/n,6) AS ap FROM n LEFT JOIN s USING (page_id)""", D, "fx_predictions")
def a22_average_precision(v: Views) -> DataFrame:
    truth, dets = v(D), v("fx_predictions")
    return rounded(L.average_precision(dets, L.match_detections(truth, dets), truth))


IGNORED = PAIRED.replace("FROM fx_detections t JOIN fx_predictions l USING (page_id))", "FROM fx_detections t JOIN care l USING (page_id) WHERE t.partkey % 6 <> 0)")
CARE = f"""care AS (SELECT l.* FROM fx_predictions l WHERE NOT EXISTS (SELECT 1 FROM fx_detections d WHERE d.page_id = l.page_id AND d.partkey % 6 = 0 AND {CUT} > CAST(0.5 AS DOUBLE)*(l.x2-l.x1)*(l.y2-l.y1)))"""


def with_ignored(v: Views) -> tuple[DataFrame, DataFrame]:
    """One region in six doesn't count, nor do detections over it."""
    truth = v(D).withColumn("ignore", F.col("partkey") % 6 == 0)
    return truth, L.mark_ignored(truth, v("fx_predictions"))


@query(f"WITH RECURSIVE {CARE}, {IGNORED} SELECT page_id, gt, det FROM matched", D, "fx_predictions")
def j10_match_with_ignored(v: Views) -> DataFrame:
    return L.match_detections(*with_ignored(v))


@query(f"""WITH RECURSIVE {CARE}, {IGNORED}, g AS (SELECT page_id, count(*) FILTER (partkey % 6 <> 0) n_gt FROM fx_detections GROUP BY 1), d AS (SELECT page_id, count(c.idx) n_det FROM fx_predictions p LEFT JOIN care c USING (page_id, idx) GROUP BY 1), m AS (SELECT page_id, count(*) hits FROM matched GROUP BY 1),
  c AS (SELECT page_id, coalesce(n_gt,0) n_gt, coalesce(n_det,0) n_det, coalesce(hits,0) hits FROM g FULL JOIN d USING (page_id) LEFT JOIN m USING (page_id)), e AS (SELECT *, FALSE AS total FROM c UNION ALL SELECT NULL, sum(n_gt), sum(n_det), sum(hits), TRUE FROM c),
  r AS (SELECT page_id, CAST(hits AS BIGINT) hits, CASE WHEN n_gt=0 AND n_det=0 AND NOT total THEN 1 WHEN n_det=0 THEN 0 ELSE hits/CAST(n_det AS DOUBLE) END::DOUBLE p, CASE WHEN n_gt=0 AND NOT total THEN 1 WHEN n_gt=0 THEN 0 ELSE hits/CAST(n_gt AS DOUBLE) END::DOUBLE r FROM e)
  SELECT page_id, hits, round(p,6) AS precision, round(r,6) AS recall, round(CASE WHEN p+r>0 THEN 2*p*r/(p+r) ELSE 0 END,6) AS hmean FROM r""", D, "fx_predictions")
def a21_metrics_with_ignored(v: Views) -> DataFrame:
    truth, dets = with_ignored(v)
    return rounded(L.detection_metrics(truth, dets, L.match_detections(truth, dets)))


def loose_lines(v: Views) -> DataFrame:
    return v("fx_lines", by_page=True).select("page_id", (F.col("block_idx") * 10 + F.col("line_no")).alias("line_no"), *L.COLS)


@query()
def h6_merge_scattered_lines(v: Views) -> DataFrame:
    """Upright lines, each with the block it comes to."""
    return rounded(Q.merge_scattered_quads(Q.from_rectangles(loose_lines(v)), 560).select("page_id", "line_no", "vertical", "block", "font_size", "angle"))


@query()
def h7_split_blocks(v: Views) -> DataFrame:
    lines = Q.from_rectangles(block_lines(v))
    shape = Q.quad_shapes(lines, "page_id", "block_idx")
    return Q.split_quads(Q.with_distance(lines.join(shape, ["page_id", "block_idx"]), 560))


@query()
def h9_group_blocks(v: Views) -> DataFrame:
    """Upright lines; detected boxes moved off the true ones, and none for some: their lines stay unassigned."""
    blocks = v("fx_predictions").join(v(D).select("page_id", "idx", F.col("lang_raw").alias("lang")), ["page_id", "idx"])
    return rounded(Q.group_quads(Q.from_rectangles(loose_lines(v)), blocks, 560, 760).drop("lines"))
