"""Queries on regions of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import rules as R
from ..operators import regions as O
from .geometry import CENTERS, AREA_A, AREA_B, INTER
from .registry import Views, query

D = "fx_detections"
LANG = "CASE lang_raw WHEN 'ja' THEN 'jpn' WHEN 'eng' THEN 'eng' END"
SELF = "p AS (SELECT a.page_id, a.idx i, b.idx j, a.x1 ax1, a.y1 ay1, a.x2 ax2, a.y2 ay2, b.x1 bx1, b.y1 by1, b.x2 bx2, b.y2 by2 FROM fx_detections a JOIN fx_detections b ON a.page_id=b.page_id AND a.idx<b.idx)"


def with_lang(v: Views) -> DataFrame:
    return v(D).withColumn("lang", R.map_languages(F.col("lang_raw")))


@query(f"WITH {SELF} SELECT page_id, i, j FROM p WHERE 100*{INTER} > 20*greatest(least({AREA_A},{AREA_B}),1)", D)
def j1_overlap_pairs(v: Views) -> DataFrame:
    return O.overlap_pairs(v(D))


@query(f"WITH {SELF} SELECT page_id, i, j FROM p WHERE {CENTERS}", D)
def j1_center_pairs(v: Views) -> DataFrame:
    return O.overlap_pairs(v(D), "center")


@query("SELECT DISTINCT page_id, x1 % 20 AS x1, y1 % 20 AS y1, x1 % 20 + 5 AS x2, y1 % 20 + 5 AS y2, min(idx) OVER (PARTITION BY page_id, x1 % 20, y1 % 20) AS idx FROM fx_detections", D)
def u1_distinct_boxes(v: Views) -> DataFrame:
    small = v(D).select("page_id", "idx", (F.col("x1") % 20).alias("x1"), (F.col("y1") % 20).alias("y1"))
    return O.distinct_boxes(small.withColumn("x2", F.col("x1") + 5).withColumn("y2", F.col("y1") + 5))


def greedy_sql(order: str, test: str, rows: str) -> str:
    """One greedy pass as a recursive query: a list of boxes is taken apart from its front."""
    it = "e"
    return f"""WITH RECURSIVE start AS ({rows}), lists AS (SELECT page_id, list(struct_pack(x1 := x1, y1 := y1, x2 := x2, y2 := y2) ORDER BY {order}) AS l FROM start GROUP BY page_id),
    go AS (SELECT page_id, l AS rest, CAST(NULL AS STRUCT(x1 INT, y1 INT, x2 INT, y2 INT)) AS made, 0 AS n FROM lists
      UNION ALL SELECT page_id, list_filter(rest[2:], lambda {it}: NOT ({test})),
        struct_pack(x1 := least(rest[1].x1, list_min(list_transform(list_filter(rest, lambda {it}: {test}), lambda z: z.x1))), y1 := least(rest[1].y1, list_min(list_transform(list_filter(rest, lambda {it}: {test}), lambda z: z.y1))),
        x2 := greatest(rest[1].x2, list_max(list_transform(list_filter(rest, lambda {it}: {test}), lambda z: z.x2))), y2 := greatest(rest[1].y2, list_max(list_transform(list_filter(rest, lambda {it}: {test}), lambda z: z.y2)))), n + 1
      FROM go WHERE len(rest) > 0)
    SELECT page_id, made.x1 AS x1, made.y1 AS y1, made.x2 AS x2, made.y2 AS y2 FROM go WHERE n > 0"""


H_CENTER = "((rest[1].x1 <= floor((e.x1+e.x2)/2) AND floor((e.x1+e.x2)/2) <= rest[1].x2 AND rest[1].y1 <= floor((e.y1+e.y2)/2) AND floor((e.y1+e.y2)/2) <= rest[1].y2) OR (e.x1 <= floor((rest[1].x1+rest[1].x2)/2) AND floor((rest[1].x1+rest[1].x2)/2) <= e.x2 AND e.y1 <= floor((rest[1].y1+rest[1].y2)/2) AND floor((rest[1].y1+rest[1].y2)/2) <= e.y2))"
H_AREA = "(100*CAST(greatest(least(rest[1].x2,e.x2)-greatest(rest[1].x1,e.x1),0) AS BIGINT)*greatest(least(rest[1].y2,e.y2)-greatest(rest[1].y1,e.y1),0) > 20*greatest(least((rest[1].x2-rest[1].x1)*(rest[1].y2-rest[1].y1),(e.x2-e.x1)*(e.y2-e.y1)),1))"


@query(greedy_sql("idx", H_CENTER, "SELECT * FROM fx_detections"), D)
def h1_merge_center_overlaps(v: Views) -> DataFrame:
    return O.merge_center_overlaps(v(D).select("page_id", "idx", *O.COLS)).drop("idx")


@query(greedy_sql("y1, x1, y2, x2", H_AREA, "SELECT DISTINCT page_id, x1, y1, x2, y2 FROM fx_detections"), D)
def h2_merge_overlaps(v: Views) -> DataFrame:
    return O.merge_overlaps(v(D).select("page_id", "idx", *O.COLS)).drop("idx")


@query()
def h3_cluster_boxes(v: Views) -> DataFrame:
    return O.cluster_boxes(v(D))


A1 = f"""c AS (SELECT page_id, {LANG} AS lang, count(*) n, min(idx) f FROM fx_detections GROUP BY ALL), l AS (SELECT page_id, first(lang ORDER BY CASE WHEN lang IS NULL THEN 1 ELSE 0 END, n DESC, f) AS page_lang FROM c GROUP BY page_id)"""


@query(f"WITH {A1} SELECT page_id, page_lang FROM l", D)
def a1_page_language(v: Views) -> DataFrame:
    return O.page_language(with_lang(v))


@query(f"WITH {A1} SELECT d.page_id, idx, row_number() OVER (PARTITION BY d.page_id ORDER BY CASE WHEN page_lang = 'jpn' THEN y1 - CAST(0.4 AS DOUBLE)*x1 ELSE y1 + CAST(0.4 AS DOUBLE)*x1 END, idx) AS position FROM fx_detections d JOIN l USING (page_id)", D)
def o2_reading_order(v: Views) -> DataFrame:
    d = with_lang(v)
    return O.reading_order(d.join(O.page_language(d), "page_id")).select("page_id", "idx", "position")


@query("SELECT page_id, idx, text, row_number() OVER (PARTITION BY page_id ORDER BY idx) AS label FROM fx_texts", "fx_texts")
def o6_label_results(v: Views) -> DataFrame:
    return O.label_results(v("fx_texts"))


def packed_text(packed: DataFrame) -> DataFrame:
    """Arrays of boxes and languages as texts."""
    text = lambda c: F.concat(F.lit("["), F.concat_ws(", ", c), F.lit("]"))
    boxes = F.transform("boxes", lambda b: F.concat_ws(",", b.cast("array<string>")))
    return packed.select("page_id", text(F.transform(boxes, lambda s: F.concat(F.lit("'"), s, F.lit("'")))).alias("boxes"), text(F.transform("box_language", lambda x: F.coalesce(x, F.lit("-")))).alias("langs"))


@query(f"SELECT page_id, CAST(list(x1 || ',' || y1 || ',' || x2 || ',' || y2 ORDER BY idx) AS STRING) AS boxes, CAST(list(coalesce({LANG}, '-') ORDER BY idx) AS STRING) AS langs FROM fx_detections GROUP BY page_id", D)
def a11_pack_boxes(v: Views) -> DataFrame:
    return packed_text(O.pack_boxes(with_lang(v)))


@query("""WITH b AS (SELECT d.*, t.text, CAST(x2-x1 AS BIGINT)*(y2-y1) AS area FROM fx_detections d JOIN fx_texts t USING (page_id, idx)), c AS (SELECT b.*, p.scale, regexp_full_match(text, '[～．ー！？０-９~.!?0-9-]*', 's') AS removed FROM b JOIN fx_pages p USING (page_id))
  SELECT page_id, idx, text, area, removed, CAST(trunc(x1/scale) AS INT) x1, CAST(trunc(y1/scale) AS INT) y1, CAST(trunc(x2/scale) AS INT) x2, CAST(trunc(y2/scale) AS INT) y2 FROM c WHERE area < 3000""", "fx_texts", "fx_pages")
def f5_ocr_filter(v: Views) -> DataFrame:
    boxes = v(D).join(v("fx_pages").select("page_id", "scale"), "page_id")
    return O.apply_ocr_filter(boxes, v("fx_texts"), scale=F.col("scale"))[1]


@query("""WITH b AS (SELECT page_id, idx, greatest(x1,0) x1, greatest(y1,0) y1, least(x2+1,560) x2, least(y2+1,760) y2 FROM fx_detections),
  xs AS (SELECT page_id, v, lead(v) OVER (PARTITION BY page_id ORDER BY v) nv FROM (SELECT page_id, x1 v FROM b UNION SELECT page_id, x2 FROM b)), ys AS (SELECT page_id, v, lead(v) OVER (PARTITION BY page_id ORDER BY v) nv FROM (SELECT page_id, y1 v FROM b UNION SELECT page_id, y2 FROM b)),
  cells AS (SELECT xs.page_id, xs.v x, ys.v y, max((xs.nv-xs.v)*(ys.nv-ys.v)) a FROM xs JOIN ys USING (page_id) JOIN b ON b.page_id = xs.page_id AND b.x1 <= xs.v AND xs.nv <= b.x2 AND b.y1 <= ys.v AND ys.nv <= b.y2 WHERE xs.nv IS NOT NULL AND ys.nv IS NOT NULL GROUP BY ALL)
  SELECT page_id, CAST(sum(a) AS BIGINT) AS covered, CAST(sum(a) AS BIGINT)*1000000//425600 AS share_ppm FROM cells GROUP BY page_id""", D)
def a23_mask_coverage(v: Views) -> DataFrame:
    return O.mask_coverage(v(D), 560, 760).select("page_id", "covered", F.expr("covered * 1000000 div 425600").alias("share_ppm"))


def greedy_parts(name: str, rows: str, order: str, test: str, extra: dict[str, str]) -> str:
    """``greedy_sql`` as parts of a longer query, ending with ``name``; columns ``extra`` (name to type) stay those of a union's first box."""
    fields = {"x1": "INT", "y1": "INT", "x2": "INT", "y2": "INT"} | extra
    whole = ", ".join(f"{f} := {f}" for f in fields)
    far = ", ".join(f"{c} := {pick}(rest[1].{c}, list_{low}(list_transform(list_filter(rest, lambda e: {test}), lambda z: z.{c})))" for c, pick, low in (("x1", "least", "min"), ("y1", "least", "min"), ("x2", "greatest", "max"), ("y2", "greatest", "max")))
    kept = "".join(f", {f} := rest[1].{f}" for f in extra)
    return f"""{name}_lists AS (SELECT page_id, list(struct_pack({whole}) ORDER BY {order}) AS l FROM ({rows}) GROUP BY page_id),
    {name}_go AS (SELECT page_id, l AS rest, CAST(NULL AS STRUCT({", ".join(f"{f} {t}" for f, t in fields.items())})) AS made, 0 AS n FROM {name}_lists
      UNION ALL SELECT page_id, list_filter(rest[2:], lambda e: NOT ({test})), struct_pack({far}{kept}), n + 1 FROM {name}_go WHERE len(rest) > 0),
    {name} AS (SELECT page_id, {", ".join(f"made.{f} AS {f}" for f in fields)} FROM {name}_go WHERE n > 0)"""


PADDED = "greatest(x1-5,0) AS x1, greatest(y1-5,0) AS y1, least(x2+5,560) AS x2, least(y2+5,760) AS y2"
CLEANED = f"""kept AS (SELECT * FROM (SELECT page_id, idx, x1, y1, x2, y2, {LANG} AS lang, CAST(x2-x1 AS BIGINT)*(y2-y1) AS area FROM fx_detections) WHERE area >= 400 AND (lang IS NOT NULL OR area >= 40000)),
  {A1.replace(f"{LANG} AS lang", "lang").replace("fx_detections", "kept")}, {greedy_parts("m", "SELECT * FROM kept", "idx", H_CENTER, {"idx": "INT", "lang": "VARCHAR"})},
  grown AS (SELECT m.page_id, idx, lang, page_lang, {PADDED} FROM m JOIN l USING (page_id)),
  cleaned AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN page_lang = 'jpn' THEN y1 - CAST(0.4 AS DOUBLE)*x1 ELSE y1 + CAST(0.4 AS DOUBLE)*x1 END, idx) AS position FROM grown)"""


@query()
def minimum_slice(v: Views) -> DataFrame:
    """Detections to packed pages in reading order."""
    return O.clean_pages(v(D))


@query(f"WITH RECURSIVE {CLEANED} SELECT page_id, CAST(list(x1 || ',' || y1 || ',' || x2 || ',' || y2 ORDER BY position) AS STRING) AS boxes, CAST(list(coalesce(lang, '-') ORDER BY position) AS STRING) AS langs FROM cleaned GROUP BY page_id", D)
def minimum_slice_text(v: Views) -> DataFrame:
    """The packed pages of ``minimum_slice``, arrays as texts."""
    return packed_text(O.clean_pages(v(D)))


@query(f"WITH RECURSIVE {CLEANED} SELECT page_id, idx, x1, y1, x2, y2, lang, page_lang, position FROM cleaned", D)
def w1_clean_regions(v: Views) -> DataFrame:
    """Detections to regions in reading order."""
    return O.clean_regions(v(D))


@query(f"""WITH RECURSIVE {CLEANED}, checked AS (SELECT c.page_id, c.idx, {PADDED} FROM cleaned c LEFT JOIN fx_texts t USING (page_id, idx)
    WHERE NOT (CAST(x2-x1 AS BIGINT)*(y2-y1) < 3000 AND coalesce(regexp_full_match(text, '[～．ー！？０-９~.!?0-9-]*', 's'), false))),
  {greedy_parts("o", "SELECT page_id, x1, y1, x2, y2, min(idx) AS idx FROM checked GROUP BY ALL", "y1, x1, y2, x2", H_AREA, {"idx": "INT"})}
  SELECT page_id, idx, x1, y1, x2, y2 FROM o""", "fx_texts")
def w1_clean_pages(v: Views) -> DataFrame:
    """Regions after the text check, extended and merged again."""
    kept, _ = O.apply_ocr_filter(O.clean_regions(v(D)), v("fx_texts"))
    extended = kept.select("page_id", "idx", *(c.alias(n) for c, n in zip(G.pad(G.box(), 5, 560, 760), O.COLS)))
    return O.merge_overlaps(extended)
