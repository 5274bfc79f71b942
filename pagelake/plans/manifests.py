"""Queries on manifests, outputs and label files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sources as S
from ..operators import manifests as M
from .registry import Views, query

OUT, SEG, P = "fx_outputs", "fx_segments", "fx_pages"


def files(v: Views, ending: str, test: str) -> DataFrame:
    page = F.col("page_id").cast("string")
    return v(P).filter(test).select(F.concat(F.lit("/cache/"), page, F.lit("_page"), page, F.lit(ending)).alias("path"))


@query("""WITH a AS (SELECT CAST(page_id AS STRING) AS uid, concat('/cache/', page_id, '_page', page_id, '#clean.json') AS page FROM fx_pages WHERE page_id % 3 <> 0), b AS (SELECT CAST(page_id AS STRING) AS uid, concat('/cache/', page_id, '_page', page_id, '#mask_data.json') AS mask FROM fx_pages WHERE page_id % 5 <> 0)
  SELECT uid, page, mask, CASE WHEN page IS NULL THEN 'no_page' WHEN mask IS NULL THEN 'no_mask' ELSE 'paired' END AS status FROM a FULL JOIN b USING (uid)""", P)
def j5_pair_documents(v: Views) -> DataFrame:
    return M.pair_documents(files(v, "#clean.json", "page_id % 3 <> 0"), files(v, "#mask_data.json", "page_id % 5 <> 0"))


@query("SELECT d.page_id, d.idx, d.x1, f.x1 - 2 AS ref_x1 FROM fx_detections d JOIN fx_detections f ON f.page_id=d.page_id AND f.idx=d.idx WHERE f.idx <= 3", "fx_detections")
def j6_pair_boxes(v: Views) -> DataFrame:
    d = v("fx_detections")
    return M.pair_boxes(d, d.filter("idx <= 3").withColumn("x1", F.col("x1") - 2)).select("page_id", "idx", "x1", "ref_x1")


@query("SELECT CAST(page_id AS STRING) AS uid, CASE WHEN page_id % 4 = 0 THEN concat('/out/', page_id, '_p_box_mask.png') END AS file FROM fx_pages", P)
def j8_find_artifacts(v: Views) -> DataFrame:
    page = F.col("page_id").cast("string")
    ending = F.when(F.col("page_id") % 4 == 0, "_box_mask.png").otherwise("_clean.png")
    return M.find_artifacts(v(P).select(page.alias("uid")), v(P).select(F.concat(F.lit("/out/"), page, F.lit("_p"), ending).alias("file")), ["_box_mask.png", "_cut_mask.png"])


KINDS = "(VALUES ('box_mask','new'),('final_mask','new'),('masked','new'),('denoised','old')) AS k(output, params)"


@query(f"SELECT p.page_id, k.output, CASE WHEN o.params IS NULL THEN 'missing' ELSE 'changed' END AS reason FROM fx_pages p CROSS JOIN {KINDS} LEFT JOIN fx_outputs o ON o.page_id=p.page_id AND o.output=k.output WHERE o.params IS NULL OR o.params <> k.params", P, OUT)
def j9_stale_outputs(v: Views) -> DataFrame:
    params = v(P).sparkSession.createDataFrame([("box_mask", "new"), ("final_mask", "new"), ("masked", "new"), ("denoised", "old")], "output string, params string")
    wanted = v(P).select("page_id", F.explode(F.array(*(F.lit(x) for x in ("box_mask", "final_mask", "masked", "denoised")))).alias("output"))
    return M.stale_outputs(wanted, v(OUT), params)


STEPS = {"masker": ("box_mask", "final_mask", "masked"), "denoiser": ("denoised",), "inpainter": ("inpainted",), "texts": ("text",)}
STEP_ROWS = "(VALUES ('masker','box_mask','new',0),('masker','final_mask','new',0),('masker','masked','new',1),('denoiser','denoised','old',1),('inpainter','inpainted','new',1),('texts','text','new',1)) AS s(step, output, params, last)"


@query(f"""WITH s AS (SELECT * FROM {STEP_ROWS}), w AS (SELECT p.page_id, s.* FROM fx_pages p JOIN s ON CASE WHEN p.page_id % 2 = 0 THEN s.output IN ('box_mask','denoised') ELSE s.output = 'text' END),
  need AS (SELECT page_id, step, output, params FROM w UNION ALL SELECT p.page_id, s.step, s.output, s.params FROM fx_pages p CROSS JOIN s WHERE s.last = 1 AND NOT EXISTS (SELECT 1 FROM w WHERE w.page_id = p.page_id AND w.step = s.step))
  SELECT DISTINCT need.page_id, need.step FROM need LEFT JOIN fx_outputs o ON o.page_id = need.page_id AND o.output = need.output WHERE o.params IS NULL OR o.params <> need.params""", P, OUT)
def j9_stale_steps(v: Views) -> DataFrame:
    now = [(o, "old" if o == "denoised" else "new") for kinds in STEPS.values() for o in kinds]
    params = v(P).sparkSession.createDataFrame(now, "output string, params string")
    asked = F.when(F.col("page_id") % 2 == 0, F.array(F.lit("box_mask"), F.lit("denoised"))).otherwise(F.array(F.lit("text")))
    return M.stale_steps(v(P).select("page_id", F.explode(asked).alias("output")), v(OUT), params, STEPS)


BEST = """c AS (SELECT page_id, output, CASE WHEN output IN ('masked','denoised','inpainted') THEN 'clean' WHEN output IN ('box_mask','final_mask') THEN 'mask' ELSE 'text' END AS category, CASE output WHEN 'denoised' THEN 1 WHEN 'inpainted' THEN 2 WHEN 'final_mask' THEN 1 ELSE 0 END AS r FROM fx_outputs),
  best AS (SELECT page_id, category, arg_max(output, r) AS output FROM c GROUP BY ALL), targets AS (SELECT page_id, list(output ORDER BY output) AS outputs FROM best GROUP BY 1)"""


@query(f"WITH {BEST} SELECT * FROM best", OUT)
def o10_highest_outputs(v: Views) -> DataFrame:
    return M.highest_outputs(v(OUT))


@query(f"WITH {BEST} SELECT page_id, array_to_string(outputs, ',') AS outputs FROM targets", OUT)
def t7_export_targets(v: Views) -> DataFrame:
    return M.export_targets(v(OUT)).withColumn("outputs", F.array_join("outputs", ","))


COMMON = "n AS (SELECT split_from, count(*) n FROM fx_segments GROUP BY 1), u AS (SELECT split_from, output, count(*) m FROM (SELECT s.split_from, unnest(outputs) AS output FROM fx_segments s JOIN targets USING (page_id)) GROUP BY ALL), common AS (SELECT split_from, output FROM u JOIN n USING (split_from) WHERE m=n)"


@query(f"WITH {BEST}, {COMMON} SELECT * FROM common", OUT, SEG)
def u2_common_outputs(v: Views) -> DataFrame:
    return M.common_outputs(M.export_targets(v(OUT)), v(SEG)).drop("place")


MERGED = f"""WITH {BEST}, {COMMON}, h AS (SELECT s.split_from, count(*) n, count(t.page_id) m FROM fx_segments s LEFT JOIN targets t USING (page_id) GROUP BY 1), o AS (SELECT split_from, string_agg(output, ',' ORDER BY output) outputs FROM common GROUP BY 1)
  SELECT h.split_from, n=m AS complete, CASE WHEN n=m THEN coalesce(outputs,'') END AS outputs FROM h LEFT JOIN o USING (split_from)"""


@query(MERGED, OUT, SEG)
def t8_merge_export_targets(v: Views) -> DataFrame:
    return M.merge_export_targets(M.export_targets(v(OUT)), v(SEG)).withColumn("outputs", F.array_join("outputs", ","))


@query(MERGED.replace("ORDER BY output)", "ORDER BY output DESC)"), OUT, SEG)
def t8_merge_in_first_order(v: Views) -> DataFrame:
    """First segments list their outputs backwards, and the strips do as they."""
    targets = M.export_targets(v(OUT)).join(v(SEG).select("page_id", "segment_no"), "page_id")
    backwards = F.when(F.col("segment_no") == 1, F.reverse("outputs")).otherwise(F.col("outputs"))
    return M.merge_export_targets(targets.select("page_id", backwards.alias("outputs")), v(SEG)).withColumn("outputs", F.array_join("outputs", ","))


@query("SELECT page_id, path, CASE WHEN page_id % 2 = 0 THEN concat('/originals/set', split_from % 5, '/page', page_id, '.png') ELSE path END AS export_path FROM fx_pages", P)
def t8_grafted_names(v: Views) -> DataFrame:
    """Even pages are segments of strips kept elsewhere."""
    strip = F.concat(F.lit("/originals/set"), (F.col("split_from") % 5).cast("string"), F.lit("/strip"), F.col("split_from").cast("string"), F.lit(".png"))
    segments = v(P).filter("page_id % 2 = 0").select(strip.alias("split_from"), F.col("path").alias("segment_path"))
    return M.grafted_targets(v(P).select("page_id", "path"), segments).select("page_id", "path", "export_path")


@query("SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL UNION SELECT DISTINCT lang_raw FROM fx_detections", "fx_detections")
def u3_engine_languages(v: Views) -> DataFrame:
    return M.engine_languages(v("documents"), v("fx_detections").select(F.col("lang_raw").alias("lang")))


@query("SELECT DISTINCT lang FROM documents WHERE lang NOT IN ('en', 'de')")
def u3_supported_languages(v: Views) -> DataFrame:
    docs = v("documents")
    return M.supported_languages(docs.select("lang").filter("lang IN ('en', 'de')"), docs)


@query("SELECT page_id, string_agg(concat_ws(' ', '1', printf('%.6f', (x1+x2)/CAST(2 AS DOUBLE)/560), printf('%.6f', (y1+y2)/CAST(2 AS DOUBLE)/760), printf('%.6f', (x2-x1)/CAST(560 AS DOUBLE)), printf('%.6f', (y2-y1)/CAST(760 AS DOUBLE))), chr(10) ORDER BY idx) AS lines FROM fx_detections GROUP BY 1", "fx_detections")
def s13_yolo_labels(v: Views) -> DataFrame:
    return M.yolo_labels(v("fx_detections"), 560, 760)


@query("SELECT page_id, string_agg(concat_ws(',', x1,y1,x2,y1,x2,y2,x1,y2), chr(10) ORDER BY block_idx, line_no) AS lines FROM fx_lines GROUP BY 1", "fx_lines")
def s14_line_polygons(v: Views) -> DataFrame:
    return M.line_polygons(v("fx_lines"))


@query("SELECT CAST(split_from AS STRING) AS split_from, segment_no, path AS segment_path FROM fx_segments", SEG)
def s12_split_manifest(v: Views) -> DataFrame:
    """Manifests are written as documents and read again."""
    segments = v(SEG).select(F.col("split_from").cast("string").alias("split_from"), "segment_no", F.col("path").alias("segment_path"))
    return S.parse_split_manifest(S.split_manifest_json(segments))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN '.tif' WHEN 1 THEN '.tiff' ELSE '.TIF' END AS suffix, CAST(page_id // 3 % 6 AS INT) AS samples FROM pages WHERE page_id % 3 = 2 OR page_id // 3 % 6 <> 5")
def s2_reject_multichannel_tiff(v: Views) -> DataFrame:
    """Headers of TIFF files with up to five samples a pixel; the suffix test heeds case."""
    samples = F.expr("CAST(page_id DIV 3 % 6 AS INT)")
    header = F.concat(F.lit("49492A0008000000010015010300010000000"), samples.cast("string"), F.lit("00000000000000"))
    suffix = F.when(F.col("page_id") % 3 == 0, ".tif").when(F.col("page_id") % 3 == 1, ".tiff").otherwise(".TIF")
    files = v("pages").select("page_id", F.concat(F.lit("/scans/p"), F.col("page_id").cast("string"), suffix).alias("path"), F.unhex(header).alias("content"), suffix.alias("suffix"), samples.alias("samples"))
    return S.reject_multichannel_tiff(files).select("page_id", "suffix", "samples")


@query("SELECT page_id, CAST(idx - 1 AS INT) AS idx, x1, y1, x2, y2, lang_raw AS language, partkey % 2 = 0 AS vertical, 1 AS n_lines FROM fx_detections", "fx_detections")
def s4_detection_documents(v: Views) -> DataFrame:
    """Documents of raw detections are written and read again: blocks with the number of their lines."""
    d = v("fx_detections")
    block = F.struct(
        "idx", F.array("x1", "y1", "x2", "y2").alias("xyxy"), F.array(F.array(*(F.array(F.col(x), F.col(y)) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))))).alias("lines"),
        F.col("lang_raw").alias("language"), (F.col("partkey") % 2 == 0).alias("vertical"),
    )
    docs = d.groupBy("page_id").agg(F.array_sort(F.collect_list(block)).alias("blk_list"))
    text = docs.select(F.to_json(F.struct(F.col("page_id").cast("string").alias("original_path"), F.lit(1.0).alias("scale"), "blk_list")).alias("value"))
    _, blocks, lines = S.parse_detections(text)
    n = lines.groupBy("original_path", F.col("block_idx").alias("idx")).agg(F.count(F.when(F.size("points") == 4, 1)).cast("int").alias("n_lines"))
    return blocks.join(n, ["original_path", "idx"]).select(F.col("original_path").cast("long").alias("page_id"), "idx", "x1", "y1", "x2", "y2", "language", "vertical", "n_lines")


@query("SELECT page_id, lower(regexp_extract(url, '\\.[^./]+$', 0)) IN ('.html', '.png', '.jpg') AS accepted FROM pages")
def s1_suffix_rule(v: Views) -> DataFrame:
    return v("pages").select("page_id", S.has_suffix(F.col("url"), (".html", ".png", ".jpg")).alias("accepted"))
