"""Queries of the analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import analytics as A
from .geometry import CH, colours
from .registry import Views, query


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes))


@query("""WITH t AS (SELECT count(*) total, count(*) FILTER (checked) small, count(*) FILTER (removed) removed FROM fx_ocr_boxes)
  SELECT *, round(small/total::DOUBLE,6) small_of_total, round(removed/total::DOUBLE,6) removed_of_total, round(removed/small::DOUBLE,6) removed_of_small FROM t""", "fx_ocr_boxes")
def a2_ocr_summary(v: Views) -> DataFrame:
    return rounded(A.ocr_summary(v("fx_ocr_boxes")))


@query("""WITH e AS (SELECT CASE WHEN max(area)<5000 THEN 500 ELSE max(area)//10 END w, min(area) lo, max(area) hi FROM fx_ocr_boxes WHERE checked),
  b AS (SELECT w, unnest(range(lo//w, hi//w)) AS bucket FROM e), c AS (SELECT area//w AS bucket, count(*) small, count(*) FILTER (removed) removed FROM fx_ocr_boxes, e WHERE checked GROUP BY 1)
  SELECT b.bucket, b.bucket*w AS lower, coalesce(small,0) small, coalesce(removed,0) removed FROM b LEFT JOIN c USING (bucket)""", "fx_ocr_boxes")
def a3_size_histogram(v: Views) -> DataFrame:
    return A.size_histogram(v("fx_ocr_boxes"))


@query("""WITH t AS (SELECT count(*) total, count(*) FILTER (NOT failed) succeeded, count(*) FILTER (failed) failed, count(*) FILTER (NOT failed AND dev=0) perfect, avg(dev) FILTER (NOT failed) mean_dev FROM fx_fits)
  SELECT total, succeeded, failed, perfect, round(mean_dev,6) mean_dev, round(succeeded/total::DOUBLE,6) success_rate, round(perfect/succeeded::DOUBLE,6) perfect_rate FROM t""", "fx_fits")
def a4_mask_summary(v: Views) -> DataFrame:
    return rounded(A.mask_summary(v("fx_fits")))


@query("""WITH k AS (SELECT unnest([4,6,8,10,12,14,16,18,20,22,24,-1,-2]) AS mask), c AS (SELECT CASE WHEN failed THEN -2 ELSE coalesce(thickness,-1) END AS mask, count(*) FILTER (NOT failed AND dev=0) perfect, count(*) total FROM fx_fits GROUP BY 1)
  SELECT k.mask, coalesce(perfect,0) perfect, coalesce(total,0) total FROM k LEFT JOIN c USING (mask)""", "fx_fits")
def a5_mask_usage(v: Views) -> DataFrame:
    return A.mask_usage_by_thickness(v("fx_fits"))


@query("SELECT page_id, count(*) FILTER (failed) AS failed, count(*) AS total FROM fx_fits GROUP BY page_id HAVING count(*) FILTER (failed) > 0", "fx_fits")
def a6_pages_with_failures(v: Views) -> DataFrame:
    return A.pages_with_failures(v("fx_fits"))


@query("SELECT count(*) total, count(*) FILTER (dev > CAST(0.25 AS DOUBLE)) AS above, round(count(*) FILTER (dev > CAST(0.25 AS DOUBLE))/count(*)::DOUBLE,6) AS ratio FROM fx_fits WHERE NOT failed", "fx_fits")
def a7_denoise_summary(v: Views) -> DataFrame:
    return rounded(A.denoise_summary(v("fx_fits")))


@query("""WITH e AS (SELECT CAST(i AS INT) AS bucket, CAST(15 AS DOUBLE)/1000*pow(i-1,3) lo, CAST(15 AS DOUBLE)/1000*pow(i,3) hi FROM range(1,11) r(i)),
  c AS (SELECT bucket, count(*) FILTER (dev <= CAST(0.25 AS DOUBLE)) below, count(*) FILTER (dev > CAST(0.25 AS DOUBLE)) above FROM fx_fits JOIN e ON dev >= lo AND dev < hi WHERE NOT failed GROUP BY 1)
  SELECT e.bucket, round(hi,6) AS upper, coalesce(below,0) below, coalesce(above,0) above FROM e LEFT JOIN c USING (bucket)""", "fx_fits")
def a8_cubic_histogram(v: Views) -> DataFrame:
    return rounded(A.cubic_histogram(v("fx_fits")))


@query("SELECT count(*) total, round(avg(thickness),6) mean_thickness FROM fx_fits WHERE dev >= 15", "fx_fits")
def a9_inpaint_summary(v: Views) -> DataFrame:
    return rounded(A.inpaint_summary(v("fx_fits").filter("dev >= 15")))


@query("WITH k AS (SELECT CAST(i AS INT) AS thickness FROM range(1,21) r(i)), c AS (SELECT thickness, count(*) n FROM fx_fits GROUP BY 1) SELECT k.thickness, coalesce(n,0) n FROM k LEFT JOIN c USING (thickness)", "fx_fits")
def a9_thickness_histogram(v: Views) -> DataFrame:
    return A.thickness_histogram(v("fx_fits"), 1, 20)


BADGE = "CASE WHEN {0} IS NULL OR {0}=0 OR {1}=0 THEN '' ELSE concat({0},'/',{1}) END"


@query(f"""WITH a AS (SELECT page_id, count(*) FILTER (removed) r, count(*) n FROM fx_ocr_boxes GROUP BY 1), b AS (SELECT page_id, count(*) FILTER (failed) f, count(*) FILTER (NOT failed AND dev=0) p, count(*) m, count(*) FILTER (NOT failed AND dev > CAST(0.25 AS DOUBLE)) d, count(*) FILTER (failed OR dev>=15) i FROM fx_fits GROUP BY 1)
  SELECT page_id, {BADGE.format('r','n')} AS ocr, {BADGE.format('f','m')} AS failures, {BADGE.format('p','m')} AS perfect, {BADGE.format('d','m')} AS denoise, CASE WHEN i=0 THEN '' ELSE CAST(i AS STRING) END AS inpaint FROM a FULL JOIN b USING (page_id)""", "fx_ocr_boxes", "fx_fits")
def a10_page_badges(v: Views) -> DataFrame:
    return A.page_badges(v("fx_ocr_boxes"), v("fx_fits"))


@query("SELECT page_id, regexp_replace(path, '^/scans/', '') AS short FROM fx_pages", "fx_pages")
def a12_trim_common_prefix(v: Views) -> DataFrame:
    return A.trim_common_prefix(v("fx_pages")).select("page_id", "short")


MODE = "CASE page_id % 4 WHEN 0 THEN 'L' WHEN 1 THEN 'RGB' WHEN 2 THEN 'RGBA' ELSE '1' END"


@query(f"SELECT split_from, max(w) AS width, CAST(sum(height) AS BIGINT) AS height, ['1','L','LA','P','RGB','RGBA','CMYK','I'][max(list_position(['1','L','LA','P','RGB','RGBA','CMYK','I'], {MODE}))] AS mode FROM fx_segments GROUP BY 1", "fx_segments")
def a17_stitched_canvas(v: Views) -> DataFrame:
    return A.stitched_canvas(v("fx_segments").withColumn("mode", F.expr(MODE)))


@query("SELECT vec_id, round(stddev_pop(px),6) dev, CAST(trunc(quantile_cont(px, 0.5)) AS INT) median, count(*) n FROM fx_pixels GROUP BY 1", "fx_pixels")
def a13_border_stats_gray(v: Views) -> DataFrame:
    return rounded(A.border_stats_gray(v("fx_pixels"), "vec_id"))


@query(f"WITH {CH}, m AS (SELECT vec_id, avg(r) mr, avg(g) mg, avg(b) mb FROM c GROUP BY 1) SELECT vec_id, round(stddev_samp(sqrt((r-mr)*(r-mr)+(g-mg)*(g-mg)+(b-mb)*(b-mb))),6) dev, count(*) n FROM c JOIN m USING (vec_id) GROUP BY 1", "fx_pixels")
def a14_border_stats_color(v: Views) -> DataFrame:
    return rounded(A.border_stats_color(colours(v), "vec_id"))


@query("WITH q AS (SELECT vec_id, px//100 AS px FROM fx_pixels), c AS (SELECT vec_id, px, count(*) n FROM q GROUP BY ALL) SELECT vec_id, max(CASE WHEN 2*n > 64 THEN CAST(px AS STRING) END) AS color FROM c GROUP BY 1", "fx_pixels")
def a15_majority_color(v: Views) -> DataFrame:
    return A.majority_color(v("fx_pixels").withColumn("px", F.floor(F.col("px") / 100).cast("int")), "vec_id", "px")


@query("""WITH RECURSIVE b AS (SELECT vec_id, px, count(*) n FROM fx_pixels GROUP BY ALL), s AS (SELECT vec_id, px, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, px) k, n, sum(n) OVER (PARTITION BY vec_id) t FROM b),
  go AS (SELECT vec_id, 0 AS pos, CAST([] AS INT[]) AS taken FROM (SELECT DISTINCT vec_id FROM s) UNION ALL
    SELECT go.vec_id, pos+1, CASE WHEN len(taken)<3 AND s.n >= s.t*CAST(0.001 AS DOUBLE) AND len(list_filter(taken, lambda z: abs(z-s.px)<=10))=0 THEN list_append(taken, s.px) ELSE taken END FROM go JOIN s ON s.vec_id=go.vec_id AND s.k=pos+1)
  SELECT vec_id, array_to_string(arg_max(taken, pos), ',') AS vals FROM go GROUP BY vec_id""", "fx_pixels")
def a18_palette_topk(v: Views) -> DataFrame:
    return A.palette_topk(v("fx_pixels"), "vec_id").select("vec_id", F.concat_ws(",", F.col("values").cast("array<string>")).alias("vals"))


@query("""WITH b AS (SELECT vec_id, px, count(*) n FROM fx_pixels GROUP BY ALL), c AS (SELECT vec_id, px, CAST(sum(n) OVER r AS BIGINT) n0, CAST(sum(n*px) OVER r AS BIGINT) s0, CAST(sum(n) OVER w AS BIGINT) na, CAST(sum(n*px) OVER w AS BIGINT) sa FROM b WINDOW r AS (PARTITION BY vec_id ORDER BY px), w AS (PARTITION BY vec_id)),
  g AS (SELECT vec_id, px, CAST(s0*(na-n0)-(sa-s0)*n0 AS DOUBLE)*(s0*(na-n0)-(sa-s0)*n0)/(CAST(n0 AS DOUBLE)*(na-n0)) v FROM c WHERE na > n0)
  SELECT vec_id, first(px ORDER BY v DESC, px) AS threshold FROM g GROUP BY 1""", "fx_pixels")
def a19_otsu_threshold(v: Views) -> DataFrame:
    return A.otsu_threshold(v("fx_pixels"), "vec_id")


@query("""WITH m AS (SELECT a.vec_id, a.px >= 128 AS a, b.px >= 128 AS b FROM fx_pixels a JOIN fx_pixels b ON b.vec_id = a.vec_id + 1 AND a.y=b.y AND a.x=b.x), t AS (SELECT vec_id, count(*) FILTER (a <> b) p, count(*) FILTER (a = b) n FROM m GROUP BY 1)
  SELECT vec_id, least(p,n) AS score, n < p AS inverted FROM t""", "fx_pixels")
def a20_mask_xor_score(v: Views) -> DataFrame:
    on = v("fx_pixels").select("vec_id", "y", "x", (F.col("px") >= 128).alias("on"))
    return A.mask_xor_score(on, on.withColumn("vec_id", F.col("vec_id") - 1), "vec_id", "y", "x")


@query("SELECT page_id, row_number() OVER (ORDER BY CAST(regexp_extract(path, 'vol(\\d+)', 1) AS INT), page_id) AS position FROM fx_pages", "fx_pages")
def o1_natural_order(v: Views) -> DataFrame:
    keyed = v("fx_pages").select("page_id", A.natural_key(F.col("path")).alias("key"))
    return A.numbered(keyed, "key").select("page_id", "position")
