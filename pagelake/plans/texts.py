"""Queries on recognised texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import regions as R
from ..operators import texts as T
from .regions import CLEANED
from .registry import Views, query

D, REC = "fx_detections", "fx_ocr_records"
CODE = "CASE WHEN startx='x1' THEN 'INVALID_INT' WHEN startx='2147483648' THEN 'INT_TOO_LARGE' WHEN filename='' THEN 'EMPTY_FILENAME' END"


@query(f"WITH e AS (SELECT *, {CODE} AS error_code FROM fx_ocr_records) SELECT file_no, line, error_code, concat_ws(',', filename, startx, starty, endx, endy) AS context FROM e WHERE error_code IS NOT NULL", REC)
def s7_record_errors(v: Views) -> DataFrame:
    return T.validate_records(v(REC))[1]


@query(f"""WITH e AS (SELECT *, {CODE} AS error_code FROM fx_ocr_records) SELECT file_no, line, filename, least(startx::INT,endx::INT) x1, least(starty::INT,endy::INT) y1, greatest(startx::INT,endx::INT) x2, greatest(starty::INT,endy::INT) y2, text FROM e WHERE error_code IS NULL""", REC)
def s7_record_rows(v: Views) -> DataFrame:
    return T.validate_records(v(REC), strict=False)[0]


@query(f"WITH r AS MATERIALIZED (SELECT file_no * 1000 + line % 200 AS file_no, line, filename, {CODE} AS error_code FROM fx_ocr_records), bad AS (SELECT DISTINCT file_no FROM r WHERE error_code IS NOT NULL) SELECT file_no, line, filename FROM r ANTI JOIN bad USING (file_no)", REC)
def s9_strict_files(v: Views) -> DataFrame:
    """Records of files without any error, the 40 files dealt into small ones."""
    small = v(REC).withColumn("file_no", F.col("file_no") * 1000 + F.col("line") % 200)
    return T.validate_records(small)[0].select("file_no", "line", "filename")


SECTIONS = r"""WITH t AS (SELECT conv_id, turn, regexp_replace(text, '[\r\n\t]+', ' ', 'g') AS text, turn = max(turn) OVER (PARTITION BY conv_id) AND conv_id % 2 = 1 AS bad FROM conversations)"""


def section_files(v: Views) -> DataFrame:
    """One file a conversation: a heading and one line a turn; odd conversations lack the last colon."""
    from pyspark.sql import Window as W

    t = v("conversations").select("conv_id", "turn", F.regexp_replace("text", r"[\r\n\t]+", " ").alias("text"))
    last = (F.col("turn") == F.max("turn").over(W.partitionBy("conv_id"))) & (F.col("conv_id") % 2 == 1)
    part = F.concat(F.lit("turn"), F.col("turn").cast("string"), F.lit(".jpg"), F.when(last, "").otherwise(":"), F.lit("\n"), F.col("text"), F.lit("\n\n"))
    parts = t.withColumn("part", part).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "part"))).alias("p"))
    return parts.select(F.col("conv_id").alias("file_no"), F.array_join(F.transform("p", lambda s: s["part"]), "").alias("value"))


@query(SECTIONS + " SELECT conv_id AS file_no, concat('turn', turn, '.jpg') AS filename, rtrim(trim(text, ' '), ' ') AS text FROM t WHERE NOT bad AND trim(text, ' ') <> ''")
def s8_section_rows(v: Views) -> DataFrame:
    return T.parse_sections(section_files(v), strict=False)[0].select("file_no", "filename", F.trim("text").alias("text"))


@query(SECTIONS + " SELECT conv_id AS file_no, 'INVALID_PATH' AS error_code, count(*) AS n FROM t WHERE bad GROUP BY conv_id")
def s8_section_errors(v: Views) -> DataFrame:
    errors = T.parse_sections(section_files(v))[1].filter("context LIKE 'turn%.jpg'")
    return errors.groupBy("file_no", "error_code").agg(F.count("*").alias("n"))


FRAG = "f AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN concat('missing', page_id, '.png') WHEN page_id % 5 = 0 THEN concat('/page', page_id, '.png') ELSE concat(page_id, '.png') END AS fragment FROM fx_pages)"


def match_input(v: Views) -> tuple[DataFrame, DataFrame]:
    """Every page as an image and as a text; short fragments end many paths."""
    return v("fx_pages").select(F.col("path").alias("image")), v("fx_pages").select(fragment_of_page().alias("fragment"))


def fragment_of_page() -> Column:
    page = F.col("page_id").cast("string")
    return F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("missing"), page, F.lit(".png"))).when(F.col("page_id") % 5 == 0, F.concat(F.lit("/page"), page, F.lit(".png"))).otherwise(F.concat(page, F.lit(".png")))


MATCH = f"""WITH {FRAG}, i AS (SELECT path AS image FROM fx_pages), z AS (SELECT DISTINCT length(fragment) AS size FROM f), e AS (SELECT image, right(image, size) AS fragment FROM i, z WHERE size <= length(image)),
  h AS (SELECT image, fragment, count(*) OVER (PARTITION BY image) ni, count(*) OVER (PARTITION BY fragment) nf FROM e JOIN (SELECT DISTINCT fragment FROM f) USING (fragment)),
  m AS (SELECT image, fragment, CASE WHEN ni>1 OR nf>1 THEN 'ambiguous' ELSE 'matched' END AS status FROM h)"""


@query(MATCH + " SELECT * FROM m UNION ALL SELECT image, NULL, 'no_text' FROM i WHERE image NOT IN (SELECT image FROM m) UNION ALL SELECT DISTINCT NULL, fragment, 'no_image' FROM f WHERE fragment NOT IN (SELECT fragment FROM m)", "fx_pages")
def j4_match_texts(v: Views) -> DataFrame:
    return T.match_texts(*match_input(v))


@query(MATCH + " SELECT i.image, m.fragment FROM i LEFT JOIN m ON m.image = i.image AND m.status = 'matched'", "fx_pages")
def t5_finalize_mapping(v: Views) -> DataFrame:
    images, texts = match_input(v)
    return T.finalize_mapping(T.match_texts(images, texts), images)


@query("SELECT split_from, segment_no, page_id, CAST(coalesce(sum(height) OVER (PARTITION BY split_from ORDER BY segment_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS off FROM fx_segments", "fx_segments")
def o4_segment_offsets(v: Views) -> DataFrame:
    return T.segment_offsets(v("fx_segments")).select("split_from", "segment_no", "page_id", F.col("offset").alias("off"))


@query("SELECT s.split_from, s.segment_no, t.idx, t.text FROM fx_segments s LEFT JOIN fx_texts t USING (page_id)", "fx_segments", "fx_texts")
def j7_attach_segments(v: Views) -> DataFrame:
    return T.attach_segments(v("fx_segments"), v("fx_texts")).select("split_from", "segment_no", "idx", "text")


OFFS = "o AS (SELECT *, CAST(coalesce(sum(height) OVER (PARTITION BY split_from ORDER BY segment_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS off FROM fx_segments)"


def box_texts(v: Views) -> DataFrame:
    return v(D).select("page_id", "idx", *T.COLS).join(v("fx_texts"), ["page_id", "idx"])


@query(f"WITH {OFFS} SELECT split_from, row_number() OVER (PARTITION BY split_from ORDER BY segment_no, d.idx) AS idx, t.text, d.x1::BIGINT x1, d.y1+off AS y1, d.x2::BIGINT x2, d.y2+off AS y2 FROM o JOIN fx_detections d USING (page_id) JOIN fx_texts t ON t.page_id=d.page_id AND t.idx=d.idx", "fx_segments", "fx_texts")
def t1_merge_segment_texts(v: Views) -> DataFrame:
    return T.merge_segment_texts(box_texts(v), v("fx_segments"))


@query("SELECT page_id, idx FROM fx_texts WHERE page_id NOT IN (SELECT page_id FROM fx_segments WHERE segment_no > 2) UNION ALL SELECT split_from, segment_no FROM fx_segments WHERE segment_no = 3", "fx_segments", "fx_texts")
def u4_replace_split_rows(v: Views) -> DataFrame:
    s = v("fx_segments")
    merged = s.filter("segment_no = 3").select(F.col("split_from").alias("page_id"), F.col("segment_no").alias("idx"))
    return T.replace_split_rows(v("fx_texts").select("page_id", "idx"), s.filter("segment_no > 2"), merged)


@query("SELECT page_id, idx, text, CAST(row_number() OVER (PARTITION BY page_id ORDER BY idx) AS STRING) AS label, 'Normal' AS status FROM fx_texts", "fx_texts")
def t2_review_start(v: Views) -> DataFrame:
    return T.review_start(v("fx_texts"))


def edits(v: Views) -> DataFrame:
    """Edits of the first regions, by the region numbers of the page."""
    d = v(D)
    op = F.when(F.col("suppkey") % 5 == 0, "add").when(F.col("suppkey") % 3 == 0, "delete").when(F.col("suppkey") % 3 == 1, "edit").otherwise("reset")
    # some edits change or delete rows that were added before
    number = F.concat(F.when(F.col("partkey") % 4 == 0, F.concat(F.lit("New "), (F.col("partkey") % 3 + 1).cast("string"))).otherwise((F.col("idx") % 3 + 1).cast("string")))
    label = F.when(op != "add", number)
    return d.select("page_id", label.alias("label"), F.col("idx").alias("seq"), op.alias("op"), F.concat(F.lit("new "), F.col("idx").cast("string")).alias("text"), *T.COLS)


EDITS = """e AS (SELECT page_id, CASE WHEN suppkey%5=0 THEN NULL WHEN partkey%4=0 THEN concat('New ', partkey%3+1) ELSE CAST(idx%3+1 AS STRING) END AS label, idx AS seq, CASE WHEN suppkey%5=0 THEN 'add' WHEN suppkey%3=0 THEN 'delete' WHEN suppkey%3=1 THEN 'edit' ELSE 'reset' END AS op, concat('new ', idx) AS text, x1, y1, x2, y2 FROM fx_detections),
  r AS (SELECT t.page_id, CAST(row_number() OVER (PARTITION BY t.page_id ORDER BY t.idx) AS STRING) AS label, t.text, d.x1, d.y1, d.x2, d.y2 FROM fx_texts t JOIN fx_detections d ON d.page_id=t.page_id AND d.idx=t.idx),
  k AS (SELECT page_id, label, seq, op, text, row_number() OVER (PARTITION BY page_id, label ORDER BY seq) n FROM e WHERE op <> 'add'),
  go AS (SELECT page_id, label, text AS original, text, 'Normal' AS status, 0 AS n FROM r UNION ALL SELECT go.page_id, go.label, go.original, CASE k.op WHEN 'edit' THEN k.text WHEN 'reset' THEN go.original ELSE go.text END,
    CASE k.op WHEN 'reset' THEN 'Normal' WHEN 'edit' THEN CASE go.status WHEN 'Normal' THEN 'Edited' WHEN 'Removed' THEN 'EditedRemoved' ELSE go.status END ELSE CASE go.status WHEN 'Normal' THEN 'Removed' WHEN 'Removed' THEN 'Normal' WHEN 'Edited' THEN 'EditedRemoved' ELSE 'Edited' END END, go.n+1
    FROM go JOIN k ON k.page_id=go.page_id AND k.label=go.label AND k.n=go.n+1),
  l AS (SELECT page_id, label, arg_max(text, n) AS text, arg_max(status, n) AS status FROM go GROUP BY ALL),
  ne AS (SELECT page_id, op, text, CAST(substr(label, 5) AS INT) AS k, row_number() OVER (PARTITION BY page_id ORDER BY seq) AS n FROM e WHERE (op='add' AND CAST(x2-x1 AS BIGINT)*(y2-y1) >= 400) OR label LIKE 'New %'),
  nl AS (SELECT page_id, 0::BIGINT AS n, [struct_pack(k := 0, t := '', o := '')] AS l FROM (SELECT DISTINCT page_id FROM ne) UNION ALL SELECT nl.page_id, ne.n, CASE ne.op
    WHEN 'add' THEN list_append(l, struct_pack(k := list_min(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(list_transform(l, lambda s: s.k), i)))::INT, t := ne.text, o := ne.text))
    WHEN 'delete' THEN list_filter(l, lambda s: s.k <> ne.k) ELSE list_transform(l, lambda s: CASE WHEN s.k = ne.k THEN struct_pack(k := s.k, t := CASE ne.op WHEN 'edit' THEN ne.text ELSE s.o END, o := s.o) ELSE s END) END
    FROM nl JOIN ne ON ne.page_id=nl.page_id AND ne.n=nl.n+1),
  made AS (SELECT page_id, unnest(arg_max(l, n)) AS s FROM nl GROUP BY page_id),
  every AS (SELECT page_id, label, text, status FROM l UNION ALL SELECT page_id, concat('New ', s.k), s.t, 'New' FROM made WHERE s.k > 0)"""


@query(f"WITH RECURSIVE {EDITS} SELECT * FROM every", "fx_texts")
def t3_review_edits(v: Views) -> DataFrame:
    return T.apply_review_edits(T.review_start(box_texts(v)), edits(v)).select("page_id", "label", "text", "status")


@query(f"WITH RECURSIVE {EDITS} SELECT *, count(*) OVER (PARTITION BY page_id) AS n_boxes FROM every WHERE status <> 'Removed'", "fx_texts")
def t4_review_finish(v: Views) -> DataFrame:
    return T.review_finish(T.apply_review_edits(T.review_start(box_texts(v)), edits(v)).select("page_id", "label", "text", "status"))


def path_texts(v: Views) -> DataFrame:
    return A.trim_common_prefix(v("fx_pages")).select("page_id", F.col("short").alias("path")).join(box_texts(v), "page_id")


@query("SELECT replace(p.path, '/scans/', '') AS path, d.idx, concat_ws(',', replace(p.path, '/scans/', ''), d.x1, d.y1, d.x2, d.y2, t.text) AS record FROM fx_pages p JOIN fx_detections d USING (page_id) JOIN fx_texts t ON t.page_id=d.page_id AND t.idx=d.idx", "fx_pages", "fx_texts")
def s10_csv_rows(v: Views) -> DataFrame:
    return T.csv_rows(path_texts(v))


@query("SELECT replace(p.path, '/scans/', '') AS path, concat(replace(p.path, '/scans/', ''), ':', chr(10), string_agg(t.text, chr(10) ORDER BY t.idx), chr(10)) AS section FROM fx_pages p JOIN fx_texts t USING (page_id) GROUP BY p.path", "fx_pages", "fx_texts")
def s11_text_sections(v: Views) -> DataFrame:
    return T.text_sections(path_texts(v))


@query(f"""WITH RECURSIVE {CLEANED}, s AS (SELECT *, coalesce(sum(height) OVER (PARTITION BY split_from ORDER BY segment_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS down FROM fx_segments)
  SELECT split_from, CAST(row_number() OVER (PARTITION BY split_from ORDER BY segment_no, position) AS INT) AS idx, text, CAST(trunc(x1/scale) AS BIGINT) x1, CAST(trunc(y1/scale)+down AS BIGINT) y1, CAST(trunc(x2/scale) AS BIGINT) x2, CAST(trunc(y2/scale)+down AS BIGINT) y2
  FROM cleaned c JOIN fx_pages p USING (page_id) JOIN s USING (page_id, split_from) LEFT JOIN fx_texts t ON t.page_id = c.page_id AND t.idx = c.idx""", "fx_texts", "fx_pages", "fx_segments")
def t6_extract_texts(v: Views) -> DataFrame:
    """Regions in reading order with their texts, moved onto their strips."""
    return T.merge_segment_texts(R.extract_texts(v(D), v("fx_texts"), v("fx_pages")), v("fx_segments"))
