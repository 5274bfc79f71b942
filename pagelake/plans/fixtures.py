"""Views of pages, regions and texts over the given tables, as SQL for Spark and DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations")

#: View -> (views it needs, its SQL).
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_pages": (
        (),
        """SELECT o_orderkey AS page_id, o_custkey AS split_from, 560 AS w, 760 AS h,
          CASE WHEN o_orderkey % 3 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS scale,
          concat('/scans/vol', CAST(o_custkey % 7 AS STRING), '/page', CAST(o_orderkey AS STRING), '.png') AS path,
          CAST(760 + o_orderkey % 50 AS INT) AS height FROM orders""",
    ),
    "fx_detections": (
        (),
        """SELECT page_id, idx, x1, y1, LEAST(x1 + bw, 560) AS x2, LEAST(y1 + bh, 760) AS y2, lang_raw, partkey, suppkey, lineno FROM (
          SELECT l_orderkey AS page_id,
            CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS idx,
            CAST((l_partkey * 7 + l_suppkey * 13) % 400 AS INT) AS x1,
            CAST((l_partkey * 11 + l_linenumber * 97) % 600 AS INT) AS y1,
            CAST(5 + (l_partkey * 3 + CAST(l_quantity AS BIGINT) * 17) % 240 AS INT) AS bw,
            CAST(5 + (l_suppkey * 5 + CAST(l_quantity AS BIGINT) * 29) % 240 AS INT) AS bh,
            CASE l_returnflag WHEN 'A' THEN 'ja' WHEN 'N' THEN 'eng' ELSE 'unknown' END AS lang_raw,
            l_partkey AS partkey, l_suppkey AS suppkey, CAST(l_linenumber AS INT) AS lineno FROM lineitem) t""",
    ),
    "fx_texts": (
        ("fx_detections",),
        """SELECT d.page_id, d.idx, CASE WHEN d.partkey % 4 = 0 THEN concat(repeat('!', d.lineno), '?') WHEN d.partkey % 9 = 0 THEN '' ELSE p.p_name END AS text
          FROM fx_detections d JOIN part p ON p.p_partkey = d.partkey""",
    ),
    "fx_candidates": (
        ("fx_detections",),
        """SELECT d.page_id, d.idx, c.k, CASE WHEN c.k = 11 THEN NULL ELSE 4 + 2 * c.k END AS thickness,
          CAST((d.partkey * (c.k + 3) + d.suppkey * 31 + d.idx * 7) % 400 AS DOUBLE) / CAST(10 AS DOUBLE) AS dev
          FROM fx_detections d CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11)) AS c(k)""",
    ),
    "fx_fits": (  # one mask fit per region, for the analytics
        ("fx_detections",),
        """SELECT page_id, idx, x1, y1, x2, y2, CAST((partkey * 5 + suppkey * 31 + idx * 7) % 400 AS DOUBLE) / CAST(10 AS DOUBLE) AS dev,
          (partkey + suppkey) % 17 = 0 AS failed, CASE WHEN partkey % 5 = 0 THEN NULL ELSE CAST(4 + 2 * (suppkey % 11) AS INT) END AS thickness
          FROM fx_detections""",
    ),
    "fx_ocr_boxes": (  # one text check per region
        ("fx_detections",),
        """SELECT page_id, idx, CAST(x2 - x1 AS BIGINT) * (y2 - y1) AS area, CAST(x2 - x1 AS BIGINT) * (y2 - y1) < 20000 AS checked,
          CAST(x2 - x1 AS BIGINT) * (y2 - y1) < 20000 AND partkey % 4 = 0 AS removed FROM fx_detections""",
    ),
    "fx_segments": (
        ("fx_pages",),
        """SELECT split_from, CAST(row_number() OVER (PARTITION BY split_from ORDER BY page_id) AS INT) AS segment_no, page_id, path, w, height FROM fx_pages""",
    ),
    "fx_lines": (
        ("fx_detections",),
        """SELECT d.page_id, d.idx AS block_idx, l.k AS line_no, d.x1 AS x1, d.y1 + l.k * 18 AS y1, d.x2 AS x2, d.y1 + l.k * 18 + 14 AS y2
          FROM fx_detections d CROSS JOIN (VALUES (0),(1),(2)) AS l(k) WHERE l.k <= d.lineno % 3""",
    ),
    "fx_quads": (  # slanted lines: rows of a block, or columns in every third one; corners clockwise from the upper left
        ("fx_detections",),
        """SELECT page_id, block_idx, block_idx * 10 + line_no AS line_no, lang,
            CASE WHEN down THEN x1 + line_no * 24 ELSE x1 END AS qx1, CASE WHEN down THEN y1 ELSE y1 + line_no * 18 END AS qy1,
            CASE WHEN down THEN x1 + line_no * 24 + 18 ELSE x2 END AS qx2, CASE WHEN down THEN y1 + tilt ELSE y1 + line_no * 18 + tilt * 4 END AS qy2,
            CASE WHEN down THEN x1 + line_no * 24 + 18 - tilt * 4 ELSE x2 - tilt END AS qx3, CASE WHEN down THEN y2 + 20 + tilt ELSE y1 + line_no * 18 + 14 + tilt * 4 END AS qy3,
            CASE WHEN down THEN x1 + line_no * 24 - tilt * 4 ELSE x1 - tilt END AS qx4, CASE WHEN down THEN y2 + 20 ELSE y1 + line_no * 18 + 14 END AS qy4
          FROM (SELECT d.page_id, d.idx AS block_idx, l.k AS line_no, d.lang_raw AS lang, d.x1, d.y1, d.x2, d.y2, CAST(d.partkey % 7 - 3 AS INT) AS tilt, d.suppkey % 3 = 0 AS down
            FROM fx_detections d CROSS JOIN (VALUES (0),(1),(2)) AS l(k) WHERE l.k <= d.lineno % 3) t""",
    ),
    "fx_predictions": (
        ("fx_detections",),
        """SELECT page_id, idx, x1 + CAST(partkey % 9 AS INT) AS x1, y1 + CAST(suppkey % 7 AS INT) AS y1, x2 + CAST(partkey % 9 AS INT) AS x2, y2 + CAST(suppkey % 7 AS INT) AS y2,
          CAST(partkey % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS conf, CAST(partkey % 2 AS INT) AS cls FROM fx_detections WHERE partkey % 5 <> 0""",
    ),
    "fx_raw_detections": (  # centres, sizes and scores as real numbers
        ("fx_detections",),
        """SELECT page_id, idx, CAST(x1 + x2 AS DOUBLE) / CAST(2 AS DOUBLE) + CAST(partkey % 13 AS DOUBLE) / CAST(13 AS DOUBLE) AS cx,
          CAST(y1 + y2 AS DOUBLE) / CAST(2 AS DOUBLE) + CAST(suppkey % 11 AS DOUBLE) / CAST(11 AS DOUBLE) AS cy,
          CAST(x2 - x1 AS DOUBLE) + CAST(suppkey % 7 AS DOUBLE) / CAST(7 AS DOUBLE) AS bw, CAST(y2 - y1 AS DOUBLE) + CAST(partkey % 3 AS DOUBLE) / CAST(3 AS DOUBLE) AS bh,
          CAST(300 + partkey * 37 % 697 AS DOUBLE) / CAST(997 AS DOUBLE) AS objectness,
          CAST(400 + suppkey * 29 % 593 AS DOUBLE) / CAST(991 AS DOUBLE) AS s0, CAST(400 + (partkey * 17 + suppkey) % 587 AS DOUBLE) / CAST(991 AS DOUBLE) AS s1 FROM fx_detections""",
    ),
    "fx_progress": (
        (),
        """SELECT user_id AS run_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'begin_step' WHEN 'error' THEN 'absolute' WHEN 'purchase' THEN 'end' ELSE 'incremental' END AS type,
          CAST(floor(value) AS INT) AS value FROM events""",
    ),
    "fx_log_events": (
        (),
        """SELECT user_id AS source_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'START' WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'CRITICAL' ELSE 'INFO' END AS level FROM events""",
    ),
    "fx_ocr_records": (
        (),
        """SELECT CAST(l_orderkey % 40 AS INT) AS file_no, row_number() OVER (PARTITION BY l_orderkey % 40 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) + 1 AS line,
          CASE WHEN l_partkey % 97 = 0 THEN '' ELSE concat('page', CAST(l_orderkey AS STRING), '.png') END AS filename,
          CASE WHEN l_partkey % 89 = 0 THEN 'x1' WHEN l_partkey % 83 = 0 THEN '2147483648' ELSE CAST(l_partkey AS STRING) END AS startx,
          CAST(l_suppkey AS STRING) AS starty, CAST(CAST(l_quantity AS BIGINT) * 20 AS STRING) AS endx, CAST(l_linenumber * 40 AS STRING) AS endy,
          concat('text ', CAST(l_partkey AS STRING)) AS text FROM lineitem""",
    ),
    "fx_outputs": (  # which outputs of a page exist, with the parameters they were made with
        (),
        """SELECT o.o_orderkey AS page_id, v.output, v.ord, CASE WHEN (o.o_orderkey + v.ord) % 11 = 0 THEN 'old' ELSE 'new' END AS params
          FROM orders o CROSS JOIN (VALUES ('box_mask', 3), ('final_mask', 5), ('masked', 6), ('denoised', 8), ('inpainted', 10), ('text', 6)) AS v(output, ord)
          WHERE (o.o_orderkey * 7 + v.ord * 5) % 4 <> 0""",
    ),
}
PIXELS_SPARK = """SELECT vec_id, CAST(i DIV 8 AS INT) AS y, CAST(i % 8 AS INT) AS x,
  LEAST(255, GREATEST(0, CAST(floor((CAST(e AS DOUBLE) + 1) * 127.5D) AS INT))) AS px FROM embeddings LATERAL VIEW posexplode(embedding) AS i, e"""
PIXELS_DUCKDB = """SELECT vec_id, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x,
  LEAST(255, GREATEST(0, CAST(floor((CAST(e AS DOUBLE) + 1) * 127.5) AS INT))) AS px
  FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"""


def _needs(name: str) -> list[str]:
    out: list[str] = []
    for n in VIEWS.get(name, ((), ""))[0]:
        out += [x for x in _needs(n) if x not in out]
    return [*out, name]


def view(spark: SparkSession, sf_dir: str, name: str, by_page: bool = False, more: str = "") -> DataFrame:
    """A view (or a table) over the Parquet files of a folder.

    ``by_page``: line items are dealt by order when they are read, so that what is gathered by page later needs no further
    exchange; views that are read so side by side share it where they take the same columns. ``more``: a further column of the view's own source.
    """
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    names = [] if name == "fx_pixels" else _needs(name)
    sql = {n: VIEWS[n][1] for n in names}
    if more:
        sql[name] = sql[name].replace("SELECT ", f"SELECT {more}, ", 1)
    texts = [PIXELS_SPARK] if name == "fx_pixels" else list(sql.values())
    base = [t for t in TABLES if any(f" {t}" in x for x in texts)]
    dealt = {"lineitem": "/*+ REPARTITION(l_orderkey) */ "} if by_page else {}
    parts = [f"{t} AS (SELECT {dealt.get(t, '')}* FROM parquet.`{sf_dir}/{t}.parquet`)" for t in base]
    parts += [f"fx_pixels AS ({PIXELS_SPARK})"] if name == "fx_pixels" else [f"{n} AS ({sql[n]})" for n in names]
    return spark.sql(f"WITH {', '.join(parts)} SELECT * FROM {name}")


def duckdb_sql(body: str, *names: str) -> str:
    """``body`` with the views it needs in front; body may begin with further ``name AS (...)`` parts and a comma-free WITH."""
    found: list[str] = []
    for name in names:
        found += [n for n in ([name] if name == "fx_pixels" else _needs(name)) if n not in found]
    parts = [f"{n} AS ({PIXELS_DUCKDB if n == 'fx_pixels' else VIEWS[n][1]})" for n in found]
    body = body.strip()
    recursive = body.upper().startswith("WITH RECURSIVE ")
    if body.upper().startswith("WITH "):
        rest = body[15:] if recursive else body[5:]
        return f"WITH {'RECURSIVE ' * recursive}{', '.join([*parts, ''])}{rest}"
    return f"WITH {', '.join(parts)} {body}" if parts else body
