"""The registered queries of the document operators: each covers its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_docs
from .fingerprints import edited_fingerprints
from .licenses import license_scan
from .negatives import hard_negatives
from .near_dups import near_duplicates
from .packing import pack
from .pieces import encode_pieces
from .pii import pii_scan
from .repetition import quality_rules
from .secrets import secret_scan
from .token_counts import count_tokens
from .token_files import token_index
from .toxicity import toxicity
from .whitening import finite, grid, whiten


def op1_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_docs(spark, sf_dir, "doc_id", "text"), size=3, percent=85)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_docs(spark, sf_dir, "doc_id", "text"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_index(read_docs(spark, sf_dir, "doc_id", "text"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_docs(spark, sf_dir, "doc_id", "text")).drop("longest_repeat")


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(read_docs(spark, sf_dir, "doc_id", "text", "source")).drop("text_key")
    return found.withColumn("marks", F.to_json("marks"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_docs(spark, sf_dir, "doc_id", "text")).withColumn("spans", F.to_json("spans"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_docs(spark, sf_dir, "doc_id", "text", "lang"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_docs(spark, sf_dir, "doc_id", "text"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(read_docs(spark, sf_dir, "doc_id", "text"), digest=True)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read_docs(spark, sf_dir, "doc_id", "text"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_scan(read_docs(spark, sf_dir, "doc_id", "text")).withColumn("found", F.to_json("found"))


def embedding_rows(embeddings: DataFrame) -> DataFrame:
    """What mining takes: labels moved on for every seventh id, entries as floor(256 * entry), anchors at every hundredth id."""
    fine = embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("embedding")))
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return fine.select(vec_id.alias("vec_id"), moved.alias("label"), (vec_id % 100 == 0).alias("anchor"), grid(F.col("embedding"), 256).alias("x"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(embedding_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_dups, op2_packing, op3_quality_rules, op4_token_files, op5_secret_scans, op6_license_scans, op7_toxicity, op8_token_counts, op9_pieces, op10_fingerprints, op11_pii, op12_hard_negatives, op13_whitening)}


#: Shingle sets by brute force, all pairs that share a shingle, and all ids reachable over links.
NEAR_DUPS_SQL = r"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, w[i:i+2] AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * both_have >= 85 * (x.n + y.n - both_have)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS label FROM documents UNION SELECT ways.b, reach.label FROM reach JOIN ways ON ways.a = reach.id),
least_of AS (SELECT id, min(label) AS label FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, label AS component_id, d.doc_id = label AS kept
FROM documents d JOIN least_of ON id = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id"""


#: Windows of words by plain grouping: of 8 for the base rule, of 5 for the share covered, and for the longest repeat
#: windows of the first length that is too long.
QUALITY_SQL = r"""WITH docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
sized AS (SELECT *, len(w) AS n, greatest(61, 15 * len(w) // 100 + 1) AS too_long FROM words),
at8 AS (SELECT id, i, w[i:i+7] AS s FROM (SELECT id, w, unnest(range(1, n - 6)) AS i FROM sized WHERE n > 8)),
at5 AS (SELECT id, i, w[i:i+4] AS s FROM (SELECT id, w, unnest(range(1, n - 3)) AS i FROM sized WHERE n > 5)),
twice8 AS (SELECT id, unnest(range(i, i + 8)) AS i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, s) AS c FROM at8) WHERE c > 1),
twice5 AS (SELECT id, unnest(range(i, i + 5)) AS i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, s) AS c FROM at5) WHERE c > 1),
long_ AS (SELECT id FROM (SELECT id, md5(array_to_string(w[i:i+too_long-1], ' ')) AS s FROM (SELECT id, w, too_long, unnest(range(1, n - too_long + 2)) AS i FROM sized WHERE n > too_long)) GROUP BY id, s HAVING count(*) > 1),
lines AS (SELECT id, unnest(string_split(text, chr(10))) AS line FROM docs),
dup AS (SELECT id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id),
r8 AS (SELECT id, count(DISTINCT i) AS n_repeat_words FROM twice8 GROUP BY id), r5 AS (SELECT id, count(DISTINCT i) AS n_covered FROM twice5 GROUP BY id),
every AS (SELECT doc_id, n AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_covered, 0) AS n_covered, id IN (SELECT id FROM long_) AS one_long
  FROM sized LEFT JOIN dup USING (id) LEFT JOIN r8 USING (id) LEFT JOIN r5 USING (id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_covered > 30 * n_words OR one_long) AS kept FROM every"""


#: All pairs of an anchor and a row.
NEGATIVES_SQL = r"""WITH fine AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
scored AS (SELECT a.row AS anchor, a.vec_id AS anchor_id, a.label = b.label AS same, b.row, b.vec_id, CAST(list_inner_product(CAST(a.x AS DOUBLE[]), CAST(b.x AS DOUBLE[])) AS BIGINT) AS score
  FROM fine a JOIN fine b ON a.vec_id % 100 = 0 AND a.row <> b.row),
positives AS (SELECT anchor, row, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, row) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM scored JOIN positives USING (anchor) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor, positives.row ORDER BY score DESC, vec_id, scored.row) QUALIFY row_number() OVER w <= 5"""


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dups": NEAR_DUPS_SQL, "op3_quality_rules": QUALITY_SQL, "op12_hard_negatives": NEGATIVES_SQL}
