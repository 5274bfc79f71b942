"""A corpus pipeline over ``documents``: quality, toxicity, near duplicates, secrets, packing.

Each stage takes (spark, docs, folder of the tables) and works on all that the
stage before kept. All but the last return the columns of documents. Rows with
null text fail the quality rules; rows that repeat an id are one document, whose
rows stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm.common import drop_tables, stored
from pagelake.llm.near_dups import near_duplicates
from pagelake.llm.packing import pack
from pagelake.llm.repetition import quality_rules
from pagelake.llm.secrets import redacted, secret_scan
from pagelake.llm.toxicity import toxicity


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs, carry=True).filter("kept").select("row.*")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not flag."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(docs, labels, carry=True).filter("not flag").select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate group."""
    gone = near_duplicates(docs, size=5, percent=80).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live-looking secrets covered in their texts."""
    marks = secret_scan(docs).filter("n_live > 0").select(F.col("doc_id").alias("of"), "text_key", "marks").dropDuplicates(["of", "text_key"])
    keyed = docs.withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    both = keyed.join(marks, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("text_key")), "left")
    text = F.when(F.col("marks").isNull(), F.col("text")).otherwise(redacted(F.col("text"), F.col("marks")))
    clean = both.withColumn("text", text)
    n_chars = F.when(F.col("marks").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return clean.withColumn("n_chars", n_chars).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    return pack(docs)


STAGES = [("quality", quality), ("toxicity", without_toxic), ("near_duplicates", one_of_each), ("secrets", without_secrets), ("packing", packed)]

#: SQL has no form of a trained classifier or of the tokenizer; tests compare the other stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made: list[str] = []
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name, made)
        drop_tables(spark, made[:-1])
        made = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
