"""Helpers that the document operators share: scratch tables and Arrow mapping."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a local session names none (tests on one machine) a temporary folder is
    made once; on a cluster that is an error, since no other machine sees such a folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("pagelake.scratch", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("pagelake.scratch", path)
    return path


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/pagelake/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, made: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.
    The folder's path is added to ``made``, for ``drop_tables``.
    """
    small_batches(df.sparkSession)
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Texts can be very long: at most BATCH_ROWS of them and about BATCH_BYTES in an Arrow batch, unless the session asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if (size := re.fullmatch(r"(\d+)b?", spark.conf.get(key))) and not 0 < int(size[1]) <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; after its last batch the worker returns freed memory to the system.

    Workers outlive their tasks, and an idle one would stay as large as its largest task.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
            trim(0)

    return whole


def drop_tables(spark: SparkSession, made: list[str]) -> None:
    """Delete stored tables that no result reads any more."""
    for path in made:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(doc_id long, text string) of a table with any other columns; null text is empty.

    With ``carry`` the whole row comes along as the struct ``row``.
    """
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")]
    return docs.select(*columns, *[F.struct(*docs.columns).alias("row")] * carry)


def map_texts(
    docs: DataFrame, rows_of: Callable[[list[str]], dict[str, list]], schema: str, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Run ``rows_of`` (a list of texts to equally long columns) over Arrow batches.

    ``schema`` holds the types of the new columns; ``keep`` columns pass through
    unchanged, so the number and identity of rows never change.
    """
    spark = docs.sparkSession
    small_batches(spark)
    new = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    out = docs.select(*keep).schema
    for field in new:
        out = out.add(field)
    names = [f.name for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for batch in batches:
            for part in _slices(batch):
                columns = rows_of(part.column("text").to_pylist())
                arrays = [part.column(k) for k in keep]
                arrays += [pa.array(columns[n], type=arrow.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow)], schema=arrow)

    return docs.mapInArrow(giving_back(run), out)


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on the machine that runs the task."""
    import public_tokenizers

    return public_tokenizers.path(name)
