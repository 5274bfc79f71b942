"""Sources and sinks: image listings, side-files of detections and masks, text files, logs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.errors import AnalysisException

from ..operators import texts as X
from ..operators.logs import START, numbered_sessions

#: Suffixes of images that can be read.
IMAGES = (".jpeg", ".jpg", ".png", ".bmp", ".tiff", ".tif", ".jp2", ".dib", ".webp", ".ppm")
#: Columns of a text table.
TEXT_COLUMNS = ("filename", "startx", "starty", "endx", "endy", "text")
#: TIFF files with so many samples a pixel are left out.
BAD_SAMPLES = 5

BLOCK = T.StructType(
    [
        T.StructField("xyxy", T.ArrayType(T.IntegerType())),
        T.StructField("lines", T.ArrayType(T.ArrayType(T.ArrayType(T.IntegerType())))),
        T.StructField("language", T.StringType()),
        T.StructField("vertical", T.BooleanType()),
        T.StructField("font_size", T.DoubleType()),
        T.StructField("distance", T.ArrayType(T.DoubleType())),
        T.StructField("angle", T.IntegerType()),
        T.StructField("vec", T.ArrayType(T.DoubleType())),
        T.StructField("norm", T.DoubleType()),
    ]
)
RAW = T.StructType([*(T.StructField(n, T.StringType()) for n in ("image_path", "mask_path", "original_path")), T.StructField("scale", T.DoubleType())])
PAGE = T.StructType(
    [
        *RAW.fields,
        T.StructField("box_language", T.ArrayType(T.StringType())),
        *(T.StructField(n, T.ArrayType(T.ArrayType(T.IntegerType()))) for n in ("boxes", "extended_boxes", "merged_extended_boxes", "reference_boxes")),
    ]
)
DETECTIONS = T.StructType([*RAW.fields, T.StructField("blk_list", T.ArrayType(BLOCK))])


def has_suffix(path: Column, suffixes: tuple[str, ...] = IMAGES) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0)).isin(list(suffixes))


def discover_images(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) files of folders, not their subfolders; a missing path raises. Only names are read."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "length")
    return files.filter(has_suffix(F.col("path"))), files.filter(~has_suffix(F.col("path")))


def tiff_samples(data: bytes) -> int | None:
    """Samples a pixel (tag 277) of a TIFF header, None for other data."""
    order = {b"II*\0": "little", b"MM\0*": "big"}.get(data[:4])
    if order is None or len(data) < 8:
        return None
    num = lambda at, n: int.from_bytes(data[at : at + n], order)
    at = num(4, 4)
    return next((num(p + 8, 2) for p in range(at + 2, at + 2 + 12 * num(at, 2), 12) if num(p, 2) == 277), 1)


def reject_multichannel_tiff(files: DataFrame) -> DataFrame:
    """Files (path, content, ...) without TIFFs of five samples a pixel; the suffix test heeds case."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tiff = pdf["path"].str.endswith((".tif", ".tiff"))
            yield pdf[[not (t and tiff_samples(bytes(c)) == BAD_SAMPLES) for t, c in zip(tiff, pdf["content"])]]

    return files.mapInPandas(run, files.schema)


def read_images(spark: SparkSession, *paths: str) -> DataFrame:
    """Decoded images (struct ``image``)."""
    return spark.read.format("image").option("dropInvalid", True).load(list(paths))


def image_rasters(images: DataFrame) -> DataFrame:
    """(image_id, h, w, data) of decoded images, as the raster operators take them: one grey byte a pixel.

    Images of three and four channels (blue first) become integer luminance; alpha is left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            data = []
            for h, w, n, raw in zip(pdf["h"], pdf["w"], pdf["n"], pdf["raw"]):
                px = np.frombuffer(raw, np.uint8).reshape(h, w, n).astype(np.int64)
                grey = px[:, :, 0] if n == 1 else (299 * px[:, :, 2] + 587 * px[:, :, 1] + 114 * px[:, :, 0]) // 1000
                data.append(grey.astype(np.uint8).tobytes())
            yield pd.DataFrame({"image_id": pdf["image_id"], "h": pdf["h"], "w": pdf["w"], "data": data})

    flat = images.select(F.col("image.origin").alias("image_id"), F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("n"), F.col("image.data").alias("raw"))
    return flat.mapInPandas(run, "image_id string, h int, w int, data binary")


def read_detections(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, blocks, lines) of raw detection documents; blocks and lines carry their place from 0."""
    return detection_rows(spark.read.schema(DETECTIONS).option("multiLine", True).option("pathGlobFilter", "*#raw.json").json(path))


def parse_detections(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same of documents in a column ``value``."""
    return detection_rows(texts.select(F.from_json("value", DETECTIONS).alias("d")).select("d.*"))


def detection_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    blocks = docs.select("original_path", F.posexplode("blk_list").alias("idx", "b")).select(
        "original_path", "idx", *(F.get("b.xyxy", F.lit(i)).alias(n) for i, n in enumerate(X.COLS)), *(f"b.{n}" for n in BLOCK.names[1:])
    )
    lines = blocks.select("original_path", F.col("idx").alias("block_idx"), F.posexplode("lines").alias("line_no", "points"))
    return docs.drop("blk_list"), blocks.drop("lines"), lines


def read_page_boxes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE).option("multiLine", True).option("pathGlobFilter", "*#clean.json").json(path)


def write_page_boxes(pages: DataFrame, path: str) -> None:
    """One JSON document a line; null languages stay null."""
    pages.select(F.to_json(F.struct(*PAGE.names), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def parse_page_boxes(text: DataFrame) -> DataFrame:
    return text.select(F.from_json("value", PAGE).alias("p")).select("p.*")


def mask_stats_json(stats: DataFrame) -> DataFrame:
    """(page_id, value): rows of a page as [[x1, y1, x2, y2], deviation, failed, thickness] in idx order."""
    item = F.concat(
        F.lit("["), F.to_json(F.array(*X.COLS)), F.lit(", "), F.col("dev").cast("string"), F.lit(", "), F.col("failed").cast("string"),
        F.lit(", "), F.coalesce(F.col("thickness").cast("string"), F.lit("null")), F.lit("]"),
    )
    rows = F.transform(F.array_sort(F.collect_list(F.struct("idx", item.alias("j")))), lambda s: s["j"])
    return stats.groupBy("page_id").agg(F.concat(F.lit('{"boxes_with_stats": ['), F.array_join(rows, ", "), F.lit("]}")).alias("value"))


def parse_mask_stats(texts: DataFrame) -> DataFrame:
    """(page_id, idx from 0, x1..y2, dev, failed, thickness) of such documents."""
    items = F.from_json(F.get_json_object("value", "$.boxes_with_stats"), "array<string>")
    rows = texts.select("page_id", F.posexplode(items).alias("idx", "j")).withColumn("v", F.from_json("j", "array<string>"))
    box = F.from_json(F.get("v", F.lit(0)), "array<int>")
    get = lambda i: F.get("v", F.lit(i))
    return rows.select(
        "page_id", "idx", *(F.get(box, F.lit(i)).alias(n) for i, n in enumerate(X.COLS)), get(1).cast("double").alias("dev"), get(2).cast("boolean").alias("failed"), get(3).cast("int").alias("thickness")
    )


def read_split_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(split_from, segment_no from 1, segment_path) of a map from originals to segments."""
    return parse_split_manifest(spark.read.text(path, wholetext=True))


def parse_split_manifest(texts: DataFrame) -> DataFrame:
    """The same of documents in a column ``value``."""
    each = texts.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("split_from", "s"))
    return each.select("split_from", F.posexplode("s").alias("n", "segment_path")).select("split_from", (F.col("n") + 1).alias("segment_no"), "segment_path")


def split_manifest_json(segments: DataFrame) -> DataFrame:
    """(value): one map from an original to its segments in order."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("segment_no", "segment_path"))), lambda s: s["segment_path"])
    one = segments.groupBy("split_from").agg(rows.alias("s"))
    return one.select(F.to_json(F.create_map("split_from", "s")).alias("value"))


def write_split_manifest(segments: DataFrame, path: str) -> None:
    split_manifest_json(segments).write.text(path)


def whole_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(files, errors): whole texts (file_no, value), and a row for each file that breaks while it is read (OS_ERROR) or is not UTF-8 (OTHER_ERROR).

    Such a file ends no job: the reader passes over it, and it is found as one that was listed, without its bytes, but not read.
    """
    name = F.col("_metadata.file_path").alias("file_no")
    passes = {"ignoreCorruptFiles": True, "ignoreMissingFiles": True}
    seen = spark.read.options(**passes).text(path, wholetext=True).select(name, "value", F.is_valid_utf8("value").alias("valid"))
    listed = spark.read.options(**passes).format("binaryFile").load(path).filter("length > 0").select(name)
    lost = listed.join(seen.select("file_no"), "file_no", "left_anti").select("file_no", F.lit("OS_ERROR").alias("error_code"), F.lit("cannot be read").alias("context"))
    other = seen.filter("NOT valid").select("file_no", F.lit("OTHER_ERROR").alias("error_code"), F.lit("not UTF-8").alias("context"))
    errors = lost.unionByName(other).select("file_no", F.lit(-1).cast("long").alias("line"), "error_code", "context")
    return seen.filter("valid").select("file_no", "value"), errors


def read_ocr_csv(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of CSV files of six columns; quoted records may span lines. A bad header is error line 1."""
    names = ("filename", "startx", "starty", "endx", "endy", "text")
    schema = "file_no string, line long, n_columns int, " + ", ".join(f"{n} string" for n in names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv
        import io

        for pdf in batches:
            out = []
            for file, value in zip(pdf["file_no"], pdf["value"]):
                for k, r in enumerate(csv.reader(io.StringIO(value, newline="")), 1):
                    out.append((file, k, len(r), *(r[:6] + [None] * (6 - len(r[:6])))))
            yield pd.DataFrame(out, columns=["file_no", "line", "n_columns", *names])

    files, lost = whole_files(spark, path)
    records = files.mapInPandas(run, schema)
    header_bad = (F.col("line") == 1) & ((F.col("n_columns") != 6) | F.coalesce(F.exists(F.array(*names), lambda c: c.rlike(r"^\d+$")), F.lit(False)))
    bad = records.filter(header_bad | (F.col("n_columns") != 6))
    context = F.concat_ws(",", *names)
    wrong = bad.select("file_no", "line", F.when(F.col("line") == 1, "INVALID_HEADER").otherwise("WRONG_COLUMN_COUNT").alias("error_code"), context.alias("context"))
    rows, errors = X.validate_records(records.filter("line > 1 AND n_columns = 6"), strict)
    if strict:
        rows = rows.join(wrong.select("file_no").distinct(), "file_no", "left_anti")
    return rows, errors.unionByName(wrong).unionByName(lost)


def read_ocr_text(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    files, lost = whole_files(spark, path)
    rows, errors = X.parse_sections(files, strict)
    return rows, errors.unionByName(lost)


def read_ocr(spark: SparkSession, *paths: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) by suffix: .csv, .txt, else an INVALID_FORMAT error row; a path that is not there gives an OS_ERROR row, one that Spark cannot open OTHER_ERROR. Files that break while they are read: see ``whole_files``."""
    kinds = {".csv": read_ocr_csv, ".txt": read_ocr_text}
    rows = errors = None
    for p in paths:
        kind, code, context = kinds.get(p[-4:].lower()), "INVALID_FORMAT", ""
        r = None
        if kind:
            try:
                r, e = kind(spark, p, strict)
            except AnalysisException as x:  # raised while the path is listed, before any file is read
                code, context = ("OS_ERROR" if "PATH_NOT_FOUND" in str(x) else "OTHER_ERROR"), str(x).split("\n")[0]
        if r is None:
            e = spark.createDataFrame([(p, -1, code, context)], "file_no string, line long, error_code string, context string")
        rows = rows if r is None else r if rows is None else rows.unionByName(r)
        errors = e if errors is None else errors.unionByName(e)
    if rows is None:
        rows = spark.createDataFrame([], "file_no string, line long, filename string, x1 int, y1 int, x2 int, y2 int, text string")
    return rows, errors


def write_ocr_csv(rows: DataFrame, path: str) -> None:
    """Texts (path, idx, x1..y2, text) as CSV files in natural path order, dealt by ranges; each file begins with the header.

    Cells are quoted only where needed; line ends in texts become a literal backslash n.
    """
    from ..operators.analytics import natural_key

    ordered = rows.withColumn("k", natural_key(F.col("path"))).repartitionByRange("k").sortWithinPartitions("k", "path", "idx")
    cells = [F.col("path"), *(F.col(c) for c in X.COLS), X.one_line(F.col("text"))]
    named = ordered.select(*(c.alias(n) for c, n in zip(cells, TEXT_COLUMNS)))
    plain = {"header": True, "quote": '"', "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    named.write.options(**plain).csv(path)


def write_ocr_text(rows: DataFrame, path: str) -> None:
    from ..operators.analytics import natural_key

    ordered = X.text_sections(rows).withColumn("k", natural_key(F.col("path"))).repartitionByRange("k").sortWithinPartitions("k", "path")
    ordered.select(F.col("section").alias("value")).write.text(path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_id"), "value")


def log_records(lines: DataFrame) -> DataFrame:
    """(source_id, size, block, text) of log files read with the start marker as line separator: the reader splits large files at markers."""
    meta = {"source_id": "file_path", "size": "file_size", "block": "file_block_start"}
    return lines.select(*(F.col(f"_metadata.{c}").alias(n) for n, c in meta.items()), F.col("value").alias("text"))


def read_log_sessions(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, session, text) of log files, as ``log_sessions`` gives them of whole texts.

    A file is read by as many tasks as it has blocks of ``spark.sql.files.maxPartitionBytes``; a row is a session, never a file.
    """
    return numbered_sessions(log_records(spark.read.option("lineSep", START).text(path)))


def stream_log_sessions(spark: SparkSession, folder: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Append the sessions of each new log file in ``folder`` to ``sink``, once."""
    records = log_records(spark.readStream.option("lineSep", START).text(folder))

    def put(batch: DataFrame, _: int) -> None:
        numbered_sessions(batch).write.mode("append").parquet(sink)

    return records.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
