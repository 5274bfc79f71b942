"""User functions: recognition and detection engines over images, in Arrow batches.

An engine is made by a factory once a worker and kept there. Text engines turn a
list of image bytes into texts; detectors turn one image into blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .rules import clean_ocr_text

Engine = Callable[[list[bytes]], list[str]]


def run_ocr(crops: DataFrame, factories: dict[str, Callable[[], Engine]]) -> DataFrame:
    """(image_id, idx, text): crops (image_id, idx, engine, data) read by the engine of their row; texts are cleaned.

    Rows are dealt by engine and a hash of the image, so a task loads few engines and no engine is one task.
    """
    made: dict[str, Engine] = {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, part in pdf.groupby("engine", sort=False):
                if name not in made:
                    made[name] = factories[name]()
                yield pd.DataFrame({"image_id": part["image_id"], "idx": part["idx"], "text": made[name]([bytes(d) for d in part["data"]])})

    dealt = crops.select("image_id", "idx", "engine", "data").repartition("engine", F.pmod(F.xxhash64("image_id"), F.lit(64)))
    return dealt.mapInPandas(run, "image_id long, idx int, text string").withColumn("text", clean_ocr_text(F.col("text")))


def run_detector(images: DataFrame, factory: Callable[[], Callable[[bytes, int, int], list[dict]]]) -> DataFrame:
    """(image_id, idx, x1, y1, x2, y2, language): blocks of images (image_id, h, w, data) by a detector."""
    made: list = []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not made:
            made.append(factory())
        for pdf in batches:
            out = [
                (r.image_id, k, *b["xyxy"], b.get("language")) for r in pdf.itertuples() for k, b in enumerate(made[0](bytes(r.data), r.h, r.w))
            ]
            yield pd.DataFrame(out, columns=["image_id", "idx", "x1", "y1", "x2", "y2", "language"])

    return images.select("image_id", "h", "w", "data").mapInPandas(run, "image_id long, idx int, x1 int, y1 int, x2 int, y2 int, language string")


#: What a detector finds on a page; lines are eight coordinates, corners clockwise from the upper left.
FOUND = "image_id long, blocks array<struct<idx:int,x1:int,y1:int,x2:int,y2:int,language:string>>, lines array<array<double>>, mask struct<h:int,w:int,data:binary>"


def detect_pages(images: DataFrame, factory: Callable[[], Callable[[bytes, int, int], dict]]) -> DataFrame:
    """One row of ``FOUND`` an image (image_id, h, w, data), from a detector of blocks, lines and text mask.

    The detector gives a dict: ``blocks`` (xyxy, language), ``lines`` (four corners each) and ``mask`` (a two-dimensional
    uint8 array of any size, or none). Images are few to an Arrow batch by its limit of bytes; pixels don't move.
    """
    made: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(factory())
        for batch in batches:
            for row in batch.to_pylist():
                found = made[0](row["data"], row["h"], row["w"])
                blocks = [dict(zip(("idx", "x1", "y1", "x2", "y2"), (k, *map(int, b["xyxy"])))) | {"language": b.get("language")} for k, b in enumerate(found.get("blocks", ()))]
                lines = [[float(v) for corner in line for v in corner] for line in found.get("lines", ())]
                mask = found.get("mask")
                packed = None if mask is None else {"h": mask.shape[0], "w": mask.shape[1], "data": mask.tobytes()}
                out = {"image_id": row["image_id"], "blocks": blocks, "lines": lines, "mask": packed}
                yield pa.RecordBatch.from_pylist([out], schema=to_arrow_schema(kinds))

    kinds = images.sparkSession.createDataFrame([], FOUND).schema
    return images.select("image_id", "h", "w", "data").mapInArrow(run, FOUND)


def blocks_of(found: DataFrame) -> DataFrame:
    """(page_id, idx, x1, y1, x2, y2, lang) of detected pages."""
    each = found.select(F.col("image_id").alias("page_id"), F.explode("blocks").alias("b"))
    return each.select("page_id", "b.idx", "b.x1", "b.y1", "b.x2", "b.y2", F.col("b.language").alias("lang"))


def lines_of(found: DataFrame) -> DataFrame:
    """(page_id, line_no from 0, qx1, qy1, ..., qx4, qy4) of detected pages."""
    each = found.select(F.col("image_id").alias("page_id"), F.posexplode("lines").alias("line_no", "q"))
    return each.select("page_id", "line_no", *(F.col("q")[2 * k + i].alias(f"q{axis}{k + 1}") for k in range(4) for i, axis in enumerate("xy")))


def masks_of(found: DataFrame) -> DataFrame:
    """(page_id, h, w, data) of detected pages that have a mask."""
    return found.filter("mask IS NOT NULL").select(F.col("image_id").alias("page_id"), "mask.*")
