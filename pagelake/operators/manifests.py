"""Manifests: pairing of side-files, stale outputs, export targets, label files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.rules import id_from_path, parent


def pair_documents(pages: DataFrame, masks: DataFrame) -> DataFrame:
    """(uid, page, mask, status): paths of both sides by the id before the first underscore; orphans are errors."""
    a = pages.select(id_from_path(F.col("path")).alias("uid"), F.col("path").alias("page"))
    b = masks.select(id_from_path(F.col("path")).alias("uid"), F.col("path").alias("mask"))
    status = F.when(F.col("page").isNull(), "no_page").when(F.col("mask").isNull(), "no_mask").otherwise("paired")
    return a.join(b, "uid", "full").withColumn("status", status)


def pair_boxes(masks: DataFrame, references: DataFrame) -> DataFrame:
    """Mask and reference boxes of a page by position; the longer list is cut."""
    b = references.select("page_id", "idx", *(F.col(c).alias(f"ref_{c}") for c in G.Box._fields))
    return masks.join(b, ["page_id", "idx"])


def find_artifacts(exports: DataFrame, files: DataFrame, suffixes: list[str]) -> DataFrame:
    """(uid, file): files that begin with an export's id and end with one of the suffixes; exports without one have null."""
    name = F.element_at(F.split("file", "/"), -1)
    ending = F.lit(False)
    for s in suffixes:
        ending = ending | name.endswith(s)
    found = files.filter(ending).select(F.split(name, "_").getItem(0).alias("uid"), "file")
    return exports.select("uid").join(found, "uid", "left")


def stale_outputs(wanted: DataFrame, outputs: DataFrame, params: DataFrame) -> DataFrame:
    """(page_id, output, reason): wanted outputs that are missing or were made with other parameters.

    ``params`` has the current digest of each output's own parameters.
    """
    have = outputs.select("page_id", "output", F.col("params").alias("made_with"))
    both = wanted.join(have, ["page_id", "output"], "left").join(params, "output")
    reason = F.when(F.col("made_with").isNull(), "missing").when(F.col("made_with") != F.col("params"), "changed")
    return both.select("page_id", "output", reason.alias("reason")).filter("reason IS NOT NULL")


def stale_steps(wanted: DataFrame, outputs: DataFrame, params: DataFrame, steps: dict[str, tuple[str, ...]]) -> DataFrame:
    """(page_id, step): steps to run again on the pages of ``wanted``.

    ``steps`` has the outputs of each step, the one that stands for it last. A step runs again if one of its wanted
    outputs is stale; where none of its outputs is wanted, if its last one is.
    """
    each = [F.struct(F.lit(step).alias("step"), F.array(*map(F.lit, kinds)).alias("kinds")) for step, kinds in steps.items()]
    pages = wanted.groupBy("page_id").agg(F.collect_set("output").alias("asked")).select("page_id", "asked", F.explode(F.array(*each)).alias("s"))
    asked = F.array_intersect("s.kinds", "asked")
    needed = pages.select("page_id", "s.step", F.explode(F.when(F.size(asked) > 0, asked).otherwise(F.slice("s.kinds", -1, 1))).alias("output"))
    stale = stale_outputs(needed.select("page_id", "output").distinct(), outputs, params)
    return needed.join(stale.select("page_id", "output"), ["page_id", "output"], "left_semi").select("page_id", "step").distinct()


def params_digest(params: DataFrame, *names: str) -> DataFrame:
    """Adds ``params``: a digest of the named parameters."""
    return params.withColumn("params", F.sha2(F.to_json(F.struct(*names)), 256))


#: Category -> outputs from the least to the most finished.
CATEGORIES = {"clean": ("masked", "denoised", "inpainted"), "mask": ("box_mask", "final_mask"), "text": ("text",)}


def highest_outputs(outputs: DataFrame) -> DataFrame:
    """(page_id, category, output): the most finished output that exists in each category."""
    rank = category = F.lit(None)
    for name, kinds in CATEGORIES.items():
        for k, kind in enumerate(kinds):
            rank = F.when(F.col("output") == kind, F.lit(k)).otherwise(rank)
            category = F.when(F.col("output") == kind, F.lit(name)).otherwise(category)
    rows = outputs.withColumn("rank", rank).withColumn("category", category).filter("category IS NOT NULL")
    return rows.groupBy("page_id", "category").agg(F.max_by("output", "rank").alias("output"))


def export_targets(outputs: DataFrame, only: str | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, outputs): pages with something to export, the best of each category, by name."""
    best = highest_outputs(outputs.filter(~F.col("output").isin(list(skip))) if skip else outputs)
    if only:
        best = best.filter(F.col("category") == only)
    return best.groupBy("page_id").agg(F.sort_array(F.collect_list("output")).alias("outputs"))


def common_outputs(targets: DataFrame, segments: DataFrame) -> DataFrame:
    """(split_from, output, place): outputs that every segment of a strip has, and where the first segment lists them, from 0.

    Segments have ``segment_no``. An output that a segment lists twice counts once.
    """
    n = segments.groupBy("split_from").agg(F.count("*").alias("n"))
    each = segments.select("page_id", "split_from", "segment_no").join(targets.select("page_id", F.array_distinct("outputs").alias("outputs")), "page_id")
    each = each.select("split_from", "segment_no", F.posexplode("outputs").alias("place", "output"))
    found = each.groupBy("split_from", "output").agg(F.count("*").alias("m"), F.min_by("place", "segment_no").alias("place"))
    return found.join(n, "split_from").filter("m = n").select("split_from", "output", "place")


def merge_export_targets(targets: DataFrame, segments: DataFrame) -> DataFrame:
    """(split_from, complete, outputs): strips whose segments all have targets collapse to one, outputs in the first segment's order; others are reported."""
    have = targets.select("page_id", F.lit(1).alias("hit"))
    n = segments.join(have, "page_id", "left").groupBy("split_from").agg(F.count("*").alias("n"), F.count("hit").alias("m"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "output"))), lambda s: s["output"])
    common = common_outputs(targets, segments).groupBy("split_from").agg(listed.alias("outputs"))
    complete = F.col("n") == F.col("m")
    return n.join(common, "split_from", "left").select("split_from", complete.alias("complete"), F.when(complete, F.coalesce("outputs", F.array().cast("array<string>"))).alias("outputs"))


def grafted_targets(targets: DataFrame, segments: DataFrame) -> DataFrame:
    """Targets (path, ...) with ``export_path``, where segments aren't merged: a segment's own name in its original's folder, else the path itself.

    ``segments``: (split_from, segment_path), the paths of originals and segments.
    """
    origin = segments.select(F.col("segment_path").alias("path"), F.col("split_from").alias("_from")).dropDuplicates(["path"])
    name = F.element_at(F.split("path", "/"), -1)
    grafted = F.when(F.col("_from").isNotNull(), F.concat(parent(F.col("_from")), F.lit("/"), name)).otherwise(F.col("path"))
    return targets.join(origin, "path", "left").withColumn("export_path", grafted).drop("_from")


def engine_languages(*engines: DataFrame) -> DataFrame:
    """(lang): every language that at least one of the engines' tables has."""
    every = engines[0].select("lang")
    for e in engines[1:]:
        every = every.unionByName(e.select("lang"))
    return every.filter("lang IS NOT NULL").distinct()


def supported_languages(engines: DataFrame, requested: DataFrame) -> DataFrame:
    """(lang): requested languages that no engine has."""
    return requested.select("lang").distinct().join(engines.select("lang").distinct(), "lang", "left_anti")


def yolo_labels(boxes: DataFrame, w: int, h: int) -> DataFrame:
    """(page_id, lines): one line a box, class 1, center and size as shares with six places."""
    shares = [F.format_string("%.6f", c.cast("double")) for c in G.xyxy_to_yolo(G.box(), F.lit(w), F.lit(h))]
    line = F.concat_ws(" ", F.lit("1"), *shares)
    return _per_page(boxes.select("page_id", F.struct("idx", line.alias("line")).alias("s")))


def line_polygons(lines: DataFrame) -> DataFrame:
    """(page_id, lines): eight integers a text line."""
    b = G.box()
    line = F.concat_ws(",", *(c.cast("string") for c in (b.x1, b.y1, b.x2, b.y1, b.x2, b.y2, b.x1, b.y2)))
    return _per_page(lines.select("page_id", F.struct("block_idx", "line_no", line.alias("line")).alias("s")))


def _per_page(rows: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list("s"))
    return rows.groupBy("page_id").agg(F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("lines"))
