"""Recognised texts: record rules, sections, segments of strips, matching to images, review.

Texts are rows (page_id or path, idx, text, x1..y2). Every rule is a column
expression; edits of a review are folded in their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G

COLS = list(G.Box._fields)
INTEGER = r"^\s*[+-]?\d+(_\d+)*\s*$"
MOST = 2**31 - 1


def _whole(c: Column) -> Column:
    """An integer as its text says (sign, blanks and single underscores allowed), else null."""
    digits = F.regexp_replace(F.trim(F.regexp_replace(c, r"\s", " ")), "_", "")
    return F.when(c.rlike(INTEGER), digits.try_cast("decimal(38,0)") if hasattr(digits, "try_cast") else digits.cast("decimal(38,0)"))


def validate_records(records: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of records (file_no, line, filename, startx..endy, text).

    Rules in this order: integers, size, corners swapped so that start <= end, file name. With ``strict``
    a file with an error gives no rows.
    """
    names = ("startx", "starty", "endx", "endy")
    whole = [_whole(F.col(n)) for n in names]
    not_int = whole[0].isNull() | whole[1].isNull() | whole[2].isNull() | whole[3].isNull()
    too_large = F.greatest(*(F.abs(c) for c in whole)) > MOST
    error = F.when(not_int, "INVALID_INT").when(too_large, "INT_TOO_LARGE").when(F.coalesce("filename", F.lit("")) == "", "EMPTY_FILENAME")
    marked = records.withColumn("error_code", error)
    context = F.concat_ws(",", "filename", *names)
    errors = marked.filter("error_code IS NOT NULL").select("file_no", "line", "error_code", context.alias("context"))
    good = marked.filter("error_code IS NULL")
    if strict:
        good = good.join(errors.select("file_no").distinct(), "file_no", "left_anti")
    box = G.normalize_corners(G.Box(*(c.cast("int") for c in whole)))
    return good.select("file_no", "line", "filename", *(c.alias(n) for c, n in zip(box, COLS)), "text"), errors


def parse_sections(files: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of whole texts (file_no, value): ``name:`` begins a section, the lines up to a blank one are its texts.

    Lines where a section should begin are errors; sections of one name merge; sections without texts vanish.
    """
    lines = files.select("file_no", F.posexplode(F.split("value", "\r\n|\n|\r")).alias("pos", "line"))
    line = F.trim(F.regexp_replace("line", r"\s", " "))
    lines = lines.withColumn("line", F.rtrim(line)).withColumn("blank", (F.col("line") == ""))
    block = F.count(F.when(F.col("blank"), 1)).over(W.partitionBy("file_no").orderBy("pos"))
    body = lines.withColumn("block", block).filter("NOT blank")
    header = F.col("line").endswith(":") & (F.length("line") > 1)
    in_block = W.partitionBy("file_no", "block")
    body = body.withColumn("head", F.min(F.when(header, F.col("pos"))).over(in_block))
    body = body.withColumn("name", F.max(F.when(F.col("pos") == F.col("head"), F.expr("trim(left(line, length(line) - 1))"))).over(in_block))
    lost = F.col("head").isNull() | (F.col("pos") < F.col("head"))
    errors = body.filter(lost).select("file_no", (F.col("pos") + 1).cast("long").alias("line"), F.lit("INVALID_PATH").alias("error_code"), F.col("line").alias("context"))
    good = body.filter(~lost & (F.col("pos") > F.col("head")))
    if strict:
        good = good.join(errors.select("file_no").distinct(), "file_no", "left_anti")
    none = [F.lit(-1).alias(c) for c in COLS]
    return good.select("file_no", (F.col("pos") + 1).cast("long").alias("line"), F.col("name").alias("filename"), *none, F.col("line").alias("text")), errors


def match_texts(images: DataFrame, texts: DataFrame, on_boundary: bool = False) -> DataFrame:
    """(image, fragment, status): an image's path ends with the fragment. status: matched, ambiguous, no_text, no_image.

    The lengths of fragments are few; each image gives one suffix per length, and an equi-join finds its fragments, at
    most one a length. From there on an image is one row. Matches of a fragment are counted with partial sums, so one
    that ends very many paths is a row a task. Repeated image rows stay repeated, and are ambiguous.
    """
    frags = texts.select("fragment").distinct()
    sizes = frags.agg(F.array_sort(F.collect_set(F.length("fragment")))).scalar()  # a number for each length
    cut = images.select("image", sizes.alias("sizes")).select("image", F.posexplode_outer("sizes").alias("pos", "size"))
    n, size, head = F.length("image"), F.col("size"), F.coalesce("pos", F.lit(0)) == 0  # the first suffix stands for its image
    fits = (size <= n) & ((size == n) | (F.substring("image", n - size, F.lit(1)) == "/") if on_boundary else F.lit(True))
    cut = cut.filter(head | fits).select("image", head.alias("head"), F.when(fits, F.expr("right(image, size)")).alias("suffix"))
    own = cut.join(frags, F.col("suffix") == F.col("fragment"), "left").filter("head OR fragment IS NOT NULL").groupBy("image")
    found = own.agg(F.count_if("head").alias("copies"), F.collect_set("fragment").alias("hits"))
    counts = found.select("copies", F.explode("hits").alias("fragment")).groupBy("fragment").agg(F.sum("copies").alias("n_f"))
    several = F.col("copies") * F.size("hits") > 1
    each = found.select("image", "copies", several.alias("several"), F.explode_outer("hits").alias("fragment")).join(counts, "fragment", "left")
    status = F.when(F.col("fragment").isNull(), "no_text").when(F.col("several") | (F.col("n_f") > 1), "ambiguous").otherwise("matched")
    out = each.select("image", "fragment", status.alias("status"), F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).drop("copy")
    no_image = frags.join(counts, "fragment", "left_anti").select(F.lit(None).cast("string").alias("image"), "fragment", F.lit("no_image").alias("status"))
    return out.unionByName(no_image)


def segment_offsets(segments: DataFrame) -> DataFrame:
    """Adds ``offset``: the heights of the earlier segments of the strip."""
    before = W.partitionBy("split_from").orderBy("segment_no").rowsBetween(W.unboundedPreceding, -1)
    return segments.withColumn("offset", F.coalesce(F.sum("height").over(before), F.lit(0)))


def attach_segments(segments: DataFrame, texts: DataFrame) -> DataFrame:
    """Every segment with its texts; segments without texts stay with null text."""
    return segments.join(texts, "page_id", "left")


def merge_segment_texts(texts: DataFrame, segments: DataFrame) -> DataFrame:
    """Texts (page_id, idx, text, x1..y2) on the strip they were cut from: shifted down, numbered by segment, then idx."""
    placed = segment_offsets(segments).select("page_id", "split_from", "segment_no", "offset").join(texts, "page_id")
    box = G.translate(G.box(), 0, F.col("offset"))
    order = W.partitionBy("split_from").orderBy("segment_no", "idx")
    return placed.select(
        "split_from", F.row_number().over(order).alias("idx"), "text", *(c.cast("long").alias(n) for c, n in zip(box, COLS))
    )


def replace_split_rows(rows: DataFrame, segments: DataFrame, merged: DataFrame) -> DataFrame:
    """Rows of segments go, merged rows come."""
    return rows.join(segments.select("page_id").distinct(), "page_id", "left_anti").unionByName(merged)


def review_start(texts: DataFrame) -> DataFrame:
    """Texts with a label (place on the page) and status Normal."""
    return texts.withColumn("label", F.row_number().over(W.partitionBy("page_id").orderBy("idx")).cast("string")).withColumn("status", F.lit("Normal"))


def apply_review_edits(results: DataFrame, edits: DataFrame, min_area: int = 400) -> DataFrame:
    """Results after ordered edits (page_id, label, seq, op, text, x1..y2), op being delete, edit, reset or add.

    delete: Normal <-> Removed, Edited <-> EditedRemoved, New vanishes. edit: sets the text, Normal -> Edited,
    Removed -> EditedRemoved. reset: original text, Normal. add: a new row "New k", k the lowest number of its page
    that is free at that edit; areas under ``min_area`` add nothing.
    """
    item = F.struct("seq", "op", F.col("text").alias("new"))
    is_new = F.coalesce(F.col("label").startswith("New "), F.lit(False))
    own = edits.filter(~is_new & (F.col("op") != "add")).groupBy("page_id", "label").agg(F.array_sort(F.collect_list(item)).alias("edits"))
    state = F.struct(F.col("text").alias("text"), F.col("status").alias("status"), F.lit(True).alias("alive"))

    def step(s: Column, e: Column) -> Column:
        flip = F.create_map(*(F.lit(x) for x in ("Normal", "Removed", "Removed", "Normal", "Edited", "EditedRemoved", "EditedRemoved", "Edited", "New", "New")))
        change = F.create_map(*(F.lit(x) for x in ("Normal", "Edited", "Removed", "EditedRemoved", "Edited", "Edited", "EditedRemoved", "EditedRemoved", "New", "New")))
        status = F.when(e["op"] == "delete", F.element_at(flip, s["status"])).when(e["op"] == "edit", F.element_at(change, s["status"])).otherwise(F.when(s["status"] == "New", F.lit("New")).otherwise(F.lit("Normal")))
        text = F.when(e["op"] == "edit", e["new"]).when(e["op"] == "reset", F.col("text")).otherwise(s["text"])
        alive = s["alive"] & ~((e["op"] == "delete") & (s["status"] == "New"))
        return F.struct(text.alias("text"), status.alias("status"), alive.alias("alive"))

    def fold_new(rows: Column, e: Column) -> Column:
        """A page's New rows after one more edit: a number is free again once its row is gone."""
        k = F.when(e["op"] == "add", F.array_min(F.array_except(F.sequence(F.lit(1), F.size(rows) + 1), F.transform(rows, lambda r: r["k"])))).otherwise(e["k"])
        made = F.struct(k.alias("k"), e["text"].alias("text"), e["text"].alias("original"), *(e[c].alias(c) for c in COLS))
        text = lambda r: F.when(e["op"] == "edit", e["text"]).otherwise(r["original"])
        changed = lambda r: F.struct(r["k"].alias("k"), text(r).alias("text"), r["original"].alias("original"), *(r[c].alias(c) for c in COLS))
        others = F.filter(rows, lambda r: r["k"] != k)
        edited = F.transform(rows, lambda r: F.when(r["k"] == k, changed(r)).otherwise(r))
        return F.when(e["op"].isin("add", "held"), F.concat(others, F.array(made))).when(e["op"] == "delete", others).otherwise(edited)

    numbered = F.col("label").rlike(r"^New \d{1,9}$")
    added = edits.filter("op = 'add'").filter(G.area(G.box()) >= min_area).withColumn("label", F.lit(None).cast("string"))
    changed = edits.filter((F.col("op") != "add") & numbered)
    seq = F.col("seq").cast("long").alias("seq")
    wide = lambda df, *first: df.select("page_id", *first, "label", "text", *COLS)
    held = wide(results.filter((F.col("status") == "New") & numbered), F.lit("held").alias("op"), F.lit(-(2**62)).cast("long").alias("seq"))
    asked = held.unionByName(wide(added, "op", seq)).unionByName(wide(changed, "op", seq))
    number = F.substring("label", 5, 9).cast("int").alias("k")
    ordered = F.array_sort(F.collect_list(F.struct("seq", "op", number, "text", *(F.col(c).cast("int").alias(c) for c in COLS))))
    none = F.array().cast("array<struct<k:int,text:string,original:string,x1:int,y1:int,x2:int,y2:int>>")
    pages = asked.groupBy("page_id").agg(ordered.alias("asked"))
    new = pages.select("page_id", F.explode(F.aggregate("asked", none, fold_new)).alias("r"))
    new = new.select("page_id", F.concat(F.lit("New "), F.col("r.k").cast("string")).alias("label"), "r.text", *(f"r.{c}" for c in COLS), F.lit("New").alias("status"))
    older = results.filter(~((F.col("status") == "New") & numbered)).select("page_id", "label", "text", *COLS, "status")
    folded = older.join(own, ["page_id", "label"], "left").withColumn("s", F.aggregate(F.coalesce("edits", F.array()), state, step))
    kept = folded.filter("s.alive").select("page_id", "label", F.col("s.text").alias("text"), *COLS, F.col("s.status").alias("status"))
    return kept.unionByName(new)


def review_finish(results: DataFrame, drop_edited_removed: bool = False) -> DataFrame:
    """Results without those of status Removed, with the number left on their page; pages without any vanish."""
    gone = ["Removed", "EditedRemoved"] if drop_edited_removed else ["Removed"]
    return results.filter(~F.col("status").isin(gone)).withColumn("n_boxes", F.count("*").over(W.partitionBy("page_id")))


def finalize_mapping(matches: DataFrame, selected: DataFrame) -> DataFrame:
    """(image, fragment): selected images, with the text they match (null: an empty record); others lose theirs."""
    return selected.join(matches.filter("status = 'matched'").select("image", "fragment"), "image", "left").select("image", "fragment")


def one_line(text: Column) -> Column:
    """Line ends become a literal backslash n."""
    return F.regexp_replace(text, "\r\n|\r|\n", r"\\n")


def csv_rows(texts: DataFrame) -> DataFrame:
    """(path, idx, record): CSV records, quoted only where needed; line ends in texts become a literal backslash n."""
    text = F.regexp_replace(one_line(F.col("text")), '"', '""')
    quoted = lambda c: F.when(c.rlike('[",\\n\\r]'), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(c)
    return texts.select("path", "idx", F.concat_ws(",", quoted(F.col("path")), *(F.col(c).cast("string") for c in COLS), quoted(text)).alias("record"))


def text_sections(texts: DataFrame) -> DataFrame:
    """(path, section): a heading and the page's texts in order, one line each."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda s: s["text"])
    return texts.groupBy("path").agg(rows.alias("t")).select("path", F.concat(F.col("path"), F.lit(":\n"), F.array_join("t", "\n"), F.lit("\n")).alias("section"))
