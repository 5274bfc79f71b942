"""Analytics of the steps: totals, ratios, histograms, per-page figures.

Ratios are null where their denominator is 0; empty tables give one row of zeros
for totals and no rows per page. Histograms keep buckets without values.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rules import badge


def share(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def count_if(c: Column) -> Column:
    return F.count(F.when(c, F.lit(1)))


def fixed_rows(like: DataFrame, name: str, values: list[int]) -> DataFrame:
    """One row for each value, made inside the plan: counts of at most these values may be broadcast to it."""
    return like.sparkSession.range(0, 1, 1, 1).select(F.explode(F.array(*map(F.lit, values))).alias(name))


def ocr_summary(boxes: DataFrame) -> DataFrame:
    """Totals of (checked, removed) regions: total, small, removed and the three ratios."""
    t = boxes.agg(F.count("*").alias("total"), count_if(F.col("checked")).alias("small"), count_if(F.col("removed")).alias("removed"))
    return t.select(
        "*",
        share(F.col("small"), F.col("total")).alias("small_of_total"),
        share(F.col("removed"), F.col("total")).alias("removed_of_total"),
        share(F.col("removed"), F.col("small")).alias("removed_of_small"),
    )


def size_histogram(boxes: DataFrame, overflow: bool = False) -> DataFrame:
    """(bucket, lower, small, removed): areas of checked and of removed regions in buckets.

    Buckets are 500 wide up to a largest area of 5000, else a tenth of it; they end before
    floor(max / width), so the tail is shown only with ``overflow``, as the last row.
    """
    checked = boxes.filter("checked")
    top = checked.agg(F.max("area").alias("top"), F.min("area").alias("low"))
    width = F.when(F.col("top") < 5000, F.lit(500)).otherwise(F.floor(F.col("top") / 10))
    edges = top.select(width.alias("width"), F.floor(F.col("low") / width).alias("first"), F.floor(F.col("top") / width).alias("last"))  # one row
    last = F.col("last") - (0 if overflow else 1)
    buckets = edges.filter(last >= F.col("first")).select("width", F.explode(F.sequence("first", last)).alias("bucket"))
    counts = (
        checked.crossJoin(F.broadcast(edges))
        .groupBy(F.least(F.floor(F.col("area") / F.col("width")), F.col("last")).alias("bucket"))
        .agg(F.count("*").alias("small"), count_if(F.col("removed")).alias("removed"))
    )
    joined = buckets.join(counts, "bucket", "left")
    return joined.select("bucket", (F.col("bucket") * F.col("width")).alias("lower"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("small", "removed")))


def mask_summary(fits: DataFrame) -> DataFrame:
    good = ~F.col("failed")
    t = fits.agg(
        F.count("*").alias("total"), count_if(good).alias("succeeded"), count_if(F.col("failed")).alias("failed"),
        count_if(good & (F.col("dev") == 0)).alias("perfect"), F.avg(F.when(good, F.col("dev"))).alias("mean_dev"),
    )
    return t.select("*", share(F.col("succeeded"), F.col("total")).alias("success_rate"), share(F.col("perfect"), F.col("succeeded")).alias("perfect_rate"))


def mask_usage_by_thickness(fits: DataFrame, first: int = 4, step: int = 2, steps: int = 11) -> DataFrame:
    """(mask, perfect, total) for every configured thickness, the box mask (-1) and failures (-2); zero rows included."""
    masks = [*(first + step * i for i in range(steps)), -1, -2]
    kinds = fixed_rows(fits, "mask", masks)
    mask = F.when(F.col("failed"), F.lit(-2)).otherwise(F.coalesce("thickness", F.lit(-1)))
    counts = fits.select("dev", "failed", mask.alias("mask")).filter(F.col("mask").isin(masks)).groupBy("mask").agg(count_if(~F.col("failed") & (F.col("dev") == 0)).alias("perfect"), F.count("*").alias("total"))
    return kinds.join(F.broadcast(counts), "mask", "left").select("mask", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("perfect", "total")))


def pages_with_failures(fits: DataFrame) -> DataFrame:
    """(page_id, failed, total) of pages with a failure."""
    return fits.groupBy("page_id").agg(count_if(F.col("failed")).alias("failed"), F.count("*").alias("total")).filter("failed > 0")


def denoise_summary(fits: DataFrame, threshold: float = 0.25) -> DataFrame:
    t = fits.filter(~F.col("failed")).agg(F.count("*").alias("total"), count_if(F.col("dev") > threshold).alias("above"))
    return t.select("*", share(F.col("above"), F.col("total")).alias("ratio"))


def cubic_histogram(fits: DataFrame, top: float = 15.0, threshold: float = 0.25) -> DataFrame:
    """(bucket, upper, below, above): ten half-open buckets with upper edges top / 1000 * i ** 3; the top value falls out."""
    edges = [top / 1000 * i**3 for i in range(11)]
    dev = F.col("dev")
    bucket = F.lit(None).cast("int")
    for i in range(10, 0, -1):
        bucket = F.when((dev >= edges[i - 1]) & (dev < edges[i]), F.lit(i)).otherwise(bucket)
    counts = fits.filter(~F.col("failed")).groupBy(bucket.alias("bucket")).agg(count_if(dev <= threshold).alias("below"), count_if(dev > threshold).alias("above"))
    upper = F.element_at(F.array(*map(F.lit, edges[1:])), F.col("bucket"))
    return fixed_rows(fits, "bucket", list(range(1, 11))).join(F.broadcast(counts), "bucket", "left").select("bucket", upper.alias("upper"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("below", "above")))


def inpaint_summary(fits: DataFrame) -> DataFrame:
    return fits.agg(F.count("*").alias("total"), F.avg("thickness").alias("mean_thickness"))


def thickness_histogram(fits: DataFrame, low: int, high: int) -> DataFrame:
    """(thickness, n) of every whole value from low to high."""
    counts = fits.filter(F.col("thickness").between(low, high)).groupBy("thickness").agg(F.count("*").alias("n"))
    return fixed_rows(fits, "thickness", list(range(low, high + 1))).join(F.broadcast(counts), "thickness", "left").select("thickness", F.coalesce("n", F.lit(0)).alias("n"))


def page_badges(ocr: DataFrame, fits: DataFrame, min_dev: float = 0.25, inpaint_dev: float = 15.0) -> DataFrame:
    """Per page: removed of regions, failed and perfect of masks, denoised of masks, inpainted; as short texts."""
    a = ocr.groupBy("page_id").agg(count_if(F.col("removed")).alias("removed"), F.count("*").alias("boxes"))
    good = ~F.col("failed")
    b = fits.groupBy("page_id").agg(
        count_if(F.col("failed")).alias("failed"), count_if(good & (F.col("dev") == 0)).alias("perfect"), F.count("*").alias("masks"),
        count_if(good & (F.col("dev") > min_dev)).alias("denoised"), count_if(F.col("failed") | (F.col("dev") >= inpaint_dev)).alias("inpainted"),
    )
    both = a.join(b, "page_id", "full")
    pair = lambda v, t: badge(F.col(v), F.col(t))
    return both.select(
        "page_id", pair("removed", "boxes").alias("ocr"), pair("failed", "masks").alias("failures"), pair("perfect", "masks").alias("perfect"),
        pair("denoised", "masks").alias("denoise"), badge(F.col("inpainted")).alias("inpaint"),
    )


def stitched_canvas(segments: DataFrame) -> DataFrame:
    """(split_from, width, height, mode): largest width, sum of heights, highest mode of the segments."""
    order = F.array(*(F.lit(m) for m in ("1", "L", "LA", "P", "RGB", "RGBA", "CMYK", "I")))
    return segments.groupBy("split_from").agg(F.max("w").alias("width"), F.sum("height").alias("height"), F.max_by("mode", F.array_position(order, F.col("mode"))).alias("mode"))


def border_stats_gray(pixels: DataFrame, *keys: str) -> DataFrame:
    """Population deviation, median with its fraction cut off, and number of the pixels of each group."""
    return pixels.groupBy(*keys).agg(F.stddev_pop("px").alias("dev"), F.expr("percentile(px, 0.5)").cast("int").alias("median"), F.count("*").alias("n"))


def border_stats_color(pixels: DataFrame, *keys: str) -> DataFrame:
    """Sample deviation of the distances to the mean colour; null for one pixel."""
    mean = pixels.groupBy(*keys).agg(*(F.avg(c).alias(f"m{c}") for c in "rgb"))
    far = F.sqrt(sum(((F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")) for c in "rgb"), F.lit(0.0)))
    return pixels.join(mean, list(keys)).groupBy(*keys).agg(F.stddev_samp(far).alias("dev"), F.count("*").alias("n"))


def majority_color(pixels: DataFrame, key: str, *channels: str) -> DataFrame:
    """(key, colour): the colour of more than half of a group's pixels, else null."""
    counts = pixels.groupBy(key, *channels).agg(F.count("*").alias("n"))
    per = counts.groupBy(key).agg(F.sum("n").alias("total"), F.max(F.struct("n", *channels)).alias("m"))
    return per.select(key, F.when(2 * F.col("m.n") > F.col("total"), F.concat_ws(",", *(F.col(f"m.{c}").cast("string") for c in channels))).alias("color"))


def palette_topk(pixels: DataFrame, key: str, k: int = 3, min_gap: int = 10, tol: float = 0.001) -> DataFrame:
    """(key, values): grey values by count (ties: smaller first), each over ``min_gap`` from those taken; stops below tol of all."""
    counts = pixels.groupBy(key, "px").agg(F.count("*").alias("n"))
    bins = counts.groupBy(key).agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "px"))).alias("bins"))  # 256 bins at most

    def step(taken: Column, b: Column) -> Column:
        fits = (F.size(taken) < k) & (-b["o"] >= F.col("total") * F.lit(tol)) & F.forall(taken, lambda t: F.abs(t - b["px"]) > min_gap)
        return F.when(fits, F.array_append(taken, b["px"])).otherwise(taken)

    return bins.select(key, F.aggregate("bins", F.array().cast("array<int>"), step).alias("values"))


def otsu_threshold(pixels: DataFrame, key: str) -> DataFrame:
    """(key, threshold): the value that maximises the variance between pixels up to it and above it; first on ties."""
    counts = pixels.groupBy(key, "px").agg(F.count("*").alias("n"))
    run = W.partitionBy(key).orderBy("px")
    every = W.partitionBy(key)
    c = counts.select(
        key, "px", F.sum("n").over(run).alias("n0"), F.sum(F.col("n") * F.col("px")).over(run).alias("s0"), F.sum("n").over(every).alias("n_all"), F.sum(F.col("n") * F.col("px")).over(every).alias("s_all")
    )
    n1, s1 = F.col("n_all") - F.col("n0"), F.col("s_all") - F.col("s0")
    # the difference of means, over one denominator, so that ties are exact
    gap = F.col("s0") * n1 - s1 * F.col("n0")
    spread = gap.cast("double") * gap / (F.col("n0").cast("double") * n1)
    return c.filter(n1 > 0).groupBy(key).agg(F.max_by("px", F.struct(spread, -F.col("px"))).alias("threshold"))


def mask_xor_score(mask: DataFrame, predicted: DataFrame, *keys: str) -> DataFrame:
    """(image, score, inverted): pixels that differ from the prediction, for the mask or its negative, whichever has fewer."""
    both = mask.withColumnRenamed("on", "a").join(predicted.withColumnRenamed("on", "b"), [*keys])
    t = both.groupBy(keys[0]).agg(count_if(F.col("a") != F.col("b")).alias("plain"), count_if(F.col("a") == F.col("b")).alias("negative"))
    return t.select(keys[0], F.least("plain", "negative").alias("score"), (F.col("negative") < F.col("plain")).alias("inverted"))


def natural_key(path: Column) -> Column:
    """Sort key in which runs of digits of any length compare as numbers: each is led by its number of digits."""
    parts = F.regexp_extract_all(path, F.lit(r"(\d+|\D+)"))
    bare = lambda s: F.regexp_replace(s, r"^0+(?=\d)", "")
    return F.concat_ws("", F.transform(parts, lambda s: F.when(s.rlike(r"^\d"), F.concat(F.lpad(F.length(bare(s)).cast("string"), 9, "0"), bare(s))).otherwise(s)))


def common_parent(paths: DataFrame, column: str = "path") -> Column:
    """The longest folder that all paths share, ending in a slash ('' if none), as a one-row subquery."""
    folders = F.slice(F.split(column, "/"), 1, F.size(F.split(column, "/")) - 1)
    ends = paths.agg(F.min(folders).alias("a"), F.max(folders).alias("b"))
    n = F.size("a")
    same = F.aggregate(
        F.zip_with(F.col("a"), F.slice(F.col("b"), 1, F.greatest(n, F.lit(0))), lambda x, y: x.eqNullSafe(y)),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, e: F.struct((s["n"] + F.when(s["on"] & e, 1).otherwise(0)).alias("n"), (s["on"] & e).alias("on")),
        lambda s: s["n"],
    )
    prefix = F.when(same > 0, F.concat(F.concat_ws("/", F.slice("a", 1, same)), F.lit("/"))).otherwise(F.lit(""))
    return ends.select(F.coalesce(prefix, F.lit("")).alias("p")).scalar()


def trim_common_prefix(paths: DataFrame, column: str = "path") -> DataFrame:
    """Adds ``short``: the path without the folder that all share."""
    prefix = common_parent(paths, column)
    return paths.withColumn("short", F.expr(f"substring({column}, 1)")).withColumn("short", F.substring("short", F.length(prefix) + 1, F.length(column)))


def key_cuts(rows: DataFrame, key: str, parts: int, n: int) -> list[str]:
    """At most ``parts`` - 1 ascending keys that deal ``n`` rows about evenly, from the keys of some 50 rows a part.

    Every task sends its smallest hashes to the driver; a bound that some four times as many keys pass keeps that from growing with the tasks.
    """
    most = 50 * parts
    hashed = rows.select(F.xxhash64(key).alias("h"), key).filter(F.col(key).isNotNull())
    if n > 4 * most:
        bound = -(2**63) + 2**66 * most // n
        hashed = hashed.filter(F.col("h") <= bound).distinct()
    ordered = sorted(r[1] for r in hashed.orderBy("h", key).limit(most).collect())
    return sorted({ordered[len(ordered) * i // parts] for i in range(1, parts)}) if ordered else []


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """Adds ``position`` from 1 in the order of a string key, without one task for all rows.

    Rows are dealt by ranges whose bounds come from a bounded sample (by hash, so the same every time);
    each range is numbered apart and shifted by the sizes of the ranges before it. Equal keys share a range.
    A row finds its range by bisection, so that its key is made once and compared some ten times.
    """
    cuts = key_cuts(rows, key, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count())
    schema, schema_of_key = (df.withColumn("part", F.lit(0)).schema for df in (rows, rows.select(key)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = [0 if v is None else bisect_right(cuts, v) for v in batch.column(key).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], names=[*batch.schema.names, "part"])

    dealt = rows.mapInArrow(deal, schema)
    local = dealt.withColumn("k", F.row_number().over(W.partitionBy("part").orderBy(key)))
    sizes = rows.select(key).mapInArrow(deal, schema_of_key).groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return local.join(F.broadcast(before), "part").withColumn("position", F.col("k") + F.col("before")).drop("part", "k", "before")
