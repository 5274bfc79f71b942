"""Document fingerprints by I-Match, in DataFrame functions only.

The lexicon holds the terms whose document frequency over the whole corpus lies
within a band. Terms are hashed to a fixed number of places, so the lexicon is a
bit table of fixed size however large the corpus is; frequencies are counted by
place. A text keeps its terms of the lexicon, sorts the distinct ones, and hashes
the part of them that falls in each of several random subsets of the lexicon.
Subsets come in groups of decreasing density, so that short and long texts both
find subsets with one or two of their terms.

Copies count once: document frequencies are those over distinct term sets. A
fingerprint also has subsets over all terms of the text, for texts of which the
lexicon has too few terms (texts of a large group of near copies, small tables).

Likeness of two fingerprints is the share of equal subset hashes among subsets
that are not empty in both, in the sparsest group with at least ``MIN_FILLED``
such subsets (else in the densest); over all terms on both sides where the lexicon
has too few of either side. Equal texts have equal fingerprints and likeness 1.

Null text is empty; null ids come last in descending order, in that of a hash of
their texts; rows that repeat an id are ordered by text and each keeps its result
row; very long texts are fingerprinted whole; with one row, it is its own
next document; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_and_text

#: Places of the lexicon: 2 ** PLACE_BITS.
PLACE_BITS = 20
#: Band of document frequency over the number of documents.
LOW, HIGH = 1e-4, 1e-2
#: Each group has SUBSETS random subsets, one term in so many in each.
SPARSITY, SUBSETS = (16, 128, 1024), 12
MIN_FILLED = 6
#: A text with fewer terms of the lexicon, or a smaller share of its terms, has too few.
MIN_KNOWN, MIN_SHARE = 8, 1 / 8
#: Rows of a range of ids, and ranges at most.
RANGE_ROWS, MOST_RANGES = 1024, 1 << 16
#: Places of a fingerprint: all terms, subsets over the lexicon, subsets over all terms, and 1 where the lexicon has enough terms.
OVER_LEXICON, OVER_ALL, ENOUGH = 1, 1 + len(SPARSITY) * SUBSETS, 1 + 2 * len(SPARSITY) * SUBSETS


def term_hashes(text: Column) -> Column:
    """Hashes of all runs of letters and digits, lower-cased, with repeats."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def place(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def lexicon(texts: DataFrame, low: float = LOW, high: float = HIGH, once: bool = False) -> DataFrame:
    """One row, one array: the bit table of places whose document frequency is within the band.

    With ``once``, texts of equal term sets count as one document.
    """
    places = lambda terms: F.array_distinct(F.transform(terms, lambda h: place(h).cast("int")))
    terms = texts.select(F.sort_array(F.array_distinct(term_hashes(F.col("text")))).alias("terms"))
    sets = terms.select(F.xxhash64("terms").alias("of"), places(F.col("terms")).alias("places"))
    if once:
        sets = sets.dropDuplicates(["of"])
    counts = sets.select(F.explode("places").alias("p")).groupBy("p").agg(F.count("*").alias("df"))
    total = sets.select(F.count("*").alias("n"))
    band = counts.crossJoin(F.broadcast(total)).filter((F.col("df") >= F.col("n") * low) & (F.col("df") <= F.col("n") * high))  # total is one row
    words = band.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v"))
    every = texts.sparkSession.range(1 << (PLACE_BITS - 6)).select(F.col("id").alias("w"))
    full = every.join(words, "w", "left").select("w", F.coalesce("v", F.lit(0).cast("long")).alias("v"))
    return full.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "v"))), lambda s: s["v"]).alias("bits"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def in_lexicon(h: Column, bits: Column) -> Column:
    return F.getbit(F.get(bits, F.shiftright(place(h), 6).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1


def subset_hashes(known: Column, group: int) -> Column:
    """Hash of the part of the sorted terms in each subset of a group, null for none."""

    def number(h: Column) -> Column:
        return F.pmod(F.shiftrightunsigned(h, 20 + 12 * group), F.lit(SPARSITY[group]))

    def hashed(terms: Column) -> Column:
        def of(k: Column) -> Column:
            mine = F.filter(terms, lambda h: number(h) == k)
            return F.when(F.size(mine) > 0, F.xxhash64(mine))

        return F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), of)

    # a cheap first pass keeps what can fall in any subset of the group; subset k takes the terms of number k
    return let(F.filter(known, lambda h: number(h) < SUBSETS), hashed)


def fingerprint(text: Column, bits: Column) -> Column:
    """Array of longs: the hash of all distinct terms, then of each subset (null where it has none).

    Subsets over the lexicon come first, then those over all terms, and last 1 or 0: has the lexicon enough terms of the text?
    """

    def of(every: Column) -> Column:
        groups = lambda terms: [subset_hashes(terms, g) for g in range(len(SPARSITY))]
        enough = lambda k: ((F.size(k) >= MIN_KNOWN) & (F.size(k) >= F.size(every) * MIN_SHARE)).cast("long")
        known = F.filter(every, lambda h: in_lexicon(h, bits))
        return let(known, lambda k: F.concat(F.array(F.xxhash64(every)), *groups(k), *groups(every), F.array(enough(k))))

    return let(F.sort_array(F.array_distinct(term_hashes(text))), of)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two fingerprint arrays."""
    enough = (F.get(a, F.lit(ENOUGH)) == 1) & (F.get(b, F.lit(ENOUGH)) == 1)
    side = lambda fp: F.slice(fp, F.when(enough, OVER_LEXICON + 1).otherwise(OVER_ALL + 1), F.lit(OVER_ALL - OVER_LEXICON))
    pairs = F.arrays_zip(side(a).alias("a"), side(b).alias("b"))
    steps = []
    for g in range(len(SPARSITY)):
        part = F.slice(pairs, 1 + g * SUBSETS, SUBSETS)
        filled = F.size(F.filter(part, lambda p: p["a"].isNotNull() | p["b"].isNotNull()))
        equal = F.size(F.filter(part, lambda p: p["a"] == p["b"]))
        steps.append((filled, equal / F.greatest(filled, F.lit(1))))
    out = F.when(F.get(a, F.lit(0)) == F.get(b, F.lit(0)), F.lit(1.0))
    for filled, share in reversed(steps):
        out = out.when(filled >= MIN_FILLED, share)
    return out.otherwise(steps[0][1]).cast("double")


def printed(fp: Column) -> Column:
    """A fingerprint as a string: eight hexadecimal digits for each part, - for an empty one."""
    return F.concat_ws("", F.transform(fp, lambda h: F.when(h.isNull(), F.lit("-")).otherwise(F.right(F.lpad(F.hex(h), 16, "0"), F.lit(8)))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row, against the lexicon of all rows."""
    texts = id_and_text(docs, id_col, text_col)
    bits = F.broadcast(lexicon(texts, once=True))  # one row of fixed size
    return texts.crossJoin(bits).select("doc_id", printed(fingerprint(F.col("text"), F.col("bits"))).alias("fingerprint"))


def with_next(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Adds ``next_<column>`` of the next row by descending doc_id; the first row is next to the last.

    Rows are dealt by ranges of ids, a range for so many rows; the first row of a range
    also goes, as a guest, to the range before, so one shuffle does. Rows without an id
    are spread over ranges by a hash of their text; those of one id stay together.
    """
    spark = rows.sparkSession
    parts = min(MOST_RANGES, rows.count() // RANGE_ROWS + 1)
    lowest = F.lit(-(2**63))
    key = F.when(F.col("doc_id").isNull(), lowest + F.shiftrightunsigned(F.xxhash64("text"), 24)).otherwise(F.greatest("doc_id", F.lit(-(2**63) + 2**40)))
    rows = rows.withColumn("key", key)
    cuts = rows.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)] or [0.5], max(10_000, 4 * parts))).first()[0] or []
    cuts = sorted(set(cuts)) if parts > 1 else []  # at most MOST_RANGES
    step = math.isqrt(len(cuts)) + 1
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    table = spark.createDataFrame([([g[-1] for g in groups], groups)], "tops array<long>, groups array<array<long>>")
    rows = rows.crossJoin(F.broadcast(table))  # one row
    below = lambda bounds: F.size(F.filter(bounds, lambda b: b < F.col("key")))
    group = below(F.col("tops"))
    at = F.when(group < len(groups), group * step + below(F.get("groups", group))).otherwise(len(cuts))
    rows = rows.withColumn("part", at).drop("tops", "groups")
    tops = rows.groupBy("part").agg(F.max("key").alias("top")).orderBy(F.desc("part")).collect()  # a row a range
    before = [tops[i - 1]["part"] for i in range(len(tops))]  # of the highest range: the lowest
    guests = spark.createDataFrame([(t["top"], p) for t, p in zip(tops, before)], "top long, guest_of int")
    dealt = rows.join(F.broadcast(guests), F.col("key") == F.col("top"), "left").drop("top")
    places = F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("guest")), F.struct(F.col("guest_of").alias("part"), F.lit(1).alias("guest")))
    dealt = dealt.withColumn("at", F.explode(F.filter(places, lambda p: p["part"].isNotNull()))).drop("part", "guest_of")
    order = W.partitionBy("at.part").orderBy("at.guest", F.desc("key"), F.desc_nulls_last("doc_id"), *columns)
    out = dealt.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns))
    return out.filter("at.guest = 0").drop("at", "key")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The edited text has its last third of code points replaced by the first as many
    of the next document in descending order of ids.
    """
    texts = id_and_text(docs, id_col, text_col)
    bits = F.broadcast(lexicon(texts, once=True))  # one row of fixed size
    own = texts.crossJoin(bits).select("doc_id", "text", fingerprint(F.col("text"), F.col("bits")).alias("fp"))
    both = with_next(own, ("text", "fp"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    both = both.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fp", "next_fp")
    both = both.crossJoin(bits).select("*", fingerprint(F.col("edited"), F.col("bits")).alias("edited_fp")).drop("bits")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("fp")).alias("fingerprint"),
        printed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
