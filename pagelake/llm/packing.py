"""Packing into sequences by non-negative least squares over the length histogram.

Texts are encoded once; whole windows are cut off, and what remains of each
text has a length below the window. Combinations of up to ``depth`` lengths that
fill a window exactly are enumerated, their repeat counts are solved against the
histogram of lengths by non-negative least squares (multiplicative updates),
rounded, and held to what the histogram has. Residual lengths are packed greedily:
the longest first, each room filled by the longest that fits.

The driver sees only the histogram (one number per length) and the plan, whose
size depends on the window, not on the rows. Rows take their places by rank:
each block of rows counts its pieces by length, running sums over blocks give
each block's first rank, and the plan's slots of a length are intervals of ranks.

Null text is empty (only the end id); repeated rows and ids each get places of
their own; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import giving_back, id_and_text, stored
from .token_files import encoded

WINDOW = 2048
#: Least-squares problems solved at most, each against what the ones before left of the histogram.
SOLVES = 24


def combinations(lengths: np.ndarray, window: int, depth: int = 3) -> np.ndarray:
    """Rows of ascending lengths, zeros in front, that sum to ``window``; ``depth`` is at most 3."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    found = [np.array([[0, 0, window]])] if have[window] else []
    short = lengths[lengths < window]
    two = short[(short * 2 <= window) & have[window - short]]
    found.append(np.stack((np.zeros_like(two), two, window - two), 1))
    if depth > 2:
        for a in short[short * 3 <= window]:
            b = short[(short >= a) & (short * 2 <= window - a)]
            b = b[have[window - a - b]]
            found.append(np.stack((np.full_like(b, a), b, window - a - b), 1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def repeats(rows: np.ndarray, histogram: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Non-negative repeat counts x for which the lengths used come near the histogram (least squares)."""
    size = len(histogram)
    used = lambda x: np.bincount(rows.ravel(), weights=np.repeat(x, rows.shape[1]), minlength=size)
    mask = np.ones(size)
    mask[0] = 0
    gathered = lambda h: (h * mask)[rows].sum(1)
    target = gathered(histogram)
    x = np.full(len(rows), histogram[1:].sum() / max(1, 3 * len(rows)))
    for _ in range(rounds):
        x *= target / np.maximum(gathered(used(x)), 1e-12)
    return x


def plan_sequences(histogram: np.ndarray, window: int = WINDOW, depth: int = 3) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how many such sequences) that use each length as often as the histogram says."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    plan: list[tuple[list[int], int]] = []

    def take(lengths: list[int], most: int) -> None:
        need: defaultdict[int, int] = defaultdict(int)
        for x in lengths:
            need[x] += 1
        n = min(most, *(int(left[x]) // k for x, k in need.items()))
        if n > 0:
            plan.append((lengths, n))
            for x, k in need.items():
                left[x] -= n * k

    for _ in range(SOLVES):
        # few combinations at a time, those that the histogram can repeat most, so that counts survive rounding
        rows = combinations(np.flatnonzero(left), window, depth)
        supply = np.where(rows > 0, left[rows], 1 << 62).min(1)
        rows = rows[np.argsort(-supply, kind="stable")[: 2 * window]]
        before = int(left.sum())
        x = np.rint(repeats(rows, left.astype(float))).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
        for i in np.argsort(-x, kind="stable"):
            if x[i] <= 0:
                break
            take([int(v) for v in rows[i] if v], int(x[i]))
        if int(left.sum()) == before:
            break
    # what is left: longest first, each room filled by the longest that fits
    open_lengths = np.flatnonzero(left).tolist()
    while open_lengths:
        lengths, room, spare = [], window, {}
        while room:
            at = int(np.searchsorted(open_lengths, room, "right")) - 1
            while at >= 0 and left[open_lengths[at]] - spare.get(open_lengths[at], 0) <= 0:
                at -= 1
            if at < 0:
                break
            x = open_lengths[at]
            n = min(room // x, int(left[x]) - spare.get(x, 0))
            lengths += [x] * n
            spare[x] = spare.get(x, 0) + n
            room -= n * x
        take(lengths, 2**62)
        open_lengths = [x for x in open_lengths if left[x]]
    return plan


def slots_of(plan: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Each length's slots as intervals of ranks, in order: length, first rank, first sequence, offset, tokens there."""
    used: defaultdict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for lengths, n in plan:
        offset = 0
        for x in sorted(lengths, reverse=True):
            rows.append((x, used[x], sequence, offset, sum(lengths)))
            used[x] += n
            offset += x
        sequence += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "offset", "total"), table.T))


def pack(
    docs: DataFrame, window: int = WINDOW, file: str = "word_bpe_49k.json", end_id: int = 1, depth: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padding.

    ``padding`` is that of the piece's sequence: up to the window, none where its
    tokens are a power of two.
    """
    spark = docs.sparkSession
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "block", "nth")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded(batch.column("text").to_pylist(), file, end_id)):
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    rows.append((doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids), block, int(seen[len(part)])))
                    seen[len(part)] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

    texts = id_and_text(docs, id_col, text_col)
    pieces = stored(texts.mapInArrow(giving_back(cut), ", ".join(f"{n} long" for n in schema.names)), "pieces")
    counts = stored(pieces.groupBy("block", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = np.zeros(window + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # a row for each length at most
        histogram[length] = n
    slots = spark.sparkContext.broadcast(slots_of(plan_sequences(histogram, window, depth)))

    before = W.partitionBy("length").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(first, ["block", "length"]).withColumn("rank", F.col("first") + F.col("nth"))
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    placed = pa.schema([(n, pa.int64()) for n in (*names, "sequence_id", "offset", "padding")])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = slots.value
        key = s["length"] << 44 | s["rank"]
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(key, batch.column("length").to_numpy() << 44 | rank, "right") - 1
            total = s["total"][at]
            padding = np.where(total & (total - 1) == 0, 0, window - total)
            new = (s["sequence"][at] + rank - s["rank"][at], s["offset"][at], padding)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(x) for x in new)], schema=placed)

    return ranked.select(*names, "rank").mapInArrow(giving_back(place), ", ".join(f"{n} long" for n in placed.names))
