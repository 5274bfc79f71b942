"""Whole pages at once: the regions of a page travel as one row of arrays, many pages to an Arrow batch.

``map_pages`` gathers each page in one exchange and hands NumPy columns of many pages
to a kernel. A kernel finds the overlapping pairs of all pages together and walks the
pairs alone, so calm pages cost nothing. Crowded pages (over ``CROWDED`` regions) fall apart
at gaps of a sweep; in a part that stays crowded the greedy pass looks up what meets the regions
it takes in grids by size, so memory grows with the regions of a page (some 100 bytes each),
never with its pairs, and one page-wide region slows nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs that are tested at once.
STEP = 1 << 20
#: Rows of a group from which pairs are not listed.
CROWDED = 2000
#: Rows of a crowded group that are compared with each other at once.
BLOCK = 256
Columns = dict[str, np.ndarray]


def map_pages(df: DataFrame, keys: list[str], kernel: Callable[[Columns, np.ndarray], Columns], schema: str) -> DataFrame:
    """``kernel`` (columns of many groups, number of each row's group) gives output columns of ``schema``.

    Columns with nulls arrive as object arrays, others as numbers; rows of a group stand together.
    """
    names = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.collect_list(F.struct(*names)).alias("rows_"))
    return mapped(packed, schema, lambda batch: kernel(*unpacked(batch, keys, "rows_", names)))


def map_sides(left: DataFrame, right: DataFrame, keys: list[str], kernel: Callable[[Columns, np.ndarray, Columns, np.ndarray], Columns], schema: str) -> DataFrame:
    """``map_pages`` for two tables: the kernel gets the columns and group numbers of both.

    Groups without a row of ``left`` are left out. Each table moves once, by the keys.
    """
    names = [[c for c in df.columns if c not in keys] for df in (left, right)]
    packed = [df.groupBy(*keys).agg(F.collect_list(F.struct(*n)).alias(side)) for df, n, side in zip((left, right), names, ("left_", "right_"))]
    both = packed[0].join(packed[1], keys, "left")
    return mapped(both, schema, lambda batch: kernel(*unpacked(batch, keys, "left_", names[0]), *unpacked(batch, keys, "right_", names[1])))


def mapped(packed: DataFrame, schema: str, body: Callable[[pa.RecordBatch], Columns]) -> DataFrame:
    out = packed.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for batch in batches:
            if not batch.num_rows:
                continue
            made = body(batch)
            arrays = [made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type, from_pandas=True) for f in arrow]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return packed.mapInArrow(run, out)


def unpacked(batch: pa.RecordBatch, keys: list[str], packed: str, names: list[str]) -> tuple[Columns, np.ndarray]:
    """Columns of the packed rows of a batch, and the number of each row's group."""
    rows = batch.column(packed)
    flat, sizes = rows.flatten(), rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    group = np.repeat(np.arange(len(rows)), sizes)
    at = pa.array(group)
    columns = {k: numbers(batch.column(k).take(at)) for k in keys}
    return columns | {n: numbers(flat.field(i)) for i, n in enumerate(names)}, group


def numbers(column: pa.Array) -> np.ndarray:
    """Plain numbers where there are no nulls, else objects."""
    if column.null_count or not (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)):
        return np.array(column.to_pylist(), object)
    return column.to_numpy(zero_copy_only=False)


def taken(columns: Columns, rows: np.ndarray) -> Columns:
    return {n: c[rows] for n, c in columns.items()}


def meeting_pairs(group: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group whose spans x1..x2 meet (edges included), some at a time.

    Rows sorted by group and left edge: those that begin before a row ends follow it directly. Real edges are
    replaced by their ranks among all edges, which keep their order.
    """
    if x1.dtype.kind == "f":
        x1, x2 = np.split(np.unique(np.concatenate((x1, x2)), return_inverse=True)[1].astype(np.int64), 2)
    lowest = int(x1.min(initial=0))
    width = int(max(x1.max(initial=0), x2.max(initial=0))) - lowest + 2
    key = group.astype(np.int64) * width + (x1 - lowest)
    order = np.argsort(key, kind="stable")
    key = key[order]
    reach = np.searchsorted(key, group[order].astype(np.int64) * width + np.maximum(x2[order] - lowest, -1), "right")
    count = np.maximum(reach - np.arange(1, len(order) + 1), 0)
    ends = np.cumsum(count)
    at = 0
    while at < len(order):
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + STEP, "right")))
        n = count[at:to]
        first = np.repeat(np.arange(at, to), n)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
        yield order[first], order[second]
        at = to


def boxes_of(columns: Columns) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates (rows, 4), real where any column is, and which rows have all of them; the others are zero."""
    names = ("x1", "y1", "x2", "y2")
    known = np.ones(len(columns["x1"]), bool)
    for n in names:
        if columns[n].dtype == object:
            known &= np.array([v is not None for v in columns[n]], bool)
    real = any(columns[n].dtype.kind == "f" or columns[n].dtype == object and any(isinstance(v, float) for v in columns[n]) for n in names)
    kind = np.float64 if real else np.int64
    box = np.zeros((len(known), 4), kind)
    box[known] = np.stack([columns[n][known].astype(kind) for n in names], 1)
    return box, known


def pairs_between(left: np.ndarray, box: np.ndarray, right: np.ndarray, other: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (left row, right row) of one group whose spans x1..x2 meet, some at a time; ``left`` and ``right`` are group numbers."""
    n = len(left)
    both = np.concatenate((box, other))
    for a, b in meeting_pairs(np.concatenate((left, right)), both[:, 0], both[:, 2]):
        mixed = (a < n) != (b < n)
        a, b = a[mixed], b[mixed]
        yield np.minimum(a, b), np.maximum(a, b) - n


def merged(columns: Columns, group: np.ndarray, order: np.ndarray, overlap: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Columns:
    """One greedy pass in each group: a row is taken in ``order``, and what overlaps it as it came is merged into it.

    The first row of a union keeps its other columns. Rows without coordinates never overlap.
    """
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    names = ("x1", "y1", "x2", "y2")
    box, known = boxes_of(columns)
    found: list[np.ndarray] = []
    part = group.astype(np.int64)
    crowded = np.bincount(group)[group] > CROWDED if len(group) else known
    if crowded.any():
        rows = np.flatnonzero(known & crowded)
        part[rows] = part.max() + 1 + _apart(group[rows], np.minimum(box[rows, :2], box[rows, 2:]), np.maximum(box[rows, :2], box[rows, 2:]))
        crowded = known & (np.bincount(part)[part] > CROWDED)
    rows = np.flatnonzero(known & ~crowded)
    for a, b in meeting_pairs(part[rows], np.minimum(box[rows, 0], box[rows, 2]), np.maximum(box[rows, 0], box[rows, 2])):
        a, b = rows[a], rows[b]
        hit = overlap(box[a], box[b])
        a, b = a[hit], b[hit]
        early = rank[a] < rank[b]
        found.append(np.stack((np.where(early, a, b), np.where(early, b, a)), 1))
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    pairs = pairs[np.lexsort((rank[pairs[:, 1]], rank[pairs[:, 0]]))]
    alive, union = np.ones(len(group), bool), box.copy()
    into = np.full(len(group), -1)
    # a pair counts if its first row was not merged before; all pairs of earlier rows have been seen by then
    for a, b in pairs.tolist():
        if alive[a] and alive[b]:
            alive[b], into[b] = False, a
    rest = order[crowded[order]]
    rest = rest[np.argsort(part[rest], kind="stable")]
    for rows in np.split(rest, np.flatnonzero(np.diff(part[rest])) + 1) if len(rest) else ():
        _walk(rows, rank, box, overlap, alive, into)
    gone = np.flatnonzero(~alive)
    np.minimum.at(union[:, 0], into[gone], box[gone, 0])
    np.minimum.at(union[:, 1], into[gone], box[gone, 1])
    np.maximum.at(union[:, 2], into[gone], box[gone, 2])
    np.maximum.at(union[:, 3], into[gone], box[gone, 3])
    out = dict(columns)
    for k, n in enumerate(names):
        out[n] = np.where(known, union[:, k], columns[n])
    return taken(out, order[alive[order]]) | {"_group": group[order[alive[order]]]}


def _apart(group: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Numbers of finer groups: rows that a gap of a sweep separates, along either axis in turn, never overlap."""
    part, kinds, still = np.unique(group, return_inverse=True)[1].astype(np.int64), -1, 0
    for turn in range(64):
        axis = turn % 2
        order = np.lexsort((low[:, axis], part))
        g = part[order]
        # the farthest end so far in each part: ranks of ends grow with the part, so one running maximum serves all
        rank = np.empty(len(g), np.int64)
        rank[np.lexsort((high[order, axis], g))] = np.arange(len(g))
        reach = high[order, axis][np.argsort(rank)][np.maximum.accumulate(rank)]
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (low[order, axis][1:] > reach[:-1])))
        part[order] = np.cumsum(new) - 1
        still = still + 1 if int(new.sum()) == kinds else 0
        kinds = int(new.sum())
        if still == 2:
            break
    return part


class Cells:
    """Rows by cells of a grid, a grid for each power of two of their sizes: the corner of a row lies in one cell, and no row is larger than its cell."""

    def __init__(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray):
        size = np.maximum((high[rows] - low[rows]).max(1).astype(float), 1e-9)
        level = np.ceil(np.log2(size)).astype(np.int64)
        self.levels = []
        for k in np.unique(level):
            at, cell = rows[level == k], 2.0 ** int(k)
            place = np.floor(low[at] / cell).astype(np.int64)
            least, most = place.min(0), place.max(0)
            key = (place[:, 1] - least[1]) * (most[0] - least[0] + 1) + place[:, 0] - least[0]
            order = np.argsort(key, kind="stable")
            self.levels.append((cell, least, most, key[order], at[order]))

    def near(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (row, row of the grid that may meet it), some at a time."""
        for cell, least, most, key, at in self.levels:
            a = np.maximum(np.floor(low[rows] / cell).astype(np.int64) - 1, least)
            b = np.minimum(np.floor(high[rows] / cell).astype(np.int64), most)
            lines = np.where((b >= a).all(1), b[:, 1] - a[:, 1] + 1, 0)
            of = np.repeat(np.arange(len(rows)), lines)
            y = a[of, 1] + np.arange(len(of)) - np.repeat(np.cumsum(lines) - lines, lines) - least[1]
            width = most[0] - least[0] + 1
            start = np.searchsorted(key, y * width + a[of, 0] - least[0])
            n = np.searchsorted(key, y * width + b[of, 0] - least[0], "right") - start
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            for begin in range(0, total, STEP):
                each = np.arange(begin, min(begin + STEP, total))
                line = np.searchsorted(ends, each, "right")
                yield rows[of[line]], at[start[line] + each - (ends[line] - n[line])]


def _walk(rows: np.ndarray, rank: np.ndarray, box: np.ndarray, overlap: Callable, alive: np.ndarray, into: np.ndarray) -> None:
    """The greedy pass over one crowded group, rows in order, a block at a time.

    Rows of a block are compared with each other; those that remain look up what they meet in the grids, and each row
    met goes to the first of them. Grids are built again when half of their rows are gone.
    """
    low, high = np.minimum(box[:, :2], box[:, 2:]), np.maximum(box[:, :2], box[:, 2:])
    first = np.full(len(box), -1)
    rows, cells, held = rows[alive[rows]], None, 0
    while len(rows):
        if cells is None or 2 * len(rows) < held:
            cells, held = Cells(rows, low, high), len(rows)
        block, rows = rows[:BLOCK], rows[BLOCK:]
        a, b = np.triu_indices(len(block), 1)
        hit = overlap(box[block[a]], box[block[b]])
        for i, j in zip(block[a[hit]].tolist(), block[b[hit]].tolist()):
            if alive[i] and alive[j]:
                alive[j], into[j] = False, i
        taken_ = block[alive[block]]
        met = []
        for i, j in cells.near(taken_, low, high):
            later = alive[j] & (rank[j] > rank[i])
            i, j = i[later], j[later]
            hit = overlap(box[i], box[j])
            i, j = i[hit], j[hit]
            order = np.lexsort((rank[i], j))
            one = order[np.concatenate(([True], j[order][1:] != j[order][:-1]))] if len(order) else order
            i, j = i[one], j[one]
            better = (first[j] < 0) | (rank[i] < rank[first[j]])
            first[j[better]] = i[better]
            met.append(j)
        gone = np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)
        alive[gone], into[gone] = False, first[gone]
        rows = rows[alive[rows]] if len(gone) else rows


def suppressed(columns: Columns, group: np.ndarray, order: np.ndarray, overlap: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Rows that a greedy pass in ``order`` keeps: a kept row removes what overlaps it."""
    keep = merged(columns | {"_row": np.arange(len(group))}, group, order, overlap)
    return keep["_row"].astype(np.int64)


def centers_meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Either centre lies in the other box."""
    inside = lambda c, box: ((box[:, :2] <= c) & (c <= box[:, 2:])).all(1)
    return inside((a[:, :2] + a[:, 2:]) // 2, b) | inside((b[:, :2] + b[:, 2:]) // 2, a)


def common_area(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    size = np.minimum(a[:, 2:], b[:, 2:]) - np.maximum(a[:, :2], b[:, :2])
    return np.where((size > 0).all(1), size[:, 0] * size[:, 1], 0)


def area(a: np.ndarray) -> np.ndarray:
    return (a[:, 2] - a[:, 0]) * (a[:, 3] - a[:, 1])


def areas_meet(threshold: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Common area over the smaller one (0 counts as 1) above ``threshold`` percent."""

    def test(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        least = np.minimum(area(a), area(b))
        common = common_area(a, b)
        return (common > 0) & (100 * common > threshold * np.where(least == 0, 1, least))

    return test


def places(group: np.ndarray) -> np.ndarray:
    """1, 2, ... within each run of equal groups."""
    if not len(group):
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    return np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group)))) + 1
