"""Hard-negative mining over a GNAT-style multiway hyperplane tree.

Score is the inner product of integer vectors; since |a - x|^2 = |a|^2 + |x|^2 - 2 a.x,
a window of scores is an annulus of distances, wider by the spread of norms below a
node. The tree: a node has several split points, a row goes to the nearest one (so
the sides are hyperplanes between them), and for every split point and every
sibling subtree the node keeps the smallest and largest distance from that point to
a row of that subtree. An anchor at known distances from the split points drops each
sibling whose ranges the annuli of its windows cannot reach. What is left is
compared exactly.

On Spark: the upper levels are chosen on a bounded sample (``sample`` rows of the
smallest hashes), but every row is routed and every range covers all rows. Rows of
one leaf (and of one label, where it has many there) are cut into parts of about
``part_rows``, each with a last level of split points and ranges of its own. Anchors
travel in blocks to the bins (neighbouring parts, a bounded number of bins) with cells
they cannot drop; a part and a block meet in one row of a join, and at most the best few of each anchor leave. Three passes:
positives in the leaves of an anchor's block, positives elsewhere (with the score to
beat), negatives in the windows of the positives.

The driver holds the split points, a range for each split point and child, and the
cells: a few thousand small rows at any size of the table. A vector that a third of
all rows share fills many parts, dealt by row.

Rows without an id, with a null label, a null vector, or a null or non-finite entry
take no part. Shorter vectors count as filled with zeros. Each repeated row is a row
of its own: as an anchor it has results of its own, and its copies are other rows;
of equal scores and ids either stands first, with the same values. Scores beyond a
long count as the nearest long. An empty table, or one without anchors, gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, small_batches, stored
from .whitening import as_matrix, padded

#: Split points of a node, levels of the upper tree, rows of the sample it is chosen on.
FAN, LEVELS, SAMPLE = 8, 3, 4096
#: Rows of a part and anchors of a block, about.
PART_ROWS, BLOCK_ROWS = 2048, 2048
#: Neighbouring parts that one join key (a bin) holds: SLICE, or more where that gives over SLICES bins. A block of anchors moves once a bin.
SLICE, SLICES = 4, 128
#: A label has cells of its own in leaves where it has this share of all rows, and half a part of rows.
OWN_CELL = 4096
#: Rounding of distances, as a share of the norms.
SLACK = 1e-6
LEAST, MOST = -(2**63), 2**63 - 1


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """(rows, points): Euclidean distances."""
    square = (x**2).sum(1)[:, None] + (points**2).sum(1)[None] - 2 * (x @ points.T)
    return np.sqrt(np.maximum(square, 0))


def spread_points(x: np.ndarray, fan: int) -> np.ndarray:
    """Up to ``fan`` distinct rows, each the farthest from those before; the first is farthest from the mean."""
    at = int(((x - x.mean(0)) ** 2).sum(1).argmax())
    chosen, near = [at], ((x - x[at]) ** 2).sum(1)
    while len(chosen) < fan and near.max() > 0:
        at = int(near.argmax())
        chosen.append(at)
        near = np.minimum(near, ((x - x[at]) ** 2).sum(1))
    return x[chosen]


@dataclass
class Tree:
    """Upper levels: split points of each node, its children (a node, or ~leaf), and what is known of each child's rows."""

    nodes: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    paths: list[list[tuple[int, int]]] = field(default_factory=list)  # of each leaf: (node, child) from the root
    low: list[np.ndarray] = field(default_factory=list)  # of each leaf: least distance to the points on its path, then least norm
    high: list[np.ndarray] = field(default_factory=list)

    def grow(self, x: np.ndarray, rows: int, fan: int, levels: int, path: list[tuple[int, int]]) -> int:
        """Add the subtree of sample rows ``x``; gives its number."""
        points = spread_points(x, fan) if len(x) > rows and levels else x[:1]
        if len(points) < 2:
            self.paths.append(path)
            return ~(len(self.paths) - 1)
        node = len(self.nodes)
        self.nodes.append(points)
        self.children.append([])
        side = distances(x, points).argmin(1)
        self.children[node] = [self.grow(x[side == c], rows, fan, levels - 1, [*path, (node, c)]) for c in range(len(points))]
        return node

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        leaf, waiting = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))] if self.nodes else []
        while waiting:
            node, rows = waiting.pop()
            side = distances(x[rows], self.nodes[node]).argmin(1)
            for c, child in enumerate(self.children[node]):
                mine = rows[side == c]
                if child < 0:
                    leaf[mine] = ~child
                elif len(mine):
                    waiting.append((child, mine))
        return leaf

    def path_distances(self, leaf: int, x: np.ndarray) -> np.ndarray:
        """Distances to all split points on a leaf's path, and last the norm (the distance to the origin)."""
        return np.column_stack([*(distances(x, self.nodes[node]) for node, _ in self.paths[leaf]), np.sqrt((x**2).sum(1))])

    def reached(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """(leaves,) whether any anchor's windows reach a leaf."""
        to = [distances(x, points) for points in self.nodes]
        norm = np.sqrt((x**2).sum(1))
        out = np.zeros(len(self.paths), bool)
        for leaf, path in enumerate(self.paths):
            if len(self.low[leaf]):
                out[leaf] = reach(np.column_stack([*(to[node] for node, _ in path), norm]), self.low[leaf], self.high[leaf], lo, hi).any()
        return out


def reach(to: np.ndarray, low: np.ndarray, high: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(anchors,) whether rows at distances ``low`` to ``high`` from the points can score in a window of the anchor.

    to: (anchors, points) distances, the last point being the origin; lo, hi: (anchors, windows).
    """
    norm, least_norm, most_norm = to[:, -1:], low[-1], high[-1]
    near = np.sqrt(np.maximum(norm**2 + least_norm**2 - 2 * hi, 0))
    far = norm**2 + most_norm**2 - 2 * lo
    slack = SLACK * (norm + most_norm) + 1e-9
    possible = (lo <= hi) & (far >= -(slack**2))
    least = np.maximum(to - high, low - to).max(1, keepdims=True)
    most = (to + high).min(1, keepdims=True)
    return (possible & (least <= np.sqrt(np.maximum(far, 0)) + slack) & (most >= near - slack)).any(1)


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: whole numbers in floating point where every sum fits its 24 or 53 bits, else long."""
    size = lambda m: int(max(-int(m.min()), int(m.max())) if m.size else 0)
    bound = size(a) * size(x) * a.shape[1]
    if bound < 2**53:
        kind = np.float32 if bound < 2**24 else np.float64
        return a.astype(kind) @ x.astype(kind).T
    if bound < 2**63:
        return a.astype(np.int64) @ x.astype(np.int64).T
    return np.clip(a.astype(object) @ x.astype(object).T, LEAST, MOST).astype(np.int64)


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as found:
        return {k: found[k] for k in found.files}


def small(x: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them."""
    for kind in (np.int8, np.int16, np.int32):
        if not x.size or np.iinfo(kind).min <= x.min() and x.max() <= np.iinfo(kind).max:
            return x.astype(kind)
    return x


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of batches that are sorted by integer ``keys``."""
    held: list[pa.RecordBatch] = []
    held_key: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for v in values:
            change |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            key = tuple(int(v[s]) for v in values)
            if held and key != held_key:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held, held_key = [*held, batch.slice(s, e - s)], key
    if held:
        yield held_key, pa.Table.from_batches(held)


@dataclass(frozen=True)
class Cell:
    leaf: int
    label: int | None  # null: all labels without a cell of their own there
    parts: int
    first: int  # parts of the cells before it


def smallest_hashes(rows: DataFrame, n: int, sample: int) -> DataFrame:
    """(h, x): the ``sample`` distinct rows of the smallest hashes, of ``n`` rows.

    Every task sends its smallest ones to the driver; a bound that some four times as many rows pass keeps that from growing with the tasks.
    """
    hashed = rows.select(F.xxhash64("vec_id", "x").alias("h"), "x")
    if n > 4 * sample:
        hashed = hashed.filter(F.col("h") <= LEAST + 2**66 * sample // n).distinct()
    return hashed.orderBy("h", "x").limit(sample)


def routed_rows(rows: DataFrame, tree: Tree, width: int) -> DataFrame:
    """``rows`` (vec_id, label, anchor, x) with the leaf of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.route(as_matrix(batch.column("x"), width).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    return rows.mapInArrow(run, "vec_id long, label long, anchor boolean, x array<long>, leaf int")


def cells_of(routed: DataFrame, part_rows: int) -> list[Cell]:
    """Cells by leaf, and by label where a label has many rows in a leaf: at most OWN_CELL and one a leaf."""
    counts = stored_counts = routed.groupBy("leaf", "label").agg(F.count("*").alias("n"))
    leaves = {r["leaf"]: r["n"] for r in counts.groupBy("leaf").agg(F.sum("n").alias("n")).collect()}
    least = max(part_rows // 2, sum(leaves.values()) // OWN_CELL, 1)
    own = stored_counts.filter(F.col("n") >= least).orderBy("leaf", "label").collect()
    for r in own:
        leaves[r["leaf"]] -= r["n"]
    found = [(r["leaf"], r["label"], r["n"]) for r in own] + [(leaf, None, n) for leaf, n in sorted(leaves.items()) if n]
    cells, first = [], 0
    for leaf, label, n in found:
        cells.append(Cell(leaf, label, -(-n // part_rows), first))
        first += cells[-1].parts
    return cells


def bin_width(cells: list[Cell]) -> int:
    """Parts of a bin."""
    return max(SLICE, -(-(cells[-1].first + cells[-1].parts) // SLICES))


def part_table(routed: DataFrame, tree: Tree, cells: list[Cell], width: int, fan: int) -> DataFrame:
    """A row a part: cell, bin, leaf, payload, and the ranges of its distances to the split points above it."""
    spark, wide = routed.sparkSession, bin_width(cells)
    table = spark.createDataFrame([(k, c.leaf, c.label, c.parts) for k, c in enumerate(cells)], "cell int, leaf int, of long, parts int")
    own = F.broadcast(table.filter("of is not null").select("cell", "leaf", F.col("of").alias("label"), "parts"))  # at most OWN_CELL rows
    rest = F.broadcast(table.filter("of is null").select(F.col("cell").alias("rest"), "leaf", F.col("parts").alias("rest_parts")))  # a row a leaf
    placed = routed.join(own, ["leaf", "label"], "left").join(rest, "leaf", "left")
    part = F.pmod(F.xxhash64("row"), F.coalesce("parts", "rest_parts")).cast("int")
    placed = placed.select(F.coalesce("cell", "rest").alias("cell"), part.alias("part"), "leaf", "row", "vec_id", "label", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (cell, part), table in whole_groups(batches, ["cell", "part"]):
            table = table.combine_chunks()
            whole = as_matrix(table.column("x").combine_chunks(), width)
            x, leaf = whole.astype(np.float64), table.column("leaf")[0].as_py()
            points = spread_points(x, fan)
            to = np.column_stack([distances(x, points), np.sqrt((x**2).sum(1))])
            side = to[:, :-1].argmin(1)
            order = np.argsort(side, kind="stable")
            ends = np.searchsorted(side[order], np.arange(len(points)), "right")
            starts = np.concatenate(([0], ends[:-1]))
            low, high = (np.array([f(to[order[s:e]], 0) for s, e in zip(starts, ends)]) for f in (np.min, np.max))
            above = tree.path_distances(leaf, x)
            ids, labels, row = (table.column(c).to_numpy()[order] for c in ("vec_id", "label", "row"))
            payload = pack(x=small(whole[order]), ids=ids, labels=labels, rows=row, points=points, ends=ends, low=low, high=high)
            values = [[cell], [(cells[cell].first + part) // wide], [leaf], [payload], [above.min(0).tolist()], [above.max(0).tolist()]]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["cell", "bin", "leaf", "payload", "low", "high"])

    dealt = placed.repartition("cell", "part").sortWithinPartitions("cell", "part")
    return dealt.mapInArrow(run, "cell int, bin int, leaf int, payload binary, low array<double>, high array<double>")


def learn_ranges(tree: Tree, parts: DataFrame) -> None:
    """The ranges of every leaf, over all rows: a few numbers a leaf reach the driver."""
    each = parts.select("leaf", F.posexplode(F.arrays_zip("low", "high")).alias("k", "r"))
    tree.low, tree.high = [np.zeros(0)] * len(tree.paths), [np.zeros(0)] * len(tree.paths)
    found: dict[int, dict[int, tuple[float, float]]] = {}
    for r in each.groupBy("leaf", "k").agg(F.min("r.low").alias("low"), F.max("r.high").alias("high")).collect():
        found.setdefault(r["leaf"], {})[r["k"]] = (r["low"], r["high"])
    for leaf, by in found.items():
        tree.low[leaf], tree.high[leaf] = (np.array([by[k][side] for k in range(len(by))]) for side in (0, 1))


Chosen = Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def block_ranges(counts: dict[int, int], block_rows: int) -> list[tuple[int, int, int]]:
    """(leaf, first block, blocks): a leaf of many anchors has blocks of its own, neighbouring leaves of few share one."""
    out, block, held = [], 0, 0
    for leaf, n in sorted(counts.items()):
        if held and held + n > block_rows:
            block, held = block + 1, 0
        many = -(-n // block_rows)
        out.append((leaf, block, many))
        block, held = (block, held + n) if many == 1 else (block + many, 0)
    return out


def probes(anchors: DataFrame, tree: Tree, cells: list[Cell], width: int, own: bool | None, same: bool, block_rows: int) -> DataFrame:
    """(bin, cells, block): blocks of anchors, once for each bin, with the cells in it that their windows reach.

    anchors: row, vec_id, label, x, leaf and ``windows`` (array of key, lo, hi). ``own``: only cells of
    the leaves of their block, only others, or all (null). ``same``: rows of the anchor's label are searched, or those of others.
    """
    wide = bin_width(cells)
    counts = {r["leaf"]: r["n"] for r in anchors.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row a leaf
    blocks = anchors.sparkSession.createDataFrame(block_ranges(counts, block_rows), "leaf int, first int, blocks int")
    no = F.col("first") + F.pmod(F.xxhash64("row"), "blocks").cast("int")
    dealt = anchors.join(F.broadcast(blocks), "leaf").withColumn("no", no).repartition("no").sortWithinPartitions("no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in whole_groups(batches, ["no"]):
            table = table.combine_chunks()
            leaves = np.unique(table.column("leaf").to_numpy())
            whole = as_matrix(table.column("x").combine_chunks(), width)
            x = whole.astype(np.float64)
            windows = table.column("windows").to_pylist()
            most = max(map(len, windows), default=0)
            lo, hi = np.full((len(x), most), MOST), np.full((len(x), most), LEAST)
            key = np.zeros((len(x), most), np.int64)
            for i, found in enumerate(windows):
                for k, w in enumerate(found):
                    key[i, k], lo[i, k], hi[i, k] = w["key"], w["lo"], w["hi"]
            labels = table.column("label").to_numpy()
            reached = np.zeros(len(tree.paths), bool)
            if own is None or not own:
                reached = tree.reached(x, lo.astype(np.float64), hi.astype(np.float64))
                reached[leaves] &= own is None
            else:
                reached[leaves] = True
            of = set(labels.tolist())
            alone = next(iter(of)) if len(of) == 1 else None
            payload = pack(x=small(whole), labels=labels, rows=table.column("row").to_numpy(), ids=table.column("vec_id").to_numpy(), key=key, lo=lo, hi=hi)
            bins: dict[int, list[int]] = {}
            for k, cell in enumerate(cells):
                if not reached[cell.leaf] or cell.label is not None and (cell.label not in of if same else cell.label == alone):
                    continue
                for b in range(cell.first // wide, (cell.first + cell.parts - 1) // wide + 1):
                    bins.setdefault(b, []).append(k)
            for b, held in bins.items():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([held], pa.list_(pa.int32())), pa.array([payload])], names=["bin", "cells", "block"])

    return dealt.select("no", "leaf", "row", "vec_id", "label", "x", "windows").mapInArrow(run, "bin int, cells array<int>, block binary")


def best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` of each group by falling score and rising id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, int)
    rank = np.arange(len(g)) - np.repeat(first, np.diff([*first, len(g)]))
    return order[rank < most]


def meet(block: dict[str, np.ndarray], part: dict[str, np.ndarray], same: bool, most: int) -> list[np.ndarray]:
    """Of each anchor and window the best ``most`` rows of a part: columns anchor, window, key, row, id, score."""
    a = block["x"].astype(np.float64)
    to = np.column_stack([distances(a, part["points"]), np.sqrt((a**2).sum(1))])
    lo, hi = block["lo"], block["hi"]
    wide = lo.astype(np.float64), hi.astype(np.float64)
    least = lo.min(1, initial=MOST)
    # anchors without a row of their label here have no positives, those of its only label no negatives
    labels = np.unique(part["labels"])
    able = np.isin(block["labels"], labels) if same else (block["labels"] != labels[0]) | (len(labels) > 1)
    out: list[np.ndarray] = []
    start = 0
    for c, end in enumerate(part["ends"].tolist()):
        index = np.flatnonzero(able & reach(to, part["low"][c], part["high"][c], *wide))
        s, start = slice(start, end), end
        if not len(index) or s.start == end:
            continue
        score = products(block["x"][index], part["x"][s])
        # the scores of all pairs are compared once, as they are; few pairs are left for the other conditions
        bound = least[index] if score.dtype.kind == "i" else np.nextafter(least[index].astype(score.dtype), score.dtype.type(-np.inf))
        if same and s.stop - s.start > 2 * most and (least[index] == LEAST).any() and hi.min() == MOST:  # nothing to beat yet: more than the best few of this part, and the anchor itself, can't win
            own = score if len(labels) == 1 else np.where(block["labels"][index][:, None] == part["labels"][s], score, score.min())
            bound = np.maximum(bound, np.partition(own, -most - 1, 1)[:, -most - 1])
        i, j = np.nonzero(score >= bound[:, None])
        anchor, row, value = index[i], j + s.start, score[i, j].astype(np.int64)
        equal = block["labels"][anchor] == part["labels"][row]
        fits = equal & (block["rows"][anchor] != part["rows"][row]) if same else ~equal
        anchor, row, value = anchor[fits], row[fits], value[fits]
        for w in range(lo.shape[1]):
            inside = (value >= lo[anchor, w]) & (value <= hi[anchor, w])
            at, col, v = anchor[inside], row[inside], value[inside]
            kept = best(at, v, part["ids"][col], most)
            out.append(np.stack([at[kept], np.full(len(kept), w), part["rows"][col[kept]], part["ids"][col[kept]], v[kept]]))
    return np.concatenate(out, 1) if out else np.zeros((5, 0), np.int64)


def search(probe: DataFrame, parts: DataFrame, same: bool, most: int) -> DataFrame:
    """(anchor, anchor_id, key, row, vec_id, score): the best ``most`` of each anchor and window over all parts it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = None, {}
        for batch in batches:
            for data, other in zip(batch.column("block"), batch.column("payload")):
                if held is None or not data.equals(held):  # a block stands in several rows on end
                    held, block = data, unpack(data.as_py())
                part = unpack(other.as_py())
                at, w, row, ids, score = meet(block, part, same, most)
                if len(at):
                    kept = best(at * block["lo"].shape[1] + w, score, ids, most)
                    at, w, row, ids, score = (v[kept] for v in (at, w, row, ids, score))
                    columns = [block["rows"][at], block["ids"][at], block["key"][at, w], row, ids, score]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "anchor_id", "key", "row", "vec_id", "score"])

    met = probe.join(parts.select("cell", "bin", "payload"), "bin").filter(F.array_contains("cells", F.col("cell"))).select("block", "payload")
    return first_of(met.mapInArrow(run, "anchor long, anchor_id long, key long, row long, vec_id long, score long"), most)


def first_of(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of each anchor and window, with their rank."""
    from pyspark.sql import Window

    order = Window.partitionBy("anchor", "key").orderBy(F.desc("score"), "vec_id", "row")
    return found.drop("rank").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def hard_negatives(
    rows: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, part_rows: int = PART_ROWS, sample: int = SAMPLE, fan: int = FAN, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor and positive.

    rows: vec_id long, label long, anchor boolean, x array<long>, all fit to take part. Positives are an anchor's
    first ``positives`` other rows of its label; negatives the first ``negatives`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark = rows.sparkSession
    small_batches(spark)
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).first()
    if not size["n"]:
        return spark.createDataFrame([], schema)
    width, made = max(size["width"], 1), []
    rows = rows.select("vec_id", "label", "anchor", padded(F.col("x"), width).alias("x"))
    chosen = smallest_hashes(rows, size["n"], sample).collect()
    tree = Tree()
    tree.grow(np.array([r["x"] for r in chosen], np.float64), max(8, part_rows * len(chosen) // size["n"]), fan, LEVELS, [])
    routed = stored(routed_rows(rows, tree, width).withColumn("row", F.monotonically_increasing_id()), "routed", made)
    cells = cells_of(routed, part_rows)
    parts = stored(part_table(routed, tree, cells, width, fan), "parts", made)
    learn_ranges(tree, parts)

    def window(key: str | int, lo: object, hi: object) -> object:
        return F.struct(F.lit(key).cast("long").alias("key") if isinstance(key, int) else F.col(key).alias("key"), lo.alias("lo"), hi.alias("hi"))

    anchors = routed.filter("anchor").select("row", "vec_id", "label", "x", "leaf")
    every = anchors.withColumn("windows", F.array(window(0, F.lit(LEAST), F.lit(MOST))))
    near = stored(search(probes(every, tree, cells, width, True, True, block_rows), parts, True, positives), "near", made)
    beat = near.filter(F.col("rank") == positives).select(F.col("anchor").alias("row"), F.col("score").alias("beat"))
    bounded = anchors.join(beat, "row", "left").withColumn("windows", F.array(window(0, F.coalesce("beat", F.lit(LEAST)), F.lit(MOST)))).drop("beat")
    far = search(probes(bounded, tree, cells, width, False, True, block_rows), parts, True, positives)
    chosen_positives = stored(first_of(near.unionByName(far), positives), "positives", made)

    # a positive is known by its rank; the window's ends are whole numbers, rounded inwards
    exact = F.col("score").cast("decimal(38,0)")
    lo, hi = -F.floor(-exact * low / 100), F.floor(exact * high / 100)
    inside = lambda c: F.least(F.greatest(c, F.lit(LEAST)), F.lit(MOST)).cast("long")
    ends = chosen_positives.select(F.col("anchor").alias("row"), F.col("rank").cast("long").alias("key"), inside(lo).alias("lo"), inside(hi).alias("hi"))
    windows = ends.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("key", "lo", "hi"))).alias("windows"))  # at most ``positives`` of each
    found = search(probes(anchors.join(windows, "row"), tree, cells, width, None, False, block_rows), parts, False, negatives)
    of = chosen_positives.select("anchor", F.col("rank").cast("long").alias("key"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.join(of, ["anchor", "key"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
    out = stored(out, "negatives")
    drop_tables(spark, made)
    return out
