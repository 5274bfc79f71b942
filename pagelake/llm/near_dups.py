"""Near-duplicate groups by a chosen-path set similarity join.

Every document is a set of word shingles, and every distinct set one class with a
number of its own (its copies only add members). A class gets a sketch of minwise tokens. Each of
several independent trees starts with all classes; a node chooses one coordinate
of the sketch (now and then a second, so that similar pairs are expected to
survive any number of levels), and a class goes to the child named by its token
there. Nodes of at most ``leaf`` classes are compared exhaustively on sketches;
larger ones branch further. Pairs whose sketches come near the threshold are
confirmed on the full sets, and confirmed links give connected components.

Only components matter, and no list of pairs ever leaves a task. In a first round
the leaves of a few trees, in a second those of all others name the members that
come near one of another component (of a pair, in the first node that both share);
the sets of those members go to the leaf once each, and the leaf confirms what
joins its components and gives at most one link less than it has members. A node
that stays large down to the last level (thousands of near copies) goes through
the first round in chunks with a few common guests, and through the second in
blocks: its members outside its main component against all of its members. Leaves
of very many shingles are split. No pair is capped away.

Null and word-less texts have empty sets and are linked with nothing. Texts with
fewer words than a shingle are one shingle of all their words. Rows that repeat
an id are one document with several sets, all in one component, linked with whatever
any of the sets is linked with; each row keeps its result row. A row
without an id cannot be named by a link and is a group of its own. A very long
text is one set of its size (8 bytes a shingle) in a task. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import drop_tables, giving_back, id_and_text, map_texts, stored

COORDINATES, LEAF, DEPTH = 128, 1024, 11
#: Chance that a pair exactly at the threshold shares a leaf of some tree at the last level, at least.
RECALL = 0.997
#: At most so many trees; the first nodes of a tree and of the next are ONE_TREE apart.
MOST_TREES, ONE_TREE = 64, 1 << 57
#: Trees of the first round.
FIRST_TREES = 1
#: Members of a large node that every chunk of it meets.
GUESTS = 4
#: Rows of a large node that are compared at once with as many others.
BLOCK = 1024
#: Shingles of a cell whose full sets are compared at once; cells of more are split.
CELL_SHINGLES = 2_000_000
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: multiplications and shifts."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


_FACTORS = (mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1))[:, None]


def missed(threshold: float, trees: int, depth: int) -> float:
    """Chance that a pair of this similarity shares no leaf at ``depth`` of any tree.

    All trees see one sketch, in which a binomial number of coordinates is equal; given
    that number, nodes choose coordinates independently.
    """
    equal = np.arange(COORDINATES + 1)
    chance = np.array([math.comb(COORDINATES, k) * threshold**k * (1 - threshold) ** (COORDINATES - k) for k in equal.tolist()])
    share, meets = equal / COORDINATES, np.ones(COORDINATES + 1)
    for _ in range(depth):
        meets = 1 - (1 - share * meets) * (1 - (1 / threshold - 1) * share * meets)
    return float((chance * (1 - meets) ** trees).sum())


def trees_for(threshold: float, recall: float, depth: int | None = None) -> int:
    """The smallest number of trees that misses at most 1 - ``recall``."""
    for n in range(FIRST_TREES + 1, MOST_TREES + 1):
        if missed(threshold, n, DEPTH if depth is None else depth) <= 1 - recall:
            return n
    raise ValueError(f"recall {recall} at {threshold} takes more than {MOST_TREES} trees")


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; A-Z are lower-cased, white space is that of ASCII."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(size, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = mix(out + h[i : len(h) - n + 1 + i] + U(n))
    return np.unique(out)


def key_of(s: np.ndarray) -> bytes | None:
    """What equal sets have in common; null for the empty one."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The minwise token, 16 bits, at each coordinate: first the low bytes, then the high ones."""
    x = (hashes >> U(32)).astype(np.uint32)
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(least, (_FACTORS * x[None, at : at + 512]).min(1), out=least)
    token = ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
    return np.concatenate((token.astype(np.uint8), (token >> np.uint16(8)).astype(np.uint8)))


def set_table(docs: DataFrame, size: int, made: list[str]) -> DataFrame:
    """doc_id, n_shingles, key (of the set; null if empty) and sketch of every row, stored."""

    def rows(texts: list[str]) -> dict[str, list]:
        out: dict[str, list] = {"n_shingles": [], "key": [], "sketch": []}
        for text in texts:
            s = shingle_set(text, size)
            out["n_shingles"].append(len(s))
            out["key"].append(key_of(s))
            out["sketch"].append(sketch(s).tobytes() if len(s) else None)
        return out

    return stored(map_texts(docs, rows, "n_shingles long, key binary, sketch binary"), "sets", made)


def descend(path: np.ndarray, index: np.ndarray, tokens: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Children of (path, row): each node chooses a coordinate, and a second with probability 1 / threshold - 1."""
    tree = path & ~U(ONE_TREE - 1)
    choice = mix(path + U(0x9E3779B97F4A7C15))
    first = choice % U(COORDINATES)
    second = (first + U(1) + (choice >> U(8)) % U(COORDINATES - 1)) % U(COORDINATES)
    taken = (choice >> U(32)) < U(int((1 / threshold - 1) * 2**32))

    def child(c: np.ndarray, at: np.ndarray) -> np.ndarray:
        token = tokens[index[at], c[at].astype(np.int64)].astype(np.uint64)
        return (mix(path[at] ^ mix((c[at] << U(16)) | token)) & U(ONE_TREE - 1)) | tree[at]

    every = np.ones(len(path), bool)
    return np.concatenate([child(first, every), child(second, taken)]), np.concatenate([index, index[taken]])


def branch(members: DataFrame, threshold: float, levels: int, trees: int = 0) -> DataFrame:
    """(node, cls) after more levels. members: (cls, sketch), with a node unless they start at the roots of ``trees``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                n = part.num_rows
                both = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint8).reshape(n, 2 * COORDINATES)
                tokens = both[:, :COORDINATES] | both[:, COORDINATES:].astype(np.uint16) << np.uint16(8)
                if trees:
                    path, index = np.repeat(np.arange(trees, dtype=np.uint64) * U(ONE_TREE), n), np.tile(np.arange(n), trees)
                else:
                    path, index = part.column("node").to_numpy().view(np.uint64), np.arange(n)
                for _ in range(levels):
                    path, index = descend(path, index, tokens, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), part.column("cls").take(pa.array(index))], names=["node", "cls"])

    return members.mapInArrow(giving_back(run), "node long, cls long")


def grow_trees(classes: DataFrame, threshold: float, trees: int, made: list[str]) -> tuple[DataFrame, DataFrame]:
    """(node, cls, n) of the leaves, and of the nodes that stay large down to the last level; n counts a node's classes."""
    leaves, depth, levels = [], 0, 2
    current = branch(classes.select("cls", "sketch"), threshold, levels, trees)
    while True:
        depth += levels
        sizes = stored(current.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"), "nodes", made)
        members = stored(current.join(sizes, "node"), "members", made)
        leaves.append(members.filter(F.col("n") <= LEAF))
        large = members.filter(F.col("n") > LEAF)
        if depth >= DEPTH or large.isEmpty():
            return reduce(DataFrame.unionByName, leaves), large
        levels = 3
        current = stored(branch(large.select("node", "cls").join(classes.select("cls", "sketch"), "cls"), threshold, levels), "paths", made)


def whole_cells(leaves: DataFrame) -> DataFrame:
    """Cells (cell, node, side, cls) of leaves: all members compared with all."""
    return leaves.select(F.col("node").alias("cell"), "node", F.lit(0).alias("side"), "cls")


def chunk_cells(large: DataFrame) -> DataFrame:
    """Large nodes in chunks, each compared within itself and with a few guests, the same in all chunks of a node."""
    chunks = F.ceil(F.col("n") / LEAF).cast("int")
    chunk = F.pmod(F.xxhash64("cls", "node"), chunks).cast("int")
    own = large.select("node", "cls", chunk.alias("chunk"))
    some = F.array(*[F.min_by("cls", F.xxhash64("cls", F.lit(k))) for k in range(GUESTS)])
    guests = large.groupBy("node", "n").agg(F.array_distinct(some).alias("some"))
    guests = guests.select("node", "n", F.explode("some").alias("cls"))
    guests = guests.select("node", "cls", chunk.alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk")).filter("own <> chunk")
    every = own.unionByName(guests.drop("own"))
    return every.select(F.xxhash64("node", "chunk").alias("cell"), "node", F.lit(0).alias("side"), "cls")


def block_cells(large: DataFrame, labels: DataFrame) -> DataFrame:
    """Large nodes of several labels: members outside a node's main label, in chunks, against blocks of all."""
    rows = large.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    sizes = rows.groupBy("node", "label").agg(F.count("*").alias("of_label"))
    main = sizes.groupBy("node").agg(
        F.sum("of_label").alias("n_all"), F.max("of_label").alias("n_main"), F.max_by("label", F.struct("of_label", F.col("label") * -1)).alias("main")
    ).filter("n_all > n_main")
    rows = rows.join(main, "node")
    blocks = F.ceil(F.col("n_all") / BLOCK).cast("int")
    chunks = F.ceil((F.col("n_all") - F.col("n_main")) / BLOCK).cast("int")
    place = lambda k: F.pmod(F.xxhash64("cls", "node"), k).cast("int")
    spread = lambda k: F.explode(F.sequence(F.lit(0), k - 1))
    base = rows.select("node", "cls", place(blocks).alias("block"), spread(chunks).alias("chunk"), F.lit(1).alias("side"))
    others = rows.filter("label <> main").select("node", "cls", spread(blocks).alias("block"), place(chunks).alias("chunk"), F.lit(2).alias("side"))
    return base.unionByName(others).select(F.xxhash64("node", "block", "chunk").alias("cell"), "node", "side", "cls")


def cell_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole cells from batches sorted by cell."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch.column("cell").to_numpy()
        cut = int(np.searchsorted(cell, cell[-1]))
        if held and held[-1].column("cell")[0].as_py() != cell[-1]:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif not held and cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def bounds(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the cells of a sorted array begin and end."""
    cuts = np.flatnonzero(cell[1:] != cell[:-1]) + 1
    return np.concatenate(([0], cuts)), np.concatenate((cuts, [len(cell)]))


def rows_of_bytes(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


class Bags:
    """Sets of ascending numbers, a row each: how many does one row share with others?"""

    def __init__(self, column: pa.ChunkedArray):
        lists = column.combine_chunks()
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        self.known, self.flat = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.mark = np.zeros(len(self.known), bool)

    def shared(self, i: int, others: np.ndarray, below: int | None = None) -> np.ndarray:
        """How many numbers of row i (those under ``below``) each of the others has."""
        mine = self.flat[self.starts[i] : self.ends[i]]
        mine = mine if below is None else mine[: np.searchsorted(self.known[mine], below)]
        self.mark[mine] = True
        starts, sizes = self.starts[others], self.ends[others] - self.starts[others]
        ends = np.cumsum(sizes)
        at = np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        hits = np.concatenate(([0], np.cumsum(self.mark[self.flat[at]])))
        self.mark[mine] = False
        return hits[ends] - hits[ends - sizes]


def candidates(low: np.ndarray, n: np.ndarray, label: np.ndarray, side: np.ndarray, cut: float, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, later rows) of a cell: pairs of two labels whose sketches and set sizes are near, rows of rare labels first."""
    _, group, often = np.unique(label, return_inverse=True, return_counts=True)
    order = np.lexsort((group, often[group]))
    last = group[order[-1]]
    for k, i in enumerate(order[:-1]):
        if group[i] == last:
            return
        js = order[k + 1 :]
        near = (group[js] != group[i]) & ((side[js] != side[i]) | (side[i] == 0))
        near &= (100 * n[js] >= percent * n[i]) & (100 * n[i] >= percent * n[js])
        js = js[near]
        if len(js):
            js = js[(low[js] == low[i]).sum(1) >= cut]
            if len(js):
                yield int(i), js


def flagged(cells: DataFrame, info: DataFrame, cut: float, percent: int) -> DataFrame:
    """Members of cells that are near a member of another label and meet it in no earlier node: cell, side, cls, parts.

    ``parts`` says in how many parts the cell is to be split (``split_cells``). info: cls, n, low, label, nodes (all nodes of the class in order).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in cell_tables(batches):
            n, label, side, node = (table.column(c).to_numpy() for c in ("n", "label", "side", "node"))
            low = rows_of_bytes(table.column("low"))
            keep = np.zeros(len(n), bool)
            starts, ends = bounds(table.column("cell").to_numpy())
            # nodes of two in one step; others with near pairs get their earlier nodes compared
            a = starts[ends - starts == 2]
            near = (label[a] != label[a + 1]) & (100 * np.minimum(n[a], n[a + 1]) >= percent * np.maximum(n[a], n[a + 1]))
            a = a[near & ((side[a] == 0) | (side[a] != side[a + 1]))]
            a = a[(low[a] == low[a + 1]).sum(1) >= cut]
            pairs = [(k, k + 2, 0, np.array([1])) for k in a.tolist()]
            more = ends - starts > 2
            for s, e in zip(starts[more].tolist(), ends[more].tolist()):
                if (label[s:e] != label[s]).any():
                    pairs += [(s, e, i, js) for i, js in candidates(low[s:e], n[s:e], label[s:e], side[s:e], cut, percent)]
            bags, of = None, -1
            for s, e, i, js in pairs:
                if s != of:
                    bags, of = Bags(table.column("nodes").slice(s, e - s)), s
                js = js[bags.shared(i, js, node[s]) == 0]
                if len(js):
                    keep[s + i] = True
                    keep[s + js] = True
            if keep.any():
                # cells are whole here
                total = np.add.reduceat(np.where(keep, n, 0), starts)
                parts = np.repeat(-(-total // CELL_SHINGLES), ends - starts).astype(np.int32)
                yield from table.select(["cell", "side", "cls"]).append_column("parts", pa.array(parts)).filter(pa.array(keep)).to_batches()

    dealt = cells.join(info, "cls").select("cell", "node", "side", "cls", "n", "low", "label", "nodes").repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(giving_back(run), "cell long, side int, cls long, parts int")


def split_cells(members: DataFrame) -> DataFrame:
    """Cells of very many shingles in smaller ones, so that the sets of one fit in memory; every pair still meets."""
    own = F.pmod(F.xxhash64("cls", "cell"), F.col("parts")).cast("int")
    rows = members.select("cell", "side", "cls", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    first = F.when(F.col("side") == 0, F.least("own", "other")).when(F.col("side") == 1, F.col("own")).otherwise(F.col("other"))
    second = F.when(F.col("side") == 0, F.greatest("own", "other")).when(F.col("side") == 1, F.col("other")).otherwise(F.col("own"))
    side = F.when((F.col("side") > 0) | (F.col("own") == F.col("other")), F.col("side")).otherwise(F.when(F.col("own") < F.col("other"), 1).otherwise(2))
    return rows.select(F.xxhash64("cell", first, second).alias("cell"), side.cast("int").alias("side"), "cls")


def links_of(members: DataFrame, facts: DataFrame, sets: DataFrame, cut: float, percent: int) -> DataFrame:
    """Links (a, b) that join the labels of each cell, confirmed on the full sets: 100 * intersection >= percent * union.

    Candidates within one component need no look. facts: cls, key, n, low, label; sets: key, shingles, which move by key and by cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in cell_tables(batches):
            starts, ends = bounds(table.column("cell").to_numpy())
            found: list[tuple[int, int]] = []
            for s, e in zip(starts.tolist(), ends.tolist()):
                part = table.slice(s, e - s)
                cls, n, label, side = (part.column(c).to_numpy() for c in ("cls", "n", "label", "side"))
                bags, root = None, np.unique(label, return_inverse=True)[1]
                for i, js in candidates(rows_of_bytes(part.column("low")), n, label, side, cut, percent):
                    js = js[root[js] != root[i]]
                    if not len(js):
                        continue
                    bags = bags or Bags(part.column("shingles"))
                    both = bags.shared(i, js)
                    js = js[100 * both >= percent * (n[i] + n[js] - both)]
                    _, first = np.unique(root[js], return_index=True)
                    for j in js[first].tolist():
                        found.append((min(cls[i], cls[j]), max(cls[i], cls[j])))
                        root[root == root[j]] = root[i]
            if found:
                a, b = np.array(found, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = members.join(facts, "cls").join(sets, "key").select("cell", "side", "cls", "n", "low", "label", "shingles").repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(giving_back(run), "a long, b long")


def sets_of(docs: DataFrame, ids: DataFrame, size: int, made: list[str], bits: int = 20) -> DataFrame:
    """(key, shingles) of the documents ``rep`` of ``ids`` (rep, key). A bit table of fixed size drops most others before the shuffle.

    The table is a broadcast of at most 2 ** (bits - 6) words: a test in Python before the join would keep a
    second worker for each task. A document that repeats an id with another text has another key, so it is never
    taken for the class. Rows that repeat a text under one id give a key once a task; more than one row of a class
    in a cell does no harm.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    words = ids.select(place("rep").alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v"))
    table = F.broadcast(stored(words, "bits", made))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes | None] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                keys, lists = [], []
                for text in batch.column("text").slice(at, 256).to_pylist():
                    s = shingle_set(text, size)
                    if (key := key_of(s)) not in seen:
                        seen.add(key)
                        keys.append(key)
                        lists.append(s.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], names=["key", "shingles"])

    held = docs.filter("doc_id is not null").select(F.col("doc_id").alias("rep"), "text", place("doc_id").alias("p")).withColumn("w", F.shiftright("p", 6))
    held = held.join(table, "w").filter("(shiftright(v, cast(p % 64 as int)) & 1) = 1").select("rep", "text")
    return held.join(ids.select("rep"), "rep", "left_semi").mapInArrow(giving_back(shingled), "key binary, shingles array<long>")


def several_sets(rows: DataFrame, classes: DataFrame, made: list[str]) -> DataFrame:
    """(doc_id, cls) of ids whose rows have different sets, and one of them is not empty."""
    keys = rows.filter("doc_id is not null").groupBy("doc_id")
    ids = keys.agg(F.min("key").alias("a"), F.max("key").alias("b"), F.count("*").alias("n"), F.count("key").alias("m")).filter("a <> b or (m > 0 and m < n)").select("doc_id")
    known = rows.filter("key is not null").join(ids, "doc_id").select("doc_id", "key").distinct()
    return stored(known.join(classes.select("key", "cls"), "key").select("doc_id", "cls"), "several", made)


def components(edges: DataFrame, made: list[str]) -> DataFrame:
    """(cls, label) of every end of an edge: label is the smallest class reachable.

    Labels spread to neighbours and jump to their label's label until none changes.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", made)
    labels = stored(both.groupBy(F.col("a").alias("cls")).agg(F.least(F.min("b"), F.col("cls")).alias("label")), "labels", made)
    while True:
        spread = both.join(labels.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("label").alias("near"))
        closer = labels.join(spread, "cls").select("cls", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        root = labels.select(F.col("cls").alias("label"), F.col("label").alias("root"))
        new = stored(closer.join(root, "label").select("cls", "was", F.least("label", "root").alias("label")), "labels", made)
        labels = new.select("cls", "label")
        if new.filter("label <> was").isEmpty():
            return labels


def joined_labels(labels: DataFrame, links: DataFrame, made: list[str]) -> DataFrame:
    """``labels`` after further links between classes of different labels."""
    label_of = lambda c: labels.select(F.col("cls").alias(c), F.col("label").alias(f"l{c}"))
    ends = links.join(label_of("a"), "a", "left").join(label_of("b"), "b", "left")
    joined = components(ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")), made)
    renamed = joined.select(F.col("cls").alias("label"), F.col("label").alias("new"))
    fresh = links.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(labels, "cls", "left_anti").withColumn("label", F.col("cls"))
    return stored(labels.unionByName(fresh).join(renamed, "label", "left").select("cls", F.coalesce("new", "label").alias("label")), "labels", made)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links) and kept (the id is the component's) of every row.

    Documents are linked with 100 * intersection >= percent * union of their sets of ``size``-word shingles.
    ``recall`` sets the number of trees (``trees_for``). A row without an id is a group of its own: null component_id, kept.
    """
    threshold = percent / 100
    cut = threshold - 4 * (threshold * (1 - threshold) / COORDINATES) ** 0.5
    cut = COORDINATES * (cut * (1 - 1 / 256) + 1 / 256)  # equal low bytes, some by chance
    made: list[str] = []
    docs = id_and_text(docs, id_col, text_col)
    rows = set_table(docs, size, made)
    distinct = rows.filter("key is not null and doc_id is not null").groupBy("key", "sketch")
    numbered = distinct.agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n")).withColumn("cls", F.monotonically_increasing_id())
    classes = stored(numbered, "classes", made)
    leaves, large = grow_trees(classes, threshold, trees_for(threshold, recall), made)
    nodes = leaves.unionByName(large).groupBy("cls").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    known = stored(classes.select("cls", "n", F.substring("sketch", 1, COORDINATES).alias("low")).join(nodes, "cls"), "known", made)

    # empty, by the plan alone: a local table of rows would start Python workers of another kind
    labels = classes.select("cls", F.col("cls").alias("label")).filter(F.lit(False))
    several = several_sets(rows, classes, made)
    repeated = not several.isEmpty()
    if repeated:  # the classes of one id, all linked with the first
        hub = several.groupBy("doc_id").agg(F.min("cls").alias("a"))
        own = several.join(hub, "doc_id").select("a", F.col("cls").alias("b")).filter("a <> b").distinct()
        labels = joined_labels(labels, own, made)
    first = F.col("node") < FIRST_TREES * ONE_TREE
    crowded = not large.isEmpty()
    for cells in (
        lambda: (whole_cells(leaves.filter(first)), chunk_cells(large.filter(first)) if crowded else None),
        lambda: (whole_cells(leaves.filter(~first)), block_cells(large, labels) if crowded else None),
    ):
        info = known.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        of_leaves, of_large = cells()
        members = stored(flagged(of_leaves.unionByName(of_large) if crowded else of_leaves, info, cut, percent), "flagged", made)
        # stored, since the links' plan takes it three times: that of all in one took the driver's memory
        wanted = members.select("cls").distinct().join(classes.select("cls", "rep", "key"), "cls")
        facts = stored(wanted.join(info.drop("nodes"), "cls"), "facts", made)
        sets = sets_of(docs, facts.select("rep", "key"), size, made)
        links = stored(links_of(split_cells(members), facts.drop("rep"), sets, cut, percent).distinct(), "links", made)
        if not links.isEmpty():
            labels = joined_labels(labels, links, made)
    # a component is named by its smallest id; most classes are alone and name themselves
    named = classes.select("key", "cls", "rep").join(labels, "cls", "left")
    smallest = named.filter("label is not null").groupBy("label").agg(F.min("rep").alias("least"))
    named = named.join(smallest, "label", "left").select("key", "cls", F.coalesce("least", "rep").alias("component_id"))

    placed = rows.select("doc_id", "n_shingles", "key").join(named.select("key", "component_id"), "key", "left")
    if repeated:  # rows without words follow the others of their id
        of_id = several.join(named.select("cls", "component_id"), "cls").groupBy("doc_id").agg(F.min("component_id").alias("of_id"))
        placed = placed.join(of_id, "doc_id", "left").withColumn("component_id", F.coalesce("of_id", "component_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    out = stored(placed.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept")), "near_dups")
    drop_tables(docs.sparkSession, made)
    return out
