"""Toxicity by a convolutional text classifier, trained in numpy on every labelled row.

Each word is hashed to a row in each of two embedding tables; filters of several
widths run over the words, each filter keeps its largest value over the whole
text, and one linear layer gives a score. It is fitted with Adagrad on all
labelled rows (whole texts) whose crc32(doc_id as text) mod 4 is not 2; the others
never give labels. The rows are dealt into blocks of some ``block`` rows by a hash
of the id. In each round every block is a task's work: it starts from the common
parameters and descends over its rows; Spark sums the changes of all blocks by
parameter row, and the driver, which sees one sum for each of these (a fixed
number), adds their means over the blocks that touched the row. A word is known if
at least ``MIN_TEXTS`` of the rows have a word of its place among 2^22 hashed
places; all rows are counted. A quarter of the rows (by another hash) isn't trained
on but calibrates the score and, for each language with enough of both classes, the
threshold of the flag: their outputs are counted in Spark by value in half
precision, so that the driver sees at most 65,536 counts a language and class. The
score uses the words alone.

Null text is empty and gets the score of no words; unknown languages use the
common threshold; repeated rows keep one result row each; labels that are null
or whose row has no text are left out; of several labels of a document the
largest counts, of several rows of an id the smallest text trains; rows without an
id are scored and never train; very long texts are scored whole and train whole.
Without labels of both classes every score is the known share of the toxic class
(0 if none). An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import drop_tables, giving_back, map_texts, stored

BITS, HALF, WIDTHS, FILTERS = 17, 8, (1, 2, 3), 8
#: Labelled rows of a block, about; all blocks train in each round.
BLOCK = 8192
#: A block is cut after so many words, a step's batch likewise.
BLOCK_WORDS, BATCH_WORDS = 4_000_000, 200_000
#: A word whose place fewer labelled texts have is unknown; places are the upper bits of a word's 63.
MIN_TEXTS, PLACE_BITS = 3, 22
#: Places of labelled ids in the bitmap that keeps most other texts out of the shuffle.
ID_PLACES = 1 << 25
#: Passes over all rows.
ROUNDS = 6
THRESHOLD = 0.3
WORD = re.compile(r"\w+")


def word_hashes(text: str) -> np.ndarray:
    words = WORD.findall(text.lower())
    return (np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)) >> np.uint64(1)).view(np.int64)


def beyond(starts: np.ndarray, k: int) -> np.ndarray:
    """Places whose ``k``-th next place is in the next of the joined texts."""
    return np.concatenate([starts[1:] - t for t in range(1, k + 1)]) if k else np.zeros(0, np.int64)


@dataclass
class Model:
    """Two embedding tables (row 0 of each stays zero), filters by width, and the last layer."""

    tables: list[np.ndarray] = field(default_factory=list)
    filters: list[np.ndarray] = field(default_factory=list)
    biases: list[np.ndarray] = field(default_factory=list)
    last: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    by_lang: dict[str, float] = field(default_factory=dict)
    constant: float | None = None
    #: Whether words of a place are known; without it all are.
    known: np.ndarray | None = None

    @classmethod
    def fresh(cls, seed: int) -> Model:
        rng = np.random.default_rng(seed)
        new = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        m = cls([new(1 << BITS, HALF, scale=0.1) for _ in range(2)], [new(w, 2 * HALF, FILTERS, scale=0.3) for w in WIDTHS])
        m.biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        m.last = new(FILTERS * len(WIDTHS), scale=0.3)
        for t in m.tables:
            t[0] = 0
        return m

    def parts(self) -> list[np.ndarray]:
        return [*self.tables, *self.filters, *self.biases, self.last]

    def common(self, hashes: np.ndarray) -> np.ndarray:
        """Unknown words are blank (-1)."""
        return hashes if self.known is None else np.where(self.known[hashes >> (63 - PLACE_BITS)], hashes, -1)

    def rows(self, hashes: np.ndarray) -> list[np.ndarray]:
        mask = (1 << BITS) - 1
        return [np.maximum(hashes & mask, 1), np.maximum((hashes >> 24) & mask, 1)]

    def forward(self, texts: list[np.ndarray]) -> dict:
        """Largest value of each filter over each text; two blank words stand behind each text."""
        blank = np.full(2, -1, np.int64)
        joined = np.concatenate([x for t in texts for x in (t, blank)])
        sizes = np.array([len(t) + 2 for t in texts])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        rows = [np.where(joined < 0, 0, r) for r in self.rows(joined)]
        x = np.concatenate([t[r] for t, r in zip(self.tables, rows)], 1)
        values, tops = [], []
        for f, b in zip(self.filters, self.biases):
            h = x @ f[0] + b
            for k in range(1, len(f)):
                h[:-k] += x[k:] @ f[k]
                over = beyond(starts, k)
                h[over] -= x[over + k] @ f[k]
            values.append(h)
            tops.append(np.maximum.reduceat(h, starts))
        top = np.concatenate(tops, 1)
        return {"x": x, "rows": rows, "starts": starts, "sizes": sizes, "values": values, "tops": tops, "z": np.maximum(top, 0) @ self.last + self.bias, "top": top}

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        texts = [self.common(t) for t in texts]
        out, at = [], 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) < 20_000):
                size += len(texts[to])
                to += 1
            out.append(self.forward(texts[at:to])["z"])
            at = to
        return np.concatenate(out) if out else np.zeros(0)

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(texts) + self.shift, -30, 30).astype(np.float64)))


def _step(value: np.ndarray, grad: np.ndarray, seen: np.ndarray, rate: float) -> None:
    seen += grad * grad
    value -= (rate * grad / np.sqrt(seen + 1e-6)).astype(value.dtype)


def fresh_seen(m: Model) -> list[np.ndarray]:
    """Adagrad's sums of squares, by part of the model; the last is the bias's."""
    return [*(np.full(v.shape, 1e-3, np.float32) for v in m.parts()), np.full(1, 1e-3)]


def flat(parts: list[np.ndarray], bias: float) -> np.ndarray:
    """All parameters in rows of eight, the bias eight times in the last."""
    return np.concatenate([*(p.ravel() for p in parts), np.full(HALF, bias)]).astype(np.float32).reshape(-1, HALF)


def spread(rows: np.ndarray, parts: list[np.ndarray]) -> float:
    """Fill ``parts`` from the form of ``flat``; returns the bias."""
    at, values = 0, rows.ravel()
    for p in parts:
        p[...] = values[at : at + p.size].reshape(p.shape)
        at += p.size
    return float(values[at])


def _batches(order: np.ndarray, sizes: list[int]) -> Iterator[np.ndarray]:
    """32 texts, fewer where they are long."""
    at = 0
    while at < len(order):
        to = words = 0
        while to < 32 and at + to < len(order) and (to == 0 or words + sizes[order[at + to]] <= BATCH_WORDS):
            words += sizes[order[at + to]]
            to += 1
        yield order[at : at + to]
        at += to


def descend(m: Model, seen: list[np.ndarray], texts: list[np.ndarray], labels: np.ndarray, share: float, rng: np.random.Generator, rate: float = 0.08, drop: float = 0.3) -> None:
    """One pass: logistic loss, small batches, classes weighted alike by the toxic ``share``; a share ``drop`` of the words is hidden each time."""
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    n_tables = len(m.tables)
    for part in _batches(rng.permutation(len(texts)), [len(t) for t in texts]):
        s = m.forward([np.where(rng.random(len(texts[i])) < drop, -1, texts[i]) for i in part])
        p = 1 / (1 + np.exp(-np.clip(s["z"], -30, 30)))
        g = ((p - labels[part]) * weight[part] / len(part)).astype(np.float32)
        on = np.maximum(s["top"], 0)
        g_top = g[:, None] * m.last[None, :] * (s["top"] > 0)
        text_of = np.repeat(np.arange(len(part)), s["sizes"])
        ends = s["starts"] + s["sizes"]
        places, grads = [], []
        for k, f in enumerate(m.filters):
            gt = g_top[:, k * FILTERS : (k + 1) * FILTERS]
            # only places of a largest value have a gradient
            at, column = np.nonzero(s["values"][k] == np.repeat(np.where(gt == 0, np.nan, s["tops"][k]), s["sizes"], 0))
            own, back = np.unique(at, return_inverse=True)
            dh = np.zeros((len(own), FILTERS), np.float32)
            dh[back, column] = gt[text_of[at], column]
            df = np.empty_like(f)
            for j in range(len(f)):
                inside = own + j < ends[text_of[own]]
                to = own[inside] + j
                df[j] = s["x"][to].T @ dh[inside]
                places.append(to)
                grads.append(dh[inside] @ f[j].T)
            _step(f, df, seen[n_tables + k], rate)
            _step(m.biases[k], dh.sum(0), seen[n_tables + len(m.filters) + k], rate)
        _step(m.last, on.T @ g, seen[-2], rate)
        b1 = np.array([g.sum()])
        seen[-1] += b1 * b1
        m.bias -= float(rate * b1[0] / np.sqrt(seen[-1][0]))
        place, dx = np.concatenate(places), np.concatenate(grads)
        if not len(place):
            continue
        for k, t in enumerate(m.tables):
            r = s["rows"][k][place]
            order = np.argsort(r, kind="stable")
            u, first = np.unique(r[order], return_index=True)
            grad = np.add.reduceat(dx[order, k * HALF : (k + 1) * HALF], first)
            grad[u == 0] = 0
            seen[k][u] += grad * grad
            t[u] -= rate * grad / np.sqrt(seen[k][u] + 1e-6)


def train(texts: list[np.ndarray], labels: np.ndarray, seed: int = 7, rounds: int = ROUNDS, rate: float = 0.08, drop: float = 0.3) -> Model:
    """A model of one block of rows."""
    m, rng = Model.fresh(seed), np.random.default_rng(seed)
    seen = fresh_seen(m)
    for _ in range(rounds):
        descend(m, seen, texts, labels, float(labels.mean()), rng, rate, drop)
    return m


def best_threshold(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """The threshold of the best F1, halfway to the next lower score."""
    order = np.argsort(-score, kind="stable")
    s, y, w = score[order], label[order], weight[order]
    hits, all_ = np.cumsum(y * w), np.cumsum(w)
    f1 = 2 * hits / (all_ + (label * weight).sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(np.argmax(f1))
    return float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k] / 2)


def known_places(rows: DataFrame) -> np.ndarray:
    """Places of words that at least ``MIN_TEXTS`` of all rows have."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << PLACE_BITS, np.int64)
        for batch in batches:
            for words in batch.column("words"):
                n[np.unique(np.frombuffer(words.as_buffer(), np.int64) >> (63 - PLACE_BITS))] += 1
        some = np.flatnonzero(n)
        for at in range(0, len(some), 100_000):
            part = some[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(n[part])], names=["place", "n"])

    counts = rows.select("words").mapInArrow(giving_back(count), "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))
    known = np.zeros(1 << PLACE_BITS, bool)
    known[counts.filter(F.col("n") >= MIN_TEXTS).select("place").toArrow().column("place").to_numpy()] = True
    return known


def one_round(rows: DataFrame, m: Model, seen: list[np.ndarray], share: float, number: int, seed: int) -> None:
    """Every block descends from the model; the means of their changes are added to ``m`` and ``seen``."""
    start = (flat(m.parts(), m.bias), flat(seen[:-1], seen[-1][0]))
    shared = rows.sparkSession.sparkContext.broadcast((*start, m.known))
    names = [f"{x}{i}" for x in "ds" for i in range(HALF)]

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], list[int]]]:
        block, texts, labels, size = None, [], [], 0
        for batch in batches:
            for b, y, words in zip(batch.column("block").to_pylist(), batch.column("toxic").to_pylist(), batch.column("words")):
                if texts and (b != block or size > BLOCK_WORDS):
                    yield block, texts, labels
                    texts, labels, size = [], [], 0
                block = b
                texts.append(np.frombuffer(words.as_py(), np.int64))
                labels.append(y)
                size += len(texts[-1])
        if texts:
            yield block, texts, labels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, squares, known = shared.value
        for block, texts, labels in units(batches):
            own = Model.fresh(seed)
            own.known = known
            own_seen = fresh_seen(own)
            own.bias = spread(values, own.parts())
            own_seen[-1][0] = spread(squares, own_seen[:-1])
            descend(own, own_seen, [own.common(t) for t in texts], np.array(labels), share, np.random.default_rng([seed, number, block]))
            change = np.concatenate([flat(own.parts(), own.bias) - values, flat(own_seen[:-1], own_seen[-1][0]) - squares], 1)
            touched = np.flatnonzero(change.any(1))
            change = change[touched] * np.float32(len(texts))
            columns = [pa.array(touched.astype(np.int32)), pa.array(np.full(len(touched), len(texts), np.int64)), *map(pa.array, np.ascontiguousarray(change.T))]
            yield pa.RecordBatch.from_arrays(columns, names=["slot", "n", *names])

    schema = "slot int, n long, " + ", ".join(f"{x} float" for x in names)
    changes = rows.select("block", "toxic", "words").mapInArrow(giving_back(run), schema).groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names])
    got = changes.select("slot", *[(F.col(x) / F.col("n")).cast("float").alias(x) for x in names]).toArrow()
    slot = got.column("slot").to_numpy()
    for a, x in zip(start, "ds"):
        for i in range(HALF):
            a[slot, i] += got.column(f"{x}{i}").to_numpy()
    m.bias = spread(start[0], m.parts())
    seen[-1][0] = spread(start[1], seen[:-1])
    shared.destroy()


def calibrate(rows: DataFrame, m: Model, share: float) -> None:
    """Slope, shift and thresholds from the outputs of all ``rows``; ``share`` is the toxic share among all labelled rows."""
    shared = rows.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = shared.value.logits([np.frombuffer(w.as_py(), np.int64) for w in batch.column("words")])
            z = np.clip(z, -60_000, 60_000).astype(np.float16).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("lang"), pa.array(z)], names=["toxic", "lang", "z"])

    counts = rows.select("toxic", "lang", "words").mapInArrow(giving_back(run), "toxic int, lang string, z float")
    counts = counts.groupBy("toxic", F.coalesce("lang", F.lit("")).alias("lang"), "z").count().orderBy("lang", "z", "toxic").toPandas()
    shared.destroy()
    z, y, n, lang = counts["z"].to_numpy(), counts["toxic"].to_numpy().astype(np.int64), counts["count"].to_numpy(), counts["lang"].to_numpy()
    toxic = (y * n).sum() / n.sum()
    w = n * np.where(y == 1, share / max(toxic, 1e-9), (1 - share) / max(1 - toxic, 1e-9))
    cut = best_threshold(z, y, w)
    mean = (z * n).sum() / n.sum()
    scale = max(float(np.sqrt((n * (z - mean) ** 2).sum() / n.sum())), 1e-3)
    m.slope = 2 / scale
    m.shift = -m.slope * cut + float(np.log(THRESHOLD / (1 - THRESHOLD)))
    score = 1 / (1 + np.exp(-np.clip(m.slope * z + m.shift, -30, 30)))
    for name in sorted(set(lang.tolist())):
        own = lang == name
        if (y * n)[own].sum() >= 20 and ((1 - y) * n)[own].sum() >= 20:
            m.by_lang[name] = best_threshold(score[own], y[own], w[own])


def may_be_among(known: DataFrame) -> Callable[[str], Column]:
    """A test of ids by a bitmap of fixed size: true for all of ``known``, false for most others."""
    place = lambda x: F.pmod(F.xxhash64(x), F.lit(ID_PLACES)) + 1
    maps = known.groupBy(F.bitmap_bucket_number(place("doc_id")).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place("doc_id"))).alias("bits"))
    bits = np.zeros(ID_PLACES // 8, np.uint8)
    for r in maps.toLocalIterator():
        own = np.frombuffer(r["bits"], np.uint8)
        bits[(r["bucket"] - 1) * 4096 :][: len(own)] = own
    shared = known.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def among(places: pd.Series) -> pd.Series:
        at = places.to_numpy() - 1
        return pd.Series((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return lambda x: among(place(x))


def train_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", block: int = BLOCK, rounds: int = ROUNDS, seed: int = 7) -> Model:
    """Fit on all labelled rows outside the held-out fold; the driver sees sums over rows only."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).dropna().filter(fold != 2)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    if not n or not toxic or toxic == n:
        return Model(constant=float((toxic or 0) / n) if n else 0.0)
    share = float(toxic / n)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.dropna(subset=["doc_id", "text"]).filter(may_be_among(known)("doc_id"))
    # one shuffle, by block, brings texts and labels together
    n_blocks = max(1, -(-min(n, docs.count()) // block))
    both = rows.withColumn("toxic", F.lit(None).cast("int")).unionByName(known, allowMissingColumns=True)
    both = both.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(n_blocks)).cast("int")).repartition(n_blocks, "block")
    one = F.min(F.when(F.col("text").isNotNull(), F.struct("text", "lang")))
    rows = both.groupBy("block", "doc_id").agg(F.max("toxic").alias("toxic"), one.alias("one")).filter("toxic is not null and one is not null").select("block", "doc_id", "toxic", "one.*")
    rows = map_texts(rows, lambda texts: {"words": [word_hashes(t).tobytes() for t in texts]}, "words binary", keep=("block", "doc_id", "toxic", "lang"))
    order = F.xxhash64("doc_id")
    made: list[str] = []
    rows = stored(rows.withColumn("held", F.pmod(order, F.lit(4)) == 3).sortWithinPartitions("block", order, "doc_id"), "labelled", made)
    try:
        return fit(rows, share, rounds, seed)
    finally:
        drop_tables(rows.sparkSession, made)


def fit(rows: DataFrame, share: float, rounds: int = ROUNDS, seed: int = 7) -> Model:
    """Train on three quarters of the stored rows, calibrate on the rest; on all where either part lacks a class."""
    counts = {(r["held"], r["toxic"]): r["count"] for r in rows.groupBy("held", "toxic").count().collect()}
    if len({toxic for _, toxic in counts}) < 2:
        return Model(constant=share)
    apart = len(counts) == 4
    trained, use = (rows.filter("not held"), rows.filter("held")) if apart else (rows, rows)
    of = [sum(n for (held, y), n in counts.items() if y == k and not (apart and held)) for k in (0, 1)]
    m = Model.fresh(seed)
    m.known = known_places(rows)
    seen = fresh_seen(m)
    for number in range(rounds):
        one_round(trained, m, seen, of[1] / sum(of), number, seed)
    calibrate(use, m, share)
    return m


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: bool = False
) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.3) and flag (score >= the language's threshold) of every row.

    With ``carry`` each input row is returned as the struct ``row``.
    """
    model = docs.sparkSession.sparkContext.broadcast(train_on(docs, labels, id_col, text_col, lang_col))
    by_lang = model.value.by_lang
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
        *[F.struct(*docs.columns).alias("row")] * carry,
    )
    scored = map_texts(rows, lambda texts: {"score": model.value.scores([word_hashes(t) for t in texts]).tolist()}, "score double", keep=("doc_id", "lang", *["row"] * carry))
    limit = F.lit(THRESHOLD)
    for name, t in sorted(by_lang.items()):
        limit = F.when(F.col("lang") == name, F.lit(t)).otherwise(limit)
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4
    return scored.select(
        "doc_id",
        (fold == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        (F.col("score") >= limit).alias("flag"),
        *["row"] * carry,
    )
