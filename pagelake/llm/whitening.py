"""Whitening of embeddings by shifted CholeskyQR.

The fit list holds each distinct vector of integers once. Its centred rows A are
never gathered: a Gram pass sums A^T A over the tasks (a d x d matrix a task), the
driver factors it by Cholesky (the first time with a diagonal shift, so that an
ill-conditioned A cannot break it), and the next pass sends every row through the
triangular solve before it multiplies. Passes go on until the rows are orthonormal,
the factors compose to one R with A = Q R, and the singular value decomposition of
that R gives the components (right singular vectors) and their eigenvalues
(squared singular values over n) without ever squaring A's condition number.

Only d x d matrices, sums by dimension and counts reach the driver; d is the
length of a vector, not the number of rows.

Rows with a null vector, or a null or non-finite entry, take no part. Shorter
vectors count as filled with zeros up to the longest. Rows without an id and
repeated rows keep a result each; ties between eigenvalues leave any basis of
their space. Directions without variance (to 1e-12 of the largest singular value)
are no components: fewer than ``most`` come out. A deviation beyond a long is null.
An empty table gives an empty result; further columns of the table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Entries become floor(SCALE * entry) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Orthonormal to this largest deviation of Q^T Q from the identity; at most so many Gram passes.
ORTHONORMAL, PASSES = 1e-12, 8
#: Singular values up to this share of the largest are no components.
RANK = 1e-12
LONG = 2**63 - 1


def finite(vector: Column) -> Column:
    """Neither null nor with null or non-finite entries."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def grid(vector: Column, scale: int) -> Column:
    """floor(scale * entry) of every entry, as long."""
    return F.transform(vector, lambda v: F.floor(v.cast("double") * scale).cast("long"))


def padded(vector: Column, width: int) -> Column:
    """``vector`` filled with zeros up to ``width`` entries."""
    return F.concat(vector, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(vector)))


def as_matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of one length as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


@dataclass(frozen=True)
class Centre:
    """The number of fit rows and their exact sums by dimension (without OFFSET)."""

    n: int
    sums: tuple[int, ...]
    exact: bool  # n * x - S fits a long for every row

    def times_n(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: longs, or Python integers where those are too small."""
        if self.exact:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """x - S / n with one rounding of an exact numerator."""
        return self.times_n(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exactly; null beyond a long."""
        far = self.times_n(x)
        if self.exact and len(far) and float((far.astype(np.float64) ** 2).sum(1).max()) < 2.0**62:
            return (far * far).sum(1).tolist()
        every = [sum(int(v) ** 2 for v in row) for row in far]
        return [v if v <= LONG else None for v in every]


def grid_rows(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, x) of the rows that take part, x as floor(SCALE * entry) without OFFSET; and the width."""
    fine = rows.filter(finite(F.col(vector_col)))
    width = fine.agg(F.max(F.size(vector_col))).first()[0] or 0
    return fine.select(F.col(id_col).cast("long").alias("vec_id"), padded(grid(F.col(vector_col), SCALE), width).alias("x")), width


def centre_of(fit: DataFrame, width: int) -> Centre:
    """One pass over the fit list: count, sums and the largest entry; one row a dimension reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, most, sums = 0, 0, [0] * width
        for batch in batches:
            x = as_matrix(batch.column("x"), width)
            if len(x):
                n += len(x)
                low, high = int(x.min()), int(x.max())
                most = max(most, -low, high)
                part = x.sum(0) if max(-low, high) < 2**40 else x.astype(object).sum(0)
                sums = [a + int(b) for a, b in zip(sums, part)]
        if n:
            text = pa.array([str(v) for v in sums])
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), text, pa.array([n] * width), pa.array([min(most, LONG)] * width)], names=["j", "s", "n", "most"])

    parts = fit.mapInArrow(run, "j int, s string, n long, most long")
    found = parts.groupBy("j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"), F.max("most").alias("most")).collect()
    by = {r["j"]: r for r in found}
    n = found[0]["n"] if found else 0
    most = found[0]["most"] if found else 0
    return Centre(n, tuple(int(by[j]["s"]) for j in range(width)) if n else (), 2 * n * most < 2**62)


def gram(fit: DataFrame, centre: Centre, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """A^T A of the centred rows A times ``weights``, and the sums of A's columns.

    A task gives one upper triangle; Spark adds them up by place, the driver gets d^2 numbers.
    """
    d = len(centre.sums)
    k = d if weights is None else weights.shape[1]
    upper = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros((k, k)), np.zeros(k)
        some = False
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                a = centre(as_matrix(batch.column("x").slice(at, 4096), d))
                a = a if weights is None else a @ weights
                total += a.T @ a
                sums += a.sum(0)
                some = True
        if some:
            i, j = (np.concatenate((u, v)).astype(np.int32) for u, v in zip(upper, (np.full(k, -1), np.arange(k))))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(np.concatenate((total[upper], sums)))], names=["i", "j", "g"])

    found = fit.mapInArrow(run, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect()
    out, sums = np.zeros((k, k)), np.zeros(k)
    for r in found:
        if r["i"] < 0:
            sums[r["j"]] = r["g"]
        else:
            out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["g"]
    return out, sums


def triangular_factor(fit: DataFrame, centre: Centre) -> np.ndarray:
    """R of A = Q R by shifted CholeskyQR: Gram passes over rows that went through the triangular solves so far."""
    d, r = len(centre.sums), None
    for _ in range(PASSES):
        weights = None if r is None else np.linalg.inv(r)
        g, _ = gram(fit, centre, weights)
        if r is not None and np.abs(g - np.eye(d)).max() <= ORTHONORMAL:
            break
        unit = np.finfo(float).eps / 2
        size = float(np.linalg.norm(g, 2))
        if size == 0:
            return np.zeros((d, d))
        shift = 11 * (centre.n * d + d * (d + 1)) * unit * size if r is None else 0.0
        while True:
            try:
                factor = np.linalg.cholesky(g + shift * np.eye(d)).T
                break
            except np.linalg.LinAlgError:  # directions without variance stay singular
                shift = max(10 * shift, 100 * d * unit * size)
        r = factor if r is None else factor @ r
        s = np.linalg.svd(r, compute_uv=False)
        if s[-1] <= RANK * s[0]:  # the rest of the directions has no variance: R is as good as it gets
            break
    return r


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 16) -> DataFrame:
    """vec_id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error of every row and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    made, width = grid_rows(rows, id_col, vector_col)
    empty = rows.sparkSession.createDataFrame([], schema)
    if not width:
        return empty
    fit = stored(made.select("x").distinct(), "fit")
    centre = centre_of(fit, width)
    r = triangular_factor(fit, centre)
    _, s, v = np.linalg.svd(r)
    rank = min(most, int((s > RANK * s[0]).sum()) if s[0] > 0 else 0)
    if not rank:
        return empty
    values, explained = s[:rank] ** 2 / centre.n, s[:rank] ** 2 / (s**2).sum()
    weights = v[:rank].T / np.sqrt(values)
    again, sums = gram(fit, centre, weights)
    error = float(np.abs(again / centre.n - np.outer(sums, sums) / centre.n**2 - np.eye(rank)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = as_matrix(batch.column("x"), width)
            if not len(x):
                continue
            index = pa.array(np.repeat(np.arange(len(x)), rank))
            deviation = pa.array(centre.deviations(x), pa.int64()).take(index)
            white = (centre(x) @ weights).ravel()
            tile = lambda values, kind: pa.array(np.tile(values, len(x)), kind)
            columns = [batch.column("vec_id").take(index), tile(np.arange(1, rank + 1), pa.int32()), pa.array([centre.n] * len(white), pa.int64()), deviation]
            columns += [pa.array(white), tile(explained, pa.float64()), pa.array([error] * len(white), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return made.mapInArrow(run, schema)
