"""Whitening of embeddings with a cyclic Jacobi eigensolver.

Tasks add up the vectors, then the products of their deviations from the mean; the symmetric matrix of these, a row per pair of
dimensions, is diagonalised on the driver by Jacobi rotations, which keep small eigenvalues accurate relative to
themselves. The leading directions, scaled to variance 1, go to every task. Vectors are whole numbers: ``floor(scale * entry) + shift``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.common import small_batches

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Whole numbers up to here are doubles without loss.
EXACT = 1 << 53
#: A variance below this share of the total is no variance but rounding.
NOTHING = 1e-14
#: Sweeps of rotations before giving up; about ten are needed.
SWEEPS = 60


def finite(col: F.Column) -> F.Column:
    """True for a non-null vector whose entries are all non-null and finite."""
    wrong = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return col.isNotNull() & ~F.exists(col, lambda c: F.coalesce(wrong(c.cast("double")), F.lit(True)))


def whole_numbers(column: pa.ListArray, scale: int, shift: int = 0) -> np.ndarray:
    """The rows of a list column as ``floor(scale * entry) + shift``; vectors of different lengths or of too large entries are an error."""
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors of different lengths")
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(x) and np.abs(x).max() >= EXACT:
        raise ValueError("an entry is too large for a whole number without loss")
    return x.reshape(len(sizes), -1).astype(np.int64) + shift


def rotate_pairs(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """One sweep: every pair of ``n`` rows once, in rounds of disjoint pairs (a round-robin tournament)."""
    seats = list(range(n + n % 2))
    for _ in range(len(seats) - 1):
        half = len(seats) // 2
        pairs = [(a, b) if a < b else (b, a) for a, b in zip(seats[:half], reversed(seats[half:])) if max(a, b) < n]
        if pairs:
            yield np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])
        seats = [seats[0], seats[-1], *seats[1:-1]]


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors (columns) of a symmetric positive semidefinite matrix.

    Rotations go on until each off-diagonal entry is below rounding relative to its two diagonal entries, not to the
    largest one; so small eigenvalues come out to their own precision.
    """
    a = np.array(matrix, np.float64)
    v = np.eye(len(a))
    small = np.finfo(np.float64).eps
    for _ in range(SWEEPS):
        turned = False
        for p, q in rotate_pairs(len(a)):
            off, gap = a[p, q], a[q, q] - a[p, p]
            due = np.abs(off) > small * np.sqrt(np.abs(a[p, p] * a[q, q]))
            if not due.any():
                continue
            turned = True
            p, q, off, gap = p[due], q[due], off[due], gap[due]
            with np.errstate(over="ignore"):
                ratio = gap / (2 * off)
                t = np.where(ratio < 0, -1.0, 1.0) / (np.abs(ratio) + np.hypot(1.0, ratio))
            c = 1 / np.hypot(1.0, t)
            s = t * c
            diagonal = a[p, p] - t * off, a[q, q] + t * off
            for m in (a, v):
                m[:, p], m[:, q] = c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]
            a[p], a[q] = c[:, None] * a[p] - s[:, None] * a[q], s[:, None] * a[p] + c[:, None] * a[q]
            a[p, q] = a[q, p] = 0.0
            a[p, p], a[q, q] = diagonal
        if not turned:
            break
    else:
        raise ArithmeticError(f"off-diagonal entries did not vanish in {SWEEPS} sweeps")
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], v[:, order]


@dataclass
class Whitening:
    """Rows and sums of the fit list, eigenvalues, directions (columns), and the matrix that whitens centred vectors."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    directions: np.ndarray
    total: float
    scale: int
    shift: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - sums / n`` in doubles: whole numbers are subtracted first, so that a large common part costs no digits."""
        near = self.sums // self.n
        return (x - near) - (self.sums - near * self.n) / self.n

    def kept(self, components: int) -> np.ndarray:
        """Of the first ``components`` directions, whether they have any variance."""
        return self.values[:components] > NOTHING * max(self.total, 0.0)

    def whiten(self, x: np.ndarray, components: int) -> np.ndarray:
        """A column for each of the first ``components`` directions; NaN where there is no variance."""
        root = np.sqrt(np.where(self.kept(components), self.values[:components], np.nan))
        return self.centred(x) @ self.directions[:, :components] / root

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums of the squares of ``n * x - sums``, exactly; an error where one isn't a 64-bit number."""
        near = self.sums // self.n
        part = self.sums - near * self.n  # below n
        y = x - near
        most = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if most <= isqrt((1 << 63) // max(1, x.shape[1])):
            d = self.n * y - part
            return (d * d).sum(axis=1).tolist()
        found = [sum((self.n * int(c) - int(s)) ** 2 for c, s in zip(row, part, strict=True)) for row in y]
        if max(found) >= 1 << 63:
            raise OverflowError("a sum of squares exceeds 64 bits")
        return found


def pair_sums(rows: DataFrame, products) -> DataFrame:
    """``(i, j, v)``: the sum over all rows of the upper triangle of ``products(column of vectors)``, added up per task, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                g = products(b.column(0))
                total = g if total is None else total + g
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"])

    return rows.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def square(found: list, size: int) -> np.ndarray:
    m = np.zeros((size, size))
    for r in found:
        m[r.i, r.j] = m[r.j, r.i] = r.v
    return m


def usable(df: DataFrame, vec_col: str) -> DataFrame:
    return df.where(finite(df[vec_col]))


def fit(df: DataFrame, vec_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> Whitening | None:
    """Mean and principal directions of all usable vectors; None if there are none.

    Null vectors and those with a null or non-finite entry take no part; repeated rows count each. Vectors of different
    lengths are an error. Sums are whole numbers and exact; products are of deviations from the mean rounded to a whole number, so they are
    whole too, and the rest of the mean (half a unit at most) is taken off afterwards without cancellation. The driver gets one row per
    dimension and one per pair of dimensions.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = usable(df, vec_col).select(df[vec_col].alias("vec"))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            if b.num_rows:
                x = whole_numbers(b.column(0), scale, shift)
                if total is not None and len(total) != x.shape[1]:
                    raise ValueError("vectors of different lengths")
                n, total = n + len(x), x.sum(axis=0) if total is None else total + x.sum(axis=0)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array([n] * len(total), pa.int64()), pa.array(total)], ["i", "n", "s"])

    found = sorted(rows.mapInArrow(added, "i int, n long, s long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect(), key=lambda r: r.i)
    if not found:
        return None
    if len({r.n for r in found}) > 1:
        raise ValueError("vectors of different lengths")
    n, sums = found[0].n, np.array([r.s for r in found], np.int64)
    near = np.array([round(int(s) / n) for s in sums], np.int64)

    def products(column: pa.ListArray) -> np.ndarray:
        y = (whole_numbers(column, scale, shift) - near).astype(np.float64)
        return y.T @ y

    rest = np.array([float(int(s) - n * int(k)) for s, k in zip(sums, near, strict=True)])
    cov = square(pair_sums(rows, products).collect(), len(sums)) / n - np.outer(rest / n, rest / n)
    values, directions = jacobi(cov)
    return Whitening(n, sums, values, directions, float(np.trace(cov)), scale, shift)


def identity_error(df: DataFrame, model: Whitening, vec_col: str = "embedding", components: int = COMPONENTS) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over the directions with variance; 0 without any."""
    kept = model.kept(components)
    if not kept.any():
        return 0.0
    sent = df.sparkSession.sparkContext.broadcast(model)

    def products(column: pa.ListArray) -> np.ndarray:
        z = sent.value.whiten(whole_numbers(column, sent.value.scale, sent.value.shift), components)[:, kept]
        z = np.hstack([z, np.ones((len(z), 1))])
        return z.T @ z

    g = square(pair_sums(usable(df, vec_col).select(df[vec_col].alias("vec")), products).collect(), int(kept.sum()) + 1) / model.n
    return float(np.abs(g[:-1, :-1] - np.outer(g[-1, :-1], g[-1, :-1]) - np.eye(len(g) - 1)).max())


def whitened(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """One row for each usable row of ``df`` and each of the first ``components`` directions (all, if fewer), numbered by falling variance.

    ``vec_id``, ``component``, ``n`` (usable rows), ``deviation`` (sum of ``(n * x - sums)`` squared), ``whitened``, ``explained``
    (share of the variance), ``identity_error``. Where a direction has no variance (equal rows, fewer rows than dimensions), ``whitened``
    is null and ``explained`` 0. Null ids are kept; repeated rows and ids stand for themselves; equal variances share their directions in any turn.
    An empty table, or one without a usable vector, gives an empty result; other columns are not read.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = df.sparkSession
    model = fit(df, vec_col, scale, shift)
    if model is None:
        return spark.createDataFrame([], schema)
    error = identity_error(df, model, vec_col, components)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = sent.value
            x = whole_numbers(b.column(1), m.scale, m.shift)
            z = m.whiten(x, components)
            k = z.shape[1]
            shares = np.where(m.kept(k), m.values[:k] / (m.total or 1.0), 0.0)
            flat = z.ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(flat), m.n)),
                    pa.array(np.repeat(np.array(m.deviations(x), np.int64), k)),
                    pa.array(flat, mask=np.isnan(flat)),
                    pa.array(np.tile(shares, len(x))),
                    pa.array(np.full(len(flat), error)),
                ],
                [c.split()[0] for c in schema.split(", ")],
            )

    return usable(df, vec_col).select(df[id_col].cast("long").alias("vec_id"), df[vec_col].alias("vec")).mapInArrow(run, schema)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
