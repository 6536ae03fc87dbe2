"""Whitening of embeddings by a covariance from squares alone (polarisation).

Entries become whole numbers, x = floor(scale * c). The fit list is each distinct x vector once; its counts, sums and
squares are added up exactly, however large: squares of centred values n*x - S for every dimension, and for every pair of
dimensions squares of the sum of both. Half of what a pair's square has over the squares of its two dimensions is their
co-moment, so that a covariance is one exact difference, rounded once. The matrix, whose size depends on the dimensions
alone, goes to the driver for eigh; everything that grows with rows stays in Spark: one shuffle of distinct vectors and
one of partial sums, a row per task and pair.

Rows whose vector is null, holds null or non-finite entries or entries of 2^44 and more (whose x a double can't tell
apart) are dropped, and so are those with another number of dimensions than most rows have (the larger of two equally
frequent numbers; `dimensions` names one). Repeated rows, null ids and repeated ids each have their row. Components with
eigenvalue 0 (fewer distinct vectors than dimensions, constant entries) have a null whitened value. Without remaining
rows the result is empty. A deviation beyond a long is null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, tidy, written

LARGEST = float(1 << 44)
_DIGIT = 20


def whole_vectors(embeddings: DataFrame, *, scale: float = 256.0, dimensions: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x of the rows that remain."""
    vector = F.col("v")
    fine = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < LARGEST), F.lit(False)))
    kept = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter(vector.isNotNull() & (F.size(vector) > 0) & fine)
    if dimensions is None:
        most = kept.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        dimensions = most.d if most else 0
    return kept.filter(F.size(vector) == dimensions).select("vec_id", F.transform(vector, lambda c: F.floor(c * F.lit(scale)).cast("long")).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def square_sums(rows: np.ndarray, largest: int) -> list[int]:
    """Exact sums of squares of each row's whole numbers, none of them beyond `largest`: at once where they fit 64 bits,
    else from digits of 20 bits."""
    if largest * largest * max(rows.shape[1], 1) < 1 << 62:
        return np.einsum("ij,ij->i", rows, rows).tolist()
    if rows.dtype == object or rows.shape[1] >= 1 << 20:
        return [sum(int(v) ** 2 for v in row) for row in rows]
    n = -(-(largest.bit_length() + 1) // _DIGIT)
    digits = [(rows >> (_DIGIT * i)) & ((1 << _DIGIT) - 1) if i < n - 1 else rows >> (_DIGIT * i) for i in range(n)]
    out = [0] * len(rows)
    for i in range(n):
        for j in range(i, n):
            weight = (1 + (i < j)) << (_DIGIT * (i + j))
            out = [a + weight * b for a, b in zip(out, np.einsum("ij,ij->i", digits[i], digits[j]).tolist())]
    return out


@dataclass
class Whitening:
    n: int
    sums: list[int]
    #: Beyond any |n*x - S|.
    largest: int
    #: Of the covariance, falling; vectors are columns.
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def defined(self) -> np.ndarray:
        """Components whose eigenvalue isn't 0."""
        return self.values > self.trace * len(self.values) * np.finfo(float).eps

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, exactly: as Python's whole numbers where 64 bits don't hold them."""
        return _centred(x, self.n, self.sums, self.largest)

    def project(self, centred: np.ndarray, components: int) -> np.ndarray:
        """Whitened values; NaN where the eigenvalue is 0."""
        scale = np.where(self.defined, 1 / np.sqrt(np.where(self.defined, self.values, 1)), np.nan)
        return (centred.astype(np.float64) / self.n) @ self.vectors[:, :components] * scale[:components]


def _centred(x: np.ndarray, n: int, sums: list[int], largest: int) -> np.ndarray:
    kind = np.int64 if largest < 1 << 61 else object
    return x.astype(kind) * n - np.array(sums, dtype=kind)


def _sums(vectors: DataFrame) -> tuple[int, list[int], int]:
    """n, sums by dimension, and a bound of |n*x - S|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, low, high = 0, [], [], []
        for batch in tidy(batches):
            if not batch.num_rows:
                continue
            x = matrix(batch.column(0))
            lows, highs = x.min(axis=0).tolist(), x.max(axis=0).tolist()
            now = (x if max(map(abs, lows + highs)) * len(x) < 1 << 62 else x.astype(object)).sum(axis=0).tolist()
            total = [a + b for a, b in zip(total, now)] if n else now
            low, high = (list(map(min, low, lows)), list(map(max, high, highs))) if n else (lows, highs)
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total)), pa.array(list(map(Decimal, total)), pa.decimal128(38, 0)), pa.array(low), pa.array(high)], ["i", "n", "total", "low", "high"])

    parts = vectors.mapInArrow(run, "i int, n long, total decimal(38,0), low long, high long")
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("i").collect()
    if not rows:
        return 0, [], 0
    n, sums = rows[0].n, [int(r.total) for r in rows]
    return n, sums, max(max(abs(n * r.low - s), abs(n * r.high - s)) for r, s in zip(rows, sums))


def _squares(vectors: DataFrame, n: int, sums: list[int], largest: int, at_once: int = 2048) -> dict[tuple[int, int], int]:
    """Sums of squares of centred values by dimension (i, i), and of the sums of two dimensions by pair (i, j)."""
    d = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [[0] * (d - s) for s in range(d)]  # by distance of the two dimensions
        for batch in tidy(batches):
            x = matrix(batch.column(0)) if batch.num_rows else np.zeros((0, d), np.int64)
            for begin in range(0, len(x), at_once):
                y = np.ascontiguousarray(_centred(x[begin : begin + at_once], n, sums, largest).T)
                for s in range(d):
                    found = square_sums(y[: d - s] + y[s:] if s else y, 2 * largest)
                    totals[s] = [a + b for a, b in zip(totals[s], found)]
        pairs = [(i, i + s, t) for s in range(d) for i, t in enumerate(totals[s])]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int32()), pa.array([p[1] for p in pairs], pa.int32()), pa.array([Decimal(p[2]) for p in pairs], pa.decimal128(38, 0))], ["i", "j", "squares"])

    rows = vectors.mapInArrow(run, "i int, j int, squares decimal(38,0)").groupBy("i", "j").agg(F.sum("squares").alias("squares")).collect()
    return {(r.i, r.j): int(r.squares) for r in rows}


def fit(vectors: DataFrame) -> Whitening:
    """Whitening of a table of distinct vectors x; it is read twice, so it should be a written one."""
    ship(vectors.sparkSession)
    n, sums, largest = _sums(vectors)
    d = len(sums)
    squares = _squares(vectors, n, sums, largest) if n else {}
    covariance = np.zeros((d, d))
    for (i, j), total in squares.items():
        double = 2 * total if i == j else total - squares[i, i] - squares[j, j]
        covariance[i, j] = covariance[j, i] = double / (2 * n**3)
    values, vectors_ = np.linalg.eigh(covariance) if d else (np.zeros(0), np.zeros((0, 0)))
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    if d:
        vectors_ = vectors_ * np.where(vectors_[np.abs(vectors_).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)
    return Whitening(n, sums, largest, values, np.ascontiguousarray(vectors_), float(np.trace(covariance)))


def whiten(vectors: DataFrame, model: Whitening, components: int) -> DataFrame:
    """vec_id, deviation (exact sum of squares of n*x - S), whitened (array by component) of every row of vec_id and x."""
    ship(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            if batch.num_rows:
                y = model.centred(matrix(batch.column(1)))
                values = model.project(y, components)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, max(values.shape[1], 1), dtype=np.int32)), pa.array(values.ravel(), from_pandas=True))
                squares = [v if v < 1 << 63 else None for v in square_sums(y, model.largest)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(squares, pa.int64()), lists], ["vec_id", "deviation", "whitened"])

    return vectors.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def identity_error(vectors: DataFrame, model: Whitening, components: int) -> float:
    """The largest absolute entry of the covariance of whitened values over the fit list, minus the identity."""
    found = int(model.defined[:components].sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(found), np.zeros((found, found))
        for batch in tidy(batches):
            if batch.num_rows:
                w = model.project(model.centred(matrix(batch.column(0))), found)
                sums, products = sums + w.sum(axis=0), products + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(found + found * found)), pa.array(np.concatenate([sums, products.ravel()]))], ["at", "total"])

    if not found:
        return 0.0
    rows = vectors.mapInArrow(run, "at long, total double").groupBy("at").agg(F.sum("total").alias("total")).collect()
    total = np.zeros(found + found * found)
    for r in rows:
        total[r.at] = r.total
    mean = total[:found] / model.n
    return float(np.abs(total[found:].reshape(found, found) / model.n - np.outer(mean, mean) - np.eye(found)).max())


def whitened_components(embeddings: DataFrame, *, components: int = 4, scale: float = 256.0, dimensions: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each remaining row and component: vec_id, component (from 1), n, deviation, whitened, explained,
    identity_error."""
    vectors = whole_vectors(embeddings, scale=scale, dimensions=dimensions, id_col=id_col, vector_col=vector_col)
    distinct = written(vectors.select("x").distinct(), "vectors")
    model = fit(distinct)
    components = min(components, len(model.sums))
    error = identity_error(distinct, model, components)
    share = F.array(*(F.lit(float(v / model.trace) if model.trace else 0.0) for v in model.values[:components])).cast("array<double>")
    rows = whiten(vectors, model, components).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", share[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
