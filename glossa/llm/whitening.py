"""Whitening of embeddings by the leading components of their covariance.

Entries become integers (256 times the entry, rounded down), so equal vectors are equal
without doubt and sums are exact.  The covariance is over each different vector once.
Spark MLlib's computeSVD runs over the centred rows, distributed; its singular values
are those of the rows, so an eigenvalue of the covariance is their square by n.  The
total variance is computed apart from it, from exact integer deviations.

Sums by dimension and products of whitened components are added up within tasks first,
so a few rows a task are shuffled; different vectors are found by an aggregation that is
combined on the map side, so a vector of many rows costs one row a task.

Defined cases: rows with a null vector, or with a null or non-finite entry, are left out;
shorter vectors are filled with zeros at the end, to the longest one; a null vec_id stays;
rows alike give rows alike; entries beyond a 64-bit integer are taken as its bound;
`deviation` is null where it does not fit into 64 bits; components with an eigenvalue of
less than 1e-12 times the first one have no rows, so equal vectors alone, a single row or an
empty table give none; columns of other names are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.shared import table, written

COMPONENTS = 4
SCALE = 256
#: Singular values below this share of the first are rounding errors of a covariance in doubles.
LEAST_SINGULAR = 1e-6
#: Up to so many dimensions all components are computed, from the products of dimensions (32 MB at most);
#: beyond, the leading ones alone, by iteration over the rows.
MOST_DENSE = 2000
#: Rows of a batch are looked at in pieces of so many entries.
PIECE = 1 << 20

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Whitener:
    """n different vectors with sums S by dimension: whole = S // n, rest = S - n * whole; a column of `axes` a component."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    axes: np.ndarray | None = None
    eigenvalues: np.ndarray | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, with the integers taken apart first."""
        return _minus(x, self.whole).astype(np.float64) - self.rest.astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums over the dimensions of (n * x - S)^2."""
        y = _minus(x, self.whole)
        most = int(np.abs(y).max(initial=0)) * self.n + self.n
        if y.dtype == np.int64 and most * most * max(1, y.shape[1]) < 1 << 62:
            d = y * self.n - self.rest.astype(np.int64)
            return (d * d).sum(axis=1).tolist()
        d = y.astype(object) * self.n - self.rest
        return [int(v) for v in (d * d).sum(axis=1)]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes / np.sqrt(self.eigenvalues)


def _minus(x: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """x - whole as 64-bit integers, or as Python's where these could overflow."""
    if all(abs(int(v)) < 1 << 61 for v in (x.max(initial=0), x.min(initial=0), *whole)):
        return x - whole.astype(np.int64)
    return x.astype(object) - whole


def _pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pieces of batches with their column x as rows of 64-bit integers."""
    rows = max(1, PIECE // max(1, width))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width)


def vectors(embeddings: DataFrame, column: str = "embedding", key: str = "vec_id") -> tuple[DataFrame, int]:
    """vec_id and x of all rows that count, and the number of dimensions."""
    value = F.col(column).cast("array<double>")
    finite = F.forall(value, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = embeddings.where(F.coalesce(finite, F.lit(False)))
    width = rows.agg(F.max(F.size(column))).first()[0] or 0
    whole = F.transform(value, lambda c: F.floor(c * SCALE))
    filled = F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(column)))
    return rows.select(F.col(key).cast("long").alias("vec_id"), F.when(F.size(column) == width, whole).otherwise(filled).alias("x")), width


def sums(fit: DataFrame, width: int) -> Whitener:
    """Number and exact sums by dimension of the different vectors."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, object)
        for part, x in _pieces(batches, width):
            n += part.num_rows
            small = int(np.abs(x.astype(np.float64)).max(initial=0)) * len(x) < 1 << 62
            total = total + (x.sum(axis=0).astype(object) if small else x.astype(object).sum(axis=0))
        if n:
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(width), pa.int32()), "s": pa.array([_decimal(v) for v in total], pa.decimal128(38, 0)), "n": pa.array([n] * width, pa.int64())})

    rows = fit.mapInArrow(add, "at int, s decimal(38,0), n long").groupBy("at").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("at").collect()  # one row a dimension
    n, s = (rows[0]["n"] if rows else 0), [int(r["s"]) for r in rows]
    return Whitener(n, np.array([v // n for v in s], object), np.array([v % n for v in s], object))


def _decimal(value: int):
    from decimal import Decimal

    return Decimal(int(value))


def total_variance(fit: DataFrame, base: Whitener) -> float:
    """The trace of the covariance, from exact deviations."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(sum(base.deviations(x)) for _, x in _pieces(batches, len(base.whole)))
        yield pa.RecordBatch.from_pydict({"t": pa.array([total / base.n**3], pa.float64())})

    return fit.mapInArrow(add, "t double").agg(F.sum("t")).first()[0] or 0.0


def decompose(fit: DataFrame, base: Whitener, components: int) -> Whitener:
    """The leading components, by MLlib's computeSVD over the centred rows."""
    width = len(base.whole)

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _pieces(batches, width):
            c = base.centred(x)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.arange(0, c.size + 1, width, dtype=np.int32), c.ravel())], ["c"])

    rows = MLUtils.convertVectorColumnsFromML(fit.mapInArrow(centre, "c array<double>").select(array_to_vector("c").alias("c")), "c")
    svd = RowMatrix(rows, base.n, width).computeSVD(width if width <= MOST_DENSE else min(components, width), False, LEAST_SINGULAR)
    k = min(components, len(svd.s))
    axes = np.asarray(svd.V.toArray())[:, :k]
    # either sign will do, but reruns should agree
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    return Whitener(base.n, base.whole, base.rest, axes, np.asarray(svd.s.toArray())[:k] ** 2 / base.n)


def identity_error(fit: DataFrame, model: Whitener) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    k = len(model.eigenvalues)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(k), np.zeros((k, k))
        for _, x in _pieces(batches, len(model.whole)):
            w = model.whitened(x)
            total += w.sum(axis=0)
            products += w.T @ w
        at = [(i, j) for i in range(k + 1) for j in range(k)]  # the last row holds the sums
        yield pa.RecordBatch.from_pydict({"i": pa.array([i for i, _ in at], pa.int32()), "j": pa.array([j for _, j in at], pa.int32()), "v": np.vstack([products, total]).ravel()})

    out = np.zeros((k + 1, k))
    for r in fit.mapInArrow(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # k * (k + 1) rows
        out[r["i"], r["j"]] = r["v"]
    mean = out[k] / model.n
    return float(np.abs(out[:k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(embeddings: DataFrame, components: int = COMPONENTS, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every row that counts and component."""
    spark = embeddings.sparkSession
    rows, width = vectors(embeddings, column, key)
    if not width:
        return spark.createDataFrame([], SCHEMA)
    fit = written(rows.select("x").distinct(), "vectors")
    base = sums(fit, width)
    variance = total_variance(fit, base)
    if not variance:
        return spark.createDataFrame([], SCHEMA)
    model = decompose(fit, base, components)
    error = identity_error(fit, model)
    k, explained = len(model.eigenvalues), model.eigenvalues / variance
    held = spark.sparkContext.broadcast(model)  # components + 2 numbers a dimension

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for part, x in _pieces(batches, width):
            n, w = part.num_rows, model.whitened(x)
            which = np.tile(np.arange(k), n)
            deviation = pa.array([v if v < 1 << 63 else None for v in model.deviations(x)], pa.int64())
            owner = pa.array(np.repeat(np.arange(n), k))
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id").take(owner), pa.array(which + 1, pa.int32()), pa.array(np.full(n * k, model.n), pa.int64()), deviation.take(owner), pa.array(w.ravel()), pa.array(explained[which]), pa.array(np.full(n * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


#: Eigenvectors have no SQL; the tests hold the result against numpy.
SQL = None
