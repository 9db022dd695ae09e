"""Whitening of embeddings: principal components by block Jacobi-Davidson over distributed centred products.

Vectors become whole numbers, x = floor(SCALE * c) + SHIFT, so sums and deviations are exact. They are written once in
blocks of rows (without the shift, which no covariance sees), and each product of the covariance with a few columns is a
pass over these blocks: every task centres its rows on whole numbers, so that no digits are lost, and gives one
partial product, whose entries are summed by Spark before the shuffle and after it. What comes to the driver is a column
block (dimensions times columns), whatever the number of rows or tasks. No covariance matrix is built.

Edge cases: rows whose vector is null or holds a null or a number that isn't finite are left out; so are empty vectors,
which have no entries to project. Components whose variance is rounding only (as of constant or dependent dimensions, or
of a single row) are left out, as nothing can be divided by it; an empty table gives no rows. Equal values leave the
choice of vectors open; one is made, the same for all rows. Repeated rows and ids count each. Vectors of different
lengths, and an entry or a deviation beyond a long, raise ValueError. Other columns are kept; those with a result's
name are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import jacobidavidson, shared

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Bytes of a block of rows.
BLOCK_BYTES = 1 << 19
RESULTS = ["deviation", "whitened"]


@dataclass
class Fit:
    """Sums are of floor(SCALE * c), without the shift; components: a row each, by falling variance."""

    n: int
    sums: list[int]
    trace: float
    variances: np.ndarray
    components: np.ndarray
    residuals: np.ndarray
    products: int

    @property
    def explained(self) -> np.ndarray:
        return self.variances / self.trace

    @property
    def base(self) -> np.ndarray:
        """The whole numbers next to the means."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([(s - int(b) * self.n) / self.n for s, b in zip(self.sums, self.base)])


def whole(vector: Column) -> Column:
    """floor(SCALE * c) of each entry, exactly; null where the row is left out."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when((F.size(vector) > 0) & ~bad, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE)))


def _rows(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix."""
    many = np.diff(vectors.offsets.to_numpy())
    if len(many) and many.min() != many.max():
        raise ValueError("the vectors differ in length")
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(flat) and max(int(flat.max()), -int(flat.min())) >= 1 << 62:
        raise ValueError("an entry is too large")
    return flat.reshape(len(many), -1)


def _to_blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        y = _rows(part.column(0))
        step = max(1, BLOCK_BYTES // (8 * max(1, y.shape[1])))
        for i in range(0, len(y), step):
            own = y[i : i + step]
            small = own.astype("<i4") if np.abs(own).max() < 1 << 31 else own.astype("<i8")
            columns = [pa.array([own.shape[1]], pa.int32()), pa.array([len(own)], pa.int64()), pa.array([small.itemsize], pa.int32()), pa.array([small.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["d", "n", "width", "data"])


def blocks(df: DataFrame, vector: str) -> DataFrame:
    """d, n, width, data: the whole numbers of some rows each, written."""
    rows = df.select(whole(F.col(vector)).alias("y")).filter("y IS NOT NULL")
    return shared.written(rows.mapInArrow(_to_blocks, "d int, n long, width int, data binary"), "blocks")


def _matrices(parts: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for part in parts:
        for d, width, data in zip(part.column("d").to_pylist(), part.column("width").to_pylist(), part.column("data")):
            yield np.frombuffer(data.as_buffer(), f"<i{width}").reshape(-1, d)


def _sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: list[int] | None = None
    for y in _matrices(parts):
        exact = y.sum(axis=0, dtype=np.int64) if len(y) * max(1.0, float(np.abs(y).max())) < 1 << 62 else y.astype(object).sum(axis=0)
        total = [int(a) + b for a, b in zip(exact, total or [0] * y.shape[1])]
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([str(x) for x in total])], ["at", "v"])


def added_up(stored: DataFrame, work: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all blocks of work(rows), a vector of the given size."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for y in _matrices(parts):
            own = work(y).ravel()
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total, pa.float64())], ["at", "v"])

    found = stored.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[found["at"].to_numpy()] = found["v"].to_numpy()
    return out


def fit(stored: DataFrame, components: int = COMPONENTS, **how) -> Fit:
    """The components of written blocks; how: for jacobidavidson.largest."""
    n, least, d = stored.agg(F.sum("n"), F.min("d"), F.max("d")).first()
    if not n:
        return Fit(0, [], 0.0, np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0)
    if least != d:
        raise ValueError("the vectors differ in length")
    sums = stored.mapInArrow(_sums, "at int, v string").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    got = Fit(n, [int(x) for _, x in sorted(sums)], 0.0, np.zeros(0), np.zeros((0, d)), np.zeros(0), 0)
    base, rest = got.base, got.rest

    def product(u: np.ndarray) -> np.ndarray:
        def work(y: np.ndarray) -> np.ndarray:
            z = (y - base) - rest
            return z.T @ (z @ u)

        return added_up(stored, work, u.size).reshape(u.shape) / n

    got.trace = float(added_up(stored, lambda y: np.square((y - base) - rest).sum(axis=0), d).sum()) / n
    pairs = jacobidavidson.largest(product, d, components, **how)
    real = pairs.values > 64 * jacobidavidson.EPS * d * got.trace
    vectors = pairs.vectors[:, real]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1, 1)
    got.variances, got.components, got.residuals, got.products = pairs.values[real], vectors.T, pairs.residuals[real], pairs.products
    return got


def _projection(got: Fit) -> Callable[[np.ndarray], np.ndarray]:
    base, rest, along = got.base, got.rest, got.components.T / np.sqrt(got.variances)
    return lambda y: ((y - base) - rest) @ along


def identity_error(stored: DataFrame, got: Fit) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity."""
    k, project = len(got.variances), _projection(got)
    if not k:
        return 0.0
    mean = added_up(stored, lambda y: project(y).sum(axis=0), k) / got.n

    def work(y: np.ndarray) -> np.ndarray:
        w = project(y) - mean
        return w.T @ w

    return float(np.abs(added_up(stored, work, k * k).reshape(k, k) / got.n - np.eye(k)).max())


def _deviations(y: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """The sum over dimensions of (n * y - S)^2 of each row, exactly."""
    largest = float(n) * max(1.0, float(np.abs(y).max(initial=0))) + max(map(abs, sums), default=0)
    fits = largest * largest * max(1, y.shape[1]) < 1 << 62
    z = y.astype(np.int64) * n - np.array(sums, np.int64) if fits else y.astype(object) * n - np.array(sums, object)
    try:
        return pa.array((z * z).sum(axis=1).tolist(), pa.int64())
    except OverflowError as e:
        raise ValueError("a deviation doesn't fit a long") from e


def transform(df: DataFrame, vector: str, got: Fit) -> DataFrame:
    """The rows that aren't left out, with deviation (of x, exact) and whitened (a number for each component)."""

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        project, k = _projection(got), len(got.variances)
        for part in parts:
            y = _rows(part)
            w = project(y) if len(y) else np.zeros((0, k))
            own = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * k, pa.int32()), pa.array(w.ravel(), pa.float64()))
            yield pa.StructArray.from_arrays([_deviations(y, got.n, got.sums), own], RESULTS)

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    name = shared.free_name(df, "whole")
    rows = df.withColumn(name, whole(F.col(vector))).filter(F.col(name).isNotNull())
    made = F.arrow_udf(run, "deviation long, whitened array<double>").asNondeterministic()(F.col(name))
    return shared.with_fields(rows, made, RESULTS).drop(name)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shared.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    stored = blocks(rows, "embedding")
    got = fit(stored)
    error = identity_error(stored, got)
    each = transform(rows, "embedding", got).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.element_at(F.lit(got.explained.tolist() or [0.0]), F.col("at") + 1)
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(got.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error")
    )
