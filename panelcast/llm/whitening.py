"""Embedding whitening by shifted CholeskyQR.

1. Entries become whole numbers, ``floor(64 * c) + 1000000``; each distinct vector
   is one row of the fit list, dealt over the partitions by its content.
2. Sums, least and greatest value per dimension are exact; rows are centred by a
   whole number first and by the remaining fraction of the mean after it, so that
   no digits cancel.
3. A pass over the fit list adds up the Gram matrix of the current rows: every
   task adds its own, stripes of it are summed in the shuffle over two levels, and
   one matrix (dimension x dimension) reaches the driver.  Its Cholesky factor,
   shifted while the rows are far from orthogonal, becomes one more triangular
   solve that the next pass applies to its rows.
4. The composed factors are R of centred rows = Q R, and the SVD of R gives the
   components (right singular vectors) and eigenvalues (squares over n).  The
   Gram matrix of the rows themselves is never decomposed, so that small
   components keep their digits.
5. A last pass measures the covariance of the whitened fit list.

Defined results: rows whose vector is null, empty, or holds null or non-finite
entries take no part; if vectors differ in length, those of the most common length
(the greater, if tied) do.  Entries beyond 2**53 / 64 are held at that bound.
Repeated vectors count once in the fit list; every row returns, null ids included.
Components whose spread is below 1e-10 of the first one's are none: constant
dimensions, or fewer distinct vectors than dimensions, give fewer components, one
distinct vector gives no rows at all, and neither does an empty table.  A
deviation beyond 64 bits is null.  Other columns of the table are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
BOUND = float(2**53)
#: Rows of the Gram matrix in one stripe, and the partial sums of a stripe on the first level.
STRIPE, SALTS = 64, 32
#: Spread, of the first component's, below which a direction counts as none.
LEAST_SPREAD = 1e-10
#: Largest entry of Q'Q - I with which Q counts as orthogonal, and the most passes.
ORTHOGONAL, PASSES = 1e-13, 8
ROUNDING = 2.0**-53
#: The shift's bound, of the Gram matrix's norm; rows of many more dimensions or sums would only converge more slowly.
MOST_SHIFT = 1e-8


# -- rows -------------------------------------------------------------------------------
def whole_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): the vectors of usable rows as whole numbers."""
    c = F.col(vector_col).cast("array<double>")
    rows = rows.select(F.col(id_col).alias("id"), c.alias("c")).filter(F.col("c").isNotNull() & (F.size("c") > 0))
    rows = rows.filter(~F.exists("c", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == math.inf)))
    x = F.transform("c", lambda v: F.floor(F.greatest(F.least(v * SCALE, F.lit(BOUND)), F.lit(-BOUND))).cast("long") + OFFSET)
    return rows.select("id", x.alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists have one length and no nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Centred:
    """Means of the fit list as a whole number and a fraction per dimension; the dimensions that vary."""

    def __init__(self, n: int, sums: list[int], varies: list[bool]):
        self.n, self.sums = n, sums
        self.base = np.array([s // n for s in sums], np.int64)
        self.fraction = np.array([(s % n) / n for s in sums])
        self.varies = np.flatnonzero(varies)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64)[:, self.varies] - self.fraction[self.varies]

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n * x - S)**2, exact."""
        left = np.array([s % self.n for s in self.sums], np.int64)
        y = x - self.base
        top = int(np.abs(y).max(initial=0)) * self.n + self.n
        if top * top * max(len(self.sums), 1) < 2**63:
            z = y * self.n - left
            return (z * z).sum(axis=1).tolist()
        z = y.astype(object) * self.n - left.astype(object)
        return [d if d < 2**63 else None for d in (z * z).sum(axis=1).tolist()]


# -- passes over the fit list ---------------------------------------------------------------
def _batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, matrix(batch.column(column))


def gram(fit: DataFrame, change: Callable[[np.ndarray], np.ndarray], dims: int) -> np.ndarray:
    """Sum of y'y over the rows y = change(x) of the fit list, with a column of ones: sums come last."""
    size = dims + 1

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for _, x in _batches(batches, 0):
            y = np.column_stack([change(x), np.ones(len(x))])
            total += y.T @ y
        yield from stripes({k: total[k:k + STRIPE] for k in range(0, size, STRIPE)})

    def stripes(found: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k, part in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()])], names=["stripe", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(part.as_buffer(), np.float64).reshape(-1, size)
                found[k] = found[k] + part if k in found else part.copy()
        yield from stripes(found)

    schema = "stripe int, part binary"
    parts = fit.select("x").mapInArrow(own, schema).withColumn("salt", F.spark_partition_id() % SALTS)
    parts = parts.repartition(SALTS, "stripe", "salt").select("stripe", "part").mapInArrow(add, schema)
    parts = parts.repartition(-(-size // STRIPE), "stripe").mapInArrow(add, schema)
    out = np.zeros((size, size))
    for row in parts.collect():  # one row a stripe: dimension x dimension numbers
        part = np.frombuffer(row.part, np.float64).reshape(-1, size)
        out[row.stripe:row.stripe + len(part)] += part
    return out


def solve(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``rows`` times the inverse of the upper triangular ``r``, by substitution."""
    out = np.asfortranarray(rows)
    for j in range(len(r)):
        if j:
            out[:, j] -= out[:, :j] @ r[:j, j]
        out[:, j] /= r[j, j]
    return out


def cholesky(g: np.ndarray, shift: float) -> np.ndarray:
    """Upper factor of ``g`` plus the shift, which grows tenfold until the sum is positive definite."""
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(len(g))).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, ROUNDING * np.trace(g))


def orthogonalise(fit: DataFrame, centred: Centred) -> np.ndarray:
    """R of centred rows = Q R, from Gram passes; Q is formed row by row in each pass and never kept."""
    dims = len(centred.varies)
    factors: list[np.ndarray] = []

    def q_of(x: np.ndarray, solved: list[np.ndarray]) -> np.ndarray:
        y = centred(x)
        for r in solved:
            y = solve(y, r)
        return y

    for _ in range(PASSES):
        done = list(factors)
        g = gram(fit, lambda x: q_of(x, done), dims)[:dims, :dims]
        g = (g + g.T) / 2
        if factors and np.abs(g - np.eye(dims)).max() < ORTHOGONAL * max(dims, 8):
            break
        near = len(factors) > 0 and np.linalg.eigvalsh(g)[0] > 0.01
        # the rounding of the Gram matrix, which is added up in blocks, as a share of its norm
        most = min(11 * (centred.n * dims + dims * (dims + 1)) * ROUNDING, MOST_SHIFT)
        factors.append(cholesky(g, 0.0 if near else most * np.linalg.norm(g, 2)))
    total = np.eye(dims)
    for r in factors:
        total = r @ total
    return total


# -- operator -----------------------------------------------------------------------------
def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of usable rows and their components."""
    spark = rows.sparkSession
    kind = rows.schema[id_col].dataType.simpleString()
    schema = (f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    every = staged(whole_vectors(rows, id_col, vector_col), "vectors")
    common = every.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    every = every.filter(F.size("x") == common.dims)
    fit = staged(every.select("x").distinct(), "fit")
    per = fit.select(F.posexplode("x").alias("dim", "v")).groupBy("dim").agg(
        F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), (F.min("v") < F.max("v")).alias("varies"))
    per = per.orderBy("dim").collect()  # one row a dimension
    centred = Centred(per[0].n, [int(p.s) for p in per], [p.varies for p in per])
    if not len(centred.varies):
        return spark.createDataFrame([], schema)

    _, spread, directions = np.linalg.svd(orthogonalise(fit, centred))
    keep = min(components, int((spread > LEAST_SPREAD * spread[0]).sum()))
    value = spread**2 / centred.n
    explained = (value / value.sum())[:keep]
    # rows times this are whitened
    to = directions[:keep].T / np.sqrt(value[:keep])
    g = gram(fit, lambda x: centred(x) @ to, keep) / centred.n
    covariance = g[:keep, :keep] - np.outer(g[keep, :keep], g[keep, :keep])
    error = float(np.abs(covariance - np.eye(keep)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _batches((part for b in batches for part in (b.slice(k, 1024) for k in range(0, b.num_rows, 1024))), 1):
            m = len(x)
            each = np.repeat(np.arange(m), keep)
            deviation = pa.array(centred.deviations(x), pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, keep + 1, dtype=np.int32), m)),
                pa.array(np.full(m * keep, centred.n)), deviation.take(pa.array(each)),
                pa.array((centred(x) @ to).reshape(-1)), pa.array(np.tile(explained, m)), pa.array(np.full(m * keep, error)),
            ], names=[p.split()[0] for p in schema.split(", ")])

    return every.select("id", "x").mapInArrow(project, schema)


def op13_whitening(rows: DataFrame) -> DataFrame:
    return whiten(rows.select("vec_id", "embedding")).withColumnRenamed("id", "vec_id")
