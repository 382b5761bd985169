"""Embedding whitening with a compensated covariance.

Vectors become integers about a large offset, so a covariance from raw products would lose its digits. Here the mean is a
double-double (exact integer sums, divided without rounding to one double) and vectors are centred before anything is multiplied. The outer products of a block are formed by error-free
transformations: each dimension is split into slices of few enough bits that a product of two slices, summed over the block, is exact in
a double; these exact sums are added to a running pair (high, low) by two-sums. Pairs merge across tasks in a tree, high and low parts
together. The eigenvectors come from LAPACK's symmetric solver (Householder reduction to a tridiagonal matrix, then divide and conquer), on the driver: a
matrix of dims x dims, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigraph.llm.vector_blocks import arrays, blocks, first_rows, kept_vectors

#: What an entry is multiplied by, what is added, and the components that are returned at most.
SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Vectors whose slices are multiplied at once (2^9), and the bits of a slice: 2 * 22 + 9 = 53.
ROWS, SLICE_BITS, SLICES = 512, 22, 3
STORED = "<i8"
#: Eigenvalues below this share of the largest, a dimension, are rounding: such components have no variance to scale by.
NO_VARIANCE = 2.0**-50


def to_int(v: np.ndarray) -> np.ndarray:
    return np.floor(v * SCALE) + OFFSET


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded sum, and what rounding lost."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add_pairs(high: np.ndarray, low: np.ndarray, more: np.ndarray, rest: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(high + low) + (more + rest) as a pair again."""
    s, e = two_sum(high, more)
    e += low + rest
    high = s + e
    return high, e - (high - s)


def centred(x: np.ndarray, mean: np.ndarray, mean_low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x (rows x dims, whole doubles) less the mean, as pairs."""
    s, e = two_sum(x, -mean)
    return add_pairs(s, e, -mean_low)


def slices(a: np.ndarray) -> list[np.ndarray]:
    """a (rows x dims) as a sum of matrices, exactly but for the last bits of the smallest; entries of one column and slice are multiples of one
    power of two and have SLICE_BITS bits at most."""
    out = []
    for _ in range(SLICES):
        top = np.abs(a).max(axis=0)
        scale = np.ldexp(1.0, np.frexp(top)[1] + 53 - SLICE_BITS)
        high = np.where(top > 0, (a + scale) - scale, 0.0)
        out.append(high)
        a = a - high
    return out


def outer_sum(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum over rows of the outer products of (high + low), as a pair of dims x dims."""
    total, rest = np.zeros((high.shape[1],) * 2), np.zeros((high.shape[1],) * 2)
    for at in range(0, len(high), ROWS):
        part = slices(high[at : at + ROWS])
        cross = high[at : at + ROWS].T @ low[at : at + ROWS]
        for i, a in enumerate(part):
            for b in part[: SLICES - i + 1]:
                total, rest = add_pairs(total, rest, a.T @ b)
        total, rest = add_pairs(total, rest, cross + cross.T)
    return total, rest


def _sum_pairs(rdd: RDD, of_block, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The tree sum of the pairs that of_block gives."""
    zero = (np.zeros(shape), np.zeros(shape))
    return rdd.treeAggregate(zero, lambda state, block: add_pairs(*state, *of_block(block)), lambda a, b: add_pairs(*a, *b), depth=3)


def _quotient(high: np.ndarray, low: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(high + low) / n as a pair; the remainder of the first division is exact, as n splits into two factors of 26 bits and less."""
    q = high / n
    big = float(n >> 26 << 26)
    a, b = _two_product(q, big), _two_product(q, float(n) - big)
    left = ((high - a[0]) - b[0]) + low - a[1] - b[1]
    return two_sum(q, left / n)


def _two_product(a: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray]:
    """The rounded product, and what rounding lost."""
    p = a * b
    split = lambda x: ((t := x * 134217729.0) - (t - x), x - (t - (t - x)))
    (ah, al), (bh, bl) = split(a), split(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


class Whitening:
    """What a fit gives: n, sums (int64), mean (a pair), components (dims x k), eigenvalues (k), the total variance."""

    def __init__(self, n: int, sums: np.ndarray, components: np.ndarray, eigenvalues: np.ndarray, trace: float):
        self.n, self.sums, self.components, self.eigenvalues, self.trace = n, sums, components, eigenvalues, trace
        self.mean = mean_of(sums, n)
        self.live = eigenvalues > NO_VARIANCE * len(sums) * max(eigenvalues.max(initial=0.0), 0.0)
        self.matrix = components / np.sqrt(np.where(self.live, eigenvalues, 1.0))

    def apply(self, block: np.ndarray) -> np.ndarray:
        """Whitened values (rows x k) of a dims x rows block of integers; 0 in components without variance."""
        high, low = centred(block.T.astype(float), *self.mean)
        return np.where(self.live, high @ self.matrix + low @ self.matrix, 0.0)


def mean_of(sums: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """sums / n: the whole part exactly, the fraction to 53 bits."""
    whole = sums // n
    return two_sum(whole.astype(float), (sums - whole * n) / n)


def fit(table: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of a block table: one tree pass for the sums, one for the centred outer products."""

    def add(state, block):
        return state[0] + block.shape[1], state[1] + block.sum(axis=1)

    n, sums = arrays(table, dims, STORED).treeAggregate((0, np.zeros(dims, np.int64)), add, lambda a, b: (a[0] + b[0], a[1] + b[1]), depth=3)
    mean = mean_of(sums, n)
    total = _sum_pairs(arrays(table, dims, STORED), lambda block: outer_sum(*centred(block.T.astype(float), *mean)), (dims, dims))
    variance, _ = _quotient(*total, n)
    values, vectors = np.linalg.eigh(variance)
    order = np.argsort(-values, kind="stable")[:components]
    return Whitening(n, sums, vectors[:, order], np.maximum(values[order], 0.0), float(np.trace(variance)))


def identity_error(table: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the covariance of the whitened values (of components with variance), minus the identity."""
    k, dims = len(model.eigenvalues), len(model.sums)
    if not model.live.any():
        return None
    high, low = _sum_pairs(arrays(table, dims, STORED), lambda block: (model.apply(block).sum(axis=0), 0.0), (k,))
    centre = _quotient(high, low, model.n)
    total = _sum_pairs(arrays(table, dims, STORED), lambda block: outer_sum(*centred(model.apply(block), *centre)), (k, k))
    covariance, _ = _quotient(*total, model.n)
    return float(np.abs(covariance - np.eye(k))[np.ix_(model.live, model.live)].max())


def deviations(block: np.ndarray, model: Whitening) -> list[int]:
    """For each column of a dims x rows block: the sum over dimensions of (n*x - S)^2, exact whatever its size."""
    # n*x - S = n*(x - whole) - left, with a mean of whole + left / n: no factor is large but n
    whole = model.sums // model.n
    gap, left = block - whole[:, None], (model.sums - whole * model.n)[:, None]
    if (int(np.abs(gap).max()) + 1) ** 2 * model.n**2 * len(whole) < 1 << 62:
        return ((gap * model.n - left) ** 2).sum(axis=0).tolist()
    return ((gap.astype(object) * model.n - left) ** 2).sum(axis=0).tolist()


ROWS_SCHEMA = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.DecimalType(38, 0)), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]


def whiten(df: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """A row for every row with a usable vector and every component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds null or non-finite entries are dropped, and so are vectors of another length than that of the smallest id (if all
    ids are null, of the first vector in order). Components number min(dims, components). One without variance (a constant dimension, fewer rows than dimensions) has whitened null
    and is no part of identity_error; without any variance explained and identity_error are null. Repeated rows and null ids give results like others. An empty table gives
    an empty result. Other columns are not read, whatever their names. deviation is a decimal, as it passes 64 bits beyond some ten million rows.
    """
    spark = df.sparkSession
    kept = kept_vectors(df, vector_col, id_col)
    schema = T.StructType([T.StructField("id", kept.schema["id"].dataType), *[T.StructField(c, t) for c, t in ROWS_SCHEMA]])
    first = first_rows(kept, 1) or kept.orderBy("v").select("v").limit(1).collect()
    if not first:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    dims = len(first[0][0])
    table = blocks(kept, dims, to_int, STORED, 1 << 53, "whitening-blocks")
    model = fit(table, dims, components)
    error = identity_error(table, model)
    k = len(model.eigenvalues)
    explained = [float(e) / model.trace if model.trace > 0 else None for e in model.eigenvalues]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column("data")):
                block = np.frombuffer(data.as_py(), STORED).reshape(dims, -1)
                ids, m = batch.column("id").slice(i, 1).flatten(), block.shape[1]
                white = pa.array(model.apply(block).ravel(), mask=np.tile(~model.live, m))
                columns = [
                    ids.take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                    pa.array(deviations(block, model), pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(m), k))), white, pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return table.select("id", "data").mapInArrow(rows, schema).withColumnRenamed("id", id_col)


def as_long(column: str):
    """A deviation as long; null where it has no room in 64 bits."""
    return F.expr(f"try_cast(`{column}` AS bigint)").alias(column)
