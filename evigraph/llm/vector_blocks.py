"""Integer vectors as columnar blocks: a row of the block table holds the components of up to BLOCK_ROWS vectors, dimension by dimension."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigraph.llm._common import bound_batches, materialize

#: Vectors of a block, at most. Blocks bound what a task holds at once.
BLOCK_ROWS = 2048


def usable(vector: Column) -> Column:
    """Whether a vector is there, has components, and none of them is null, NaN or infinite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


def kept_vectors(df: DataFrame, vector_col: str, id_col: str, *others: str) -> DataFrame:
    """(id, v as array<double>, o0, o1, ...) of the rows with a usable vector."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    return df.select(F.col(f"`{id_col}`").alias("id"), v.alias("v"), *[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(others)]).where(usable(F.col("v")))


def blocks(kept: DataFrame, dims: int, to_int: Callable[[np.ndarray], np.ndarray], dtype: str, limit: int, name: str) -> DataFrame:
    """A written table of blocks (n, id array, o0 array, ..., data binary); data is dims x n integers of dtype.

    kept: what kept_vectors gives; vectors of another length than dims are left out. to_int turns doubles into whole doubles; beyond limit
    they raise OverflowError, as sums of their squares would not be exact.
    """
    bound_batches(kept.sparkSession)
    carried = [f for f in kept.schema.fields if f.name != "v"]
    schema = T.StructType([T.StructField("n", T.LongType()), *[T.StructField(f.name, T.ArrayType(f.dataType)) for f in carried], T.StructField("data", T.BinaryType())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                whole = to_int(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
                if np.abs(whole).max() > limit:
                    raise OverflowError(f"whole components beyond {limit} have no exact sums")
                n = part.num_rows
                columns = [pa.array([n], pa.int64())]
                columns += [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), part.column(f.name)) for f in carried]
                columns.append(pa.array([np.ascontiguousarray(whole.T.astype(dtype)).tobytes()], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["n", *[f.name for f in carried], "data"])

    return materialize(kept.where(F.size("v") == dims).mapInArrow(build, schema), name)


def arrays(table: DataFrame, dims: int, dtype: str):
    """An RDD of the dims x n integer arrays of a block table."""
    return table.select("data").rdd.map(lambda row: np.frombuffer(row[0], dtype).reshape(dims, -1))


def first_rows(kept: DataFrame, count: int) -> list:
    """The rows of the count smallest non-null ids (ties: by vector), at most; count is a constant of the caller."""
    return kept.where(F.col("id").isNotNull()).orderBy("id", "v").limit(count).select("v").collect()
