"""Vector code compression: product quantisation in whole numbers.

Components become integers and vectors are cut into PARTS consecutive parts. The codebooks are refined in a fixed number of rounds, each
one RDD treeAggregate over columnar blocks: a task adds up squared distances dimension by dimension, takes the nearest
entry, and adds parts into int64 sum and count tensors with np.add.at; tensors, whose size is that of the codebooks, merge in a reduction tree.
All arithmetic is exact, so the result depends neither on the partitions nor on the order of merges.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigraph.llm._common import discard, materialize
from evigraph.llm.vector_blocks import arrays, blocks, first_rows, kept_vectors

#: What a component is multiplied by, the parts of a vector, the entries of a codebook, the rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors whose distances to all entries are held at once.
CHUNK = 512
STORED = "<i4"


def to_int(v: np.ndarray) -> np.ndarray:
    return np.floor(v * SCALE)


def largest(dims: int) -> int:
    """Whole components up to this keep the squared distance of two vectors below 2^62."""
    return min(math.isqrt((1 << 62) // dims) // 2, np.iinfo(STORED).max)


def bounds(dims: int) -> list[tuple[int, int]]:
    """First and last dimension of each part; where the parts can't be equal their lengths differ by one."""
    return [(dims * p // PARTS, dims * (p + 1) // PARTS) for p in range(PARTS)]


def nearest(block: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """block: dims x n, codebook: entries x dims. The index of the nearest entry (the lowest of equals) and the squared distance, of each column."""
    index, distance = np.empty(block.shape[1], np.int64), np.empty(block.shape[1], np.int64)
    for at in range(0, block.shape[1], CHUNK):
        part = block[:, at : at + CHUNK].astype(np.int64)
        total = np.zeros((part.shape[1], len(codebook)), np.int64)
        for d in range(len(part)):
            gap = part[d][:, None] - codebook[:, d][None, :]
            gap *= gap
            total += gap
        index[at : at + CHUNK] = total.argmin(axis=1)
        distance[at : at + CHUNK] = total.min(axis=1)
    return index, distance


def _refined(books: list[np.ndarray], sums: list[np.ndarray], counts: np.ndarray) -> list[np.ndarray]:
    out = []
    for p, book in enumerate(books):
        used = counts[p] > 0
        new = book.copy()
        new[used] = sums[p][used] // counts[p][used][:, None]
        out.append(new)
    return out


def fit_codebooks(table: DataFrame, dims: int, books: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """The codebooks (entries x part dimensions, int64) after the given rounds over a block table."""
    context, cuts, entries = table.sparkSession.sparkContext, bounds(dims), len(books[0])
    for _ in range(rounds):
        shared = context.broadcast(books)  # ENTRIES * dims integers, whatever the input

        def add(state, block):
            sums, counts = state
            for p, (a, b) in enumerate(cuts):
                index, _ = nearest(block[a:b], shared.value[p])
                np.add.at(sums[p], index, block[a:b].T.astype(np.int64))
                np.add.at(counts[p], index, 1)
            return state

        def merge(one, other):
            for p in range(PARTS):
                one[0][p] += other[0][p]
            one[1][...] += other[1]
            return one

        zero = ([np.zeros((entries, b - a), np.int64) for a, b in cuts], np.zeros((PARTS, entries), np.int64))
        books = _refined(books, *arrays(table, dims, STORED).treeAggregate(zero, add, merge, depth=3))
        shared.unpersist()
    return books


def codebooks_digest(books: list[np.ndarray]) -> str:
    """Lowercase hex SHA-256 of all components, by part, entry and position, as decimal integers joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def compress(df: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", label_col: str | None = "label", rounds: int = ROUNDS) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every row with a usable vector.

    code is the index of the nearest entry in each part, two hex digits each; error the squared distance, summed over parts; label_error
    the errors summed over rows of equal label, null labels together (over all rows where label_col is None). Rows whose vector is null, empty, or holds null
    or non-finite components are dropped, and so are vectors of another length than that of the smallest id. Fewer than 256 ids give fewer entries; a null id is
    coded, but is no initial entry (if all ids are null, nothing can be coded and the result is empty). Repeated rows give repeated
    results; of rows with equal id the order of their vectors decides which are initial. Lengths that PARTS doesn't divide give parts whose lengths differ by one. Components so large
    that squared distances pass 2^62 (beyond 131,072 at 64 dimensions) raise OverflowError. An empty table gives an empty result. Other columns are not read, whatever their names.
    """
    spark = df.sparkSession
    kept = kept_vectors(df, vector_col, id_col, *([label_col] if label_col else []))
    id_type = kept.schema["id"].dataType
    out = T.StructType([T.StructField("id", id_type), *[f for f in kept.schema.fields if f.name == "o0"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    first = [np.array(r[0]) for r in first_rows(kept, ENTRIES)]
    if not first:
        return spark.createDataFrame([], T.StructType([T.StructField(id_col, id_type)])).selectExpr(f"`{id_col}`", "'' AS code", "0L AS error", "0L AS label_error", "'' AS codebooks_sha256")
    dims = len(first[0])
    start = to_int(np.array([v for v in first if len(v) == dims])).astype(np.int64)
    table = blocks(kept, dims, to_int, STORED, largest(dims), "vector-blocks")
    cuts = bounds(dims)
    books = fit_codebooks(table, dims, [start[:, a:b] for a, b in cuts], rounds)
    carried = [f.name for f in out.fields[:-2]]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column("data")):
                block = np.frombuffer(data.as_py(), STORED).reshape(dims, -1)
                found = [nearest(block[a:b], book) for (a, b), book in zip(cuts, books, strict=True)]
                codes = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
                errors = sum(distance for _, distance in found)
                columns = [batch.column(c).slice(i, 1).flatten() for c in carried]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(errors, pa.int64())], names=out.names)

    coded = materialize(table.select(*carried, "data").mapInArrow(assign, out), "vector-codes")
    discard(table)
    if label_col:
        by_label = coded.groupBy(F.col("o0").alias("label")).agg(F.sum("error").alias("label_error"))
        coded = coded.join(by_label, F.col("o0").eqNullSafe(F.col("label")))
    else:
        coded = coded.withColumn("label_error", F.lit(coded.agg(F.sum("error")).first()[0]))
    return coded.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
