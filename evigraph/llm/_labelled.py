"""Labelled rows for the classifiers: a bounded, repeatable sample of those that may be learnt from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows of each class that a classifier is fitted on, at most; both classes together bound what is broadcast.
MAX_PER_CLASS = 10_000


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text (a null id: as an empty text), modulo modulus."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, text_col: str, id_col: str, max_per_class: int = MAX_PER_CLASS) -> DataFrame:
    """(text, y) of the learnable labelled documents, at most max_per_class ids of each class in order of a hash.

    A document labelled several times counts with its highest label; null labels and ids are left out. The chosen ids
    (2 * max_per_class at most) are broadcast, so no text is shuffled.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & learnable)
    one = usable.groupBy(id_col).agg(F.max(F.col(label).cast("int")).alias("y"))
    picked = None
    for y in (0, 1):
        part = one.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(91), id_col), id_col).limit(max_per_class)
        picked = part if picked is None else picked.unionByName(part)
    picked = picked.withColumnRenamed(id_col, "__id")
    return docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), "__id").select("text", "y")
