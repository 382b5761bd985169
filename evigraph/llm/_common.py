"""What the operators share: the shared working folder, word splitting and word hashing."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Fixed value: what a word is, for every operator that counts words.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Entries that a task's word cache holds before it is emptied; bounds worker memory on any input.
CACHE_ENTRIES = 300_000
#: Of an Arrow batch that goes to a Python worker; a single row may be larger.
BATCH_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir.

    Only on one machine (master local) and where neither that setting nor a checkpoint directory exists, as in tests, a
    temporary folder is made and set as the session's checkpoint directory; on a cluster RuntimeError is raised.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        found = tempfile.mkdtemp(prefix="evigraph-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df once to the shared folder as Parquet, in a folder for each value of by, and read it back: cuts lineage, survives lost executors.

    The job's shuffle files go once it has ended, as nothing after it reads them.
    """
    spark = df.sparkSession
    path, tidy = f"{shared_dir(spark)}/evigraph/{name}-{uuid.uuid4().hex}", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(tidy)
    spark.conf.set(tidy, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(tidy, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def discard(df: DataFrame, part: str = "") -> None:
    """Delete the files of a materialized table (or of one of its folders, as kind=1) that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{df.stage_path}/{part}".rstrip("/"))
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_prefix(columns: list[str], prefix: str = "_x") -> str:
    """A prefix that no column name begins with, for working columns beside those of a user."""
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = "_" + prefix
    return prefix


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ...: mapInArrow takes no column with a dot in its name."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def bound_batches(spark: SparkSession) -> None:
    """Have Spark cut the Arrow batches that it sends to Python at BATCH_BYTES, unless the session has a smaller bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(key))) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


class WordHash(dict):
    """bytes -> 64-bit hash, remembered; at most CACHE_ENTRIES words are held between documents."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def trim(self) -> None:
        if len(self) > CACHE_ENTRIES:
            self.clear()
