"""Loops over DataFrames: each round is written to the shared folder and deleted when the next has read it, so plans stay short and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """df written once as Parquet to the folder in spark.checkpoint.dir, and read back; the job's shuffle files go with it.

    On one machine (master local) without such a folder a temporary one is used; on a cluster RuntimeError is raised.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        folder = tempfile.mkdtemp(prefix="evigraph-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/loops/{uuid.uuid4().hex}"
    tidy = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(tidy)
    spark.conf.set(tidy, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(tidy, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


@contextmanager
def joined_by_size(spark: SparkSession):
    """Within it joins broadcast what was seen to be small when it was shuffled, never what a file's size or a guess says: ids compress to a fraction of what they take in memory."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "4MB"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, value in names.items():
        spark.conf.set(n, value)
    try:
        yield
    finally:
        for n, value in before.items():
            spark.conf.unset(n) if value is None else spark.conf.set(n, value)


def discard(*tables: DataFrame) -> None:
    """Delete the files of settled tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stage_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, order: list[str], name: str, base: int = 0) -> DataFrame:
    """df with name: the place (from base) of a row in the order of the columns, which must tell all rows apart. Settled; its attribute rows is their number.

    Range partitions are sorted and numbered each on its own as they are written, and shifted by the sizes of those before (a number for each
    partition, on the driver), so no task sees all rows.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = settle(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    inside, part = F.expr("__at & 8589934591"), F.shiftright("__at", 33)  # fixed layout of these ids: 33 bits count within a partition
    sizes = {r["p"]: r["n"] for r in parts.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    shifts, total = [], 0
    for p in sorted(sizes):
        shifts.append((p, base + total))
        total += sizes[p]
    before = spark.createDataFrame(shifts, "__p long, __before long")
    out = parts.withColumn("__p", part).join(F.broadcast(before), "__p").withColumn(name, inside + F.col("__before")).drop("__p", "__at", "__before")
    out.stage_path, out.rows = parts.stage_path, total
    return out


def roots(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest (node, parent: itself at a root), by pointer jumping: as many rounds as the depth has binary digits. Settled."""
    labels = settle(parents.select("node", F.col("parent").alias("root")))
    while True:
        far = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = settle(labels.join(far, "root").select("node", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")))
        discard(labels)
        labels = new
        if labels.where("moved").isEmpty():
            return labels


def connected(pairs: DataFrame) -> DataFrame:
    """(id, label) of every id that pairs (a, b) names: the least id of its component. Settled.

    Graphs are contracted: every node goes to the first of itself and its neighbours in an order that changes each round, and on to where that goes; edges follow
    their ends, and what is left of them is a fraction of a round's, whatever the shape of the graph. Nodes are then looked up in the rounds backwards.
    Ids that are no longs are numbered first, so rounds move numbers only.
    """
    if pairs.schema["a"].dataType.typeName() != "long":
        ids = numbered(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), ["id"], "n")
        for end in ("a", "b"):
            pairs = pairs.join(ids.select(F.col("id").alias(end), F.col("n").alias(f"n{end}")), end)
        labels = connected(pairs.select(F.col("na").alias("a"), F.col("nb").alias("b")))
        out = settle(labels.join(ids.select(F.col("n").alias("label"), F.col("id").alias("least")), "label").join(ids.withColumnRenamed("n", "number"), F.col("number") == labels["id"]).select(ids["id"], F.col("least").alias("label")))
        discard(labels, ids)
        return out
    edges, rounds = settle(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), []
    while not edges.isEmpty():
        turn, mask = 61 - 11 * len(rounds) % 60, 0x2545F4914F6CDD1D  # any order will do that no graph follows: bits turned and some of them flipped, which loses nothing
        mixed = lambda c: (F.shiftleft(c, 64 - turn).bitwiseOR(F.shiftrightunsigned(c, turn))).bitwiseXOR(F.lit(mask))  # noqa: B023, E731
        plain = lambda c: (lambda x: F.shiftleft(x, turn).bitwiseOR(F.shiftrightunsigned(x, 64 - turn)))(c.bitwiseXOR(F.lit(mask)))  # noqa: B023, E731
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("by")), F.struct(F.col("b").alias("id"), F.col("a").alias("by")))).alias("e")).select("e.id", mixed(F.col("e.by")).alias("by"))
        near = settle(both.groupBy("id").agg(F.min("by").alias("by")).select("id", plain(F.least("by", mixed(F.col("id")))).alias("to")))
        far = settle(near.join(near.select(F.col("id").alias("to"), F.col("to").alias("far")), "to").select("id", F.col("far").alias("to")))
        discard(near)
        moved = edges
        for end in ("a", "b"):
            moved = moved.join(far.select(F.col("id").alias(end), F.col("to").alias(f"t{end}")), end)
        left = settle(moved.where("ta != tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        discard(edges)
        edges = left
        rounds.append(far)
    discard(edges)
    if not rounds:
        return settle(pairs.limit(0).select(F.col("a").alias("id"), F.col("a").alias("label")))
    roots_ = rounds.pop()
    while rounds:
        below = rounds.pop()
        joined = settle(below.join(roots_.select(F.col("id").alias("to"), F.col("to").alias("root")), "to", "left").select("id", F.coalesce("root", "to").alias("to")))
        discard(below, roots_)
        roots_ = joined
    out = settle(roots_.join(roots_.groupBy("to").agg(F.min("id").alias("label")), "to").select("id", "label"))
    discard(roots_)
    return out
