"""Synthetic graphs of any size, made by spark.range."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.graph import Graph


def _graph(spark: SparkSession, n: int, edges: DataFrame, kind: str = "concept") -> Graph:
    name = lambda c: F.concat(F.lit("n"), F.lpad(F.col(c).cast("string"), 9, "0"))
    nodes = spark.range(n).select(name("id").alias("id"), F.lit(kind).alias("type"), F.col("id").alias("pos"))
    return Graph(nodes, edges.select(name("a").alias("source"), name("b").alias("target"), F.lit("related").alias("type"), F.monotonically_increasing_id().alias("pos")), unique_ids=True)


def path(spark: SparkSession, n: int) -> Graph:
    return _graph(spark, n, spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))


def star(spark: SparkSession, n: int) -> Graph:
    return _graph(spark, n, spark.range(1, n).select(F.lit(0).alias("a"), F.col("id").alias("b")))


def cycle(spark: SparkSession, n: int) -> Graph:
    return _graph(spark, n, spark.range(n).select(F.col("id").alias("a"), ((F.col("id") + 1) % n).alias("b")))


def blocks(spark: SparkSession, n: int, size: int = 5) -> Graph:
    """Paths of `size` nodes that are not joined."""
    return _graph(spark, n, spark.range(n - 1).where(F.col("id") % size != size - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))


def pairs(spark: SparkSession, n: int) -> Graph:
    """n claims, each supported by a source of its own with confidence 0.8."""
    ids = spark.range(n)
    node = lambda kind: ids.select(F.concat(F.lit(f"{kind}::"), F.col("id").cast("string")).alias("id"), F.lit(kind).alias("type"), F.concat(F.lit(f"{kind} "), F.col("id").cast("string")).alias("title"), F.col("id").alias("pos"))
    edges = ids.select(F.concat(F.lit("source::"), F.col("id").cast("string")).alias("source"), F.concat(F.lit("claim::"), F.col("id").cast("string")).alias("target"), F.lit("supports_claim").alias("type"), F.lit(0.8).alias("confidence"), F.col("id").alias("pos"))
    return Graph(node("source").unionByName(node("claim")), edges, unique_ids=True)


def random_sparse(spark: SparkSession, n: int, seed: int = 7) -> Graph:
    """2n edges between ends drawn by hash."""
    draw = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(n))
    return _graph(spark, n, spark.range(2 * n).select(draw(1).alias("a"), draw(2).alias("b")))


def record_fixture(spark: SparkSession, scale: int = 1) -> Graph:
    """A record-shaped export as a graph: 6 nodes and 5 edges for each unit of scale, kinds in turn, edges to the next node."""
    n = 6 * max(1, int(scale))
    turn = lambda c: F.when(c % 3 == 0, "concept").when(c % 3 == 1, "claim").otherwise("observation")
    name = lambda c: F.concat(turn(c), F.lit("::fixture-"), c.cast("string"))
    i = F.col("id")
    nodes = spark.range(n).select(name(i).alias("id"), turn(i).alias("type"), F.concat(F.lit("Sanitized fixture record "), i.cast("string")).alias("title"), F.when(i % 4 == 0, "promoted").otherwise("reviewed").alias("status"), i.alias("pos"))
    kind = F.when(i % 3 == 0, "supports").otherwise("related_to")
    edges = spark.range(n // 6 * 5).select(name(i).alias("source"), name((i + 1) % n).alias("target"), kind.alias("type"), F.concat(F.lit("relation::fixture-"), i.cast("string")).alias("id"), F.lit("reviewed").alias("status"), i.alias("pos"))
    return Graph(nodes, edges, unique_ids=True)
