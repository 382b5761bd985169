"""The driver's tables seen as graphs and evaluation rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.graph import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}::"), F.col(key).cast("string"))


def supply(spark: SparkSession, sf_dir: str, customers: bool = True) -> Graph:
    """Regions, nations, suppliers and customers; located_in edges. Acyclic."""
    t = lambda n: table(spark, sf_dir, n)
    parts = [("region", t("region"), "r_regionkey", "r_name", None, None), ("nation", t("nation"), "n_nationkey", "n_name", "region", "n_regionkey"), ("supplier", t("supplier"), "s_suppkey", "s_name", "nation", "s_nationkey")]
    if customers:
        parts.append(("customer", t("customer"), "c_custkey", "c_name", "nation", "c_nationkey"))
    nodes = edges = None
    for kind, df, key, name, up, up_key in parts:
        n = df.select(_id(kind, key).alias("id"), F.lit(kind).alias("type"), F.col(name).alias("title"), _id(kind, key).alias("pos"))
        nodes = n if nodes is None else nodes.unionByName(n)
        if up:
            e = df.select(_id(kind, key).alias("source"), _id(up, up_key).alias("target"), F.lit("located_in").alias("type"), _id(kind, key).alias("pos"))
            edges = e if edges is None else edges.unionByName(e)
    return Graph(nodes, edges, unique_ids=True)


def evidence(spark: SparkSession, sf_dir: str, concepts: bool = True, suppliers: str = "true") -> Graph:
    """Parts as claims, suppliers as sources, brands as concepts; line items as evidence, dated by their ship date.

    suppliers: SQL condition on the supplier rows that become nodes.
    """
    part, supplier, line = (table(spark, sf_dir, n) for n in ("part", "supplier", "lineitem"))
    none, text = F.lit(None).cast("double"), lambda: F.lit(None).cast("string")
    meta = lambda quality, artifact, fragment, at: F.struct(quality.alias("source_quality"), artifact.alias("artifact_id"), fragment.alias("fragment_id"), at.alias("available_at"))
    when = lambda: F.lit(None).cast("timestamp_ntz")
    quality = F.element_at(F.array(F.lit("peer_reviewed"), F.lit("secondary"), F.lit("low")), F.col("s_nationkey") % 3 + 1)
    row = lambda df, kind, key, title, conf, m: df.select(_id(kind[0], key).alias("id"), F.lit(kind[1]).alias("type"), F.col(title).alias("title"), conf.alias("confidence"), m.alias("metadata"), _id(kind[0], key).alias("pos"))
    nodes = row(part, ("part", "claim"), "p_partkey", "p_name", F.col("p_size") / 50, meta(text(), text(), text(), when()))
    nodes = nodes.unionByName(row(supplier.where(suppliers), ("supplier", "source"), "s_suppkey", "s_name", none, meta(quality, text(), text(), when())))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")], cents.cast("string"))
    kind = F.when(F.col("l_returnflag") == "R", "contradicts").when(F.col("l_returnflag") == "A", "qualifies").otherwise("supports_claim")
    edges = line.select(
        _id("supplier", "l_suppkey").alias("source"), _id("part", "l_partkey").alias("target"), kind.alias("type"), key.alias("id"), (F.col("l_quantity") / 50).alias("confidence"),
        meta(text(), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_shipdate")).alias("metadata"), key.alias("pos"),
    )
    if concepts:
        brands = part.select("p_brand").distinct()
        nodes = nodes.unionByName(row(brands, ("brand", "concept"), "p_brand", "p_brand", none, meta(text(), text(), text(), when())))
        about = part.select(
            _id("part", "p_partkey").alias("source"), _id("brand", "p_brand").alias("target"), F.lit("about_concept").alias("type"), _id("about", "p_partkey").alias("id"), none.alias("confidence"),
            meta(text(), text(), text(), when()).alias("metadata"), _id("about", "p_partkey").alias("pos"),
        )
        edges = edges.unionByName(about)
    return Graph(nodes, edges, unique_ids=True)


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stories: each line item is a claim, false where returned, and, where discounted, evidence against itself. An order has few lines."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")], F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"))
    number, blank, empty = F.col("l_linenumber").cast("string"), F.lit(""), F.lit("{}")
    anchor = F.concat(F.lit("line "), number)
    truth = F.when(F.col("l_returnflag") == "R", "false").when(F.col("l_returnflag") == "A", "misleading").otherwise("true")
    claim_id = F.concat(F.lit("claim::"), key)
    claim = F.struct(claim_id.alias("claim_id"), F.lit("a claim").alias("text"), blank.alias("speaker"), truth.alias("truth_status"), anchor.alias("narrative_anchor"), number.alias("introduced_at"), blank.alias("notes"), empty.alias("metadata"))
    evidence = F.struct(
        F.concat(F.lit("evidence::"), key).alias("evidence_id"), F.when(F.col("l_tax") == 0, "").otherwise("evidence").alias("text"), claim_id.alias("contradicts_claim_id"), number.alias("available_at"), anchor.alias("narrative_anchor"),
        F.when(F.col("l_quantity") > 45, "hidden").otherwise("reader").alias("access_scope"), blank.alias("notes"), empty.alias("metadata"),
    )
    lists = line.groupBy("l_orderkey").agg(F.collect_list(claim).alias("claims"), F.collect_list(F.when(F.col("l_discount") >= 0.05, evidence)).alias("decisive_evidence"))
    fair = F.when(F.col("o_orderstatus") == "F", "fair_play").when(F.col("o_orderstatus") == "P", "ambiguous").otherwise("late_decisive_evidence")
    return orders.join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.lit("detective_story_annotation").alias("annotation_kind"), _id("story", "o_orderkey").alias("story_id"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), blank.alias("source_url"),
        F.lit("line").alias("narrative_unit"), (F.col("o_custkey") % 8).cast("string").alias("reveal_point"), fair.alias("fair_play_status"), "claims", "decisive_evidence", blank.alias("graph_file"),
    )


def chain(spark: SparkSession, sf_dir: str) -> Graph:
    """Each user's events in order of time, an edge from each to the next."""
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events")
    after = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    nodes = events.select(_id("event", "event_id").alias("id"), F.lit("event").alias("type"), F.col("event_type").alias("title"), F.struct(F.col("ts").alias("observed_at")).alias("metadata"), F.col("event_id").alias("pos"))
    edges = events.withColumn("next", after).where("next IS NOT NULL").select(_id("event", "event_id").alias("source"), _id("event", "next").alias("target"), F.lit("follows").alias("type"), F.col("event_id").alias("pos"))
    return Graph(nodes, edges, unique_ids=True)


def g_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as evaluation rows: condition is the event type, env C before 2024-01-16 and K from then."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("subject_id"), F.col("event_type").alias("condition"), F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "C").otherwise("K").alias("env"),
        (k >= 50).cast("int").alias("y"), F.least(F.col("value") / 500, F.lit(1.0)).alias("p"), (F.col("user_id") % 3).cast("string").alias("level"), F.when(F.col("user_id") % 2 == 0, "before").otherwise("after").alias("phase"),
    )


def calibration_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").cast("string").alias("subject_id"), F.least(F.col("n_chars") / 5000, F.lit(1.0)).alias("predicted"), F.col("quality").cast("double").alias("observed"),
        F.lit("response_correctness").alias("dimension"), F.lit("quality").alias("event"), F.struct((F.col("lang") == "es").alias("abstained"), F.when(F.col("lang") != "fr", F.lit(0.5)).alias("evidence_coverage")).alias("metadata"),
    )
