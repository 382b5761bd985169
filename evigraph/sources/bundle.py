"""Graph bundles: one JSON document per graph, many read at once; written as JSON or as Parquet tables."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigraph import schema
from evigraph.graph import Graph

_TEXT = {"description", "title", "status", "justification", "id", "source", "target", "type"}


def read_bundles(spark: SparkSession, path: str) -> Graph:
    """All bundle files under path. Missing texts are empty, a missing confidence is null (and is not 0), metadata stays JSON text.

    Keys that the layout lacks are dropped. A file that is no JSON object raises when read.
    """
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", schema.BUNDLE, {"mode": "FAILFAST"}).alias("b")).select("b.*")
    header = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("bundle_kind", "graph_id", "title", "description")], "metadata")
    return Graph(_component(docs, "nodes"), _component(docs, "edges"), header)


def _component(docs: DataFrame, name: str) -> DataFrame:
    rows = docs.select(F.coalesce("graph_id", F.lit("")).alias("graph_id"), F.posexplode(name).alias("pos", "c")).select("graph_id", F.col("pos").cast("long").alias("pos"), "c.*")
    return _defaults(rows)


def _defaults(rows: DataFrame) -> DataFrame:
    filled = {}
    for f in rows.schema.fields:
        if isinstance(f.dataType, T.StringType):
            filled[f.name] = F.coalesce(f.name, F.lit("{}" if f.name == "metadata" else ""))
        elif isinstance(f.dataType, T.ArrayType):
            filled[f.name] = F.coalesce(f.name, F.array().cast(f.dataType))
    return rows.withColumns(filled)


def graph_from_payload(spark: SparkSession, payload: dict[str, Any]) -> Graph:
    """A Graph of one bundle given as a dict (tests, small inputs)."""
    texts = spark.createDataFrame([(json.dumps(payload),)], "value string")
    docs = texts.select(F.from_json("value", schema.BUNDLE, {"mode": "FAILFAST"}).alias("b")).select("b.*")
    header = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("bundle_kind", "graph_id", "title", "description")], "metadata")
    return Graph(_component(docs, "nodes"), _component(docs, "edges"), header)


def read_records(spark: SparkSession, path: str) -> Graph:
    """Record-shaped exports: nodes as node_id, node_kind and record; edges as edge_id, source_id, target_id and relation_type, in edges and
    provenance_edges. A provenance given as text becomes its origin_path."""
    node = "node_id STRING, node_kind STRING, status STRING, record STRUCT<title STRING, current_status STRING>"
    edge = "edge_id STRING, source_id STRING, target_id STRING, relation_type STRING, status STRING, evidence_ids ARRAY<STRING>, provenance STRING"
    layout = f"root_concept STRUCT<concept_id STRING>, query_type STRING, nodes ARRAY<STRUCT<{node}>>, edges ARRAY<STRUCT<{edge}>>, provenance_edges ARRAY<STRUCT<{edge}>>"
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", layout, {"mode": "FAILFAST"}).alias("b")).select("b.*")
    gid = F.coalesce("root_concept.concept_id", F.lit("export")).alias("graph_id")
    nodes = docs.select(gid, F.posexplode("nodes").alias("pos", "c")).select(
        "graph_id", F.col("pos").cast("long").alias("pos"), F.coalesce("c.node_id", F.lit("")).alias("id"), F.coalesce("c.node_kind", F.lit("")).alias("type"), F.coalesce("c.record.title", "c.node_id", F.lit("")).alias("title"),
        F.coalesce("c.status", "c.record.current_status", F.lit("")).alias("status"), F.lit(None).cast("double").alias("confidence"), F.lit("{}").alias("metadata"),
    )
    empty = F.array().cast(docs.schema["edges"].dataType)
    every = docs.select(gid, F.posexplode(F.concat(F.coalesce("edges", empty), F.coalesce("provenance_edges", empty))).alias("pos", "c"))
    kind = f"array<{schema.PROVENANCE}>"
    listed = F.from_json("c.provenance", kind)
    one = F.transform(F.array(F.col("c.provenance")), lambda p: F.struct(*[F.lit("").alias(n) for n in ("source_id", "artifact_id")], p.alias("origin_path"), *[F.lit("").alias(n) for n in ("source_url", "support_kind", "grounding_status")], F.lit("{}").alias("metadata")))
    provenance = F.when(F.coalesce("c.provenance", F.lit("")) == "", F.array().cast(kind)).when(F.startswith(F.col("c.provenance"), F.lit("[")), listed).otherwise(one.cast(kind))
    edges = every.select(
        "graph_id", F.col("pos").cast("long").alias("pos"), *[F.coalesce(f"c.{a}", F.lit("")).alias(b) for a, b in (("edge_id", "id"), ("source_id", "source"), ("target_id", "target"), ("relation_type", "type"), ("status", "status"))],
        F.lit(None).cast("double").alias("confidence"), F.coalesce("c.evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"), provenance.alias("provenance"), F.lit("{}").alias("metadata"),
    )
    header = docs.select(gid, F.lit("").alias("title"), F.lit("").alias("description"), F.to_json(F.struct(F.coalesce("query_type", F.lit("")).alias("source_query_type"))).alias("metadata"))
    return Graph(nodes, edges, header)


def write_tables(graph: Graph, path: str) -> None:
    """nodes, edges and header as Parquet, for graphs of any size."""
    graph.nodes.write.parquet(f"{path}/nodes")
    graph.edges.write.parquet(f"{path}/edges")
    if graph.header is not None:
        graph.header.write.parquet(f"{path}/header")


def read_tables(spark: SparkSession, path: str, unique_ids: bool = False) -> Graph:
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/header"), unique_ids)


def _plain(row: Any) -> Any:
    """A row as JSON values: nulls dropped, nested metadata parsed."""
    if hasattr(row, "asDict"):
        row = row.asDict()
    if isinstance(row, dict):
        return {k: json.loads(v) if k == "metadata" and isinstance(v, str) else _plain(v) for k, v in row.items() if v is not None}
    return [_plain(x) for x in row] if isinstance(row, list) else row


def bundle_payload(graph: Graph, graph_id: str | None = None) -> dict[str, Any]:
    """One bundle as a dict, for graphs that fit on the driver. summary holds the counts of nodes and edges; metadata.summary wins over them."""
    head = graph.header.first() if graph.header is not None else None
    out = _plain(head) if head else {"graph_id": graph_id or ""}
    for name, df in (("nodes", graph.nodes), ("edges", graph.edges)):
        out[name] = [_plain(r) for r in df.orderBy("pos").drop("pos", "graph_id").collect()]
    out.setdefault("metadata", {})
    own = out["metadata"].get("summary")
    out["summary"] = {"node_count": len(out["nodes"]), "edge_count": len(out["edges"]), **(own if isinstance(own, dict) else {})}
    return out


def write_bundle(graph: Graph, path: str | Path) -> None:
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(bundle_payload(graph), indent=2), encoding="utf-8")
