"""Graphs as DOT, Cytoscape JSON and JSON-LD: a line per node and edge, made where the rows are.

Empty values are left out and keys are in order. Open metadata is spread over the other keys and wins over them; that merge is a
vectorised UDF and is only planned where a table has a metadata column.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigraph.functions import text
from evigraph.graph import Graph
from evigraph.operators.loops import settle

#: Terms of the JSON-LD context.
CONTEXT = {
    "name": "http://schema.org/name",
    "description": "http://schema.org/description",
    "source": {"@id": "http://schema.org/source", "@type": "@id"},
    "target": {"@id": "http://schema.org/target", "@type": "@id"},
    "prov": "http://www.w3.org/ns/prov#",
}


def _filled(df: DataFrame, fields: dict[str, Column]) -> Column:
    """JSON object of the fields that are not empty, keys in order. Nulls are dropped by to_json."""
    out = []
    for key in sorted(fields):
        value = fields[key]
        kind = df.select(value.alias("x")).schema["x"].dataType
        if isinstance(kind, T.StringType):
            value = F.nullif(value, F.lit(""))
        elif isinstance(kind, T.ArrayType):
            value = F.when(F.size(value) > 0, value)
        out.append(value.alias(key))
    return F.to_json(F.struct(*out))


@F.pandas_udf(T.StringType())
def _spread(objects: pd.Series, metadata: pd.Series) -> pd.Series:
    def merge(obj: str, meta: str | None) -> str:
        made = json.loads(obj)
        for key, value in (json.loads(meta) if meta else {}).items():
            made[key] = value
        made = {k: v for k, v in made.items() if v not in ("", None, [], {})}
        return json.dumps(made, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    return pd.Series([merge(o, m) for o, m in zip(objects, metadata, strict=True)])


def _object(df: DataFrame, fields: dict[str, Column]) -> Column:
    made = _filled(df, fields)
    if "metadata" not in df.columns:
        return made
    kind = df.schema["metadata"].dataType
    meta = F.col("metadata") if isinstance(kind, T.StringType) else F.to_json("metadata")
    return _spread(made, meta)


def _some(df: DataFrame, names) -> dict[str, Column]:
    return {n: F.col(n) for n in names if n in df.columns}


def _lines(graph: Graph, node: Column, edge: Column, name: str) -> DataFrame:
    """(part, pos, name): pos keeps its type, so numbers order as numbers; where nodes and edges differ in it, it is a pair of both."""
    kinds = [df.schema["pos"].dataType for df in (graph.nodes, graph.edges)]
    place = [F.col("pos"), F.col("pos")]
    if kinds[0] != kinds[1]:
        place = [F.struct(F.col("pos").alias("node"), F.lit(None).cast(kinds[1]).alias("edge")), F.struct(F.lit(None).cast(kinds[0]).alias("node"), F.col("pos").alias("edge"))]
    nodes = graph.nodes.select(F.lit(0).alias("part"), place[0].alias("pos"), node.alias(name))
    return nodes.unionByName(graph.edges.select(F.lit(1).alias("part"), place[1].alias("pos"), edge.alias(name)))


def in_order(lines: DataFrame) -> DataFrame:
    """lines with place, from 0: nodes before edges, each in the order of pos. Numbered by ranges, not in one task."""
    parts = settle(lines.repartitionByRange(lines.sparkSession.sparkContext.defaultParallelism, "part", "pos").sortWithinPartitions("part", "pos").withColumn("range", F.spark_partition_id()))
    inside = parts.withColumn("i", F.row_number().over(Window.partitionBy("range").orderBy("part", "pos")))
    sizes = parts.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # a row per range
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("range")) - F.col("n"))
    return inside.join(F.broadcast(before), "range").withColumn("place", (F.col("before") + F.col("i") - 1).cast("long")).drop("range", "i", "n", "before")


def write_lines(lines: DataFrame, path: str) -> None:
    """The lines as text files whose names order as the document does, for graphs of any size."""
    column = lines.columns[-1]
    lines.repartitionByRange(lines.sparkSession.sparkContext.defaultParallelism, "part", "pos").sortWithinPartitions("part", "pos").select(F.col(column).alias("value")).write.text(path)


def dot_lines(graph: Graph) -> DataFrame:
    """(part, pos, line): statements of nodes (part 0) and edges (part 1)."""
    q = lambda c: F.concat(F.lit('"'), text.dot_escape(c), F.lit('"'))
    title = F.coalesce(F.nullif("title", F.lit("")), F.col("id")) if "title" in graph.nodes.columns else F.col("id")
    node = F.concat(F.lit("  "), q(F.col("id")), F.lit(" [label="), q(title), F.lit(", type="), q(F.col("type")), F.lit("];"))
    edge = F.concat(F.lit("  "), q(F.col("source")), F.lit(" -> "), q(F.col("target")), F.lit(" [label="), q(F.col("type")), F.lit("];"))
    return _lines(graph, node, edge, "line")


def cytoscape_lines(graph: Graph) -> DataFrame:
    wrap = lambda c: F.concat(F.lit('{"data":'), c, F.lit("}"))
    node = _object(graph.nodes, _some(graph.nodes, ("id", "type", "title", "description", "status", "confidence", "assessments")))
    edge = _object(graph.edges, _some(graph.edges, ("id", "source", "target", "type", "title", "justification", "confidence", "assessments", "status", "evidence_ids")))
    return _lines(graph, wrap(node), wrap(edge), "json")


def jsonld_lines(graph: Graph) -> DataFrame:
    """Elements of @graph."""
    at = lambda c: F.struct(F.col(c).alias("@id"))
    named = {"name": "title", "description": "description", "status": "status", "prov:wasDerivedFrom": "provenance", "assessments": "assessments"}
    node = {"@id": F.col("id"), "@type": F.col("type"), **{k: F.col(c) for k, c in named.items() if c in graph.nodes.columns}}
    own = F.col("id") if "id" in graph.edges.columns else F.lit("")
    ident = F.when(F.coalesce(own, F.lit("")) != "", own).otherwise(text.compound_edge_id(F.col("source"), F.col("type"), F.col("target"), "--"))
    e_named = {"name": "title", "description": "justification", "confidence": "confidence", "status": "status", "evidence": "evidence_ids", "prov:wasDerivedFrom": "provenance", "assessments": "assessments"}
    edge = {"@id": ident, "@type": F.col("type"), "source": at("source"), "target": at("target"), **{k: F.col(c) for k, c in e_named.items() if c in graph.edges.columns}}
    return _lines(graph, _object(graph.nodes, node), _object(graph.edges, edge), "json")


def _collected(lines: DataFrame, column: str, part: int) -> list[str]:
    return [r[0] for r in lines.where(F.col("part") == part).orderBy("pos").select(column).collect()]


def to_dot(graph: Graph, name: str = "graph") -> str:
    """The whole document, for graphs that fit on the driver; write dot_lines as text otherwise."""
    lines = dot_lines(graph)
    head = re.sub(r"[^0-9A-Za-z_]", "_", name) or "graph"
    return "\n".join([f"digraph {head} {{", *_collected(lines, "line", 0), *_collected(lines, "line", 1), "}"])


def to_cytoscape(graph: Graph) -> dict:
    lines = cytoscape_lines(graph)
    return {"nodes": [json.loads(x) for x in _collected(lines, "json", 0)], "edges": [json.loads(x) for x in _collected(lines, "json", 1)]}


def to_jsonld(graph: Graph, graph_id: str = "", title: str = "") -> dict:
    lines = jsonld_lines(graph)
    return {"@context": CONTEXT, "@id": graph_id, "@type": "GraphBundle", "name": title, "@graph": [json.loads(x) for k in (0, 1) for x in _collected(lines, "json", k)]}


def write_text(path: str | Path, content: str | dict) -> None:
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(content if isinstance(content, str) else json.dumps(content, indent=2), encoding="utf-8")
