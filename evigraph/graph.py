"""A graph as DataFrames: nodes, edges and a header."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions.meta import with_field
from evigraph.schema import CHALLENGE, REVISION, SUPPORT


def of_types(column: Column, types) -> Column:
    """None stands for all types, an empty collection for none."""
    if types is None:
        return F.lit(True)
    return column.isin(*sorted(types)) if types else F.lit(False)


@dataclass(frozen=True)
class Graph:
    """nodes: id, type, pos and any of the columns of schema.NODES; edges: source, target, type, pos and any of schema.EDGES.

    pos orders a graph's rows (any orderable type; unique among edges). Of nodes with equal ids the last is the one that edges
    meet; unique_ids says that there are none, which saves a window. Many graphs go into one after `qualified`.
    """

    nodes: DataFrame
    edges: DataFrame
    header: DataFrame | None = None
    unique_ids: bool = False

    def index(self) -> DataFrame:
        """One node per id: the last."""
        if self.unique_ids:
            return self.nodes
        last = Window.partitionBy("id").orderBy(F.col("pos").desc())
        return self.nodes.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")

    def valid_edges(self, edge_types=None) -> DataFrame:
        """Edges of the types whose ends both exist."""
        ids = self.index().select("id")
        edges = self.edges.where(of_types(F.col("type"), edge_types))
        return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")

    def undirected(self, node_types=None, edge_types=None) -> DataFrame:
        """(a, b): neighbours both ways, once each; a self-loop makes a node its own neighbour."""
        ids = self.index().where(of_types(F.col("type"), node_types)).select("id")
        edges = self.edges.where(of_types(F.col("type"), edge_types)).select(F.col("source").alias("a"), F.col("target").alias("b"))
        edges = edges.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
        return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()

    def qualified(self) -> Graph:
        """Ids prefixed by graph_id, so that many graphs can be worked on at once."""
        tag = lambda c: F.concat_ws("/", "graph_id", c)
        nodes = self.nodes.withColumn("id", tag("id"))
        edges = self.edges.withColumns({"source": tag("source"), "target": tag("target"), "pos": F.struct("graph_id", "pos")})
        return replace(self, nodes=nodes.withColumn("pos", F.struct("graph_id", "pos")), edges=edges)


def with_component_reliability(graph: Graph, component_ids: DataFrame, level: str | float, key: str = "counterfactual_reliability") -> Graph:
    """graph with metadata[key] = level (JSON metadata) on the nodes and edges that component_ids (id) names, edges by id or by source->type->target."""
    ids = component_ids.select(F.col("id").alias("named")).distinct().withColumn("hit", F.lit(True))

    def marked(df: DataFrame, names: list[Column]) -> DataFrame:
        out = df
        for i, name in enumerate(names):
            out = out.join(ids.select(F.col("named").alias(f"_n{i}"), F.col("hit").alias(f"_h{i}")), name == F.col(f"_n{i}"), "left")
        hit = F.greatest(*[F.coalesce(f"_h{i}", F.lit(False)) for i in range(len(names))]) if len(names) > 1 else F.coalesce("_h0", F.lit(False))
        old = F.coalesce(F.nullif("metadata", F.lit("")), F.lit("{}")) if "metadata" in df.columns else F.lit("{}")
        return out.withColumn("metadata", F.when(hit, with_field(old, key, level)).otherwise(old)).drop(*[f"_{x}{i}" for i in range(len(names)) for x in "nh"])

    compound = F.concat("source", F.lit("->"), "type", F.lit("->"), "target")
    names = [F.col("id"), compound] if "id" in graph.edges.columns else [compound]
    return replace(graph, nodes=marked(graph.nodes, [F.col("id")]), edges=marked(graph.edges, names))


def edge_ref(df: DataFrame, dated: bool = False) -> Column:
    """What a report says of an edge: its ends, type, confidence and evidence; in temporal reports its id and title instead. Missing columns are null."""
    names = ("id", "source", "target", "type", "title") if dated else ("source", "target", "type", "confidence", "evidence_ids")
    return _ref(df, names)


def node_ref(df: DataFrame) -> Column:
    """What a report says of a node."""
    return _ref(df, ("id", "type", "title", "confidence", "status"))


def _ref(df: DataFrame, names: tuple[str, ...]) -> Column:
    return F.struct(*[(F.col(n) if n in df.columns else F.lit(None)).alias(n) for n in names])


def stance(kind: Column) -> Column:
    return F.when(kind.isin(*SUPPORT), "support").when(kind.isin(*CHALLENGE), "challenge").when(kind.isin(*REVISION), "revision")
