"""Neighbours, reachability, shortest paths and k-hop subgraphs; topological order and cycles are those of ordering.

Every search runs for all start nodes at once: a frontier of (start, node) rows is joined with the edges once a level.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.graph import Graph, of_types
from evigraph.operators.loops import numbered, settle
from evigraph.operators.ordering import cycle_nodes, topological_order

__all__ = ["ancestors", "cycle_nodes", "descendants", "incoming", "k_hop_subgraph", "neighborhood", "outgoing", "reachable", "shortest_paths", "topological_order"]


def incoming(graph: Graph, ids: DataFrame, edge_types=None) -> DataFrame:
    """Edges that end in a node of ids (id), the other end existing or not; none for ids that the graph lacks."""
    known = ids.join(graph.index().select("id"), "id", "left_semi").withColumnRenamed("id", "target")
    return graph.edges.where(of_types(F.col("type"), edge_types)).join(known, "target", "left_semi")


def outgoing(graph: Graph, ids: DataFrame, edge_types=None) -> DataFrame:
    known = ids.join(graph.index().select("id"), "id", "left_semi").withColumnRenamed("id", "source")
    return graph.edges.where(of_types(F.col("type"), edge_types)).join(known, "source", "left_semi")


def neighborhood(graph: Graph, ids: DataFrame, edge_types=None) -> DataFrame:
    """(node_id, direction, neighbor, edge_type, pos): a row per edge at a node of ids whose other end exists."""
    there = graph.index().select(F.col("id").alias("neighbor"))
    into = incoming(graph, ids, edge_types).select(F.col("target").alias("node_id"), F.lit("in").alias("direction"), F.col("source").alias("neighbor"), F.col("type").alias("edge_type"), "pos")
    out = outgoing(graph, ids, edge_types).select(F.col("source").alias("node_id"), F.lit("out").alias("direction"), F.col("target").alias("neighbor"), F.col("type").alias("edge_type"), "pos")
    return into.unionByName(out).join(there, "neighbor", "left_semi")


def _steps(graph: Graph, direction: str, edge_types=None) -> DataFrame:
    edges = graph.valid_edges(edge_types)
    a, b = ("target", "source") if direction == "up" else ("source", "target")
    return settle(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct())


def reachable(graph: Graph, starts: DataFrame, direction: str = "down", edge_types=None, max_depth: int | None = None) -> DataFrame:
    """(start, node, depth) of what can be reached from the ids of starts, themselves left out; starts that do not exist reach nothing.

    direction: down follows edges, up goes against them, both ignores their direction. Depth is that of the first visit.
    """
    steps = settle(graph.undirected(edge_types=edge_types)) if direction == "both" else _steps(graph, direction, edge_types)
    there = starts.select("id").distinct().join(graph.index().select("id"), "id", "left_semi")
    seen = settle(there.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("depth")))
    frontier, depth = seen, 0
    parts = [seen]
    while max_depth is None or depth < max_depth:
        depth += 1
        found = frontier.join(steps, F.col("node") == F.col("a")).select("start", F.col("b").alias("node")).distinct()
        frontier = settle(found.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        parts.append(frontier)
        seen = seen.unionByName(frontier)
        if len(parts) % 16 == 0:
            seen = settle(seen)
    return seen.where("depth > 0")


def descendants(graph: Graph, starts: DataFrame, edge_types=None) -> DataFrame:
    return reachable(graph, starts, "down", edge_types)


def ancestors(graph: Graph, starts: DataFrame, edge_types=None) -> DataFrame:
    return reachable(graph, starts, "up", edge_types)


def shortest_paths(graph: Graph, pairs: DataFrame, edge_types=None) -> DataFrame:
    """(source, target, path) for each pair: of the paths with the fewest edges the one that is least as a list of ids.

    An empty path where there is none or an end is missing; [s] from a node to itself. Rows of the search hold no paths: a node's rank
    orders the least paths to the nodes of its level, as (rank of the parent, id) does; parents are kept level by level, and paths are put
    together backwards for the pairs alone.
    """
    steps = _steps(graph, "down", edge_types)
    ids = graph.index().select("id")
    asked = settle(pairs.select("source", "target").distinct())
    open_ = settle(asked.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi"))
    frontier = settle(open_.select("source").distinct().select("source", F.col("source").alias("node"), F.lit(0).cast("long").alias("rank"), F.lit(None).cast("string").alias("parent")))
    seen, levels, hits = frontier.select("source", "node"), [frontier], []
    while True:
        reached = frontier.select("source", F.col("node").alias("target"), F.lit(True).alias("hit"))
        sorted_out = settle(open_.select("source", "target").join(reached, ["source", "target"], "left"))
        hits.append(sorted_out.where("hit"))
        open_ = sorted_out.where("hit IS NULL")
        if open_.isEmpty():
            break
        live = frontier.join(open_.select("source").distinct(), "source", "left_semi")
        step = live.join(steps, F.col("node") == F.col("a")).select("source", F.col("b").alias("node"), F.struct(F.col("rank"), F.col("node").alias("parent")).alias("by"))
        step = step.join(seen, ["source", "node"], "left_anti")
        best = step.groupBy("source", "node").agg(F.min("by").alias("by")).select("source", "node", F.col("by.rank").alias("after"), F.col("by.parent").alias("parent"))
        ranked = numbered(best, ["source", "after", "node"], "rank")
        if not ranked.rows:
            break
        frontier = ranked.select("source", "node", "rank", "parent")
        levels.append(frontier)
        seen = seen.unionByName(frontier.select("source", "node"))
        if len(levels) % 16 == 0:
            seen = settle(seen)  # one table again, so plans stay short
    # backwards: a path joins the parents of its level, and those that end at a level come in there
    paths = None
    for depth in range(len(hits) - 1, -1, -1):
        found = hits[depth].select("source", "target", F.col("target").alias("node"), F.array("target").alias("path"))
        paths = found if paths is None else paths.unionByName(found)
        if depth:
            up = levels[depth].select("source", "node", "parent")
            paths = paths.join(up, ["source", "node"]).select("source", "target", F.col("parent").alias("node"), F.concat(F.array("parent"), "path").alias("path"))
            paths = settle(paths) if depth % 8 == 0 else paths
    return asked.join(paths.select("source", "target", "path"), ["source", "target"], "left").withColumn("path", F.coalesce("path", F.array().cast("array<string>")))


def k_hop_subgraph(graph: Graph, seeds: DataFrame, hops: int = 1, edge_types=None) -> Graph:
    """Nodes within hops edges of a seed, whatever their direction, and the edges (of the types) among them.

    The header, where there is one, gets the id of a subgraph, a description, and the seeds and hops in its metadata.
    """
    near = reachable(graph, seeds, "both", edge_types, max_depth=hops).select(F.col("node").alias("id"))
    kept = settle(near.unionByName(seeds.select("id").join(graph.index().select("id"), "id", "left_semi")).distinct())
    nodes = graph.nodes.join(kept, "id", "left_semi")
    edges = graph.edges.where(of_types(F.col("type"), edge_types))
    edges = edges.join(kept.withColumnRenamed("id", "source"), "source", "left_semi").join(kept.withColumnRenamed("id", "target"), "target", "left_semi")
    return Graph(nodes, edges, _subgraph_header(graph.header, seeds, hops), graph.unique_ids)


def _subgraph_header(header: DataFrame | None, seeds: DataFrame, hops: int) -> DataFrame | None:
    if header is None:
        return None
    asked = [r["id"] for r in seeds.select("id").collect()]  # the seeds are the caller's own list
    own = F.coalesce(F.nullif("graph_id", F.lit("")), F.lit(""))
    made = {"graph_id": F.when(own == "", "subgraph").otherwise(F.concat(own, F.lit(":subgraph"))), "description": F.lit(f"{hops}-hop subgraph")}
    more = json.dumps({"subgraph_seeds": asked, "subgraph_hops": hops}, separators=(",", ":"))
    if "metadata" in header.columns:
        rest = F.regexp_replace(F.coalesce(F.nullif("metadata", F.lit("")), F.lit("{}")), r"\}\s*$", "")
        made["metadata"] = F.concat(rest, F.when(F.trim(rest) == "{", "").otherwise(","), F.lit(more[1:]))
    return header.withColumns(made)
