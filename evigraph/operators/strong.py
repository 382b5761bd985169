"""Strongly connected components, and tests of reachability that build no closure.

Components: what lies on no cycle is taken off first, from both ends: a few times all nodes without predecessors or successors, then, if there are still
some, by the order (ordering contracts chains, so depth doesn't matter there). Of the rest every node takes the least id that reaches it; a node takes the id of its id too, so labels travel in jumps. Among the nodes of one
label the least id that a node reaches is found the same way against the edges; where both are the same, the node is in the component of
that id. Components so found go, as do edges between labels, and the rest is labelled again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.graph import Graph, of_types
from evigraph.operators.loops import discard, joined_by_size, settle
from evigraph.operators.ordering import topological_order


def _least_along(edges: DataFrame, start: str, end: str) -> DataFrame:
    """(id, label): the least id from which edges lead (start to end) to each id that edges name, itself included. Settled."""
    ids = edges.select(F.col(start).alias("id")).unionByName(edges.select(F.col(end).alias("id"))).distinct()
    labels = settle(ids.select("id", F.col("id").alias("label")))
    while True:
        known = labels.select(F.col("id").alias("at"), F.col("label").alias("far"))
        told = edges.join(known, F.col(start) == F.col("at")).select(F.col(end).alias("id"), F.col("far").alias("label"), F.lit(None).cast("string").alias("old"))
        jumped = labels.join(known, F.col("label") == F.col("at")).select("id", F.col("far").alias("label"), F.col("label").alias("old"))
        new = settle(told.unionByName(jumped).groupBy("id").agg(F.min("label").alias("label"), F.max("old").alias("old")).withColumn("moved", F.col("label") != F.col("old")).drop("old"))
        discard(labels)
        labels = new
        if labels.where("moved").isEmpty():
            return labels


#: Rounds in which nodes without predecessors or successors are taken off before the order is looked for.
TRIMS = 8


def _trimmed(edges: DataFrame) -> DataFrame | None:
    """edges (a, b) between nodes that are on a cycle or between cycles, or None if TRIMS rounds have not come to an end. Settled."""
    n, left = edges.count(), edges
    for _ in range(TRIMS):
        new = settle(left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi"))
        if left is not edges:
            discard(left)
        left, before, n = new, n, new.count()
        if n in (0, before):
            return left
    discard(left)
    return None


def strong_components(graph: Graph, edge_types=None, node_types=None) -> DataFrame:
    """(id, component) of every node: the least id of its strongly connected component. Settled.

    Edges whose ends don't both exist and self-loops change nothing; a node on no cycle is its own component.
    """
    with joined_by_size(graph.nodes.sparkSession):
        return _components(graph, edge_types, node_types)


def _components(graph: Graph, edge_types, node_types) -> DataFrame:
    ids = settle(graph.index().where(of_types(F.col("type"), node_types)).select("id").distinct())
    edges = graph.edges.where(of_types(F.col("type"), edge_types) & (F.col("source") != F.col("target"))).select(F.col("source").alias("a"), F.col("target").alias("b")).distinct()
    edges = settle(edges.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi"))
    live, cyclic, spent = _trimmed(edges), None, [ids]
    if live is None:
        nodes = ids.select("id", F.lit("").alias("type"), F.col("id").alias("pos"))
        there, back = (topological_order(Graph(nodes, edges.select(F.col(a).alias("source"), F.col(b).alias("target"), F.lit("").alias("type"), F.lit(0).alias("pos")), unique_ids=True))[1] for a, b in (("a", "b"), ("b", "a")))
        cyclic = settle(there.join(back, "id", "left_semi"))  # between cycles or on one
        live = settle(edges.join(cyclic.withColumnRenamed("id", "a"), "a", "left_semi").join(cyclic.withColumnRenamed("id", "b"), "b", "left_semi"))
        spent.append(cyclic)
    found = None
    spent.append(edges)
    while not live.isEmpty():
        down = _least_along(live, "a", "b")
        for end in ("a", "b"):
            live = live.join(down.select(F.col("id").alias(end), F.col("label").alias(f"l{end}")), end)
        same = settle(live.where("la = lb").select("a", "b", F.col("la").alias("label")))
        up = _least_along(same, "b", "a")
        done = settle(up.withColumnRenamed("label", "reached").join(down.select("id", "label"), "id").where("reached = label").select("id", F.col("label").alias("component")))
        found = done if found is None else found.unionByName(done)
        left = same.select("a", "b").join(done.select(F.col("id").alias("a")), "a", "left_anti").join(done.select(F.col("id").alias("b")), "b", "left_anti")
        live = settle(left)
        spent += [down, same, up]
    if found is None:
        found = ids.limit(0).select("id", F.col("id").alias("component"))
    out = settle(ids.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component")))
    discard(*spent)
    return out


def reaches(graph: Graph, pairs: DataFrame, edge_types=None) -> DataFrame:
    """(source, target, reaches) of each pair (source, target): whether edges lead from one to the other; a node that exists reaches itself.

    Components are contracted, and what is left has an order from both sides: a node can only reach what is on a later level
    than itself in both. Pairs that this doesn't decide are searched level by level, through nodes alone that it still allows for their target.
    """
    with joined_by_size(graph.nodes.sparkSession):
        return _reaches(graph, pairs, edge_types)


def _reaches(graph: Graph, pairs: DataFrame, edge_types) -> DataFrame:
    components = strong_components(graph, edge_types)
    named = lambda name: components.select(F.col("id").alias(name), F.col("component").alias(f"c_{name}"))
    asked = settle(pairs.select("source", "target").distinct())
    known = asked.join(named("source"), "source").join(named("target"), "target")
    between = graph.edges.where(of_types(F.col("type"), edge_types)).select("source", "target").join(named("source"), "source").join(named("target"), "target")
    steps = settle(between.where("c_source != c_target").select(F.col("c_source").alias("a"), F.col("c_target").alias("b")).distinct())
    whole = components.select(F.col("component").alias("id")).distinct().select("id", F.lit("").alias("type"), F.col("id").alias("pos"))
    levels = [topological_order(Graph(whole, steps.select(F.col(a).alias("source"), F.col(b).alias("target"), F.lit("").alias("type"), F.lit(0).alias("pos")), unique_ids=True))[0] for a, b in (("a", "b"), ("b", "a"))]
    label = settle(levels[0].select("id", F.col("level").alias("down")).join(levels[1].select("id", F.col("level").alias("up")), "id"))
    at = lambda name, d, u: label.select(F.col("id").alias(name), F.col("down").alias(d), F.col("up").alias(u))
    todo = known.select("c_source", "c_target").distinct().join(at("c_source", "d0", "u0"), "c_source").join(at("c_target", "d1", "u1"), "c_target")
    open_ = settle(todo.where("c_source != c_target AND d0 < d1 AND u0 > u1").select("c_source", "c_target", F.col("c_source").alias("node"), "d1", "u1"))
    hits, seen = todo.where("c_source = c_target").select("c_source", "c_target"), open_.select("c_source", "c_target", "node")
    rounds = [open_]
    while not open_.isEmpty():
        step = open_.join(steps, F.col("node") == F.col("a")).select("c_source", "c_target", F.col("b").alias("node"), "d1", "u1").distinct()
        near = settle(step.join(at("node", "d", "u"), "node").where("node = c_target OR (d < d1 AND u > u1)").join(seen, ["c_source", "c_target", "node"], "left_anti"))
        hit = near.where("node = c_target").select("c_source", "c_target")
        hits = hits.unionByName(hit)
        open_ = settle(near.join(hit, ["c_source", "c_target"], "left_anti").select("c_source", "c_target", "node", "d1", "u1"))
        seen = seen.unionByName(open_.select("c_source", "c_target", "node"))
        rounds.append(open_)
        if len(rounds) % 16 == 0:
            seen, hits = settle(seen), settle(hits)
    reached = known.join(hits.distinct().withColumn("hit", F.lit(True)), ["c_source", "c_target"]).select("source", "target", "hit")
    return settle(asked.join(reached, ["source", "target"], "left").select("source", "target", F.coalesce("hit", F.lit(False)).alias("reaches")))
