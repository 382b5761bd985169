"""Components, cut vertices, degrees, diagnostics and quality counts of a graph."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.graph import Graph, of_types
from evigraph.operators import biconnected
from evigraph.operators.loops import connected, discard, numbered, settle


def component_labels(graph: Graph, node_types=None) -> DataFrame:
    """(id, component): the least id of each undirected component, isolated nodes included. Settled."""
    ids = numbered(graph.index().where(of_types(F.col("type"), node_types)).select("id").distinct(), ["id"], "n")
    edges = graph.edges.where("source != target").select("source", "target")
    for end in ("source", "target"):  # only edges whose ends both exist find their numbers
        edges = edges.join(ids.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}")), end)
    labels = connected(edges.select(F.col("n_source").alias("a"), F.col("n_target").alias("b")))
    found = ids.join(labels.select(F.col("id").alias("n"), "label"), "n", "left").select("id", F.coalesce("label", "n").alias("label"))
    out = settle(found.join(ids.select(F.col("n").alias("label"), F.col("id").alias("component")), "label").select("id", "component"))
    discard(labels, ids)
    return out


def component_sizes(graph: Graph, node_types=None) -> DataFrame:
    """(component, size)."""
    return component_labels(graph, node_types).groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def connected_components(graph: Graph, node_types=None) -> DataFrame:
    """(component, size, ids): ids in order. Order by size descending, ids ascending to list them.

    A list holds a whole component, so this is for components that fit in a row; component_labels and component_sizes have no such bound.
    """
    labels = component_labels(graph, node_types)
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list("id")).alias("ids"))


def _cut_vertices(order: list[str], pairs: list[tuple[str, str]]) -> list[tuple[str, int, int]]:
    """(node, component size, size after removal of the part with the least remaining id) of one component, by depth-first search.

    order: its ids in order; pairs: neighbours, both ways.
    """
    number = {v: i for i, v in enumerate(order)}
    near: list[list[int]] = [[] for _ in order]
    for a, b in pairs:
        near[number[a]].append(number[b])
    n = len(order)
    seen, reach, size, parent = [-1] * n, [0] * n, [1] * n, [-1] * n
    cut_size: dict[int, int] = {}  # nodes that a non-root cut vertex separates from the root's part
    holder: dict[int, int] = {}
    clock, branches, stack = 0, 0, [(0, iter(near[0]))]
    seen[0] = reach[0] = clock
    branch_of = [-1] * n
    while stack:
        v, rest = stack[-1]
        w = next(rest, None)
        if w is None:
            stack.pop()
            if (p := parent[v]) >= 0:
                reach[p] = min(reach[p], reach[v])
                size[p] += size[v]
                if p != 0 and reach[v] >= seen[p]:
                    cut_size[p] = cut_size.get(p, 0) + size[v]
                if p == 0:
                    holder[branch_of[v]] = size[v]
        elif seen[w] < 0:
            clock += 1
            parent[w], seen[w], reach[w] = v, clock, clock
            if v == 0:
                branches += 1
                branch_of[w] = branches
            else:
                branch_of[w] = branch_of[v]
            stack.append((w, iter(near[w])))
        elif w != parent[v]:
            reach[v] = min(reach[v], seen[w])
    out = [(order[v], n, n - 1 - s) for v, s in cut_size.items()]
    if branches > 1:
        out.append((order[0], n, holder[branch_of[1]]))
    return out


#: Directed pairs of neighbours of a component that one task searches, at most: some 100 MB. Larger components are taken apart in parallel.
SEARCH_PAIRS = 400_000


def bridge_nodes(graph: Graph, node_types=None, labels: DataFrame | None = None, search_pairs: int = SEARCH_PAIRS) -> DataFrame:
    """(node_id, component_size, reachable_after_removal) of the cut vertices of components of three or more nodes.

    Components of up to search_pairs pairs are searched in a task each, dealt by their label; for larger ones blocks are found by
    joins over all of their edges (biconnected.cut_vertices), whatever their size. labels: those of component_labels, where they are known already.
    """
    labels = component_labels(graph, node_types) if labels is None else labels
    near = settle(graph.undirected(node_types).where("a != b").join(labels.withColumnRenamed("id", "a"), "a").select("component", "a", "b"))
    sizes = settle(near.groupBy("component").agg(F.count(F.lit(1)).alias("pairs")))
    large = sizes.where((F.col("pairs") > search_pairs) & (F.col("pairs") > 2)).select("component")
    found = _searched(near.join(sizes.where(F.col("pairs") <= search_pairs).select("component"), "component", "left_semi"))
    if large.isEmpty():
        return found
    return found.unionByName(biconnected.cut_vertices(labels.join(large, "component", "left_semi"), near.join(large, "component", "left_semi").where("a < b")))


def _searched(near: DataFrame) -> DataFrame:
    """Cut vertices of components of (component, a, b), pairs both ways, each by search in a task."""

    def search(group: pa.Table) -> pa.Table:
        a, b = group.column("a").to_pylist(), group.column("b").to_pylist()
        ids = set(a)
        found = _cut_vertices(sorted(ids), list(zip(a, b, strict=True))) if len(ids) > 2 else []
        return pa.table({"node_id": pa.array([x[0] for x in found], pa.string()), "component_size": pa.array([x[1] for x in found], pa.int64()), "reachable_after_removal": pa.array([x[2] for x in found], pa.int64())})

    return near.groupBy("component").applyInArrow(search, "node_id string, component_size long, reachable_after_removal long")


def degrees(graph: Graph, node_types=None) -> DataFrame:
    """(id, type, degree, in_degree, out_degree): degree counts distinct neighbours, the others every edge."""
    nodes = graph.index().where(of_types(F.col("type"), node_types)).select("id", "type")
    ids = nodes.select("id")
    edges = graph.edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    near = graph.undirected(node_types).groupBy("a").agg(F.count(F.lit(1)).alias("degree")).withColumnRenamed("a", "id")
    into = edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    out = edges.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    joined = nodes.join(near, "id", "left").join(into, "id", "left").join(out, "id", "left")
    return joined.select("id", "type", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("degree", "in_degree", "out_degree")])


def top_degrees(graph: Graph, n: int = 10, node_types=None) -> DataFrame:
    return degrees(graph, node_types).orderBy(F.desc("degree"), F.desc("in_degree"), "id").limit(n)


def diagnostics_summary(graph: Graph, node_types=None) -> DataFrame:
    """One row: counts of nodes, edges among them, components, the largest of these, isolated nodes and cut vertices."""
    ids = graph.index().where(of_types(F.col("type"), node_types)).select("id")
    edges = graph.edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    labels = component_labels(graph, node_types)
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    shape = sizes.agg(F.count(F.lit(1)).alias("component_count"), F.coalesce(F.max("size"), F.lit(0)).alias("largest_component_size"), F.coalesce(F.sum("size"), F.lit(0)).alias("node_count"))
    lonely = degrees(graph, node_types).where("degree = 0").agg(F.count(F.lit(1)).alias("isolated_node_count"))
    cut = bridge_nodes(graph, node_types, labels).agg(F.count(F.lit(1)).alias("bridge_node_count"))
    parts = edges.agg(F.count(F.lit(1)).alias("edge_count"))
    return shape.crossJoin(parts).crossJoin(lonely).crossJoin(cut)  # one row each


def duplicate_node_ids(graph: Graph) -> DataFrame:
    return graph.nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")


def missing_endpoints(graph: Graph) -> DataFrame:
    """Edges with an end that no node has."""
    ids = graph.nodes.select("id").distinct()
    no_source = graph.edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti")
    rest = graph.edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    return no_source.unionByName(rest.join(ids.withColumnRenamed("id", "target"), "target", "left_anti"))


def weak_edges(graph: Graph, below: float = 0.5) -> DataFrame:
    return graph.edges.where(F.col("confidence") < below)


def _uncited(edges: DataFrame):
    """No provenance and no evidence ids; columns that a table lacks count as empty."""
    out = F.lit(True)
    for name in ("provenance", "evidence_ids"):
        if name in edges.columns:
            out = out & (F.coalesce(F.size(name), F.lit(0)) <= 0)
    return out


def missing_provenance(graph: Graph, edge_types) -> DataFrame:
    return graph.edges.where(of_types(F.col("type"), edge_types) & _uncited(graph.edges))


def qa_summary(graph: Graph, provenance_edge_types=()) -> DataFrame:
    """One row of counts."""
    edges = graph.edges.agg(
        F.count(F.lit(1)).alias("edge_count"),
        F.count_if(F.col("confidence") < 0.5).alias("weak_edge_count"),
        F.count_if(of_types(F.col("type"), provenance_edge_types) & _uncited(graph.edges)).alias("missing_provenance_count"),
    )
    per_id = graph.nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    nodes = per_id.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("node_count"), F.count_if(F.col("n") > 1).alias("duplicate_node_id_count"))
    lost = missing_endpoints(graph).agg(F.count(F.lit(1)).alias("missing_endpoint_count"))
    return nodes.crossJoin(edges).crossJoin(lost)  # one row each


def type_counts(graph: Graph) -> DataFrame:
    """(component, type, n) for nodes and edges."""
    nodes = graph.nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("component"), "type", "n")
    return nodes.unionByName(graph.edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("component"), "type", "n"))

