"""Cut vertices and diagnostics of the whole supply graph against brute force."""

from evigraph.plans import catalog
from evigraph.plans import projections as P


def test_customers_count(spark, sf_dir):
    graph = P.supply(spark, sf_dir)
    near = {r["id"]: set() for r in graph.nodes.select("id").collect()}
    edges = [(r["source"], r["target"]) for r in graph.edges.select("source", "target").collect()]
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)

    def reach(start, without=None):
        seen, todo = {start}, [start]
        while todo:
            new = near[todo.pop()] - seen - {without}
            seen |= new
            todo += new
        return seen

    want = []
    for v in near:
        whole = reach(v)
        if len(whole) > 2:
            left = len(reach(min(whole - {v}), v))
            want += [(v, len(whole), left)] * (left < len(whole) - 1)
    assert any(n.startswith("customer") for n in near)
    assert sorted(tuple(r) for r in catalog.queries()["cut_vertices"](spark, sf_dir).select("node_id", "component_size", "reachable_after_removal").collect()) == sorted(want)
    row = catalog.queries()["diagnostics_summary"](spark, sf_dir).first()
    assert (row["node_count"], row["edge_count"], row["bridge_node_count"]) == (len(near), len(edges), len(want))
