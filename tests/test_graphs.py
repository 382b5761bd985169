"""Traversal and structure against brute force on seeded random graphs, and small goldens."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from evigraph.graph import Graph
from evigraph.operators import biconnected, strong, structure, traversal
from evigraph.operators.structure import _cut_vertices
from evigraph.sources import synthetic


def graph_of(spark, nodes, edges):
    n = spark.createDataFrame([(x, "concept", i) for i, x in enumerate(nodes)], "id string, type string, pos long")
    e = spark.createDataFrame([(a, b, "related", i) for i, (a, b) in enumerate(edges)], "source string, target string, type string, pos long")
    return Graph(n, e)


def ids(spark, *names):
    return spark.createDataFrame([(x,) for x in names], "id string")


def parts(nodes, pairs):
    left, out = set(nodes), []
    near = {v: set() for v in nodes}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    while left:
        queue, seen = deque([min(left)]), {min(left)}
        while queue:
            for w in near[queue.popleft()] - seen:
                seen.add(w)
                queue.append(w)
        out.append(seen)
        left -= seen
    return out


@pytest.mark.parametrize("seed", range(60))
def test_cut_vertices_against_removal(seed):
    r = random.Random(seed)
    nodes = [f"n{i}" for i in range(r.randint(3, 9))]
    pairs = {tuple(sorted(r.sample(nodes, 2))) for _ in range(r.randint(2, 12))}
    for part in parts(nodes, pairs):
        if len(part) < 3:
            continue
        inside = [p for p in pairs if p[0] in part]
        want = []
        for v in part:
            rest = parts(part - {v}, [p for p in inside if v not in p])
            if len(rest) > 1:
                want.append((v, len(part), len(next(x for x in rest if min(part - {v}) in x))))
        both = [*inside, *[(b, a) for a, b in inside]]
        assert sorted(_cut_vertices(sorted(part), both)) == sorted(want)


def test_cut_vertices_of_a_path(spark):
    found = structure.bridge_nodes(graph_of(spark, "abcde", ["ab", "bc", "cd", "de"])).orderBy("node_id").collect()
    assert [(r["node_id"], r["component_size"], r["reachable_after_removal"]) for r in found] == [("b", 5, 1), ("c", 5, 2), ("d", 5, 3)]


@pytest.mark.parametrize("seed", range(3))
def test_searches_against_brute_force(spark, seed):
    r = random.Random(seed)
    nodes = [f"n{i}" for i in range(9)]
    edges = [(r.choice(nodes), r.choice(nodes)) for _ in range(14)] + [("n0", "missing")]
    graph = graph_of(spark, nodes, edges)
    out = {v: sorted({b for a, b in edges if a == v and b in nodes}) for v in nodes}

    def shortest(s, t):
        queue, paths = deque([s]), {s: [s]}
        while queue:
            v = queue.popleft()
            for w in out[v]:
                if w not in paths:
                    paths[w] = paths[v] + [w]
                    queue.append(w)
        return paths.get(t, [])

    pairs = [(a, b) for a in nodes[:4] for b in nodes] + [("missing", "n0")]
    got = traversal.shortest_paths(graph, spark.createDataFrame(pairs, "source string, target string")).collect()
    assert {(x["source"], x["target"]): x["path"] for x in got} == {(a, b): shortest(a, b) if a in nodes else [] for a, b in pairs}
    reach = traversal.descendants(graph, ids(spark, *nodes, "missing")).collect()
    assert {(x["start"], x["node"]) for x in reach} == {(a, b) for a in nodes for b in nodes if a != b and shortest(a, b)}
    labels = {x["id"]: x["component"] for x in structure.component_labels(graph).collect()}
    assert labels == {v: min(p) for p in parts(nodes, [e for e in edges if e[1] in nodes]) for v in p}


def kahn(nodes, edges):
    succ = {v: sorted({b for a, b in edges if a == v}) for v in nodes}
    need = {v: len({a for a, b in edges if b == v}) for v in nodes}
    queue, out = deque(sorted(v for v in nodes if not need[v])), []
    while queue:
        v = queue.popleft()
        out.append(v)
        for w in succ[v]:
            need[w] -= 1
            if not need[w]:
                queue.append(w)
    return out, sorted(set(nodes) - set(out))


@pytest.mark.parametrize("seed", range(3))
def test_topological_order(spark, seed):
    r = random.Random(seed + 50)
    nodes = [f"n{i}" for i in range(8)]
    edges = [tuple(sorted(r.sample(nodes, 2))) for _ in range(10)] + ([("n7", "n6"), ("n6", "n7")] if seed == 2 else [])
    order, left = traversal.topological_order(graph_of(spark, nodes, edges))
    want, rest = kahn(nodes, edges)
    assert [x["id"] for x in order.orderBy("place").collect()] == want
    assert sorted(x["id"] for x in left.collect()) == rest


@pytest.mark.parametrize("seed", (0, 3))
def test_order_of_runs_equals_step_by_step(spark, seed):
    """Chains of many lengths that begin, meet, wait for each other and end; rings; branches."""
    r = random.Random(seed)
    nodes = [f"n{i:03d}" for i in range(90)]
    r.shuffle(nodes)
    edges, at = set(), 0
    stops = [nodes[i] for i in range(12)]
    at = 12
    for _ in range(16):
        a, b = sorted(r.sample(range(12), 2))
        run = nodes[at : at + r.randrange(0, 6)]
        at += len(run)
        whole = [stops[a], *run, stops[b]]
        edges |= set(zip(whole, whole[1:], strict=False))
    ring = nodes[at : at + 4]
    edges |= set(zip(ring, [*ring[1:], ring[0]], strict=True)) if seed % 2 else set()
    if seed == 3:
        edges |= {(ring[0], nodes[-1]), (nodes[-1], nodes[-2])}
    order, left = traversal.topological_order(graph_of(spark, nodes, sorted(edges)))
    want, rest = kahn(nodes, edges)
    rows = order.orderBy("place").collect()
    assert [x["id"] for x in rows] == want and [x["place"] for x in rows] == list(range(len(want)))
    depth = {}
    for v in want:
        depth[v] = max((depth[a] + 1 for a, b in edges if b == v), default=0)
    assert {x["id"]: x["level"] for x in rows} == depth
    assert sorted(x["id"] for x in left.collect()) == rest


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    from evigraph.operators import loops, ordering

    rounds = []
    monkeypatch.setattr(ordering, "settle", lambda df: rounds.append(1) or loops.settle(df))
    monkeypatch.setattr(ordering, "numbered", lambda *a, **k: rounds.append(1) or loops.numbered(*a, **k))
    order, left = traversal.topological_order(synthetic.path(spark, 50_000))
    assert order.where("place != level").isEmpty() and order.count() == 50_000 and left.isEmpty()
    assert len(rounds) < 40


def test_paths_of_equal_length_go_by_ids(spark):
    """Many shortest paths: the least list of ids, found without carrying lists."""
    rows = [[f"{c}{k}" for c in "abcd"] for k in range(4)]
    edges = [("s", v) for v in rows[0]] + [(a, b) for x, y in zip(rows, rows[1:], strict=False) for i, a in enumerate(x) for j, b in enumerate(y) if (i, j) != (0, 0)] + [(v, "t") for v in rows[-1] if v != "a3"]
    graph = graph_of(spark, ["s", "t", *sum(rows, [])], edges)
    pairs = spark.createDataFrame([("s", "t"), ("t", "s"), ("s", "d3"), ("s", "s")], "source string, target string")
    got = {(r["source"], r["target"]): r["path"] for r in traversal.shortest_paths(graph, pairs).collect()}
    assert got == {("s", "t"): ["s", "a0", "b1", "a2", "b3", "t"], ("t", "s"): [], ("s", "d3"): ["s", "a0", "b1", "a2", "d3"], ("s", "s"): ["s"]}


def test_strong_components_and_reach(spark):
    r = random.Random(7)
    nodes = [f"n{i:02d}" for i in range(15)]
    r.shuffle(nodes)
    edges = {(r.choice(nodes), r.choice(nodes)) for _ in range(12)} | {(nodes[10 + i], nodes[10 + (i + 1) % 5]) for i in range(5)} | {(nodes[3], nodes[4]), (nodes[4], nodes[3]), ("n00", "gone")}
    out = {v: {b for a, b in edges if a == v and b in nodes} for v in nodes}

    def reach(v):
        seen, todo = {v}, [v]
        while todo:
            new = out[todo.pop()] - seen
            seen |= new
            todo += new
        return seen

    whole = {v: reach(v) for v in nodes}
    graph = graph_of(spark, nodes, sorted(edges))
    got = {x["id"]: x["component"] for x in strong.strong_components(graph).collect()}
    assert got == {v: min(w for w in whole[v] if v in whole[w]) for v in nodes}
    assert len(set(got.values())) < 11
    pairs = [(a, b) for a in nodes[::2] for b in nodes] + [("gone", "n00"), ("n00", "gone")]
    asked = spark.createDataFrame(pairs, "source string, target string")
    assert {(x["source"], x["target"]): x["reaches"] for x in strong.reaches(graph, asked).collect()} == {(a, b): a in whole and b in whole[a] for a, b in pairs}


def test_index_edge_cases(spark):
    nodes = spark.createDataFrame([("a", "concept", "old", 0), ("b", "claim", "", 1), ("a", "claim", "new", 2)], "id string, type string, title string, pos long")
    edges = spark.createDataFrame([("a", "a", "related", 0), ("a", "gone", "related", 1), ("b", "a", "related", 2)], "source string, target string, type string, pos long")
    graph = Graph(nodes, edges)
    assert graph.index().where("id = 'a'").first()["title"] == "new"
    assert structure.duplicate_node_ids(graph).collect()[0]["id"] == "a"
    assert structure.missing_endpoints(graph).count() == 1
    assert traversal.outgoing(graph, ids(spark, "a")).count() == 2
    assert traversal.outgoing(graph, ids(spark, "gone")).count() == 0
    assert traversal.incoming(graph, ids(spark, "a"), set()).count() == 0
    top = {r["id"]: (r["degree"], r["in_degree"], r["out_degree"]) for r in structure.degrees(graph).collect()}
    assert top == {"a": (2, 2, 1), "b": (1, 0, 1)}


def test_k_hop_and_components_of_a_star(spark):
    star = synthetic.star(spark, 20)
    first = star.nodes.orderBy("pos").select("id").limit(1)
    assert traversal.k_hop_subgraph(star, first, 1).nodes.count() == 20
    assert structure.connected_components(synthetic.blocks(spark, 23)).where(F.col("size") == 5).count() == 4
    assert traversal.cycle_nodes(synthetic.cycle(spark, 6)).count() == 6
    assert structure.component_labels(synthetic.path(spark, 100)).select("component").distinct().count() == 1


@pytest.mark.parametrize("seed", range(1))
def test_cut_vertices_by_blocks(spark, seed):
    """Trees, cycles with trees on them, denser parts and a hub, all in parallel, against the search in a task."""
    r = random.Random(seed)
    names = [f"n{i:03d}" for i in range(110)]
    r.shuffle(names)
    links = {(i, r.randrange(max(0, i - 6), i)) for i in range(1, 30)}  # a tree
    links |= {(30 + i, 30 + (i + 1) % 8) for i in range(8)} | {(38 + i, 30 + r.randrange(8 + i)) for i in range(22)}  # a cycle with trees
    links |= {(60 + r.randrange(25), 60 + r.randrange(25)) for _ in range(30)} | {(88, 89)}
    links |= {(90, i) for i in range(91, 110)} | {(91, 92), (92, 93), (95, 96)}
    nodes = spark.createDataFrame([(n, "x", n) for n in names], "id string, type string, pos string")
    edges = spark.createDataFrame([(names[a], names[b], "e", f"{a}-{b}") for a, b in links], "source string, target string, type string, pos string")
    graph = Graph(nodes, edges, unique_ids=True)
    searched, taken_apart = (sorted(tuple(x) for x in structure.bridge_nodes(graph, search_pairs=above).collect()) for above in (10**6, 0))
    assert taken_apart == searched and len(searched) > 20


def test_cut_vertices_of_a_long_path_and_a_cycle(spark):
    path = [tuple(r) for r in structure.bridge_nodes(synthetic.path(spark, 300), search_pairs=0).collect()]
    assert len(path) == 298 and {(size, left) for _, size, left in path} == {(300, k) for k in range(1, 299)}
    assert structure.bridge_nodes(synthetic.cycle(spark, 50), search_pairs=0).count() == 0
    assert [r["reachable_after_removal"] for r in structure.bridge_nodes(synthetic.star(spark, 40), search_pairs=0).collect()] == [1]


def test_forests_ranks_and_intervals(spark):
    r = random.Random(2)
    pairs = sorted({tuple(sorted(r.sample(range(200), 2))) for _ in range(260)})
    df = spark.createDataFrame(pairs, "x long, y long")
    forest = [tuple(x) for x in biconnected.spanning_forest(df).collect()]
    touched = sorted({v for p in pairs for v in p})
    assert set(forest) <= set(pairs) and len(forest) == len(touched) - len(parts(touched, pairs)) and len(parts(touched, forest)) == len(parts(touched, pairs))
    order = list(range(77))
    r.shuffle(order)
    links = spark.createDataFrame([(a, b) for a, b in zip(order, [*order[1:], None], strict=True)], "k long, succ long")
    assert {x["k"]: x["d"] for x in biconnected.ranked(links).collect()} == {k: 76 - i for i, k in enumerate(order)}
    spans = [(i, 3 * i, r.randrange(3 * i, 600), r.randrange(1000), r.randrange(1000)) for i in range(200)]
    got = biconnected.interval_extremes(spark.createDataFrame(spans, "v long, first long, last long, lo long, hi long")).collect()
    inside = lambda a, b, c: [s[c] for s in spans if a <= s[1] <= b]
    assert {(x["v"], x["low"], x["high"]) for x in got} == {(v, min(inside(a, b, 3)), max(inside(a, b, 4))) for v, a, b, _, _ in spans}
