"""Cut vertices of large components in parallel: no step has a component, a node's edges or a path in one task.

A spanning forest grows by contraction (each part takes its least edge to another part). Its Euler tour, the arcs of all trees in one list, is ranked by
pointer jumping; the places of the two arcs of a tree edge then tell parents from children, and a subtree is an
interval of places. The least and greatest place that a subtree reaches by an edge outside the forest come from minima over dyadic intervals.
Tree edges that these show to lie on a common cycle are linked; the components of these links are the blocks (biconnected
components), and a node whose tree edges are in several blocks is a cut vertex.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.operators.loops import connected, discard, numbered, roots, settle


def spanning_forest(pairs: DataFrame) -> DataFrame:
    """(x, y): the edges of a spanning forest of pairs (x < y, each once). Settled.

    Edges are ordered by their ends, so every part's least edge to another part belongs to one and the same forest; the parts at least halve each round.
    """
    live = settle(pairs.select(F.col("x").alias("a"), F.col("y").alias("b"), "x", "y"))
    chosen = []
    while True:
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b"), "x", "y"))
        best = settle(both.groupBy("a").agg(F.min(F.struct("x", "y", "b")).alias("m")).select("a", F.col("m.b").alias("b"), "m.x", "m.y"))
        if best.isEmpty():
            discard(live, best)
            break
        chosen.append(best)
        # two parts that choose the same edge: the lesser becomes the root
        back = best.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("mutual"))
        parents = best.join(back, ["a", "b"], "left").select(F.col("a").alias("node"), F.when(F.col("mutual") & (F.col("a") < F.col("b")), F.col("a")).otherwise(F.col("b")).alias("parent"))
        to = roots(parents)
        one = live.join(to.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(to.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").where("ra != rb")
        merged = one.groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.min(F.struct("x", "y")).alias("m")).select("a", "b", "m.x", "m.y")
        new = settle(merged)
        discard(live, to)
        live = new
    edges = chosen[0].select("x", "y").limit(0) if not chosen else chosen[0].select("x", "y")
    for more in chosen[1:]:
        edges = edges.unionByName(more.select("x", "y"))
    out = settle(edges.distinct())
    discard(*chosen)
    return out


def ranked(links: DataFrame) -> DataFrame:
    """(k, d) of a linked list (k, succ: the next, null at the end): how many elements follow k. Settled; one round for each binary digit of the length."""
    state = settle(links.select("k", "succ", F.col("succ").isNotNull().cast("long").alias("d")))
    while not state.where("succ IS NOT NULL").isEmpty():
        far = state.select(F.col("k").alias("succ"), F.col("succ").alias("far"), F.col("d").alias("more"))
        jumped = state.where("succ IS NOT NULL").join(far, "succ").select("k", F.col("far").alias("succ"), (F.col("d") + F.col("more")).alias("d"))
        new = settle(jumped.unionByName(state.where("succ IS NULL")))
        discard(state)
        state = new
    return state.select("k", "d")


def rooted(tree: DataFrame, tops: DataFrame) -> DataFrame:
    """(v, parent, first, last) of every node of the trees (x, y): the subtree of v holds those whose first lies between. Settled.

    tops: (root, total): the root of each tree and its number of nodes, two at least. Roots have a null parent.
    """
    arcs = numbered(tree.select(F.col("x").alias("u"), F.col("y").alias("w")).unionByName(tree.select(F.col("y").alias("u"), F.col("x").alias("w"))), ["u", "w"], "k")
    # around a node: after the arc to one neighbour comes the arc to the next, after the last the first
    after = arcs.join(arcs.select((F.col("k") - 1).alias("k"), F.col("u").alias("next_u")), "k", "left").select("u", "w", "k", F.when(F.col("u") == F.col("next_u"), F.col("k") + 1).alias("turn"))
    starts = arcs.groupBy("u").agg(F.min("k").alias("start"))
    around = settle(after.where("turn IS NOT NULL").unionByName(after.where("turn IS NULL").join(starts, "u").select("u", "w", "k", F.col("start").alias("turn"))))
    # the arc that follows u -> w in the tour is the one that turns from w -> u; the tours of all trees make one list, in order of their roots
    heads = numbered(starts.join(tops.select(F.col("root").alias("u")), "u"), ["u"], "i")
    ends = heads.join(heads.select((F.col("i") - 1).alias("i"), F.col("start").alias("onward")), "i", "left").select(F.col("start").alias("succ"), "onward", F.lit(True).alias("end"))
    tour = arcs.join(around.select(F.col("w").alias("u"), F.col("u").alias("w"), F.col("turn").alias("succ")), ["u", "w"]).join(ends, "succ", "left")
    rank = ranked(tour.select("k", F.when(F.col("end"), F.col("onward")).otherwise(F.col("succ")).alias("succ")))
    placed = settle(arcs.join(rank, "k").select("u", "w", "k", (-2 * F.col("d")).alias("place")))
    back = placed.select(F.col("w").alias("u"), F.col("u").alias("w"), F.col("place").alias("last"))
    down = placed.join(back, ["u", "w"]).where("place < last").select(F.col("w").alias("v"), F.col("u").alias("parent"), F.col("place").alias("first"), "last")
    first = F.col("place") - 1
    top = heads.join(placed.select(F.col("k").alias("start"), "place"), "start").join(tops.withColumnRenamed("root", "u"), "u").select(F.col("u").alias("v"), F.lit(None).cast("long").alias("parent"), first.alias("first"), (first + 4 * (F.col("total") - 1)).alias("last"))
    out = settle(down.unionByName(top))
    discard(arcs, around, heads, placed)
    return out


def interval_extremes(nodes: DataFrame) -> DataFrame:
    """(v, low, high): least lo and greatest hi of the nodes whose first lies in [first, last] of v. nodes: (v, first, last, lo, hi). Settled.

    Values are gathered once for each level of dyadic intervals, near each other by range partitions; every interval is put together from two pieces a level at most.
    """
    base, top = nodes.agg(F.min("first"), F.max("last")).first()
    if base is None:
        return settle(nodes.select("v", F.col("lo").alias("low"), F.col("hi").alias("high")))
    levels = F.sequence(F.lit(0), F.lit(max(1, (top - base + 1).bit_length())))
    shifted = lambda c, k: F.expr(f"shiftright({c}, {k})")
    at = nodes.select((F.col("first") - base).alias("l"), (F.col("last") - base + 1).alias("r"), "v", "lo", "hi")
    held = at.select("l", "lo", "hi").repartitionByRange("l").withColumn("k", F.explode(levels))
    pieces = settle(held.groupBy("k", shifted("l", "k").alias("j")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    many = at.where("r - l > 1").select("v", "l", "r", F.explode(levels).alias("k"))
    # at level k the part still open runs from ceil(l / 2^k) to floor(r / 2^k); an odd end is a piece of its own
    a, b = F.expr("shiftright(l + shiftleft(1L, k) - 1, k)"), F.expr("shiftright(r, k)")
    cut = many.withColumns({"a": a, "b": b}).where("a < b").select("v", "k", F.explode(F.array_compact(F.array(F.when(F.col("a") % 2 == 1, F.col("a")), F.when(F.col("b") % 2 == 1, F.col("b") - 1)))).alias("j"))
    found = cut.join(pieces, ["k", "j"]).select("v", "lo", "hi").unionByName(at.where("r - l <= 1").select("v", "lo", "hi"))
    out = settle(found.groupBy("v").agg(F.min("lo").alias("low"), F.max("hi").alias("high")))
    discard(pieces)
    return out


def blocks(pairs: DataFrame, tops: DataFrame) -> DataFrame:
    """(v, parent, first, last, block) of every node of the components that pairs (x < y) make; block is that of the edge to the parent. Settled.

    tops: (root, total) of each component; any node will do as root.
    """
    tree = spanning_forest(pairs)
    nodes = rooted(tree, tops)
    spans = nodes.select("v", "first", "last")
    rest = pairs.join(tree, ["x", "y"], "left_anti")
    for end in ("x", "y"):
        rest = rest.join(spans.select(F.col("v").alias(end), F.col("first").alias(f"{end}_first"), F.col("last").alias(f"{end}_last")), end)
    rest = settle(rest)
    reach = rest.select(F.col("x").alias("v"), F.col("y_first").alias("to")).unionByName(rest.select(F.col("y").alias("v"), F.col("x_first").alias("to"))).groupBy("v").agg(F.min("to").alias("lo"), F.max("to").alias("hi"))
    own = settle(spans.join(reach, "v", "left").select("v", "first", "last", F.least("first", F.coalesce("lo", "first")).alias("lo"), F.greatest("first", F.coalesce("hi", "first")).alias("hi")))
    extremes = interval_extremes(own)
    inner = nodes.where("parent IS NOT NULL")
    up = inner.select(F.col("v").alias("parent"), F.col("first").alias("p_first"), F.col("last").alias("p_last"))
    onward = inner.select("v", "parent").join(extremes, "v").join(up, "parent").where("low < p_first OR high > p_last").select(F.col("v").alias("a"), F.col("parent").alias("b"))
    beside = rest.where("x_last < y_first OR y_last < x_first").select(F.col("x").alias("a"), F.col("y").alias("b"))
    labels = connected(onward.unionByName(beside))
    out = settle(nodes.join(labels.select(F.col("id").alias("v"), "label"), "v", "left").select("v", "parent", "first", "last", F.when(F.col("parent").isNotNull(), F.coalesce("label", "v")).alias("block")))
    discard(tree, nodes, rest, own, extremes)
    return out


def cut_vertices(members: DataFrame, links: DataFrame) -> DataFrame:
    """(node_id, component_size, reachable_after_removal) of the cut vertices. Settled.

    members: (component, id) of the components, each of three nodes or more; links: (a, b), neighbours, at least once each. The third
    column counts the part of what is left of a component that holds its least remaining id.
    """
    known = numbered(members.select("component", "id"), ["component", "id"], "v")
    # numbers run through each component in order of its ids: the least is its root, and the next one the least when the root goes
    tops = settle(known.groupBy("component").agg(F.min("v").alias("root"), F.count(F.lit(1)).alias("total")))
    ends = links.where("a != b").join(known.select(F.col("id").alias("a"), F.col("v").alias("x")), "a").join(known.select(F.col("id").alias("b"), F.col("v").alias("y")), "b")
    pairs = settle(ends.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    held = blocks(pairs, tops.select("root", "total"))
    size = ((F.col("last") - F.col("first")) / 2 + 1).cast("long") / 2
    kids = held.where("parent IS NOT NULL").select("v", "parent", "first", "last", "block", size.cast("long").alias("size"))
    above = held.select(F.col("v").alias("parent"), F.col("block").alias("above"))
    inner = kids.join(above, "parent").where("block != above").groupBy("parent").agg(F.sum("size").alias("apart"))
    second = held.select((F.col("v") - 1).alias("parent"), F.col("first").alias("at"))
    under = settle(kids.join(tops.select(F.col("root").alias("parent")), "parent", "left_semi").join(second, "parent"))
    mixed = under.groupBy("parent").agg(F.min("block").alias("one"), F.max("block").alias("other")).where("one != other").select("parent")
    holder = under.where("at BETWEEN first AND last").select("parent", "block")
    kept = under.join(holder, ["parent", "block"], "left_semi").join(mixed, "parent", "left_semi").groupBy("parent").agg(F.sum("size").alias("kept"))
    found = inner.select(F.col("parent").alias("v"), "apart", F.lit(None).cast("long").alias("kept")).unionByName(kept.select(F.col("parent").alias("v"), F.lit(None).cast("long").alias("apart"), "kept"))
    named = found.join(known, "v").join(tops, "component")
    out = settle(named.select(F.col("id").alias("node_id"), F.col("total").alias("component_size"), F.coalesce("kept", F.col("total") - 1 - F.col("apart")).cast("long").alias("reachable_after_removal")))
    discard(known, tops, pairs, held, under)
    return out
