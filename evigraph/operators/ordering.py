"""Topological order in rounds by what happens in it, not by its length.

Runs of nodes with one predecessor and one successor are contracted first (pointer jumping), so that only other nodes, called
stops, are waited for. The sweep then visits those levels alone at which a stop is due or a run begins. Between two such levels nothing
changes but the level: the runs under way keep their order, and their nodes get their places at the end, all at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.graph import Graph, of_types
from evigraph.operators.loops import discard, numbered, settle


def _heads(inner: DataFrame) -> DataFrame:
    """(id, run, i) of the inner nodes (id, pred): the first node of its run and the steps from there. Nodes of closed rings have none. Settled."""
    before = inner.select(F.col("id").alias("pred"), F.lit(True).alias("inside"))
    state = settle(inner.join(before, "pred", "left").select("id", F.when(F.col("inside"), F.col("pred")).alias("up"), F.coalesce(F.when(F.col("inside"), F.col("pred")), F.col("id")).alias("run"), F.when(F.col("inside"), 1).otherwise(0).cast("long").alias("i")))
    for _ in range(state.count().bit_length() + 1):  # a run has no more nodes than that; what is open then goes round in a ring
        if state.where("up IS NOT NULL").isEmpty():
            break
        far = state.select(F.col("id").alias("up"), F.col("up").alias("far"), F.col("run").alias("far_run"), F.col("i").alias("more"))
        jumped = state.where("up IS NOT NULL").join(far, "up").select("id", F.col("far").alias("up"), F.col("far_run").alias("run"), (F.col("i") + F.col("more")).alias("i"))
        new = settle(jumped.unionByName(state.where("up IS NULL")))
        discard(state)
        state = new
    return state.where("up IS NULL").select("id", "run", "i")


def topological_order(graph: Graph, edge_types=None, node_types=None) -> tuple[DataFrame, DataFrame]:
    """((id, level, place), leftover ids).

    Levels are those of repeated removal of nodes without predecessors; place (from 0) orders by level, then by the place of the
    last predecessor, then by id. Leftover are the members of cycles and all behind them. Parallel edges count once.
    """
    ids = settle(graph.index().where(of_types(F.col("type"), node_types)).select("id"))
    edges = graph.edges.where(of_types(F.col("type"), edge_types)).select(F.col("source").alias("a"), F.col("target").alias("b")).distinct()
    edges = settle(edges.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi"))
    into = edges.groupBy(F.col("b").alias("id")).agg(F.count(F.lit(1)).alias("needs"), F.min("a").alias("pred"))
    onto = edges.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("leads"), F.min("b").alias("succ"))
    known = settle(ids.join(into, "id", "left").join(onto, "id", "left").select("id", F.coalesce("needs", F.lit(0)).alias("needs"), F.coalesce("leads", F.lit(0)).alias("leads"), "pred", "succ"))
    inside = (F.col("needs") == 1) & (F.col("leads") == 1)
    runs, members, links = None, None, edges.select("a", "b", F.lit(0).cast("long").alias("size"), F.lit(None).cast("string").alias("run"))
    inner = known.where(inside)
    if not inner.isEmpty():
        members = _heads(inner.select("id", "pred"))
        ends = members.groupBy("run").agg(F.max(F.struct("i", "id")).alias("last")).select("run", (F.col("last.i") + 1).alias("size"), F.col("last.id").alias("last"))
        firsts, lasts = inner.select(F.col("id").alias("run"), F.col("pred").alias("a")), inner.select(F.col("id").alias("last"), F.col("succ").alias("b"))
        runs = settle(ends.join(firsts, "run").join(lasts, "last").select("a", "b", "size", "run"))
        within = inner.select("id")
        direct = links.join(within.withColumnRenamed("id", "a"), "a", "left_anti").join(within.withColumnRenamed("id", "b"), "b", "left_anti")
        links = settle(direct.unionByName(runs))
        stops = known.where(~inside)
    else:
        stops = known
    waiting = settle(stops.where("needs > 0").select("id", "needs", F.lit(0).cast("long").alias("met"), F.lit(-1).cast("long").alias("level")))
    alive, pieces, level, due = None, [], 0, stops.where("needs = 0").select("id")
    while True:
        # what is at this level: new stops, runs that begin and runs under way, each after what it follows
        blank, here = F.lit(None).cast("long"), F.lit(level).cast("long")
        if alive is None:
            rows = due.select("id", F.lit(-1).cast("long").alias("after"), F.lit(False).alias("is_run"), here.alias("start"), here.alias("until"))
        else:
            ending = alive.where(F.col("until") == level - 1)
            stop_ends, run_ends = ending.where("NOT is_run").select(F.col("id").alias("a"), "rank"), ending.where("is_run").select(F.col("id").alias("run"), "rank")
            met = links.where("run IS NULL").join(stop_ends, "a").select("b", "rank")
            if runs is not None:
                met = met.unionByName(runs.join(run_ends, "run").select("b", "rank"))
            met = met.join(due.select(F.col("id").alias("b")), "b", "left_semi").groupBy(F.col("b").alias("id")).agg(F.max("rank").alias("after"))
            rows = met.select("id", "after", F.lit(False).alias("is_run"), here.alias("start"), here.alias("until"))
            if runs is not None:
                begun = runs.join(stop_ends, "a").select(F.col("run").alias("id"), F.col("rank").alias("after"), F.lit(True).alias("is_run"), here.alias("start"), (here + F.col("size") - 1).alias("until"))
                under_way = alive.where("is_run").where(F.col("until") >= level).select("id", F.col("rank").alias("after"), "is_run", "start", "until")
                rows = rows.unionByName(begun).unionByName(under_way)
        ranked = numbered(rows, ["after", "id"], "rank")
        pieces.append((level, ranked))
        new = ranked.where("NOT is_run").select(F.col("id").alias("a"))
        told = links.join(new, "a").groupBy(F.col("b").alias("id")).agg(F.count(F.lit(1)).alias("more"), F.max(here + F.col("size") + 1).alias("at"))
        still = waiting.join(due, "id", "left_anti") if alive is not None else waiting
        updated = settle(still.join(told, "id", "left").select("id", "needs", (F.col("met") + F.coalesce("more", F.lit(0))).alias("met"), F.greatest("level", F.coalesce("at", F.lit(-1))).alias("level")))
        discard(waiting)
        waiting, alive = updated, ranked
        ahead = [waiting.where("met = needs").agg(F.min("level")).first()[0]]
        if runs is not None and not runs.join(new, "a", "left_semi").isEmpty():
            ahead.append(level + 1)
        ahead = [x for x in ahead if x is not None]
        if not ahead:
            break
        level = min(ahead)
        due = waiting.where((F.col("met") == F.col("needs")) & (F.col("level") == level)).select("id")
    placed = _placed(pieces, members)
    discard(ids, edges, waiting, known, *[x for x in (runs, links if runs is not None else None) if x is not None])
    every = graph.index().where(of_types(F.col("type"), node_types)).select("id")
    return placed, every.join(placed.select("id"), "id", "left_anti")


def _placed(pieces: list[tuple[int, DataFrame]], members: DataFrame | None) -> DataFrame:
    """(id, level, place) of the stops and of the nodes of runs. pieces: a level, and who was there with its rank."""
    nexts = [level for level, _ in pieces[1:]] + [None]
    stops, spans = None, None
    for (level, rows), following in zip(pieces, nexts, strict=True):
        own = rows.where("NOT is_run").select("id", F.lit(level).cast("long").alias("level"), "rank")
        stops = own if stops is None else stops.unionByName(own)
        if members is not None:
            upto = F.col("until") if following is None else F.least("until", F.lit(following - 1).cast("long"))
            span = rows.where("is_run").select(F.col("id").alias("run"), "start", "rank", F.lit(level).cast("long").alias("level"), upto.alias("upto"))
            spans = span if spans is None else spans.unionByName(span)
    if members is None:  # every level is there: the rows before it are those of the levels before
        placed, base = None, 0
        for level, rows in pieces:
            own = rows.select("id", F.lit(level).cast("long").alias("level"), (F.col("rank") + base).alias("place"))
            placed, base = own if placed is None else placed.unionByName(own), base + rows.rows
        return placed
    shown = spans.select("run", "start", "rank", F.explode(F.sequence("level", "upto")).alias("level"))
    inner = members.join(shown.withColumn("i", F.col("level") - F.col("start")), ["run", "i"]).select("id", "level", "rank")
    stops = stops.unionByName(inner)
    out = numbered(stops, ["level", "rank"], "place").select("id", "level", "place")
    discard(*[rows for _, rows in pieces])
    return out


def cycle_nodes(graph: Graph, edge_types=None, node_types=None) -> DataFrame:
    """(id): members of cycles and everything downstream of one."""
    return topological_order(graph, edge_types, node_types)[1]
