"""Graphs as of a time, status and tenability of claims, timelines, recognition and fair play."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import text, timekey
from evigraph.functions.meta import Meta
from evigraph.graph import Graph, of_types
from evigraph.schema import AVAILABILITY_KEYS, CHALLENGE, EVENT_KEYS, HIDDEN_SCOPE, HIDDEN_STATUS, INACTIVE_STATUS, REVISION, SUPPORT

LATEST_FIRST = AVAILABILITY_KEYS + ("retrieval_date",)


def item_time(df: DataFrame, keys=AVAILABILITY_KEYS) -> Column:
    """struct<kind, val, shown> of a row: the earliest of its own metadata's and its provenance's time, each the first key present.

    keys is a sequence and may be read any number of times.
    """
    keys = tuple(keys)
    own = Meta.of(df).first_time(keys)
    if "provenance" not in df.columns:
        return own
    kind = df.schema["provenance"].dataType.elementType
    cited = F.transform(F.coalesce("provenance", F.array().cast(df.schema["provenance"].dataType)), lambda p: Meta(kind["metadata"].dataType, p["metadata"]).first_time((*keys, "retrieval_date")))
    return F.array_min(F.concat(F.array(own), cited))  # nulls are passed over


def _available(t: Column, cutoff: Column, include_undated: bool) -> Column:
    return F.when(t.isNull() | ~timekey.comparable(t, cutoff), F.lit(include_undated)).otherwise(t["val"] <= cutoff["val"])


def graph_at(graph: Graph, when, include_undated: bool = True, keys=AVAILABILITY_KEYS) -> Graph:
    """Nodes available by when, and edges that are so and have both ends among them."""
    cutoff = timekey.literal(when)
    nodes = graph.nodes.where(_available(item_time(graph.nodes, keys), cutoff, include_undated))
    ids = nodes.select("id").distinct()
    edges = graph.edges.where(_available(item_time(graph.edges, keys), cutoff, include_undated))
    edges = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return Graph(nodes, edges, graph.header, graph.unique_ids)


def touching(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """edges with claim: a row for each claim (claim) at either end; a self-loop once."""
    a = edges.join(claims.withColumnRenamed("claim", "target"), "target", "left_semi").withColumn("claim", F.col("target"))
    b = edges.where("source != target").join(claims.withColumnRenamed("claim", "source"), "source", "left_semi").withColumn("claim", F.col("source"))
    return a.unionByName(b)


def evidence_available_at(graph: Graph, claims: DataFrame, when) -> DataFrame:
    """(claim, support_count, challenge_count, revision_count) on the slice; claims without evidence are left out."""
    edges = touching(graph_at(graph, when).edges.select("source", "target", "type"), claims)
    kind = F.col("type")
    return edges.groupBy("claim").agg(
        F.count_if(kind.isin(*SUPPORT) & (F.col("target") == F.col("claim"))).alias("support_count"), F.count_if(kind.isin(*CHALLENGE)).alias("challenge_count"), F.count_if(kind.isin(*REVISION)).alias("revision_count")
    )


def claim_status_at(graph: Graph, claims: DataFrame, when) -> DataFrame:
    """(claim, status): missing, not_yet_available, revised_or_superseded, contradicted, supported or unresolved."""
    nodes = graph.index()
    known = nodes.select(F.col("id").alias("claim"), _available(item_time(nodes), timekey.literal(when), True).alias("there"))
    counts = evidence_available_at(graph, claims, when)
    out = claims.join(known, "claim", "left").join(counts, "claim", "left")
    status = (
        F.when(F.col("there").isNull(), "missing").when(~F.col("there"), "not_yet_available").when(F.col("revision_count") > 0, "revised_or_superseded")
        .when(F.col("challenge_count") > 0, "contradicted").when(F.col("support_count") > 0, "supported").otherwise("unresolved")
    )
    return out.select("claim", status.alias("status"))


def claim_status_over(graph: Graph, claims: DataFrame, whens: list) -> DataFrame:
    """(claim, cutoff, status) for every claim and each of a list of cutoffs: what claim_status_at says of each, in one pass over the edges.

    An edge counts from the latest time of its own and its ends' on; the cutoff at which it comes in is looked up, and of each claim the first cutoff of
    every kind of edge is kept (combined where the edges are), which says what there is at any other. Times of the other kind than a
    cutoff's, and missing ones, count as in a slice: always.
    """
    found = graph.nodes.sparkSession.range(1).select(*[timekey.literal(w).alias(f"c{i}") for i, w in enumerate(whens)]).first()
    if any(c is None for c in found):
        raise ValueError(f"not a time: {[w for w, c in zip(whens, found, strict=True) if c is None]}")
    out = None
    for kind in sorted({c["kind"] for c in found}):
        cuts = sorted({(c["val"], str(w)) for w, c in zip(whens, found, strict=True) if c["kind"] == kind})
        rows = _status_over(graph, claims, kind, [v for v, _ in cuts], [w for _, w in cuts])
        out = rows if out is None else out.unionByName(rows)
    return out


def _status_over(graph: Graph, claims: DataFrame, kind: str, cuts: list[float], names: list[str]) -> DataFrame:
    def since(t: Column) -> Column:
        return F.when(t["kind"] == kind, t["val"]).otherwise(F.lit(float("-inf")))

    def slot(value: Column) -> Column:
        """Place of the first cutoff that is no earlier."""
        return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < value))

    asked = claims.select("claim").distinct()
    ends = graph.nodes.select("id", since(item_time(graph.nodes)).alias("t")).groupBy("id").agg(F.min("t").alias("t"))
    ends = ends.join(asked.select(F.col("claim").alias("id"), F.lit(True).alias("is")), "id", "left").select("id", "t", F.coalesce("is", F.lit(False)).alias("is"))
    kinds = {"revision": REVISION, "challenge": CHALLENGE, "support": SUPPORT}
    edges = graph.edges.where(of_types(F.col("type"), [t for types in kinds.values() for t in types])).select("source", "target", "type", since(item_time(graph.edges)).alias("t"))
    for side in ("source", "target"):
        edges = edges.join(ends.select(F.col("id").alias(side), F.col("t").alias(f"t_{side}"), F.col("is").alias(f"is_{side}")), side)
    at = F.array_compact(F.array(F.when(F.col("is_target"), F.struct(F.col("target").alias("claim"), F.lit(True).alias("end"))), F.when(F.col("is_source") & (F.col("source") != F.col("target")), F.struct(F.col("source").alias("claim"), F.lit(False).alias("end")))))
    placed = edges.select("type", slot(F.greatest("t", "t_source", "t_target")).alias("slot"), F.explode(at).alias("c")).where(F.col("slot") < len(cuts))
    since_slot = {n: F.min(F.when(F.col("type").isin(*types) & (F.col("c.end") if n == "support" else F.lit(True)), F.col("slot"))).alias(n) for n, types in kinds.items()}
    first = placed.groupBy(F.col("c.claim").alias("claim")).agg(*since_slot.values())
    nodes = graph.index()
    begun = nodes.select(F.col("id").alias("claim"), since(item_time(nodes)).alias("begun"))
    grid = asked.join(begun, "claim", "left").join(first, "claim", "left").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(len(cuts) - 1))))
    status = (
        F.when(F.col("begun").isNull(), "missing").when(slot(F.col("begun")) > F.col("slot"), "not_yet_available").when(F.col("revision") <= F.col("slot"), "revised_or_superseded")
        .when(F.col("challenge") <= F.col("slot"), "contradicted").when(F.col("support") <= F.col("slot"), "supported").otherwise("unresolved")
    )
    return grid.select("claim", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("slot") + 1).alias("cutoff"), status.alias("status"))


def _dated(graph: Graph, claims: DataFrame, types) -> DataFrame:
    edges = graph.edges.where(of_types(F.col("type"), types))
    own = F.col("id") if "id" in edges.columns else F.lit("")
    edges = edges.select("source", "target", "type", "pos", text.edge_key(F.col("source"), F.col("type"), F.col("target"), own).alias("edge_key"), item_time(edges).alias("t"))
    return touching(edges, claims)


def first_edge_times(graph: Graph, claims: DataFrame, types=CHALLENGE) -> DataFrame:
    """(claim, kind, val, shown, edge_key): the earliest dated edge of the types at each claim, of equals the first."""
    order = F.struct("t.kind", "t.val", "pos")
    return _dated(graph, claims, types).where("t IS NOT NULL").groupBy("claim").agg(F.min_by(F.struct("t.kind", "t.val", "t.shown", "edge_key"), order).alias("f")).select("claim", "f.*")


def tenability_windows(graph: Graph, claims: DataFrame) -> DataFrame:
    """(claim, introduced_at, tenable_until, terminal_edge, terminal_kind, terminal_val, status).

    The end is the first contradiction or revision, a contradiction before a revision of the same time. One pass over the edges
    serves all claims.
    """
    edges = _dated(graph, claims, (*CHALLENGE, *REVISION)).where("t IS NOT NULL")
    order = F.struct("t.kind", "t.val", F.col("type").isin(*REVISION).alias("late"), "pos")
    ends = edges.groupBy("claim").agg(F.min_by(F.struct("t.kind", "t.val", "t.shown", "edge_key"), order).alias("f"))
    nodes = graph.index()
    begun = nodes.select(F.col("id").alias("claim"), item_time(nodes).alias("i"))
    return claims.join(begun, "claim", "left").join(ends, "claim", "left").select(
        "claim", F.coalesce("i.shown", F.lit("")).alias("introduced_at"), F.coalesce("f.shown", F.lit("")).alias("tenable_until"), F.col("f.edge_key").alias("terminal_edge"),
        F.col("f.kind").alias("terminal_kind"), F.col("f.val").alias("terminal_val"), F.when(F.col("f").isNull(), "open").otherwise("bounded").alias("status"),
    )


def stale_claims_after(graph: Graph, when, node_types=("claim",)) -> DataFrame:
    """(claim, tenable_until, terminal_edge) of claims still active though their end is no later than when (pairs compared as such)."""
    nodes = graph.nodes.where(of_types(F.col("type"), node_types or ("claim",)))
    if "status" in nodes.columns:
        nodes = nodes.where(~F.coalesce("status", F.lit("")).isin(*INACTIVE_STATUS))
    windows = tenability_windows(graph, nodes.select(F.col("id").alias("claim")).distinct())
    cutoff = timekey.literal(when)
    ended = F.struct(F.col("terminal_kind").alias("kind"), F.col("terminal_val").alias("val")) <= F.struct(cutoff["kind"].alias("kind"), cutoff["val"].alias("val"))
    return windows.where("terminal_kind IS NOT NULL").where(ended).select("claim", "tenable_until", "terminal_edge")


def stale_in_order(stale: DataFrame) -> DataFrame:
    """As a report lists them: by the end as text, then by claim."""
    return stale.orderBy("tenable_until", "claim")


def timeline_in_order(events: DataFrame) -> DataFrame:
    """By time key (dates before steps), component and event."""
    return events.orderBy("kind", "val", "component_id", "event")


def timeline_events(graph: Graph, keys=EVENT_KEYS) -> DataFrame:
    """(component, component_id, component_type, event, kind, val, shown) of every dated key of nodes, edges and their provenance."""
    own = F.col("id") if "id" in graph.edges.columns else F.lit("")
    key = text.edge_key(F.col("source"), F.col("type"), F.col("target"), own)
    parts = []
    for name, df, ident in (("node", graph.nodes, F.col("id")), ("edge", graph.edges, key)):
        meta = Meta.of(df)
        parts.append(_events(df, name, ident, meta.times(keys)))
        if "provenance" in df.columns:
            kind = df.schema["provenance"].dataType.elementType["metadata"].dataType
            cited = df.select(ident.alias("__id"), "type", F.explode("provenance").alias("p"))
            parts.append(_events(cited, f"{name}_provenance", F.col("__id"), Meta(kind, F.col("p.metadata")).times(keys)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _events(df: DataFrame, component: str, ident: Column, times: Column) -> DataFrame:
    rows = df.select(ident.alias("component_id"), F.col("type").alias("component_type"), F.explode(times).alias("e"))
    return rows.select(F.lit(component).alias("component"), "component_id", "component_type", "e.event", "e.t.kind", "e.t.val", "e.t.shown")


def availability_lag(claim: Column, contradiction: Column, persistence: Column) -> Column:
    """struct<comparable, time_to_contradiction, post_contradiction_persistence> of three time keys."""
    same = timekey.comparable(claim, contradiction) & timekey.comparable(contradiction, persistence)
    return F.struct(
        same.alias("comparable"),
        F.when(same, contradiction["val"] - claim["val"]).alias("time_to_contradiction"),
        F.when(same, persistence["val"] - contradiction["val"]).alias("post_contradiction_persistence"),
    )


def recognition_windows(graph: Graph, recognized: DataFrame) -> DataFrame:
    """recognized: (claim, recognized_at: a time key struct or null). Returns (claim, contradiction_available_at, recognition_lag, status)."""
    first = first_edge_times(graph, recognized.select("claim").distinct())
    out = recognized.join(first, "claim", "left")
    lag = timekey.lag(F.struct("kind", "val"), F.col("recognized_at"))
    status = (
        F.when(F.col("kind").isNull(), "no_available_contradiction").when(F.col("recognized_at").isNull(), "not_measured").when(lag.isNotNull(), "recognized").otherwise("recognized_uncomparable_time")
    )
    return out.select("claim", F.coalesce("shown", F.lit("")).alias("contradiction_available_at"), F.when(F.col("kind").isNotNull(), lag).alias("recognition_lag"), status.alias("status"))


def fair_play(graph: Graph, claims: DataFrame | None = None, reveal_at=None, decisive_types=(*CHALLENGE, *REVISION)) -> DataFrame:
    """(claim, rating, failures, decisive_evidence_count, first_time, first_edge): is decisive evidence there before the reveal?

    reveal_at: a time, or a column of claims (a key struct<kind, val>) where claims differ in it.
    """
    if claims is None:
        claims = graph.nodes.where("type = 'claim'").select(F.col("id").alias("claim"))
    meta = Meta.of(graph.edges)
    hidden = F.coalesce(F.lower(F.trim(meta.shown("availability_status"))).isin(*HIDDEN_STATUS), F.lit(False)) | F.coalesce(F.lower(F.trim(meta.shown("access_scope"))).isin(*HIDDEN_SCOPE), F.lit(False))
    edges = graph.edges.where(of_types(F.col("type"), decisive_types or (*CHALLENGE, *REVISION)))
    own = F.col("id") if "id" in edges.columns else F.lit("")
    edges = edges.select("source", "target", "pos", text.edge_key(F.col("source"), F.col("type"), F.col("target"), own).alias("edge_key"), item_time(edges).alias("t"), hidden.alias("hidden"))
    return judged(edges, claims, reveal_at)


def judged(edges: DataFrame, claims: DataFrame, reveal_at=None) -> DataFrame:
    """fair_play of decisive edges (source, target, pos, edge_key, t, hidden) as they are; further columns of claims stay.

    An edge goes to both of its ends at once. The earliest time takes numbers only; the edge that it belongs to is an aggregate of its own, so whoever asks for the rating alone doesn't move it.
    """
    at = F.explode(F.array_compact(F.array("target", F.when(F.col("source") != F.col("target"), F.col("source")))))
    when = lambda kind: F.min(F.when(F.col("t.kind") == kind, F.col("t.val")))
    per = edges.select(at.alias("claim"), "pos", "edge_key", "t", "hidden").groupBy("claim").agg(
        F.count(F.lit(1)).alias("n"), F.max("hidden").alias("hidden"), when("datetime").alias("day"), when("numeric").alias("step"),
        F.min_by(F.struct("t.shown", "edge_key"), F.when(F.col("t").isNotNull(), F.struct("t.kind", "t.val", "pos"))).alias("e"),
    )
    kind = F.when(F.col("day").isNotNull(), "datetime").when(F.col("step").isNotNull(), "numeric")
    per = per.select("claim", "n", "hidden", F.struct(kind.alias("kind"), F.coalesce("day", "step").alias("val")).alias("f"), "e")
    kept = [c for c in claims.columns if c not in ("claim", "reveal")]
    out = claims.join(per, "claim", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "dated": F.col("f.kind").isNotNull()})
    failures = [F.when(F.col("n") == 0, "no_decisive_evidence"), F.when((F.col("n") > 0) & ~F.coalesce("dated", F.lit(False)), "undated_decisive_evidence")]
    if reveal_at is not None:
        cut = timekey.literal(reveal_at)
        first = F.struct(F.col("f.kind").alias("kind"), F.col("f.val").alias("val"))
        dated, same = F.coalesce("dated", F.lit(False)), timekey.comparable(first, cut)
        failures.append(F.when(dated & ~same, "uncomparable_reveal_time").when(dated & (first["val"] > cut["val"]), "late_decisive_evidence").when(dated & (first["val"] == cut["val"]), "decisive_evidence_at_reveal"))
    failures.append(F.when(F.col("hidden"), "hidden_or_private_decisive_evidence"))
    out = out.withColumn("failures", F.array_compact(F.array(*failures)))
    only = F.array_join("failures", ",")
    rating = F.when(only == "", "fair").when(only.isin("decisive_evidence_at_reveal", "uncomparable_reveal_time"), "partial").otherwise("unfair")
    return out.select(*kept, "claim", rating.alias("rating"), "failures", F.col("n").alias("decisive_evidence_count"), F.coalesce("e.shown", F.lit("")).alias("first_time"), F.col("e.edge_key").alias("first_edge"))


def fair_play_rating(checks: DataFrame) -> DataFrame:
    """One row: overall rating and counts."""
    n = lambda r: F.count_if(F.col("rating") == r)
    total = F.count(F.lit(1))
    overall = F.when(total == 0, "no_claims").when(total == n("fair"), "fair").when(n("unfair") > 0, "unfair").otherwise("partial")
    return checks.agg(overall.alias("rating"), total.alias("claim_count"), n("fair").alias("fair_count"), n("partial").alias("partial_count"), n("unfair").alias("unfair_count"))
