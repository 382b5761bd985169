"""Epistemic summaries: a target's neighbourhood, what it says, flags, a heuristic score and the Bayesian block.

The neighbourhood of a target is itself, its claims, and the ends of all edges at either. A (target, member) table holds it
for all targets at once. The induced edges are those at a target or its claims, which need no look at the neighbourhood, and those between two of its
other members, which are looked for only among edges whose ends are both such members of something.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import bayes, text
from evigraph.functions.meta import Meta
from evigraph.graph import Graph, of_types, stance
from evigraph.operators import bayesian, ledger
from evigraph.operators.loops import settle
from evigraph.schema import ADVERSARIAL, ASSESSED_TYPES, GROUNDING, HIGH_TRUST, LOW_TRUST, MIXED_TRUST, QUALITY_KEYS, STANCE_KEYS, SUPPORT

#: Order of labels in the assessment report.
LABEL_RANK = ("prior_sensitive", "thin_evidence", "contested", "fragile_support", "stable_support")


def claim_members(graph: Graph, targets: DataFrame) -> DataFrame:
    """(target, claim): a claim is its own, any other target has the claims with an about_concept edge into it."""
    nodes = graph.index().select("id", "type")
    asked = targets.select(F.col("id").alias("target")).distinct().join(nodes.withColumnRenamed("id", "target"), "target", "left")
    own = asked.where("type = 'claim'").select("target", F.col("target").alias("claim"))
    others = asked.where("type IS NULL OR type != 'claim'").select("target")
    about = graph.edges.where("type = 'about_concept'").select(F.col("source").alias("claim"), "target")
    claims = nodes.where("type = 'claim'").select(F.col("id").alias("claim"))
    return own.unionByName(about.join(others, "target", "left_semi").join(claims, "claim", "left_semi").distinct().select("target", "claim"))


def cores_of(graph: Graph, targets: DataFrame) -> DataFrame:
    """(target, core): a target itself and its claims, once each."""
    return claim_members(graph, targets).select("target", F.col("claim").alias("core")).unionByName(targets.select(F.col("id").alias("target"), F.col("id").alias("core"))).distinct()


def neighborhoods(graph: Graph, targets: DataFrame) -> DataFrame:
    """(target, member), once each."""
    cores = cores_of(graph, targets)
    ends = graph.edges.select(F.col("source").alias("core"), F.col("target").alias("member")).unionByName(graph.edges.select(F.col("target").alias("core"), F.col("source").alias("member"))).distinct()
    return cores.join(ends, "core").select("target", "member").unionByName(cores.select("target", F.col("core").alias("member"))).distinct()


def induced_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """edges (src, dst, ...) once for every target that has both ends among members (target, member), with the target.

    An edge first meets the targets of the end that fewer have as a member, so a hub's edges don't meet all the targets near the hub.
    """
    times = members.groupBy("member").agg(F.count(F.lit(1)).alias("n"))
    placed = edges.join(times.select(F.col("member").alias("src"), F.col("n").alias("src_n")), "src").join(times.select(F.col("member").alias("dst"), F.col("n").alias("dst_n")), "dst")
    near = F.col("dst_n") <= F.col("src_n")
    placed = placed.withColumns({"near": F.when(near, F.col("dst")).otherwise(F.col("src")), "far": F.when(near, F.col("src")).otherwise(F.col("dst"))}).drop("src_n", "dst_n")
    met = placed.join(members.withColumnRenamed("member", "near"), "near")
    return met.join(members.withColumnRenamed("member", "far"), ["target", "far"]).drop("near", "far")


def edges_at(edges: DataFrame, cores: DataFrame) -> DataFrame:
    """edges (src, dst, ...) once for every target that has an end as core (target, core), with the target and aimed: whether that is the edge's dst."""
    into = edges.join(cores.withColumnRenamed("core", "dst"), "dst").withColumn("aimed", F.lit(True))
    out = edges.where("src != dst").join(cores.withColumnRenamed("core", "src"), "src").join(cores.withColumnRenamed("core", "dst"), ["target", "dst"], "left_anti").withColumn("aimed", F.lit(False))
    return into.unionByName(out)


def summaries(graph: Graph, node_types=ASSESSED_TYPES, low_confidence: float = 0.5, prior: bayesian.Profile = "neutral", credibility: float = 0.95, posterior: bool = True) -> DataFrame:
    """A row per node of the types: counts, flags, score, band and, with posterior, the Bayesian columns. An empty node_types means the default.

    prior and credibility are those of the Bayesian columns, which no other column depends on.
    """
    nodes, meta_n, meta_e = graph.index(), Meta.of(graph.nodes), Meta.of(graph.edges)
    targets = nodes.where(of_types(F.col("type"), node_types or ASSESSED_TYPES)).select("id", "type", *(["title"] if "title" in nodes.columns else []))
    cores = settle(cores_of(graph, targets.select("id")))
    none = F.array().cast("array<string>")

    roles = F.concat(meta_n.words(["source_role"]), meta_n.words(["source_roles"]))
    status = F.lower(F.trim("status")) if "status" in nodes.columns else F.lit(None).cast("string")
    flagged = lambda m: F.array_compact(F.array(F.when(m.is_true("adversarial"), "adversarial"), F.when(m.is_true("denialist"), "denialist")))
    side_n = nodes.select(
        F.col("id").alias("member"), F.col("confidence") if "confidence" in nodes.columns else F.lit(None).cast("double").alias("confidence"), roles.alias("roles"),
        meta_n.words(QUALITY_KEYS).alias("quality"), F.concat(meta_n.words(STANCE_KEYS), flagged(meta_n)).alias("hostile"),
        F.concat(F.when(status.isin(*GROUNDING), F.array(status)).otherwise(none), ledger._grounding(nodes)).alias("grounding"),
    )
    extra = graph.edges.select(*(["pos"] if posterior else []), meta_e.words(QUALITY_KEYS).alias("quality"), F.concat(meta_e.words(STANCE_KEYS), flagged(meta_e)).alias("hostile"), ledger._grounding(graph.edges).alias("grounding"), F.col("source").alias("src"), F.col("target").alias("dst"), stance(F.col("type")).alias("kind"), F.col("type").isin(*SUPPORT).alias("supports"))
    near = settle(edges_at(extra, cores))
    ends = near.select("target", F.explode(F.array("src", "dst")).alias("member"))
    members = settle(ends.unionByName(cores.withColumnRenamed("core", "member")).distinct())
    of_nodes = members.join(side_n, "member")
    rim = settle(members.join(cores.withColumnRenamed("core", "member"), ["target", "member"], "left_anti"))
    rims = settle(rim.select("member").distinct())
    between = extra
    for end in ("src", "dst"):
        between = between.join(rims.withColumnRenamed("member", end), end, "left_semi")
    between = settle(between)
    induced = near if between.isEmpty() else near.unionByName(settle(induced_edges(between, rim)).withColumn("aimed", F.lit(False)))
    induced = induced.withColumn("direct", F.col("supports") & F.col("aimed"))

    # one pass over the members and one over the edges: words are counted within their rows; only distinct roles need their rows apart
    groups = {"grounding": {"grounded": GROUNDING[:1], "partly": GROUNDING[1:2], "ungrounded": GROUNDING[2:]}, "quality": {"high": HIGH_TRUST, "mixed": MIXED_TRUST, "low": LOW_TRUST}, "hostile": {"adversarial": ADVERSARIAL}}

    def among(column: str, words: tuple[str, ...]) -> Column:
        return F.size(F.filter(column, lambda x: x.isin(*words)))

    def tallies(side: str) -> list[Column]:
        return [x for c, g in groups.items() for x in (F.sum(F.size(c)).alias(f"{side}_{c}_n"), *[F.sum(among(c, words)).alias(f"{side}_{k}") for k, words in g.items()])]

    edge_counts = induced.groupBy("target").agg(F.count_if("direct").alias("support_count"), F.count_if(F.col("kind") == "challenge").alias("challenge_count"), F.count_if(F.col("kind") == "revision").alias("revision_count"), *tallies("e"))
    node_counts = of_nodes.groupBy("target").agg(F.count_if(F.col("confidence") < low_confidence).alias("low_confidence_node_count"), F.avg("confidence").alias("mean_confidence"), *tallies("n"))
    parts = [edge_counts, node_counts]
    if meta_n.may_hold(("source_role", "source_roles")):
        parts.append(of_nodes.select("target", F.explode("roles").alias("word")).groupBy("target").agg(F.count(F.lit(1)).alias("roles_n"), F.count_distinct("word").alias("roles_kinds")))
    if posterior:
        used = induced.where("direct OR kind = 'challenge'").select(F.col("target").alias("ledger"), "pos")
        parts.append(bayesian.evidence_totals(used.join(ledger.weighted_edges(graph), "pos")).withColumnRenamed("ledger", "target"))
    out = targets.withColumnRenamed("id", "target")
    for part in parts:
        out = out.join(part, "target", "left")
    if "roles_n" not in out.columns:
        out = out.withColumns({c: F.lit(0).cast("long") for c in ("roles_n", "roles_kinds")})
    both = {c: F.coalesce(f"n_{c}", F.lit(0)) + F.coalesce(f"e_{c}", F.lit(0)) for k, g in groups.items() for c in (f"{k}_n", *g)}
    out = out.withColumns(both).drop(*[f"{side}_{c}" for side in "ne" for c in both])
    filled = [c for c in out.columns if c not in ("target", "type", "title", "mean_confidence")]
    out = out.fillna(0, filled)
    return _scored(bayesian.classified(out, profile=prior, credibility=credibility) if posterior else out)


def _scored(df: DataFrame) -> DataFrame:
    c = F.col
    ratio = lambda top, n, none: F.when(c(n) > 0, top / c(n)).otherwise(none)
    grounding = ratio(c("grounded") + 0.55 * c("partly") + 0.05 * c("ungrounded"), "grounding_n", 0.35)
    quality = ratio(c("high") + 0.55 * c("mixed") + 0.1 * c("low") + 0.45 * (c("quality_n") - c("high") - c("mixed") - c("low")), "quality_n", 0.5)
    score = (
        0.25 * grounding + 0.25 * F.least(F.lit(1.0), c("support_count") / 3.0) + 0.18 * F.coalesce("mean_confidence", F.lit(0.5)) + 0.12 * F.least(F.lit(1.0), c("roles_kinds") / 3.0) + 0.12 * quality
        + F.least(F.lit(0.15), c("revision_count") * 0.05) - F.least(F.lit(0.35), c("challenge_count") * 0.12) - F.least(F.lit(0.25), c("adversarial") * 0.1)
    )
    flags = F.array_compact(
        F.array(
            F.when(c("support_count") == 0, "no_direct_support"), F.when(c("challenge_count") > 0, "challenged"), F.when(c("revision_count") > 0, "revised_or_qualified"),
            F.when(c("low_confidence_node_count") > 0, "low_confidence"), F.when((c("ungrounded") > 0) | ((c("grounding_n") > 0) & (c("grounded") == 0)), "weak_grounding"),
            F.when(c("roles_kinds") == 1, "narrow_source_role"), F.when(c("low") > 0, "low_trust_source_signal"), F.when(c("adversarial") > 0, "adversarial_source_signal"),
        )
    )
    out = df.withColumns({"reliability_score": bayes.clamp(score), "flags": flags})
    s = c("reliability_score")
    return out.withColumn("reliability_band", F.when(s >= 0.75, "strong").when(s >= 0.5, "moderate").when(s >= 0.3, "weak").otherwise("poor"))


def rationale(summary: DataFrame) -> DataFrame:
    """summary with rationale: an array of short sentences that say what the score of a row rests on."""
    c, n = F.col, lambda x: F.col(x).cast("string")
    counted = lambda names: F.array_join(F.array_compact(F.array(*[F.when(c(x) > 0, F.concat(F.lit(f"{x} "), n(x))) for x in names])), ", ")
    said = F.array_compact(
        F.array(
            F.when(c("support_count") > 0, F.concat(n("support_count"), F.lit(" edges in direct support"))).otherwise("nothing in direct support"),
            F.when(c("challenge_count") > 0, F.concat(n("challenge_count"), F.lit(" challenges"))), F.when(c("revision_count") > 0, F.concat(n("revision_count"), F.lit(" revisions"))),
            F.when(c("grounding_n") > 0, F.concat(F.lit("grounding: "), counted(("grounded", "partly", "ungrounded")))).otherwise("grounding is not stated"),
            F.when(c("roles_kinds") > 0, F.concat(n("roles_kinds"), F.lit(" kinds of source role"))).otherwise("source roles are not stated"),
            F.when(c("quality_n") > 0, F.concat(F.lit("source quality: "), counted(("high", "mixed", "low")))), F.when(c("hostile_n") > 0, F.concat(n("hostile_n"), F.lit(" statements of a source's stance"))),
        )
    )
    return summary.withColumn("rationale", said)


def excerpts(graph: Graph, targets: DataFrame, kinds=("support", "challenge", "revision"), most: int = 12) -> DataFrame:
    """(target, kind, place, source, dst, type, edge_key): the first edges by pos of each kind at a target's claims, a report's excerpt of at most `most` each.

    Support counts at its claim's end only. The window keeps the first rows of each partition before it shuffles.
    """
    claims = claim_members(graph, targets).unionByName(targets.select(F.col("id").alias("target"), F.col("id").alias("claim"))).distinct()
    own = F.col("id") if "id" in graph.edges.columns else F.lit("")
    edges = graph.edges.select("source", F.col("target").alias("dst"), "type", "pos", text.edge_key(F.col("source"), F.col("type"), F.col("target"), own).alias("edge_key"), stance(F.col("type")).alias("kind")).where(F.col("kind").isin(*kinds))
    at_end = edges.join(claims.withColumnRenamed("claim", "dst"), "dst")
    at_start = edges.where("kind <> 'support' AND source <> dst").join(claims.withColumnRenamed("claim", "source"), "source")
    both = at_end.select("target", *edges.columns).unionByName(at_start.select("target", *edges.columns)).distinct()
    first = Window.partitionBy("target", "kind").orderBy("pos")
    return both.withColumn("place", F.row_number().over(first)).where(F.col("place") <= most).drop("pos")


def report_counts(summary: DataFrame) -> DataFrame:
    """(kind, name, n): counts of flags, reliability bands, Bayesian labels and flags (where the summary has them), nodes and flagged nodes."""
    one = lambda kind, df: df.groupBy("name").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    out = one("flag", summary.select(F.explode("flags").alias("name")))
    out = out.unionByName(one("band", summary.select(F.col("reliability_band").alias("name"))))
    if "bayesian_label" in summary.columns:
        out = out.unionByName(one("label", summary.select(F.col("bayesian_label").alias("name"))))
        out = out.unionByName(one("bayesian_flag", summary.select(F.explode("bayesian_flags").alias("name"))))
    return out.unionByName(one("nodes", summary.select(F.when(F.size("flags") > 0, "flagged").otherwise("unflagged").alias("name"))))


def assessment_rows(summary: DataFrame) -> DataFrame:
    """Rows of the Bayesian assessment report, in its order: label, prior range descending, evidence, id."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in LABEL_RANK]), F.col("bayesian_label")), F.lit(10))
    rank = F.when(rank == 0, 10).otherwise(rank)
    return summary.orderBy(rank, F.desc("mean_range"), "effective_n", "target")
