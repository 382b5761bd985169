"""Further registered queries: story annotations, collection of rows, ledgers by branch, open metadata, GEDCOM; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.functions import confidence
from evigraph.functions.meta import Meta
from evigraph.graph import Graph
from evigraph.operators import bayesian, experiment, gmetric, ledger, stories, strong, temporal, traversal
from evigraph.plans import projections as P
from evigraph.plans.catalog import _EDGES, _SUPPLY, query, rounded
from evigraph.sources import export, gedcom

# ------------------------------------------------------------------ stories

#: lines: a line item as claim and, where discounted, as evidence against itself; orders are stories.
_STORIES = """
lines AS (
  SELECT 'story::' || l_orderkey AS story_id, 'claim::' || k AS claim_id, 'evidence::' || k AS evidence_id, l_linenumber AS spot, o_custkey % 8 AS reveal, l_returnflag IN ('R', 'A') AS wrong,
         l_discount >= 0.05 AS shown, l_quantity > 45 AS hidden, l_tax = 0 AS bare, CASE o_orderstatus WHEN 'F' THEN 'fair_play' WHEN 'P' THEN 'ambiguous' ELSE 'late_decisive_evidence' END AS fair, l_suppkey
  FROM (SELECT *, l_orderkey || ':' || l_partkey || ':' || l_suppkey || ':' || l_linenumber || ':' || CAST(round(l_extendedprice * 100) AS BIGINT) AS k FROM lineitem) JOIN orders ON o_orderkey = l_orderkey),
told AS (
  SELECT 'story::' || o_orderkey AS story_id, CASE o_orderstatus WHEN 'F' THEN 'fair_play' WHEN 'P' THEN 'ambiguous' ELSE 'late_decisive_evidence' END AS fair,
         count(story_id) AS claims, count(*) FILTER (wrong) AS wrong, count(*) FILTER (shown) AS shown, count(*) FILTER (shown AND bare) AS bare, count(*) FILTER (shown AND NOT wrong) AS nonfalse,
         count(*) FILTER (shown AND spot > reveal) AS late, count(*) FILTER (shown AND hidden) AS hidden
  FROM orders LEFT JOIN lines ON story_id = 'story::' || o_orderkey GROUP BY ALL),
judged AS (
  SELECT story_id, claim_id, fair, spot, l_suppkey, shown,
         CASE WHEN NOT shown OR spot > reveal OR hidden THEN 'unfair' WHEN spot = reveal THEN 'partial' ELSE 'fair' END AS rating
  FROM lines WHERE wrong)
"""


@query(
    f"""WITH {_STORIES} SELECT severity, code, n FROM (
      SELECT 'info' AS severity, 'missing_sidecar_reference' AS code, 3 * count(*) AS n FROM told
      UNION ALL SELECT 'error', 'missing_claim_annotations', count(*) FROM told WHERE claims = 0 UNION ALL SELECT 'warning', 'missing_false_claim_annotation', count(*) FROM told WHERE wrong = 0
      UNION ALL SELECT 'error', 'missing_decisive_evidence', count(*) FROM told WHERE shown = 0 UNION ALL SELECT 'error', 'missing_evidence_field', sum(bare)::BIGINT FROM told
      UNION ALL SELECT 'warning', 'decisive_evidence_targets_nonfalse_claim', sum(nonfalse)::BIGINT FROM told UNION ALL SELECT 'warning', 'decisive_evidence_after_reveal', sum(late)::BIGINT FROM told
      UNION ALL SELECT 'warning', 'decisive_evidence_not_reader_available', sum(hidden)::BIGINT FROM told) WHERE n > 0"""
)
def story_finding_counts(spark, sf_dir):
    return stories.findings(P.stories(spark, sf_dir)).groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_STORIES}, s AS (SELECT *, CASE WHEN claims = 0 OR shown = 0 OR bare > 0 THEN 'error' WHEN wrong = 0 OR nonfalse > 0 OR late > 0 OR hidden > 0 THEN 'warning' ELSE 'pass' END AS status FROM told)
    SELECT 'total' AS kind, 'story_count' AS name, count(*) AS n FROM s UNION ALL SELECT 'total', 'claim_count', sum(claims)::BIGINT FROM s UNION ALL SELECT 'total', 'decisive_evidence_count', sum(shown)::BIGINT FROM s
    UNION ALL SELECT 'status', status, count(*) FROM s GROUP BY status UNION ALL SELECT 'fair_play_status', fair, count(*) FROM s GROUP BY fair"""
)
def story_corpus_summary(spark, sf_dir):
    return stories.corpus_summary(P.stories(spark, sf_dir))


@query(
    f"""WITH {_STORIES} SELECT story_id AS item_id, claim_id, 'line ' || spot AS source_anchor, CASE WHEN shown THEN spot || '' ELSE '' END AS contradiction_available_at, (spot + l_suppkey % 3) || '' AS recognized_at,
    CASE WHEN shown THEN (l_suppkey % 3) || '.0' ELSE '' END AS recognition_lag, fair AS fair_play_rating FROM judged"""
)
def story_recognition_rows(spark, sf_dir):
    """An answer to every false claim, recognised some lines later."""
    table = P.stories(spark, sf_dir)
    false = table.select("story_id", F.explode("claims").alias("c")).where(F.col("c.truth_status").isin(*stories.FALSE))
    supplier = F.split(F.col("c.claim_id"), ":")[4].cast("long")
    answers = false.select("story_id", F.col("c.claim_id").alias("claim_id"), F.lit(1).alias("y"), F.lit(0.5).alias("p"), F.lit("K").alias("env"), (F.col("c.introduced_at").cast("long") + supplier % 3).cast("string").alias("recognized_at"))
    rows = stories.recognition_rows(table, answers)
    return rows.select("item_id", "claim_id", "source_anchor", "contradiction_available_at", "recognized_at", "recognition_lag", "fair_play_rating")


@query(
    f"""WITH {_STORIES}, r AS (SELECT story_id, count(*) AS claim_count, count(*) FILTER (rating = 'fair') AS fair_count, count(*) FILTER (rating = 'partial') AS partial_count, count(*) FILTER (rating = 'unfair') AS unfair_count FROM judged GROUP BY 1)
    SELECT told.story_id, coalesce(claim_count, 0) AS claim_count, coalesce(fair_count, 0) AS fair_count, coalesce(partial_count, 0) AS partial_count, coalesce(unfair_count, 0) AS unfair_count,
    CASE WHEN claim_count IS NULL THEN 'no_claims' WHEN claim_count = fair_count THEN 'fair' WHEN unfair_count > 0 THEN 'unfair' ELSE 'partial' END AS rating FROM told LEFT JOIN r USING (story_id)"""
)
def story_fair_play(spark, sf_dir):
    return stories.fair_play_by_story(P.stories(spark, sf_dir)).select("story_id", "claim_count", "fair_count", "partial_count", "unfair_count", "rating")


@query(f"WITH {_STORIES} SELECT story_id, 'claim' AS artifact_kind, claim_id AS artifact_id, 'line ' || spot AS current_narrative_anchor, 'needs_review' AS review_status FROM lines UNION ALL SELECT story_id, 'decisive_evidence', evidence_id, 'line ' || spot, 'needs_review' FROM lines WHERE shown")
def anchor_review_template(spark, sf_dir):
    return stories.anchor_review_template(P.stories(spark, sf_dir)).select("story_id", "artifact_kind", "artifact_id", "current_narrative_anchor", "review_status")


@query(
    f"""WITH {_STORIES}, s AS (SELECT sum(CASE rating WHEN 'fair' THEN 1 ELSE 0 END)::BIGINT AS fair_count, sum(CASE rating WHEN 'partial' THEN 1 ELSE 0 END)::BIGINT AS partial_count, sum(CASE rating WHEN 'unfair' THEN 1 ELSE 0 END)::BIGINT AS unfair_count, count(*) AS claim_count FROM judged)
    SELECT *, CASE WHEN claim_count = 0 THEN 'no_claims' WHEN claim_count = fair_count THEN 'fair' WHEN unfair_count > 0 THEN 'unfair' ELSE 'partial' END AS rating FROM s"""
)
def fair_play_rollup(spark, sf_dir):
    return temporal.fair_play_rating(stories.fair_play(P.stories(spark, sf_dir)))


# ------------------------------------------------------------------ collection of rows

_CONDITIONS, _PHASES, _SUBJECTS = ["plain", "Guided Reading"], ["before", "after"], 2


def _sheets(spark, sf_dir):
    """A template row for every part, condition and phase; then a sheet per condition and subject."""
    part = P.table(spark, sf_dir, "part")
    claims = part.select(F.col("p_brand").alias("item_id"), F.concat(F.lit("part::"), F.col("p_partkey").cast("string")).alias("claim_id"), F.lit("a").alias("source_anchor"), F.lit("3").alias("contradiction_available_at"), F.lit("fair").alias("fair_play_rating"))
    rows = experiment.collection_template(claims, _CONDITIONS, _PHASES, ["fair"], experiment_id="x")
    return experiment.run_sheets(rows, "run", subjects=_SUBJECTS, seed=7)


_SHEETS = """
sheets AS (
  SELECT 'run-' || kind || '-0' || s AS run_id, 'subject-' || kind || '-0' || s AS subject_id, condition, phase, p_brand AS item_id, 'part::' || p_partkey AS claim_id,
         row_number() OVER (PARTITION BY kind, s ORDER BY sha256('7:' || condition || ':' || s || ':' || phase || ':' || p_brand || ':part::' || p_partkey), phase, p_brand, 'part::' || p_partkey) AS place
  FROM part CROSS JOIN (VALUES ('plain', 'plain'), ('Guided Reading', 'guided-reading')) c(condition, kind) CROSS JOIN (VALUES ('before'), ('after')) p(phase) CROSS JOIN (VALUES (1), (2)) u(s))
"""


@query(f"WITH {_SHEETS} SELECT * FROM sheets")
def run_sheets(spark, sf_dir):
    return rounded(_sheets(spark, sf_dir).select("run_id", "subject_id", "condition", "phase", "item_id", "claim_id", "place"))


@query(f"WITH {_SHEETS} SELECT run_id, item_id, phase, run_id || '::' || lpad(place::VARCHAR, greatest(3, len(place::VARCHAR))::INT, '0') AS row_key FROM sheets")
def blinded_rows(spark, sf_dir):
    return experiment.blind(_sheets(spark, sf_dir))[0].select("run_id", "item_id", "phase", "row_key")


@query(f"WITH {_SHEETS} SELECT run_id, condition, count(*) AS n, 0::BIGINT AS lost FROM sheets GROUP BY 1, 2")
def unblinded_counts(spark, sf_dir):
    public, key = experiment.blind(_sheets(spark, sf_dir))
    rows, lost = experiment.unblind(public, key)
    return rows.groupBy("run_id", "condition").agg(F.count(F.lit(1)).alias("n")).crossJoin(lost.agg(F.count(F.lit(1)).alias("lost")))  # one row


@query(
    """WITH r AS (SELECT event_type AS condition, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'p' END AS phase, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN '1' ELSE '2' END AS y, value / 400 AS p, CASE WHEN event_id % 4 = 0 THEN '' ELSE 't' END AS response,
             CASE WHEN user_id % 2 = 0 THEN '' ELSE '9' END AS recognized_at, CASE WHEN user_id % 3 = 0 THEN '' WHEN user_id % 3 = 1 THEN '2' ELSE '7' END AS recognition_lag FROM events)
    SELECT severity, code, n FROM (
      SELECT 'error' AS severity, 'missing_required_g_collection_field' AS code, count(*) AS n FROM r WHERE phase = '' UNION ALL SELECT 'error', 'missing_completed_g_field', count(*) FROM r WHERE y = ''
      UNION ALL SELECT 'warning', 'missing_response_text', count(*) FROM r WHERE response = '' UNION ALL SELECT 'error', 'invalid_y_value', count(*) FROM r WHERE y = '2'
      UNION ALL SELECT 'error', 'invalid_probability_value', count(*) FROM r WHERE p NOT BETWEEN 0 AND 1 UNION ALL SELECT 'warning', 'positive_recognition_missing_time', count(*) FROM r WHERE y = '1' AND recognized_at = ''
      UNION ALL SELECT 'warning', 'missing_recognition_lag', count(*) FROM r WHERE recognized_at != '' AND recognition_lag = '' UNION ALL SELECT 'warning', 'recognition_lag_mismatch', count(*) FROM r WHERE recognized_at != '' AND recognition_lag = '2') WHERE n > 0"""
)
def row_finding_counts(spark, sf_dir):
    e, pick = P.table(spark, sf_dir, "events"), lambda *kv: F.when(kv[0], kv[1]).otherwise(kv[2])
    id_, user = F.col("event_id"), F.col("user_id")
    rows = e.select(
        F.lit("r").alias("run_id"), F.lit("s").alias("subject_id"), F.col("event_type").alias("condition"), pick(id_ % 5 == 0, "", "p").alias("phase"), id_.cast("string").alias("item_id"), F.lit("c").alias("claim_id"), F.lit("K").alias("env"),
        F.when(id_ % 3 == 0, "").when(id_ % 3 == 1, "1").otherwise("2").alias("y"), (F.col("value") / 400).alias("p"), F.lit("x").alias("answer"), pick(id_ % 4 == 0, "", "t").alias("response"), F.lit("a").alias("source_anchor"),
        pick(user % 2 == 0, "", "9").alias("recognized_at"), F.lit("2").alias("contradiction_available_at"), F.when(user % 3 == 0, "").when(user % 3 == 1, "2").otherwise("7").alias("recognition_lag"), F.lit("fair").alias("fair_play_rating"),
    )
    return experiment.row_findings(rows).groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ ledgers, posteriors, assessments


@query(
    f"""WITH {_EDGES}, p AS (SELECT * FROM (VALUES ('neutral', 1.0, 1.0), ('skeptical', 1.0, 2.0), ('supportive', 2.0, 1.0), ('source_conservative', 1.0, 3.0), ('adversarial_aware', 1.0, 4.0), ('own', 2.5, 0.5)) x(prior, alpha, beta)),
    q AS (SELECT ledger, prior, success + alpha AS a, failure + beta AS b FROM totals CROSS JOIN p)
    SELECT ledger, prior, round(a / (a + b), 6) AS mean, round(greatest(a / (a + b) - 1.644854 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 0), 6) AS lower, round(least(a / (a + b) + 1.644854 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 1), 6) AS upper FROM q"""
)
def posterior_by_profile(spark, sf_dir):
    """Posteriors of every claim under all named profiles and one of its own, at a credibility of 0.9."""
    graph = P.evidence(spark, sf_dir, concepts=False)
    units = ledger.ledger_units(graph, graph.nodes.where("type = 'claim'").select("id"))
    chosen = {n: n for n in ("neutral", "skeptical", "supportive", "Source-Conservative", "adversarial_aware")}
    made = bayesian.by_profile(bayesian.evidence_totals(units.where("stance IN ('support', 'challenge', 'revision')")), {k.lower().replace("-", "_"): v for k, v in chosen.items()} | {"own": (2.5, 0.5)}, 0.9)
    return rounded(made.select("ledger", "prior", "mean", "lower", "upper"))


@query(
    """WITH r AS (SELECT l_linenumber, l_suppkey, l_partkey, l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT CASE WHEN l_linenumber = 1 THEN 'own:' || l_orderkey WHEN l_linenumber IN (2, 3) THEN 'evidence:artifact-fragment:' || sha256('{"artifact_id":"' || l_partkey || '","fragment_id":"' || l_suppkey || '"}')
    WHEN l_linenumber IN (4, 5) THEN 'evidence:graph-edge:' || l_orderkey || '->' || l_partkey ELSE 'evidence:provenance:' || sha256('{"part":' || l_partkey || ',"source":"s' || l_suppkey || '"}') END AS identity, sum(n)::BIGINT AS n FROM r GROUP BY 1"""
)
def evidence_identity_branches(spark, sf_dir):
    """All four ways to an identity, by line number."""
    line, k = P.table(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    text_ = lambda c: F.col(c).cast("string")
    none = F.lit("")
    provenance = F.concat(F.lit('{"source": "s'), text_("l_suppkey"), F.lit('", "part": '), text_("l_partkey"), F.lit("}"))
    made = ledger.evidence_identity(
        F.when(k == 1, F.concat(F.lit("own:"), text_("l_orderkey"))).otherwise(none), F.when(k <= 3, text_("l_partkey")).otherwise(none), F.when(k <= 3, text_("l_suppkey")).otherwise(none),
        F.when(k.isin(4, 5), F.concat(text_("l_orderkey"), F.lit("->"), text_("l_partkey"))).otherwise(none), provenance,
    )
    return line.select(made.alias("identity")).groupBy("identity").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_EDGES}, r AS (SELECT target AS ledger, stance, confidence * 0.5 AS w FROM ev)
    SELECT ledger, count(*) FILTER (stance = 'support') AS raw_support_count, count(*) FILTER (stance = 'challenge') AS raw_challenge_count, round(coalesce(sum(w) FILTER (stance = 'support'), 0), 6) AS raw_support_weight,
    round(coalesce(sum(w) FILTER (stance = 'challenge'), 0), 6) AS raw_challenge_weight FROM r GROUP BY 1"""
)
def ledger_from_edges(spark, sf_dir):
    """Ledgers of edges chosen by their target, with half the edge's confidence as weight."""
    graph = P.evidence(spark, sf_dir, concepts=False)
    kind = F.when(F.col("type") == "contradicts", "challenge").when(F.col("type") == "qualifies", "revision").otherwise("support")
    units = ledger.ledger_from_edges(graph, graph.edges.select(F.col("target").alias("ledger"), kind.alias("stance"), "pos"), F.col("raw_weight") * 0.5)
    counts = ledger.ledger_counts(units, F.struct(bayesian.stance_rank(F.col("stance")), F.col("pos")))
    return rounded(counts.select("ledger", "raw_support_count", "raw_challenge_count", "raw_support_weight", "raw_challenge_weight"))


@query(
    """WITH a AS (SELECT 'a' || (l_orderkey * 8 + l_linenumber) AS id, CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE 'm' END AS name, CASE WHEN l_partkey % 5 = 0 THEN 'a' || (l_orderkey * 8 + l_linenumber + 100000000) ELSE '' END AS old FROM lineitem)
    SELECT code, n FROM (SELECT 'duplicate_assessment_id' AS code, count(*) AS n FROM (SELECT id FROM a GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'missing_assessment_method', count(*) FROM a WHERE name = ''
    UNION ALL SELECT 'dangling_assessment_supersession', count(*) FROM a WHERE old != '') WHERE n > 0"""
)
def lineage_finding_counts(spark, sf_dir):
    number = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    rows = P.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("a"), number.cast("string")).alias("assessment_id"), F.struct(F.when(F.col("l_suppkey") % 7 == 0, "").otherwise("m").alias("name"), F.lit("1").alias("version")).alias("method"),
        F.when(F.col("l_partkey") % 5 == 0, F.concat(F.lit("a"), (number + 100_000_000).cast("string"))).otherwise("").alias("supersedes_assessment_id"),
    )
    return confidence.lineage_findings(rows).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT unnest(CASE WHEN (SELECT count(*) FROM events WHERE ts < TIMESTAMP '2024-01-16' AND event_type = 'none') = 0 THEN ['mixed_evaluation_targets', 'no_clean_rows'] ELSE ['mixed_evaluation_targets'] END) AS code")
def g_comparison_warnings(spark, sf_dir):
    """Summaries of every condition, each with a target of its own, and one without clean rows."""
    rows = P.g_rows(spark, sf_dir)
    made = gmetric.g_estimate(rows.unionByName(rows.where("condition = 'click' AND env = 'K'").withColumn("condition", F.lit("late"))), ["condition"])
    return gmetric.comparison_warnings(made.select(F.col("condition").alias("evaluation_target"), F.lit("events").alias("corpus"), "n_clean", "n_target", F.array().cast("array<string>").alias("warnings")))


# ------------------------------------------------------------------ open metadata, GEDCOM, order, cycles


@query(
    """SELECT 'supplier::' || s_suppkey AS id, CASE s_nationkey % 3 WHEN 0 THEN 'peer_reviewed' WHEN 1 THEN 'low,mixed' ELSE '' END AS quality, s_nationkey % 3 = 1 AS adversarial, CASE WHEN s_nationkey % 3 = 2 THEN '' ELSE 'n' || s_nationkey END AS artifact,
    CASE s_nationkey % 3 WHEN 0 THEN 'datetime' WHEN 1 THEN 'numeric' END AS time_kind FROM supplier"""
)
def json_metadata(spark, sf_dir):
    """Metadata as JSON text: a text or a list of qualities, true booleans only, a date, a number or no time."""
    k = F.col("s_nationkey") % 3
    artifact = F.concat(F.lit('"artifact_id":"n'), F.col("s_nationkey").cast("string"), F.lit('"'))
    made = (
        F.when(k == 0, F.concat(F.lit('{"source_quality":" Peer_Reviewed ","adversarial":"true","available_at":"2020-01-02",'), artifact, F.lit("}")))
        .when(k == 1, F.concat(F.lit('{"source_reliability":["Low","","mixed"],"adversarial":true,"timestep":7,"source_quality":3,'), artifact, F.lit("}")))
        .otherwise(F.lit('{"source_quality":[],"adversarial":null,"available_at":"soon"}'))
    )
    rows = P.table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier::"), F.col("s_suppkey").cast("string")).alias("id"), made.alias("metadata"))
    meta = Meta.of(rows)
    quality = F.array_join(meta.words(("source_quality", "source_reliability", "trust_status")), ",")
    return rows.select("id", quality.alias("quality"), meta.is_true("adversarial").alias("adversarial"), F.coalesce(meta.text("artifact_id"), F.lit("")).alias("artifact"), meta.first_time(("available_at", "timestep"))["kind"].alias("time_kind"))


@query(
    """SELECT component, type, n FROM (SELECT 'node' AS component, 'person_candidate' AS type, count(*) AS n FROM customer UNION ALL SELECT 'node', 'event_claim', count(*) FROM customer
    UNION ALL SELECT 'node', 'source_record', count(*) FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'node', 'relationship_claim', count(*) FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT 'edge', 'about_person', count(*) FROM customer UNION ALL SELECT 'edge', 'supports', count(*) FROM customer WHERE c_custkey % 2 = 0
    UNION ALL SELECT 'edge', 'relationship_participant', 2 * count(*) FROM customer WHERE c_custkey % 3 = 0) WHERE n > 0"""
)
def gedcom_counts(spark, sf_dir):
    """A file for each customer: a person with a birth, some with a cited source, some as parent of the next."""
    c, text_ = P.table(spark, sf_dir, "customer"), F.col("c_custkey").cast("string")
    cites, parent = F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 3 == 0
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("\n"))
    value = F.concat(
        line("0 @I", text_, "@ INDI"), line("1 NAME ", F.col("c_name"), " /X/"), line("1 BIRT"), line("2 DATE 1 JAN 1900"), F.when(cites, line("2 SOUR @S", text_, "@")).otherwise(""), F.when(cites, line("0 @S", text_, "@ SOUR")).otherwise(""),
        F.when(parent, F.concat(line("0 @F", text_, "@ FAM"), line("1 HUSB @I", text_, "@"), line("1 CHIL @I", (F.col("c_custkey") + 1).cast("string"), "@"))).otherwise(""),
    )
    graph = gedcom.graph_of(gedcom.parsed_lines(c.select(text_.alias("file"), value.alias("value"))), "g")
    count = lambda df, name: df.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("component"), "type", "n")
    return count(graph.nodes, "node").unionByName(count(graph.edges, "edge"))


@query(
    """WITH e AS (SELECT event_id, event_type, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events),
    l AS (SELECT 0 AS part, event_id AS pos, '  "event::' || event_id || '" [label="' || event_type || '", type="event"];' AS line FROM e UNION ALL SELECT 1, event_id, '  "event::' || event_id || '" -> "event::' || nxt || '" [label="follows"];' FROM e WHERE nxt IS NOT NULL)
    SELECT row_number() OVER (ORDER BY part, pos) - 1 AS place, line FROM l"""
)
def dot_order(spark, sf_dir):
    """The lines of a DOT document with their places; positions are numbers."""
    return export.in_order(export.dot_lines(P.chain(spark, sf_dir))).select("place", "line")


_RINGS = "b AS (SELECT p_partkey // 5 AS block, arg_min(p_size, p_partkey) < 25 AS cyclic, arg_min(p_brand, p_partkey) AS brand, min(p_partkey) AS first FROM part GROUP BY 1)"


def _rings(spark, sf_dir):
    """Parts in blocks of five, each pointing to the next, the last back to the first where that is small; the first also points to its brand."""
    part = P.table(spark, sf_dir, "part")
    block = F.floor(F.col("p_partkey") / 5)
    ends = part.groupBy(block.alias("block")).agg(F.min("p_partkey").alias("first"), F.max("p_partkey").alias("last"), F.min_by("p_size", "p_partkey").alias("size"), F.min_by("p_brand", "p_partkey").alias("brand"))
    ident = lambda c: F.concat(F.lit("part::"), F.col(c).cast("string"))
    brand = F.concat(F.lit("brand::"), F.col("brand"))
    following = part.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"), block.alias("block")).join(ends, "block").where("b <= last").select(ident("a").alias("source"), ident("b").alias("target"))
    back = ends.where("size < 25").select(ident("last").alias("source"), ident("first").alias("target"))
    out = ends.select(ident("first").alias("source"), brand.alias("target"))
    edges = following.unionByName(back).unionByName(out).withColumns({"type": F.lit("next"), "pos": F.concat("source", "target")})
    nodes = part.select(ident("p_partkey").alias("id")).unionByName(ends.select(brand.alias("id")).distinct()).withColumns({"type": F.lit("part"), "pos": F.col("id")})
    return Graph(nodes, edges, unique_ids=True)


@query(
    f"""WITH {_RINGS}
    SELECT 'part::' || p_partkey AS id FROM part JOIN b ON block = p_partkey // 5 WHERE cyclic UNION SELECT 'brand::' || brand FROM b WHERE cyclic"""
)
def cycle_nodes(spark, sf_dir):
    """Members of rings, and the brands behind them."""
    return traversal.cycle_nodes(_rings(spark, sf_dir))


@query(
    f"""WITH {_RINGS}
    SELECT 'part::' || p_partkey AS id, CASE WHEN cyclic THEN min('part::' || p_partkey) OVER (PARTITION BY p_partkey // 5) ELSE 'part::' || p_partkey END AS component FROM part JOIN b ON block = p_partkey // 5
    UNION SELECT 'brand::' || brand, 'brand::' || brand FROM b"""
)
def strong_components(spark, sf_dir):
    return strong.strong_components(_rings(spark, sf_dir))


@query(f"WITH {_SUPPLY} SELECT target AS node_id, 'in' AS direction, source AS neighbor, 'located_in' AS edge_type FROM se UNION ALL SELECT source, 'out', target, 'located_in' FROM se")
def neighborhood(spark, sf_dir):
    graph = P.supply(spark, sf_dir)
    return traversal.neighborhood(graph, graph.nodes.select("id")).drop("pos")


@query(f"WITH {_SUPPLY} SELECT source, target FROM se")
def incoming_edges(spark, sf_dir):
    graph = P.supply(spark, sf_dir)
    return traversal.incoming(graph, graph.nodes.select("id")).select("source", "target")
