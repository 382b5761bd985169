"""Registered queries over the driver's tables and their SQL equivalents. Doubles are rounded to 6 digits on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions import confidence, text, timekey
from evigraph.operators import bayesian, calibration, epistemic, gmetric, ledger, strong, structure, temporal, traversal, validation
from evigraph.plans import projections as P
from evigraph.schema import CHALLENGE, PRIORS
from evigraph.sources import export

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(F.col(c), 6) if t == "double" else F.col(c).cast("long") if t in ("int", "bigint") else F.col(c)).alias(c) for c, t in df.dtypes])


# ------------------------------------------------------------------ SQL fragments

_EDGES = """
ev AS (
  SELECT 'supplier::' || l_suppkey AS source, 'part::' || l_partkey AS target,
         CASE l_returnflag WHEN 'R' THEN 'contradicts' WHEN 'A' THEN 'qualifies' ELSE 'supports_claim' END AS type,
         CASE l_returnflag WHEN 'R' THEN 'challenge' WHEN 'A' THEN 'revision' ELSE 'support' END AS stance,
         CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 0 END AS rank,
         l_orderkey || ':' || l_partkey || ':' || l_suppkey || ':' || l_linenumber || ':' || CAST(round(l_extendedprice * 100) AS BIGINT) AS id,
         l_quantity / 50 AS confidence, CAST(l_shipdate AS DATE) AS day, l_suppkey, l_partkey
  FROM lineitem),
quality AS (SELECT s_suppkey, [1.0, 0.65, 0.2][s_nationkey % 3 + 1] AS q, ['peer_reviewed', 'secondary', 'low'][s_nationkey % 3 + 1] AS word FROM supplier),
weighted AS (SELECT ev.*, least(greatest(confidence, 0), 1) * q * 1.0 * 0.85 AS w FROM ev JOIN quality ON s_suppkey = l_suppkey),
winners AS (SELECT * FROM weighted QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY rank, id) = 1),
counts AS (SELECT target AS ledger, count(*) FILTER (stance = 'support') AS support_edges, count(*) FILTER (stance = 'challenge') AS challenge_edges FROM weighted GROUP BY 1),
totals AS (
  SELECT target AS ledger, coalesce(sum(w) FILTER (stance = 'support'), 0) AS success, coalesce(sum(w) FILTER (stance = 'challenge'), 0) AS failure,
         coalesce(sum(w) FILTER (stance = 'revision'), 0) AS revision
  FROM winners GROUP BY 1),
post AS (
  SELECT t.*, support_edges, challenge_edges, success + 1 AS a, failure + 1 AS b, success + failure AS effective_n
  FROM totals t JOIN counts USING (ledger)),
post2 AS (
  SELECT *, a / (a + b) AS mean, a * b / ((a + b) * (a + b) * (a + b + 1)) AS variance FROM post),
post3 AS (
  SELECT *, least(greatest(mean - 1.959964 * sqrt(variance), 0), 1) AS lower, least(greatest(mean + 1.959964 * sqrt(variance), 0), 1) AS upper,
         greatest((success + 1) / (effective_n + 2), (success + 1) / (effective_n + 3), (success + 2) / (effective_n + 3), (success + 1) / (effective_n + 4), (success + 1) / (effective_n + 5))
         - least((success + 1) / (effective_n + 2), (success + 1) / (effective_n + 3), (success + 2) / (effective_n + 3), (success + 1) / (effective_n + 4), (success + 1) / (effective_n + 5)) AS mean_range
  FROM post2),
labelled AS (
  SELECT *, effective_n < 2 AS thin, upper - lower >= 0.45 AS wide, mean_range >= 0.2 AS swayed, support_edges > 0 AND challenge_edges > 0 AS mixed FROM post3),
classified AS (
  SELECT *, CASE WHEN thin THEN 'thin_evidence' WHEN swayed THEN 'prior_sensitive' WHEN mean BETWEEN 0.35 AND 0.65 AND mixed THEN 'contested'
                 WHEN mean >= 0.75 AND NOT (thin OR wide OR swayed OR mixed) THEN 'stable_support' WHEN mean >= 0.65 THEN 'fragile_support'
                 WHEN mixed THEN 'contested' ELSE 'thin_evidence' END AS bayesian_label,
         concat_ws(',', CASE WHEN thin THEN 'thin_evidence' END, CASE WHEN wide THEN 'wide_interval' END, CASE WHEN swayed THEN 'prior_sensitive' END,
                   CASE WHEN mixed THEN 'mixed_support_challenge' END) AS bayesian_flags
  FROM labelled)
"""
_SUPPLY = """
sn AS (
  SELECT 'region::' || r_regionkey AS id, 'region' AS type, r_name AS title FROM region UNION ALL SELECT 'nation::' || n_nationkey, 'nation', n_name FROM nation
  UNION ALL SELECT 'supplier::' || s_suppkey, 'supplier', s_name FROM supplier UNION ALL SELECT 'customer::' || c_custkey, 'customer', c_name FROM customer),
se AS (
  SELECT 'nation::' || n_nationkey AS source, 'region::' || n_regionkey AS target FROM nation UNION ALL SELECT 'supplier::' || s_suppkey, 'nation::' || s_nationkey FROM supplier
  UNION ALL SELECT 'customer::' || c_custkey, 'nation::' || c_nationkey FROM customer),
su AS (SELECT source AS a, target AS b FROM se UNION SELECT target, source FROM se)
"""
_G = r"""
g AS (
  SELECT CAST(user_id AS VARCHAR) AS subject_id, event_type AS condition, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'C' ELSE 'K' END AS env,
         CASE WHEN CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) >= 50 THEN 1 ELSE 0 END AS y, least(value / 500, 1) AS p,
         CAST(user_id % 3 AS VARCHAR) AS level, CASE WHEN user_id % 2 = 0 THEN 'before' ELSE 'after' END AS phase
  FROM events),
"""


def _g_sql(key: str) -> str:
    """CTE est: G and its parts by key over g."""
    return f"""{_G}
ranked AS (SELECT {key} AS k, env, y, p, rank() OVER (PARTITION BY {key}, env ORDER BY p) + (count(*) OVER (PARTITION BY {key}, env, p) - 1) / 2.0 AS rk FROM g),
env_stats AS (
  SELECT k, env, count(*) AS n, sum(y) AS pos, avg((p - y) * (p - y)) AS brier,
         CASE WHEN sum(y) = 0 OR sum(y) = count(*) THEN 0.5 ELSE (sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) END AS auc
  FROM ranked GROUP BY k, env),
wide AS (
  SELECT k, coalesce(max(n) FILTER (env = 'K'), 0) AS n_target, coalesce(max(n) FILTER (env = 'C'), 0) AS n_clean, max(brier) FILTER (env = 'K') AS brier, max(auc) FILTER (env = 'K') AS auc_t,
         max(auc) FILTER (env = 'C') AS auc_c, max(pos) FILTER (env = 'K') * 1.0 / max(n) FILTER (env = 'K') AS prev
  FROM env_stats GROUP BY k),
est AS (
  SELECT k, n_target, n_clean, least(greatest(1 - brier / greatest(prev * (1 - prev), 1e-12), 0), 1) AS st, least(greatest((auc_t - 0.5) / 0.5, 0), 1) AS sd,
         least(greatest(1 - (auc_c - auc_t) / greatest(auc_c - 0.5, 1e-12), 0), 1) AS sr
  FROM wide),
gs AS (SELECT k, CASE WHEN n_target > 0 AND n_clean > 0 THEN (st + sd + sr) / 3 ELSE 0 END AS g_value, st, sd, sr, n_target, n_clean FROM est)"""


# ------------------------------------------------------------------ evidence and posteriors


def _units(spark, sf_dir):
    graph = P.evidence(spark, sf_dir, concepts=False)
    return ledger.weighted_edges(graph).withColumn("ledger", F.col("target"))


def _totals(spark, sf_dir):
    return bayesian.evidence_totals(_units(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT ledger, round(success, 6) AS success, round(failure, 6) AS failure, round(mean, 6) AS mean, round(variance, 6) AS variance, round(lower, 6) AS lower, round(upper, 6) AS upper, CASE WHEN effective_n < 1 OR upper - lower >= 0.6 THEN 'fragile' WHEN upper - lower >= 0.35 THEN 'moderate' ELSE 'stable' END AS stability FROM post3")
def bayes_posterior_by_claim(spark, sf_dir):
    return rounded(bayesian.with_posterior(_totals(spark, sf_dir)).select("ledger", "success", "failure", "mean", "variance", "lower", "upper", "stability"))


@query(
    f"WITH {_EDGES} SELECT ledger, "
    + ", ".join(f"round((success + {a}) / (effective_n + {a + b}), 6) AS mean_{n}" for n, (a, b) in PRIORS.items())
    + ", round(mean_range, 6) AS mean_range FROM post3"
)
def bayes_prior_sensitivity(spark, sf_dir):
    return rounded(bayesian.prior_means(_totals(spark, sf_dir)).select("ledger", *[f"mean_{n}" for n in PRIORS], "mean_range"))


@query(f"WITH {_EDGES} SELECT ledger, bayesian_label, bayesian_flags, round(mean, 6) AS mean, round(upper - lower, 6) AS width, support_edges, challenge_edges FROM classified")
def bayes_classification(spark, sf_dir):
    return rounded(bayesian.classified(_totals(spark, sf_dir)).select("ledger", "bayesian_label", F.array_join("bayesian_flags", ",").alias("bayesian_flags"), "mean", "width", "support_edges", "challenge_edges"))


@query(f"WITH {_EDGES} SELECT bayesian_label, count(*) AS n FROM classified GROUP BY 1")
def bayes_label_counts(spark, sf_dir):
    return bayesian.classified(_totals(spark, sf_dir)).groupBy("bayesian_label").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_EDGES} SELECT id AS edge_key, stance, round(confidence, 6) AS raw_weight, round(w, 6) AS bayes_weight FROM weighted")
def evidence_weight_multipliers(spark, sf_dir):
    return rounded(_units(spark, sf_dir).select("edge_key", "stance", "raw_weight", "bayes_weight"))


@query(f"WITH {_EDGES} SELECT id AS edge_key, sha256('{{\"artifact_id\":\"' || l_partkey || '\",\"fragment_id\":\"' || l_suppkey || '\"}}') AS dedup_key FROM weighted")
def evidence_identity(spark, sf_dir):
    return _units(spark, sf_dir).select("edge_key", "dedup_key")


@query(
    f"""WITH {_EDGES}, first AS (SELECT * FROM weighted QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY id) = 1),
    raw AS (SELECT target AS ledger, count(*) FILTER (stance = 'support') AS raw_support_count, count(*) FILTER (stance = 'challenge') AS raw_challenge_count, count(*) FILTER (stance = 'revision') AS raw_revision_count,
      coalesce(sum(confidence) FILTER (stance = 'support'), 0) AS rs FROM weighted GROUP BY 1),
    d AS (SELECT target AS ledger, count(*) FILTER (stance = 'support') AS dedup_support_count, count(*) FILTER (stance = 'challenge') AS dedup_challenge_count, count(*) FILTER (stance = 'revision') AS dedup_revision_count,
      coalesce(sum(confidence) FILTER (stance = 'support'), 0) AS ds FROM first GROUP BY 1)
    SELECT ledger, raw_support_count, raw_challenge_count, raw_revision_count, dedup_support_count, dedup_challenge_count, dedup_revision_count, round(rs, 6) AS raw_support_weight, round(ds, 6) AS dedup_support_weight
    FROM raw JOIN d USING (ledger)"""
)
def ledger_dedup_counts(spark, sf_dir):
    graph = P.evidence(spark, sf_dir, concepts=False)
    units = ledger.ledger_units(graph, graph.nodes.where("type = 'claim'").select("id"))
    out = ledger.ledger_counts(units, F.col("pos"))
    return rounded(out.select("ledger", *[f"{w}_{s}_count" for w in ("raw", "dedup") for s in ("support", "challenge", "revision")], "raw_support_weight", "dedup_support_weight"))


@query(
    f"""WITH {_EDGES}, first AS (SELECT * FROM weighted QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY id) = 1),
    m AS (SELECT l_partkey, l_suppkey, count(*) AS merged, string_agg(id, ',' ORDER BY id) AS referring FROM weighted GROUP BY 1, 2)
    SELECT target AS ledger, 'evidence:graph-edge:' || id AS unit_id, stance, round(confidence, 6) AS weight, merged, referring FROM first JOIN m USING (l_partkey, l_suppkey)"""
)
def ledger_units_deduplicated(spark, sf_dir):
    graph = P.evidence(spark, sf_dir, concepts=False)
    units = ledger.deduplicate(ledger.ledger_units(graph, graph.nodes.where("type = 'claim'").select("id")), F.col("pos"))
    return rounded(units.select("ledger", "unit_id", "stance", "weight", "merged", F.array_join("referring_edges", ",").alias("referring")))


@query(f"WITH {_EDGES} SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'legacy_edge_confidence' ELSE 'missing_weight_default' END AS weight_rule, count(*) AS n FROM weighted GROUP BY 1")
def ledger_missing_weight(spark, sf_dir):
    graph = P.evidence(spark, sf_dir, concepts=False)
    edges = graph.edges.withColumn("confidence", F.when(F.col("metadata.fragment_id").cast("long") % 2 == 0, F.col("confidence")))
    weights = ledger.weighted_edges(type(graph)(graph.nodes, edges, unique_ids=True))
    return weights.groupBy("weight_rule").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ epistemic summaries

_SUMMARY = f"""WITH {_EDGES},
 hood AS (SELECT 'part::' || p_partkey AS target, 'brand::' || p_brand AS brand, p_size / 50 AS confidence FROM part),
 e AS (SELECT target, count(*) FILTER (stance = 'support') AS support_count, count(*) FILTER (stance = 'challenge') AS challenge_count, count(*) FILTER (stance = 'revision') AS revision_count FROM weighted GROUP BY 1),
 src AS (SELECT DISTINCT target, l_suppkey, word FROM weighted JOIN quality ON s_suppkey = l_suppkey),
 q AS (SELECT target, count(*) AS qn, count(*) FILTER (word = 'peer_reviewed') AS hi, count(*) FILTER (word = 'secondary') AS mid, count(*) FILTER (word = 'low') AS lo FROM src GROUP BY 1),
 parts AS (
  SELECT h.target, coalesce(support_count, 0) AS support_count, coalesce(challenge_count, 0) AS challenge_count, coalesce(revision_count, 0) AS revision_count, coalesce(qn, 0) AS qn, coalesce(lo, 0) AS lo,
    CASE WHEN coalesce(qn, 0) > 0 THEN (hi + 0.55 * mid + 0.1 * lo) / qn ELSE 0.5 END AS quality, h.confidence
  FROM hood h LEFT JOIN e USING (target) LEFT JOIN q USING (target)),
 scored AS (
  SELECT *, least(greatest(0.25 * 0.35 + 0.25 * least(1.0, support_count / 3.0) + 0.18 * confidence + 0.12 * 0 + 0.12 * quality + least(0.15, revision_count * 0.05) - least(0.35, challenge_count * 0.12), 0), 1) AS s FROM parts)
"""


@query(
    _SUMMARY
    + """SELECT target, support_count, challenge_count, revision_count, round(s, 6) AS reliability_score, CASE WHEN s >= 0.75 THEN 'strong' WHEN s >= 0.5 THEN 'moderate' WHEN s >= 0.3 THEN 'weak' ELSE 'poor' END AS reliability_band,
    concat_ws(',', CASE WHEN support_count = 0 THEN 'no_direct_support' END, CASE WHEN challenge_count > 0 THEN 'challenged' END, CASE WHEN revision_count > 0 THEN 'revised_or_qualified' END,
      CASE WHEN confidence < 0.5 THEN 'low_confidence' END, CASE WHEN lo > 0 THEN 'low_trust_source_signal' END) AS flags FROM scored"""
)
def epistemic_summary(spark, sf_dir):
    out = epistemic.summaries(P.evidence(spark, sf_dir), node_types=("claim",), posterior=False)
    return rounded(out.select("target", "support_count", "challenge_count", "revision_count", "reliability_score", "reliability_band", F.array_join("flags", ",").alias("flags")))


@query(
    """SELECT 'brand::' || p_brand AS target, count(*) AS claims, sum(n_support)::BIGINT AS support_count, sum(n_challenge)::BIGINT AS challenge_count, sum(n_revision)::BIGINT AS revision_count
    FROM (SELECT p_brand, p_partkey, 1 + count(*) FILTER (l_returnflag NOT IN ('R', 'A')) AS n_support, count(*) FILTER (l_returnflag = 'R') AS n_challenge, count(*) FILTER (l_returnflag = 'A') AS n_revision
          FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2
          UNION ALL SELECT p_brand, p_partkey, 1, 0, 0 FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)) GROUP BY 1"""
)
def concept_summary(spark, sf_dir):
    graph = P.evidence(spark, sf_dir)
    out = epistemic.summaries(graph, node_types=("concept",), posterior=False)
    claims = epistemic.claim_members(graph, graph.nodes.where("type = 'concept'").select("id")).groupBy("target").agg(F.count(F.lit(1)).alias("claims"))
    return rounded(out.join(claims, "target").select("target", "claims", "support_count", "challenge_count", "revision_count"))


@query("SELECT 'brand::' || p_brand AS target, 'part::' || p_partkey AS claim FROM part")
def concept_claim_membership(spark, sf_dir):
    graph = P.evidence(spark, sf_dir)
    return epistemic.claim_members(graph, graph.nodes.where("type = 'concept'").select("id"))


@query(
    _SUMMARY
    + """SELECT kind, name, count(*) AS n FROM (
      SELECT 'flag' AS kind, unnest(list_filter([CASE WHEN support_count = 0 THEN 'no_direct_support' END, CASE WHEN challenge_count > 0 THEN 'challenged' END, CASE WHEN revision_count > 0 THEN 'revised_or_qualified' END,
        CASE WHEN confidence < 0.5 THEN 'low_confidence' END, CASE WHEN lo > 0 THEN 'low_trust_source_signal' END], lambda x: x IS NOT NULL)) AS name FROM scored
      UNION ALL SELECT 'band', CASE WHEN s >= 0.75 THEN 'strong' WHEN s >= 0.5 THEN 'moderate' WHEN s >= 0.3 THEN 'weak' ELSE 'poor' END FROM scored) GROUP BY 1, 2"""
)
def epistemic_report_counts(spark, sf_dir):
    return epistemic.report_counts(epistemic.summaries(P.evidence(spark, sf_dir), node_types=("claim",), posterior=False)).where("kind IN ('flag', 'band')")


# ------------------------------------------------------------------ quality and validation


@query(
    f"""WITH {_EDGES} SELECT (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier WHERE s_acctbal > 0) AS node_count, count(*) AS edge_count, 0::BIGINT AS duplicate_node_id_count,
    count(*) FILTER (l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)) AS missing_endpoint_count, count(*) FILTER (confidence < 0.5) AS weak_edge_count,
    count(*) FILTER (type = 'supports_claim') AS missing_provenance_count FROM ev"""
)
def qa_report(spark, sf_dir):
    return rounded(structure.qa_summary(P.evidence(spark, sf_dir, concepts=False, suppliers="s_acctbal > 0"), ("supports_claim",)))


@query(f"WITH {_EDGES} SELECT source, target, type FROM ev WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def missing_endpoints(spark, sf_dir):
    return structure.missing_endpoints(P.evidence(spark, sf_dir, concepts=False, suppliers="s_acctbal > 0")).select("source", "target", "type")


@query(f"WITH {_EDGES} SELECT source, target, type, round(confidence, 6) AS confidence FROM ev WHERE confidence < 0.5")
def weak_edges(spark, sf_dir):
    return rounded(structure.weak_edges(P.evidence(spark, sf_dir, concepts=False)).select("source", "target", "type", "confidence"))


@query("SELECT 'order::' || l_orderkey AS id FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    from evigraph.graph import Graph

    lines = P.table(spark, sf_dir, "lineitem")
    nodes = lines.select(F.concat(F.lit("order::"), F.col("l_orderkey").cast("string")).alias("id"), F.lit("order").alias("type"), F.col("l_linenumber").alias("pos"))
    return structure.duplicate_node_ids(Graph(nodes, lines.limit(0)))


@query(
    f"""WITH {_EDGES} SELECT severity, code, count(*) AS n FROM (
      SELECT 'warning' AS severity, 'missing_evidence_provenance' AS code FROM ev UNION ALL SELECT 'warning', 'missing_graph_id'
      UNION ALL SELECT 'error', 'missing_edge_endpoint' FROM ev WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
      UNION ALL SELECT 'warning', 'assessed_node_without_evidence' FROM part WHERE 'part::' || p_partkey NOT IN (SELECT target FROM ev WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0))) GROUP BY 1, 2"""
)
def readiness_finding_counts(spark, sf_dir):
    graph = P.evidence(spark, sf_dir, concepts=False, suppliers="s_acctbal > 0")
    return validation.readiness_findings(graph).groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT severity, code, count(*) AS n FROM (
      SELECT 'error' AS severity, 'missing_edge_field' AS code FROM lineitem WHERE l_returnflag = 'R'
      UNION ALL SELECT 'warning', 'unexpected_edge_target_type' FROM lineitem UNION ALL SELECT 'warning', 'missing_edge_provenance' FROM lineitem WHERE l_returnflag = 'A') GROUP BY 1, 2"""
)
def shape_finding_counts(spark, sf_dir):
    shape = validation.GraphShape(required_node_fields={"claim": {"title"}}, required_edge_fields={"contradicts": {"justification"}}, allowed_targets={"source": {"concept"}}, provenance_types={"qualifies"})
    return validation.shape_findings(P.evidence(spark, sf_dir, concepts=False), shape).groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ traversal and structure


@query(f"WITH {_SUPPLY} SELECT source, target FROM se WHERE source LIKE 'nation::%'")
def outgoing_edges(spark, sf_dir):
    graph = P.supply(spark, sf_dir)
    return traversal.outgoing(graph, graph.nodes.where("type = 'nation'").select("id"), {"located_in"}).select("source", "target")


@query(f"WITH RECURSIVE {_SUPPLY}, r AS (SELECT source AS start, target AS node FROM se WHERE source LIKE 'supplier::%' UNION SELECT start, target FROM r JOIN se ON source = node) SELECT start, node FROM r")
def descendants(spark, sf_dir):
    graph = P.supply(spark, sf_dir)
    return traversal.descendants(graph, graph.nodes.where("type = 'supplier'").select("id")).select("start", "node")


@query(f"WITH RECURSIVE {_SUPPLY}, r AS (SELECT target AS start, source AS node FROM se WHERE target LIKE 'region::%' UNION SELECT start, source FROM r JOIN se ON target = node) SELECT start, node FROM r")
def ancestors(spark, sf_dir):
    graph = P.supply(spark, sf_dir)
    return traversal.ancestors(graph, graph.nodes.where("type = 'region'").select("id")).select("start", "node")


@query(
    f"WITH RECURSIVE {_SUPPLY}, r AS (SELECT 'nation::3' AS node, 0 AS d UNION SELECT b, d + 1 FROM r JOIN su ON a = node WHERE d < 2), k AS (SELECT DISTINCT node FROM r) SELECT source, target FROM se WHERE source IN (SELECT node FROM k) AND target IN (SELECT node FROM k)"
)
def k_hop(spark, sf_dir):
    """Two hops around a nation: its suppliers and customers, its region, the region's other nations, and the edges among all."""
    graph = P.supply(spark, sf_dir)
    return traversal.k_hop_subgraph(graph, graph.nodes.where("id = 'nation::3'").select("id"), 2).edges.select("source", "target")


@query("SELECT 'supplier::' || s_suppkey AS source, 'region::' || r_regionkey AS target, CASE WHEN n_regionkey = r_regionkey THEN 'supplier::' || s_suppkey || '>nation::' || s_nationkey || '>region::' || r_regionkey ELSE '' END AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey CROSS JOIN region")
def shortest_path(spark, sf_dir):
    graph = P.supply(spark, sf_dir)
    pairs = graph.nodes.where("type = 'supplier'").select(F.col("id").alias("source")).crossJoin(F.broadcast(graph.nodes.where("type = 'region'").select(F.col("id").alias("target"))))  # the five regions
    return traversal.shortest_paths(graph, pairs).select("source", "target", F.array_join("path", ">").alias("path"))


@query("SELECT 'supplier::' || s_suppkey AS source, 'region::' || r_regionkey AS target, n_regionkey = r_regionkey AS reaches FROM supplier JOIN nation ON s_nationkey = n_nationkey CROSS JOIN region")
def reaches(spark, sf_dir):
    graph = P.supply(spark, sf_dir)
    pairs = graph.nodes.where("type = 'supplier'").select(F.col("id").alias("source")).crossJoin(F.broadcast(graph.nodes.where("type = 'region'").select(F.col("id").alias("target"))))  # the five regions
    return strong.reaches(graph, pairs)


_COMPONENTS = f"""{_SUPPLY}, home AS (
  SELECT 'nation::' || n_nationkey AS id, n_regionkey AS r FROM nation UNION ALL SELECT 'region::' || r_regionkey, r_regionkey FROM region
  UNION ALL SELECT 'supplier::' || s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'customer::' || c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(f"WITH {_COMPONENTS} SELECT id, min(id) OVER (PARTITION BY r) AS component FROM home")
def connected_components(spark, sf_dir):
    return structure.component_labels(P.supply(spark, sf_dir))


@query("SELECT 'event::' || event_id AS id, min('event::' || event_id) OVER (PARTITION BY user_id) AS component FROM events")
def event_chain_components(spark, sf_dir):
    return structure.component_labels(P.chain(spark, sf_dir))


@query(
    """WITH RECURSIVE n AS (SELECT 'region::' || r_regionkey AS id, r_regionkey AS r FROM region UNION ALL SELECT 'nation::' || n_nationkey, n_regionkey FROM nation UNION ALL SELECT 'supplier::' || s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    e AS (SELECT 'nation::' || n_nationkey AS a, 'region::' || n_regionkey AS b FROM nation UNION ALL SELECT 'supplier::' || s_suppkey, 'nation::' || s_nationkey FROM supplier),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    inner_nodes AS (SELECT n.id AS v, n.r FROM n WHERE (SELECT count(*) FROM u WHERE u.a = n.id) > 1),
    start AS (SELECT v, inner_nodes.r, min(n.id) AS s FROM inner_nodes JOIN n ON n.r = inner_nodes.r AND n.id != v GROUP BY 1, 2),
    reach AS (SELECT v, s AS id FROM start UNION SELECT v, b FROM reach JOIN u ON u.a = reach.id WHERE b != v)
    SELECT v AS node_id, (SELECT count(*) FROM n WHERE n.r = inner_nodes.r) AS component_size, (SELECT count(*) FROM reach WHERE reach.v = inner_nodes.v) AS reachable_after_removal FROM inner_nodes"""
)
def cut_vertices_suppliers(spark, sf_dir):
    """The graph without the customers, which its SQL can walk node by node."""
    return structure.bridge_nodes(P.supply(spark, sf_dir, customers=False))


_LEAVES = """leaf AS (SELECT 'supplier::' || s_suppkey AS id, s_nationkey AS k FROM supplier UNION ALL SELECT 'customer::' || c_custkey, c_nationkey FROM customer),
    sized AS (SELECT n_nationkey AS k, n_regionkey AS r, count(leaf.id) AS leaves FROM nation LEFT JOIN leaf ON leaf.k = n_nationkey GROUP BY 1, 2),
    home AS (SELECT id, k, r FROM leaf JOIN sized USING (k) UNION ALL SELECT 'nation::' || k, k, r FROM sized UNION ALL SELECT 'region::' || r_regionkey, -1, r_regionkey FROM region),
    inner_nodes AS (SELECT 'nation::' || k AS v, k, r, leaves FROM sized WHERE leaves > 0 UNION ALL SELECT 'region::' || r, -1, r, 0 FROM sized GROUP BY r HAVING count(*) > 1)"""


@query(
    f"""WITH {_LEAVES}, total AS (SELECT r, count(*) AS n FROM home GROUP BY 1),
    start AS (SELECT v, arg_min(home.k, home.id) AS k FROM inner_nodes JOIN home ON home.r = inner_nodes.r AND home.id != v GROUP BY 1)
    SELECT v AS node_id, total.n AS component_size, CASE WHEN inner_nodes.k = -1 THEN 1 + sized.leaves WHEN start.k = inner_nodes.k THEN 1 ELSE total.n - 1 - inner_nodes.leaves END AS reachable_after_removal
    FROM inner_nodes JOIN total ON total.r = inner_nodes.r JOIN start USING (v) LEFT JOIN sized ON sized.k = start.k"""
)
def cut_vertices(spark, sf_dir):
    """Over the whole supply graph; its SQL counts the leaves of each nation instead of walking the graph."""
    return structure.bridge_nodes(P.supply(spark, sf_dir))


_TOPO = f"""{_SUPPLY}, low AS (SELECT id FROM sn WHERE id NOT IN (SELECT target FROM se)),
 l0 AS (SELECT id, 0::BIGINT AS level, row_number() OVER (ORDER BY id) - 1 AS place FROM low),
 l1n AS (SELECT target AS id, max(place) AS after FROM se JOIN l0 ON source = l0.id GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM se s2 WHERE s2.target = se.target)),
 l1 AS (SELECT id, 1::BIGINT AS level, (SELECT count(*) FROM l0) + row_number() OVER (ORDER BY after, id) - 1 AS place FROM l1n),
 p1 AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1),
 l2n AS (SELECT target AS id, max(place) AS after FROM se JOIN p1 ON source = p1.id WHERE target NOT IN (SELECT id FROM p1) GROUP BY 1),
 l2 AS (SELECT id, 2::BIGINT AS level, (SELECT count(*) FROM p1) + row_number() OVER (ORDER BY after, id) - 1 AS place FROM l2n)
 SELECT * FROM p1 UNION ALL SELECT * FROM l2"""


@query(f"WITH {_TOPO}")
def topological_order(spark, sf_dir):
    return rounded(traversal.topological_order(P.supply(spark, sf_dir))[0])


@query(
    f"""WITH {_SUPPLY}, d AS (SELECT a AS id, count(*) AS degree FROM su GROUP BY 1), i AS (SELECT target AS id, count(*) AS in_degree FROM se GROUP BY 1), o AS (SELECT source AS id, count(*) AS out_degree FROM se GROUP BY 1)
    SELECT sn.id, type, coalesce(degree, 0) AS degree, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree FROM sn LEFT JOIN d USING (id) LEFT JOIN i USING (id) LEFT JOIN o USING (id) ORDER BY 3 DESC, 4 DESC, 1 LIMIT 10"""
)
def degree_top10(spark, sf_dir):
    return structure.top_degrees(P.supply(spark, sf_dir))


@query(
    """WITH n AS (SELECT 'region::' || r_regionkey AS id, r_regionkey AS r FROM region UNION ALL SELECT 'nation::' || n_nationkey, n_regionkey FROM nation UNION ALL SELECT 'supplier::' || s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    e AS (SELECT 'nation::' || n_nationkey AS a, 'region::' || n_regionkey AS b FROM nation UNION ALL SELECT 'supplier::' || s_suppkey, 'nation::' || s_nationkey FROM supplier),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), deg AS (SELECT a, count(*) AS d FROM u GROUP BY 1)
    SELECT (SELECT count(DISTINCT r) FROM n) AS component_count, (SELECT max(c) FROM (SELECT count(*) AS c FROM n GROUP BY r)) AS largest_component_size, (SELECT count(*) FROM n) AS node_count, (SELECT count(*) FROM e) AS edge_count,
      (SELECT count(*) FROM n WHERE id NOT IN (SELECT a FROM u)) AS isolated_node_count, (SELECT count(*) FROM deg WHERE d > 1) AS bridge_node_count"""
)
def diagnostics_summary_suppliers(spark, sf_dir):
    """The graph without the customers, as in cut_vertices_suppliers."""
    return rounded(structure.diagnostics_summary(P.supply(spark, sf_dir, customers=False)))


@query(
    f"""WITH {_LEAVES} SELECT (SELECT count(DISTINCT r) FROM home) AS component_count, (SELECT max(c) FROM (SELECT count(*) AS c FROM home GROUP BY r)) AS largest_component_size, (SELECT count(*) FROM home) AS node_count,
      (SELECT count(*) FROM leaf) + (SELECT count(*) FROM nation) AS edge_count, (SELECT count(*) FROM region WHERE r_regionkey NOT IN (SELECT r FROM sized)) AS isolated_node_count, (SELECT count(*) FROM inner_nodes) AS bridge_node_count"""
)
def diagnostics_summary(spark, sf_dir):
    """Over the whole supply graph."""
    return rounded(structure.diagnostics_summary(P.supply(spark, sf_dir)))


@query(f"WITH {_SUPPLY} SELECT 'node' AS component, type, count(*) AS n FROM sn GROUP BY 2 UNION ALL SELECT 'edge', 'located_in', count(*) FROM se")
def type_counts(spark, sf_dir):
    return structure.type_counts(P.supply(spark, sf_dir))


# ------------------------------------------------------------------ time

_CUT = "1996-06-30"


def _claims(graph):
    return graph.nodes.where("type = 'claim'").select(F.col("id").alias("claim"))


@query(f"WITH {_EDGES} SELECT id, source, target FROM ev WHERE day <= DATE '{_CUT}'")
def graph_at(spark, sf_dir):
    return temporal.graph_at(P.evidence(spark, sf_dir, concepts=False), _CUT).edges.select("id", "source", "target")


@query(
    f"""WITH {_EDGES}, c AS (SELECT target, count(*) FILTER (stance = 'support') AS s, count(*) FILTER (stance = 'challenge') AS x, count(*) FILTER (stance = 'revision') AS r FROM ev WHERE day <= DATE '{_CUT}' GROUP BY 1)
    SELECT 'part::' || p_partkey AS claim, CASE WHEN r > 0 THEN 'revised_or_superseded' WHEN x > 0 THEN 'contradicted' WHEN s > 0 THEN 'supported' ELSE 'unresolved' END AS status FROM part LEFT JOIN c ON target = 'part::' || p_partkey"""
)
def claim_status_at(spark, sf_dir):
    graph = P.evidence(spark, sf_dir, concepts=False)
    return temporal.claim_status_at(graph, _claims(graph), _CUT)


_MONTHS = tuple(f"{y}-{m:02d}-15" for y in range(1992, 1999) for m in (1, 4, 7, 10))


@query(
    f"""WITH {_EDGES}, cut AS (SELECT unnest([{", ".join(f"'{m}'" for m in _MONTHS)}]) AS cutoff), c AS (SELECT target, cutoff, count(*) FILTER (stance = 'support') AS s, count(*) FILTER (stance = 'challenge') AS x, count(*) FILTER (stance = 'revision') AS r FROM ev JOIN cut ON day <= CAST(cutoff AS DATE) GROUP BY 1, 2)
    SELECT 'part::' || p_partkey AS claim, cut.cutoff, CASE WHEN r > 0 THEN 'revised_or_superseded' WHEN x > 0 THEN 'contradicted' WHEN s > 0 THEN 'supported' ELSE 'unresolved' END AS status FROM part CROSS JOIN cut LEFT JOIN c ON target = 'part::' || p_partkey AND c.cutoff = cut.cutoff"""
)
def claim_status_by_month(spark, sf_dir):
    """Every claim at each of 28 dates, in one pass."""
    graph = P.evidence(spark, sf_dir, concepts=False)
    return temporal.claim_status_over(graph, _claims(graph), list(_MONTHS))


@query(f"WITH {_EDGES} SELECT target AS claim, min(day)::VARCHAR AS day FROM ev WHERE stance = 'challenge' GROUP BY 1")
def first_contradiction(spark, sf_dir):
    graph = P.evidence(spark, sf_dir, concepts=False)
    return temporal.first_edge_times(graph, _claims(graph), CHALLENGE).select("claim", F.substring("shown", 1, 10).alias("day"))


_TERMINAL = f"""{_EDGES}, terminal AS (SELECT * FROM ev WHERE stance IN ('challenge', 'revision') QUALIFY row_number() OVER (PARTITION BY target ORDER BY day, rank, id) = 1)"""


@query(
    f"WITH {_TERMINAL} SELECT 'part::' || p_partkey AS claim, coalesce(day::VARCHAR, '') AS tenable_until, id AS terminal_edge, CASE WHEN id IS NULL THEN 'open' ELSE 'bounded' END AS status FROM part LEFT JOIN terminal ON target = 'part::' || p_partkey"
)
def tenability_window(spark, sf_dir):
    graph = P.evidence(spark, sf_dir, concepts=False)
    return temporal.tenability_windows(graph, _claims(graph)).select("claim", F.substring("tenable_until", 1, 10).alias("tenable_until"), "terminal_edge", "status")


@query(f"WITH {_TERMINAL} SELECT target AS claim, day::VARCHAR AS tenable_until FROM terminal WHERE day <= DATE '{_CUT}'")
def stale_claims(spark, sf_dir):
    return temporal.stale_claims_after(P.evidence(spark, sf_dir, concepts=False), _CUT).select("claim", F.substring("tenable_until", 1, 10).alias("tenable_until"))


@query(f"WITH {_EDGES} SELECT 'edge' AS component, id AS component_id, type AS component_type, 'available_at' AS event, 'datetime' AS kind, date_diff('day', DATE '0001-01-01', day) + 1 AS ordinal FROM ev")
def timeline_events(spark, sf_dir):
    out = temporal.timeline_events(P.evidence(spark, sf_dir, concepts=False))
    return out.select("component", "component_id", "component_type", "event", "kind", F.col("val").cast("long").alias("ordinal"))


@query(
    f"""WITH {_EDGES}, f AS (SELECT target, min(day) AS day FROM ev WHERE stance = 'challenge' GROUP BY 1), last AS (SELECT target, max(day) AS day FROM ev GROUP BY 1)
    SELECT last.target AS claim, CAST(date_diff('day', f.day, last.day) AS BIGINT) AS lag, CASE WHEN f.day IS NULL THEN 'no_available_contradiction' ELSE 'recognized' END AS status FROM last LEFT JOIN f USING (target)"""
)
def recognition_lag(spark, sf_dir):
    graph = P.evidence(spark, sf_dir, concepts=False)
    last = graph.edges.groupBy(F.col("target").alias("claim")).agg(F.max("metadata.available_at").alias("at")).select("claim", timekey.of_timestamp(F.col("at")).alias("recognized_at"))
    return temporal.recognition_windows(graph, last).select("claim", F.col("recognition_lag").cast("long").alias("lag"), "status")


@query(
    f"""WITH {_EDGES}, c AS (SELECT target, min(day) AS begun, min(day) FILTER (stance = 'challenge') AS x, max(day) AS last FROM ev GROUP BY 1)
    SELECT target AS claim, x IS NOT NULL AS comparable, CAST(date_diff('day', begun, x) AS BIGINT) AS to_contradiction, CAST(date_diff('day', x, last) AS BIGINT) AS persistence FROM c"""
)
def availability_lag(spark, sf_dir):
    edges = P.evidence(spark, sf_dir, concepts=False).edges
    at = F.col("metadata.available_at")
    per = edges.groupBy(F.col("target").alias("claim")).agg(F.min(at).alias("a"), F.min(F.when(F.col("type").isin(*CHALLENGE), at)).alias("b"), F.max(at).alias("c"))
    lag = temporal.availability_lag(*[timekey.of_timestamp(F.col(c)) for c in "abc"])
    return per.select("claim", lag.alias("l")).select("claim", "l.comparable", F.col("l.time_to_contradiction").cast("long").alias("to_contradiction"), F.col("l.post_contradiction_persistence").cast("long").alias("persistence"))


@query(
    f"""WITH {_TERMINAL}, n AS (SELECT target, count(*) AS n FROM ev WHERE stance IN ('challenge', 'revision') GROUP BY 1),
    c AS (SELECT 'part::' || p_partkey AS claim, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'no_decisive_evidence' WHEN day > DATE '{_CUT}' THEN 'late_decisive_evidence' WHEN day = DATE '{_CUT}' THEN 'decisive_evidence_at_reveal' ELSE '' END AS failures
      FROM part LEFT JOIN n ON n.target = 'part::' || p_partkey LEFT JOIN terminal ON terminal.target = 'part::' || p_partkey)
    SELECT claim, CASE failures WHEN '' THEN 'fair' WHEN 'decisive_evidence_at_reveal' THEN 'partial' ELSE 'unfair' END AS rating, failures, n AS decisive_evidence_count FROM c"""
)
def fair_play(spark, sf_dir):
    out = temporal.fair_play(P.evidence(spark, sf_dir, concepts=False), reveal_at=_CUT)
    return rounded(out.select("claim", "rating", F.array_join("failures", ",").alias("failures"), "decisive_evidence_count"))


# ------------------------------------------------------------------ evaluation


@query(f"WITH {_g_sql("'all'")} SELECT round(g_value, 6) AS \"G\", round(st, 6) AS \"S_T\", round(sd, 6) AS \"S_D\", round(sr, 6) AS \"S_R\", n_clean, n_target FROM gs")
def g_estimate(spark, sf_dir):
    return rounded(gmetric.g_estimate(P.g_rows(spark, sf_dir)).select("G", "S_T", "S_D", "S_R", "n_clean", "n_target"))


@query(f"WITH {_g_sql('condition')} SELECT k AS label, round(g_value, 6) AS \"G\", n_clean, n_target FROM gs")
def g_by_condition(spark, sf_dir):
    return rounded(gmetric.experiment_summary(P.g_rows(spark, sf_dir)).where("label IS NOT NULL").select("label", "G", "n_clean", "n_target"))


@query(f"WITH {_g_sql('condition')}, r AS (SELECT k, g_value, row_number() OVER (ORDER BY g_value DESC, k) AS rank FROM gs) SELECT k AS experiment_id, rank, round(g_value, 6) AS \"G\", round(g_value - (SELECT g_value FROM r ORDER BY rank DESC LIMIT 1), 6) AS delta_from_baseline FROM r")
def g_rank_compare(spark, sf_dir):
    per = gmetric.g_estimate(P.g_rows(spark, sf_dir), ["condition"]).select(F.col("condition").alias("experiment_id"), "G", F.col("condition").alias("input_pos"))
    return rounded(gmetric.compare(per).select("experiment_id", "rank", "G", "delta_from_baseline"))


@query(
    f"WITH {_g_sql('phase')}, w AS (SELECT max(g_value) FILTER (k = 'before') AS b, max(g_value) FILTER (k = 'after') AS a FROM gs) SELECT round(b, 6) AS \"G_before\", round(a, 6) AS \"G_after\", round(a - b, 6) AS \"delta_G\", round((a - b) / greatest(1 - b, 1e-12), 6) AS \"normalized_delta_G\" FROM w"
)
def delta_g(spark, sf_dir):
    return rounded(gmetric.delta_g(P.g_rows(spark, sf_dir), F.col("phase")))


@query(f"WITH {_g_sql('level')} SELECT k AS level, round(g_value, 6) AS \"G\", round(g_value - (SELECT g_value FROM gs WHERE k = '0'), 6) AS delta_from_baseline FROM gs")
def reliability_sensitivity(spark, sf_dir):
    return rounded(gmetric.level_sensitivity(P.g_rows(spark, sf_dir), "level", "0"))


_SAMPLES = "s AS (SELECT least(n_chars / 5000, 1) AS p, CAST(quality AS DOUBLE) AS o, lang FROM documents JOIN labels USING (doc_id)), b AS (SELECT *, least(CAST(floor(p * 10) AS INT), 9) AS g FROM s), binned AS (SELECT p, o, CASE WHEN p < g / 10.0::DOUBLE THEN g - 1 WHEN p >= (g + 1) / 10.0::DOUBLE AND g < 9 THEN g + 1 ELSE g END AS bin FROM b), per AS (SELECT bin, count(*) AS n, avg(p) AS mp, avg(o) AS mo FROM binned GROUP BY 1)"


@query(f"WITH {_SAMPLES} SELECT i AS bin, coalesce(n, 0) AS \"count\", round(coalesce(mp, 0), 6) AS mean_predicted, round(coalesce(mo, 0), 6) AS mean_observed FROM range(10) t(i) LEFT JOIN per ON bin = i")
def calibration_bins(spark, sf_dir):
    return rounded(calibration.bins(P.calibration_samples(spark, sf_dir)).select("bin", "count", "mean_predicted", "mean_observed"))


@query(f"WITH {_SAMPLES} SELECT round(sum(n * abs(mp - mo)) / sum(n), 6) AS expected_calibration_error FROM per")
def calibration_ece(spark, sf_dir):
    return rounded(calibration.expected_calibration_error(P.calibration_samples(spark, sf_dir)))


@query(f"WITH {_SAMPLES} SELECT count(*) AS sample_count, round(avg((p - o) * (p - o)), 6) AS brier_score, round(avg(-(o * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - o) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)))), 6) AS log_loss FROM s")
def calibration_scores(spark, sf_dir):
    return rounded(calibration.scores(P.calibration_samples(spark, sf_dir)))


@query(
    f"""WITH {_SAMPLES} SELECT count(*) FILTER (o >= 0.5) AS positive_count, count(*) FILTER (o < 0.5) AS negative_count, round(avg(p) FILTER (o >= 0.5), 6) AS mean_positive_prediction, round(avg(p) FILTER (o < 0.5), 6) AS mean_negative_prediction,
    round(avg(p) FILTER (o >= 0.5) - avg(p) FILTER (o < 0.5), 6) AS auc_proxy FROM s"""
)
def calibration_discrimination(spark, sf_dir):
    return rounded(calibration.discrimination(P.calibration_samples(spark, sf_dir)))


@query(f"WITH {_SAMPLES} SELECT count(*) FILTER (lang = 'es') AS abstention_count, round(count(*) FILTER (lang = 'es') * 1.0 / count(*), 6) AS abstention_rate, count(*) FILTER (lang != 'fr') AS coverage_count, CAST(0.5 AS DOUBLE) AS mean_coverage FROM s")
def calibration_coverage(spark, sf_dir):
    return rounded(calibration.coverage(P.calibration_samples(spark, sf_dir)))


# ------------------------------------------------------------------ confidence and export


@query("SELECT 'part::' || p_partkey AS id, CASE WHEN v < 0.2 THEN 'very_low' WHEN v < 0.4 THEN 'low' WHEN v < 0.7 THEN 'moderate' WHEN v < 0.9 THEN 'high' ELSE 'very_high' END AS band FROM (SELECT p_partkey, p_size / 50 AS v FROM part)")
def assessment_band(spark, sf_dir):
    return P.evidence(spark, sf_dir, concepts=False).nodes.where("type = 'claim'").select("id", confidence.band(F.col("confidence")).alias("band"))


@query(
    """WITH a AS (SELECT l_partkey, l_orderkey, l_suppkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_quantity / 50 AS v, CAST(l_shipdate AS DATE) AS day, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_suppkey, l_linenumber, round(l_extendedprice * 100)) AS i FROM lineitem),
    live AS (SELECT * FROM a WHERE NOT (i = 1 AND (SELECT count(*) FROM a b WHERE b.l_partkey = a.l_partkey) > 1))
    SELECT 'part::' || l_partkey AS id, count(*) AS active, round(arg_max(v, (day, -i)), 6) AS latest_value FROM live GROUP BY 1"""
)
def latest_assessments(spark, sf_dir):
    """Each part's line items as assessments of one dimension; the second supersedes the first."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    rows = P.table(spark, sf_dir, "lineitem").select("l_partkey", F.struct("l_orderkey", "l_suppkey", "l_linenumber", cents.alias("cents"), (F.col("l_quantity") / 50).alias("v"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")).alias("a"))
    lists = rows.groupBy("l_partkey").agg(F.array_sort(F.collect_list("a")).alias("a"))
    made = F.transform(
        "a", lambda x, i: F.struct(i.cast("string").alias("assessment_id"), F.lit("grounding_strength").alias("dimension"), x["v"].alias("value"), x["day"].alias("recorded_at"), F.when(i == 1, "0").otherwise("").alias("supersedes_assessment_id"))
    )
    out = lists.select(F.concat(F.lit("part::"), F.col("l_partkey").cast("string")).alias("id"), made.alias("x"))
    return rounded(out.select("id", F.size(confidence.active(F.col("x"))).alias("active"), confidence.latest(F.col("x"), "grounding_strength")["value"].alias("latest_value")))


@query(f"""WITH {_SUPPLY} SELECT '  "' || id || '" [label="' || title || '", type="' || type || '"];' AS line FROM sn UNION ALL SELECT '  "' || source || '" -> "' || target || '" [label="located_in"];' FROM se""")
def export_dot(spark, sf_dir):
    return export.dot_lines(P.supply(spark, sf_dir)).select("line")


@query(f"""WITH {_SUPPLY} SELECT '{{"data":{{"id":"' || id || '","title":"' || title || '","type":"' || type || '"}}}}' AS json FROM sn UNION ALL SELECT '{{"data":{{"source":"' || source || '","target":"' || target || '","type":"located_in"}}}}' FROM se""")
def export_cytoscape(spark, sf_dir):
    return export.cytoscape_lines(P.supply(spark, sf_dir)).select("json")


@query(f"""WITH {_SUPPLY} SELECT '{{"@id":"' || id || '","@type":"' || type || '","name":"' || title || '"}}' AS json FROM sn UNION ALL SELECT '{{"@id":"' || source || '--located_in--' || target || '","@type":"located_in","source":{{"@id":"' || source || '"}},"target":{{"@id":"' || target || '"}}}}' FROM se""")
def export_jsonld(spark, sf_dir):
    return export.jsonld_lines(P.supply(spark, sf_dir)).select("json")


@query("SELECT 'part::' || p_partkey AS id, coalesce(nullif(trim(regexp_replace(lower(trim(p_name || ' ' || p_brand || '!')), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'untitled') AS slug FROM part")
def slugs(spark, sf_dir):
    return P.table(spark, sf_dir, "part").select(F.concat(F.lit("part::"), F.col("p_partkey").cast("string")).alias("id"), text.slug(F.concat("p_name", F.lit(" "), "p_brand", F.lit("!"))).alias("slug"))


def queries() -> dict:
    from evigraph.plans import cases  # noqa: F401  adds its queries

    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    from evigraph.plans import cases  # noqa: F401

    return dict(_SQL)
