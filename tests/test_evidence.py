"""Weights, ledgers, posteriors, labels and summaries of small bundles."""

import pytest
from pyspark.sql import functions as F

from evigraph.functions import bayes, canonical, confidence
from evigraph.operators import bayesian, epistemic, ledger, validation
from evigraph.sources import bundle, export


def node(ident, kind="source", **more):
    return {"id": ident, "type": kind, "title": ident, **more}


def edge(source, target, kind, ident="", **more):
    return {"source": source, "target": target, "type": kind, "id": ident, **more}


@pytest.fixture(scope="module")
def small(spark):
    payload = {
        "graph_id": "g",
        "nodes": [
            node("k", "concept"), node("c", "claim", confidence=0.4), node("s1", metadata={"source_quality": "peer_reviewed", "source_role": "journal", "source_family_id": "f1"}, status="grounded"),
            node("s2", metadata={"source_quality": ["low", "Secondary "], "adversarial": True}), node("s3", metadata={"adversarial": "true", "source_quality": 3}),
        ],
        "edges": [
            edge("c", "k", "about_concept", "e0"), edge("s1", "c", "supports_claim", "e1", confidence=0.8, metadata={"artifact_id": "A", "fragment_id": "1"}),
            edge("s2", "c", "contradicts", "e2", confidence=0.5, metadata={"artifact_id": "A", "fragment_id": "1"}), edge("s3", "c", "supports", "e3"),
            edge("s3", "c", "supersedes", "e4", confidence=0.0, metadata={"revises_unit_id": "evidence:graph-edge:e1"}),
        ],
    }
    return bundle.graph_from_payload(spark, payload)


def test_weights(small):
    w = {r["edge_key"]: r for r in ledger.weighted_edges(small).collect()}
    assert w["e1"]["raw_weight"] == 0.8 and w["e1"]["weight_rule"] == "legacy_edge_confidence"
    assert w["e1"]["bayes_weight"] == pytest.approx(0.8 * 1.0 * 1.0 * 1.0)
    assert w["e2"]["bayes_weight"] == pytest.approx(0.5 * (0.2 + 0.65) / 2 * (1 - 0.45) * 0.85)
    assert w["e3"]["weight_rule"] == "missing_weight_default" and w["e3"]["raw_weight"] == 1.0
    assert w["e3"]["bayes_weight"] == pytest.approx(0.75 * 0.65 * 1.0 * 0.85)  # neither a text "true" nor a number counts
    assert w["e4"]["bayes_weight"] == 0.0 and w["e4"]["raw_weight"] == 0.0
    assert w["e1"]["dedup_key"] == canonical.canonical_hash({"artifact_id": "A", "fragment_id": "1"})
    assert w["e1"]["families"] == ["f1"]


def test_one_fragment_is_one_unit_of_the_first_stance(small):
    claims = small.nodes.where("type = 'claim'").select("id")
    units = ledger.ledger_units(small, claims)
    assert units.count() == 5  # the claim's own edge to its concept takes a stance too
    r = ledger.ledger_counts(units, F.col("pos")).first()
    assert (r["raw_support_count"], r["raw_challenge_count"], r["dedup_support_count"], r["dedup_challenge_count"]) == (3, 1, 3, 0)
    made = {u["unit_id"]: u for u in ledger.deduplicate(units, F.col("pos")).collect()}
    assert made["evidence:graph-edge:e1"]["referring_edges"] == ["e1", "e2"]
    assert ledger.ledger_violations(ledger.deduplicate(units, F.col("pos"))).count() == 0
    concept = ledger.ledger_units(small, small.nodes.where("type = 'concept'").select("id"))
    assert {r["unit_subject"] for r in concept.collect()} == {"c"}  # the concept itself is none of its claims


def test_posterior_and_labels(spark):
    rows = spark.createDataFrame([("a", 8.0, 0.0, 0.0, 8, 0), ("b", 0.0, 0.0, 0.0, 0, 0), ("c", 6.0, 6.0, 0.0, 6, 6), ("d", 12.0, 1.0, 0.0, 12, 1)], "ledger string, success double, failure double, revision double, support_edges long, challenge_edges long")
    r = {x["ledger"]: x for x in bayesian.classified(rows).collect()}
    assert r["a"]["mean"] == pytest.approx(0.9) and r["a"]["variance"] == pytest.approx(9 / (100 * 11))
    assert r["b"]["bayesian_label"] == "thin_evidence" and r["b"]["bayesian_flags"][:2] == ["thin_evidence", "wide_interval"]
    assert r["c"]["bayesian_label"] == "contested"
    assert r["d"]["bayesian_label"] == "fragile_support" and "mixed_support_challenge" in r["d"]["bayesian_flags"]
    assert r["a"]["mean_range"] == pytest.approx(10 / 11 - 9 / 13)
    assert bayes.z_value(0.9) == 1.644854 and bayes.z_value(0.42) == 1.959964
    with pytest.raises(ValueError):
        bayes.posterior(F.lit(1.0), F.lit(1.0), credibility=1.0)


def test_epistemic_summary(small):
    rows = {r["target"]: r for r in epistemic.summaries(small).collect()}
    c = rows["c"]
    assert (c["support_count"], c["challenge_count"], c["revision_count"], c["low_confidence_node_count"]) == (2, 1, 1, 1)
    assert c["flags"] == ["challenged", "revised_or_qualified", "low_confidence", "narrow_source_role", "low_trust_source_signal", "adversarial_source_signal"]
    quality = (1.0 + 0.1 + 0.55) / 3
    want = 0.25 * 1.0 + 0.25 * 2 / 3 + 0.18 * 0.4 + 0.12 / 3 + 0.12 * quality + 0.05 - 0.12 - 0.1
    assert c["reliability_score"] == pytest.approx(want)
    assert rows["k"]["support_count"] == 3  # of the concept and of its claim
    assert c["revision"] == 0.0  # revisions are no evidence in a summary
    assert {r["name"]: r["n"] for r in epistemic.report_counts(epistemic.summaries(small)).where("kind = 'nodes'").collect()} == {"flagged": 2}


def test_assessments(spark):
    made = lambda i, v, at, old="": {"assessment_id": i, "dimension": "grounding_strength", "value": v, "recorded_at": at, "supersedes_assessment_id": old, "method": {"name": "m", "version": "1"}}
    graph = bundle.graph_from_payload(spark, {"graph_id": "g", "nodes": [node("c", "claim", assessments=[made("old", 0.35, "2025-01-01"), made("new", 0.75, "2024-06-01T00:00:00Z", "old"), made("same", 0.1, "2024-06-01")])], "edges": []})
    r = graph.nodes.select(confidence.latest(F.col("assessments"), "grounding_strength").alias("a"), F.size(confidence.active(F.col("assessments"))).alias("n")).first()
    assert r["a"]["assessment_id"] == "new" and r["n"] == 2
    bad = graph.nodes.select(F.explode(F.concat("assessments", "assessments")).alias("a")).select("a.*")
    assert {x["code"] for x in confidence.lineage_findings(bad).collect()} == {"duplicate_assessment_id"}


def test_bundle_round_trip(spark, tmp_path):
    payload = {"graph_id": "g", "title": "t", "nodes": [node("a", "claim", confidence=0.0, metadata={"x": [1, "é"]}), node("b", "claim")], "edges": [edge("a", "b", "supports", "e", confidence=0.0)], "metadata": {"summary": {"node_count": 9}}}
    graph = bundle.graph_from_payload(spark, payload)
    bundle.write_bundle(graph, tmp_path / "g.json")
    again = bundle.bundle_payload(bundle.read_bundles(spark, str(tmp_path / "g.json")))
    assert again == bundle.bundle_payload(graph)
    assert again["nodes"][0]["confidence"] == 0.0 and "confidence" not in again["nodes"][1]
    assert again["nodes"][0]["metadata"] == {"x": [1, "é"]} and again["summary"] == {"node_count": 9, "edge_count": 1}


def test_exports(small):
    dot = export.to_dot(small, "my graph")
    assert dot.startswith("digraph my_graph {") and '"s1" -> "c" [label="supports_claim"];' in dot
    made = export.to_cytoscape(small)
    assert {"source_quality": "peer_reviewed", "status": "grounded"}.items() <= next(n["data"] for n in made["nodes"] if n["data"]["id"] == "s1").items()
    linked = export.to_jsonld(small)["@graph"]
    assert next(x for x in linked if x["@id"] == "e1")["target"] == {"@id": "c"}


def test_findings(small):
    codes = {r["code"] for r in validation.readiness_findings(small).collect()}
    assert codes == {"missing_evidence_provenance", "missing_temporal_metadata", "assessed_node_without_evidence"}
    shape = validation.GraphShape(required_node_fields={"source": {"source_role"}}, acyclic_types={"supports"}, allowed_targets={"source": {"concept"}})
    found = validation.shape_findings(small, shape).groupBy("code").count().collect()
    assert {r["code"]: r["count"] for r in found} == {"missing_node_field": 2, "unexpected_edge_target_type": 4}
    assert validation.status(validation.readiness_findings(small)).first()["status"] == "warning"
