import io
import json
import random

import pytest
from pyspark.sql import functions as F

from evigraph import cli, rpc
from evigraph.functions import meta, timekey
from evigraph.graph import Graph, edge_ref, node_ref, with_component_reliability
from evigraph.operators import bayesian, calibration, epistemic, gmetric, ledger, temporal, traversal
from evigraph.plans import manifests, report
from evigraph.sources import bundle, export, gedcom, synthetic


def payload(n=12):
    nodes = [{"id": f"n{i}", "type": "claim" if i else "concept", "title": f"N {i}", "metadata": {"a": i}} for i in range(n)]
    edges = [{"source": f"n{i}", "target": "n1", "type": "supports_claim", "id": f"e{i}", "confidence": 0.5} for i in range(2, n)]
    return {"bundle_kind": "k", "graph_id": "g", "title": "T", "nodes": nodes, "edges": edges + [{"source": "n1", "target": "n0", "type": "about_concept"}], "metadata": {}}


@pytest.fixture(scope="module")
def graph(spark):
    return bundle.graph_from_payload(spark, payload())


def test_documents_are_in_bundle_order(graph):
    lines = export.to_dot(graph).splitlines()
    assert [x.split('"')[1] for x in lines[1:13]] == [f"n{i}" for i in range(12)]
    assert [e["data"]["source"] for e in export.to_cytoscape(graph)["edges"]] == [*[f"n{i}" for i in range(2, 12)], "n1"]
    placed = export.in_order(export.dot_lines(graph)).orderBy("place").collect()
    assert [r["place"] for r in placed] == list(range(23)) and [r["line"] for r in placed] == lines[1:-1]


def test_lines_are_written_in_order(graph, spark, tmp_path):
    export.write_lines(export.dot_lines(graph), str(tmp_path / "dot"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "dot").glob("part-*")))
    assert text.splitlines() == export.to_dot(graph).splitlines()[1:-1]


def test_subgraph_header(spark, graph):
    out = traversal.k_hop_subgraph(graph, spark.createDataFrame([("n3",)], "id string"), 1)
    head = out.header.first()
    assert (head["graph_id"], head["description"]) == ("g:subgraph", "1-hop subgraph")
    assert json.loads(head["metadata"]) == {"subgraph_seeds": ["n3"], "subgraph_hops": 1}


def test_component_reliability(spark, graph):
    ids = spark.createDataFrame([("n2",), ("e3",), ("n1->about_concept->n0",)], "id string")
    out = with_component_reliability(graph, ids, "low")
    twice = with_component_reliability(out, ids, 0.5)
    for made, level in ((out, "low"), (twice, 0.5)):
        assert {r["id"]: json.loads(r["metadata"]).get("counterfactual_reliability") for r in made.nodes.collect() if r["id"] in ("n2", "n3")} == {"n2": level, "n3": None}
        marked = [(r["source"], r["target"]) for r in made.edges.collect() if json.loads(r["metadata"]).get("counterfactual_reliability") == level]
        assert sorted(marked) == [("n1", "n0"), ("n3", "n1")]
    assert json.loads(out.nodes.where("id = 'n2'").first()["metadata"])["a"] == 2


def test_manifests():
    policies = {k: {"name": "x"} for k in manifests.POLICIES["assessment"]}
    good = manifests.make("assessment", assessment_id="a", graph_file="g", bayesian_prior_profile="neutral", assessment_file="f", validation_file="v", **policies)
    assert manifests.report(good)["status"] == "pass"
    bad = good | {"graph_file": "", "temporal_policy": "x", "validation_policy": {}, "assessment_file": ""}
    assert [f["code"] for f in manifests.findings(bad)] == ["missing_required_manifest_field", "invalid_policy_block", "missing_policy_name", "missing_assessment_file"]
    plan = manifests.make("treatment", experiment_id="e", evaluation_target="t", corpus_sidecar_manifest="s", row_file="r", treatments=[{"condition": "a", "exposed_artifacts": ["x"]}], phases=["p"], **{k: {} for k in manifests.POLICIES["treatment"]})
    assert manifests.report(plan, "treatment")["status"] == "pass"
    worse = {"manifest_kind": "other", "treatments": [{"condition": ""}, {"condition": ""}], "row_file": "r"}
    codes = [f["code"] for f in manifests.findings(worse, "treatment")]
    assert codes.count("missing_required_treatment_field") == 3 and codes.count("invalid_policy_block") == 3
    assert {"unexpected_manifest_kind", "duplicate_treatment_condition", "missing_treatment_condition", "missing_treatment_exposed_artifacts", "missing_phases"} <= set(codes)
    assert "missing_treatments" in [f["code"] for f in manifests.findings({"manifest_kind": "treatment"})]


def test_reports_are_not_cut(spark):
    df = spark.range(1500).select(F.col("id"))
    assert len(report.table(df).splitlines()) == 1502
    assert report.table(df, 10).splitlines()[-1] == "The first 10 rows; there are more."


def test_gedcom_of_any_depth(spark):
    texts = spark.createDataFrame([("f", "\n".join(f"{i} T{i}" for i in range(20)) + "\n3 T")], "file string, value string")
    rows = {r["line_no"]: r["parent"] for r in gedcom.parsed_lines(texts).collect()}
    assert rows[0] is None and all(rows[i] == i - 1 for i in range(1, 20)) and rows[20] == 2


def test_gedcom_in_blocks_and_splits(spark, tmp_path):
    """Parents over block borders, levels of any size, and files that many tasks read: as a plain stack finds them."""
    r = random.Random(6)
    wanted = {}
    for name in "ab":
        levels, level = [0], 0
        for _ in range(400):
            level = r.choice((0, max(0, level - r.randint(0, 4)), level + 1, level + r.choice((1, 5, 1_000_000))))
            levels.append(level)
        levels[150:150] = [9] * 60  # a run that no block ends
        text = "\r\n".join(f"{x} @{name}{i}@ T{i} v" if i % 9 else f"{x} T{i}" for i, x in enumerate(levels))
        (tmp_path / f"{name}.ged").write_bytes(text.encode())
        for i, x in enumerate(levels):
            parent = next((j for j in range(i - 1, -1, -1) if levels[j] < x), None)
            wanted[name, i] = (x, parent, max(j for j in range(i + 1) if levels[j] == 0))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = gedcom.read_lines(spark, str(tmp_path / "*.ged"))
        assert spark.read.text(str(tmp_path / "*.ged")).rdd.getNumPartitions() > 4
        rows = lines.collect()
        small = gedcom.with_parents(lines.drop("parent", "root"), block_lines=16).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for got in (rows, small):
        assert {(x["file"][-5], x["line_no"]): (x["level"], x["parent"], x["root"]) for x in got} == wanted
    assert {x["tag"] for x in rows} == {f"T{i}" for i in range(461)} and all(x["xref"] == "" for x in rows if x["line_no"] % 9 == 0)


def test_metadata_edits_keep_what_is_nested(spark):
    texts = ['{"a": {"k": "x}, \\"k\\": 1"}, "k": {"deep": [1, {"k": 2}]}, "z": "\u00e9"}', "{}", None, "no object", '{"k": "say \\"k\\": {"}']
    df = spark.createDataFrame([(t,) for t in texts], "m string").select(meta.with_field(F.col("m"), "k", "low").alias("x"), meta.with_field(F.col("m"), "k", 0.5).alias("y"))
    for t, row in zip(texts, df.collect(), strict=True):
        old = json.loads(t) if t and t.startswith("{") else {}
        assert json.loads(row["x"]) == old | {"k": "low"} and json.loads(row["y"]) == old | {"k": 0.5}


def test_tools_say_what_they_take():
    tools = {t["name"]: t["inputSchema"] for t in rpc.list_tools()}
    assert len(tools) == 5 and tools["graph_neighborhood"]["required"] == ["graph_bundle", "node_id"]
    assert set(tools["graph_neighborhood"]["properties"]) == {"graph_bundle", "node_id", "hops"} and tools["epistemic_report"]["properties"]["node_types"]["type"] == "array"


def test_times_are_trimmed(spark):
    r = spark.sql("SELECT ' 1953-04-25 ' AS a, ' 7' AS b, 'soon' AS c").select(*[timekey.of_text(F.col(x)).alias(x) for x in "abc"]).first()
    assert r["a"]["kind"] == "datetime" and r["b"]["val"] == 7 and r["c"] is None


def test_priors():
    assert bayesian.resolve_profile(" Source-Conservative ") == {"name": "source_conservative", "alpha": 1.0, "beta": 3.0}
    assert bayesian.resolve_profile({"alpha": 2, "beta": 5, "name": "mine"}) == {"name": "mine", "alpha": 2.0, "beta": 5.0}
    assert bayesian.resolve_profiles({"x": (1, 2), "y": "neutral"}) == {"x": (1.0, 2.0), "y": (1.0, 1.0)}
    assert list(bayesian.resolve_profiles(["skeptical"])) == ["skeptical"]
    for wrong, error in (("none", KeyError), ((0, 1), ValueError)):
        with pytest.raises(error):
            bayesian.resolve_profile(wrong)


def test_posteriors_by_profile(spark):
    totals = spark.createDataFrame([("l", 3.0, 1.0)], "ledger string, success double, failure double")
    rows = {r["prior"]: r for r in bayesian.by_profile(totals, {"a": (1, 1), "b": (2, 6)}).collect()}
    assert rows["a"]["mean"] == pytest.approx(4 / 6) and rows["b"]["mean"] == pytest.approx(5 / 12)


def test_evidence_identity(spark):
    import hashlib

    rows = [("own", "a", "f", "e", "{}"), ("", "a", "f", "e", "{}"), ("", "a", "", "e", "{}"), (None, "", "", "", '{"b": 1, "a": "x"}')]
    df = spark.createDataFrame(rows, "x string, a string, f string, e string, p string")
    got = [r[0] for r in df.select(ledger.evidence_identity(*[F.col(c) for c in "xafep"])).collect()]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == ["own", "evidence:artifact-fragment:" + digest('{"artifact_id":"a","fragment_id":"f"}'), "evidence:graph-edge:e", "evidence:provenance:" + digest('{"a":"x","b":1}')]


def test_ledger_of_chosen_edges(spark, graph):
    chosen = graph.edges.where("type = 'supports_claim'").select(F.lit("L").alias("ledger"), F.lit("support").alias("stance"), "pos")
    plain = ledger.ledger_from_edges(graph, chosen)
    assert plain.count() == 10 and {r["raw_weight"] for r in plain.collect()} == {0.5}
    own = ledger.ledger_from_edges(graph, chosen, F.col("bayes_weight") * 0 + 0.25)
    assert {(r["raw_weight"], r["weight_rule"], r["unit_subject"]) for r in own.collect()} == {(0.25, "resolved_weight", "L")}
    units = ledger.deduplicate(own, F.col("pos"))
    assert ledger.require_valid(units) is units
    a, b = (ledger.content_hashes(units.repartition(n)).first()["content_hash"] for n in (1, 5))
    assert a == b != ledger.content_hashes(units.limit(9)).first()["content_hash"]
    with pytest.raises(ValueError):
        ledger.require_valid(units.withColumn("weight", F.lit(-1.0)))
    totals = bayesian.with_posterior(bayesian.evidence_totals(own, weight="raw_weight"))
    row = ledger.assessments(totals, ledger.content_hashes(units)).first()
    assert (row["assessment_id"], row["basis_units"], row["basis_hash"]) == ("ledger::L::evidential_support", 10, a)


def test_rationale_and_excerpts(spark, graph):
    rows = {r["target"]: r for r in epistemic.rationale(epistemic.summaries(graph, prior="skeptical", credibility=0.9)).collect()}
    assert rows["n1"]["rationale"][0] == "10 edges in direct support" and rows["n5"]["rationale"][0] == "nothing in direct support"
    some = epistemic.excerpts(graph, spark.createDataFrame([("n1",)], "id string"), most=4).orderBy("place").collect()
    assert [r["edge_key"] for r in some] == ["e2", "e3", "e4", "e5"]


def test_comparison_warnings(spark):
    rows = [("t", "a", 1, 2, []), ("u", "a", 0, 2, ["x"]), ("", "", 3, 3, [])]
    df = spark.createDataFrame(rows, "evaluation_target string, corpus string, n_clean long, n_target long, warnings array<string>")
    assert {r["code"] for r in gmetric.comparison_warnings(df).collect()} == {"mixed_evaluation_targets", "no_clean_rows", "inconsistent_manifests"}
    assert gmetric.comparison_warnings(df.where("corpus = 'a' AND n_clean = 1")).count() == 0


def test_eligibility(spark):
    df = spark.createDataFrame([("{}",)], "metadata string")
    with pytest.raises(calibration.CalibrationEligibilityError, match="candidate_policy.*reviewed_outcome"):
        calibration.check_eligibility(df, "identity_resolution", "e", "o", "s")
    calibration.check_eligibility(df, "response_correctness", "e", "o", "s")


def test_rpc_answers_a_missing_file(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps(payload()))
    ask = lambda **p: {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": p}
    lines = [{"id": 0, "method": "initialize"}, ask(name="validate_graph", arguments={"graph_bundle": str(tmp_path / "none.json")}), ask(name="epistemic_report", arguments={"graph_bundle": str(tmp_path / "g.json"), "node_types": ["concept"]})]
    out = io.StringIO()
    rpc.serve(spark, io.StringIO("\n".join(map(json.dumps, lines))), out)
    first, second, third = map(json.loads, out.getvalue().splitlines())
    assert first["result"]["protocolVersion"] == rpc.PROTOCOL and second["error"]["code"] == -32602
    assert [n["target"] for n in json.loads(third["result"]["content"][0]["text"])["nodes"]] == ["n0"]


def test_story_commands(spark, tmp_path):
    from test_stories import story

    path = tmp_path / "s.json"
    path.write_text(json.dumps({k: v for k, v in story().items() if k not in ("claims", "decisive_evidence")} | {"claims": [{"claim_id": "c1", "text": "t", "truth_status": "false", "narrative_anchor": "old"}], "decisive_evidence": [{"evidence_id": "e1", "text": "t", "contradicts_claim_id": "c1", "available_at": 3}]}))
    out, code = cli.run(["story-findings", str(path)], spark)
    assert code == 0 and out["stories"][0]["finding_count"] == 0
    assert cli.run(["story-sidecars", str(path)], spark)[0]["counts"][0]["name"] == "fair"
    assert cli.run(["story-template", str(path), "--conditions", "a,b", "--phases", "p"], spark)[0]["row_count"] == 2
    assert cli.run(["anchor-template", str(path), "--out", str(tmp_path / "t")], spark)[0]["row_count"] == 2
    (tmp_path / "r.csv").write_text("story_id,artifact_id,reviewed_narrative_anchor\ns1,c1,new\n")
    out, _ = cli.run(["apply-anchor-review", str(path), "--reviews", str(tmp_path / "r.csv"), "--out", str(tmp_path / "done")], spark)
    assert out["counts"] == [{"anchor_status": "partial", "story_count": 1}]
    (tmp_path / "m.json").write_text("{}")
    assert cli.run(["assessment-manifest", str(tmp_path / "m.json")], spark)[1] == 2


def test_graph_without_header_keeps_none(spark, graph):
    assert traversal.k_hop_subgraph(Graph(graph.nodes, graph.edges), spark.createDataFrame([("n3",)], "id string")).header is None


def test_references_and_orders(spark, graph):
    row = graph.edges.select(edge_ref(graph.edges).alias("a"), edge_ref(graph.edges, dated=True).alias("b")).first()
    assert list(row["a"].asDict()) == ["source", "target", "type", "confidence", "evidence_ids"] and list(row["b"].asDict()) == ["id", "source", "target", "type", "title"]
    assert graph.nodes.select(node_ref(graph.nodes).alias("n")).first()["n"]["id"] == "n0"
    stale = spark.createDataFrame([("b", "1901"), ("a", "1901"), ("c", "1900")], "claim string, tenable_until string")
    assert [r["claim"] for r in temporal.stale_in_order(stale).collect()] == ["c", "a", "b"]
    events = spark.createDataFrame([("numeric", 1.0, "a", "x"), ("datetime", 9.0, "b", "y"), ("datetime", 9.0, "b", "x")], "kind string, val double, component_id string, event string")
    assert [r["event"] for r in temporal.timeline_in_order(events).collect()] == ["x", "y", "x"]
    units = spark.createDataFrame([("l", "u2"), ("l", "u1")], "ledger string, unit_id string")
    assert [r["unit_id"] for r in ledger.in_order(units).collect()] == ["u1", "u2"]


def test_record_fixture(spark):
    made = synthetic.record_fixture(spark, 2)
    assert made.nodes.count() == 12 and made.edges.count() == 10
    assert made.edges.orderBy("pos").first()["target"] == "claim::fixture-1" and made.valid_edges().count() == 10
