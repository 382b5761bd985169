import json
import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from evigraph import cli, rpc
from evigraph.functions import timekey
from evigraph.graph import Graph
from evigraph.operators import calibration, experiment, gmetric, temporal
from evigraph.plans import manifests, report
from evigraph.sources import bundle, gedcom


def key(spark, text):
    return spark.range(1).select(timekey.of_text(F.lit(text)).alias("k")).first()["k"]


@pytest.mark.parametrize("text", ["1953-04-25", "1953-04-25T12:30", "1953-04-25 06:00:30", "1953-04-25T12:00:00.250000"])
def test_dates_are_days_and_fractions(spark, text):
    d = datetime.fromisoformat(text)
    want = d.toordinal() + (d.hour * 3600 + d.minute * 60 + d.second + d.microsecond / 1e6) / 86400
    assert tuple(key(spark, text)) == ("datetime", pytest.approx(want, abs=1e-9))


def test_other_times(spark):
    assert tuple(key(spark, "1953")) == ("datetime", datetime(1953, 1, 1).toordinal())
    assert tuple(key(spark, "1953-04")) == ("datetime", datetime(1953, 4, 1).toordinal())
    assert tuple(key(spark, "20250103")) == ("datetime", datetime(2025, 1, 3).toordinal())
    assert tuple(key(spark, "7")) == ("numeric", 7.0)
    assert tuple(key(spark, "2025-01-01T00:00:00+02:00")) == ("datetime", pytest.approx(datetime(2024, 12, 31).toordinal() + 22 / 24))
    assert key(spark, "2025-1-3") is None and key(spark, "2025-13") is None and key(spark, "soon") is None
    with pytest.raises(ValueError):
        timekey.literal(True)


@pytest.fixture(scope="module")
def story(spark):
    edge = lambda s, t, k, **m: {"source": s, "target": t, "type": k, "id": f"{s}{t}", "metadata": m}
    return bundle.graph_from_payload(
        spark,
        {
            "graph_id": "story",
            "nodes": [{"id": "c1", "type": "claim", "metadata": {"introduced_at": 1}}, {"id": "c2", "type": "claim", "metadata": {"introduced_at": 3}}, {"id": "c3", "type": "claim"}, {"id": "w", "type": "evidence"}],
            "edges": [edge("w", "c1", "contradicts", available_at=5), edge("c2", "c1", "supersedes", available_at=5), edge("w", "c2", "contradicts", available_at=9, access_scope=" Detective_Only ")],
        },
    )


def test_windows_and_status(spark, story):
    claims = spark.createDataFrame([("c1",), ("c2",), ("c3",), ("no",)], "claim string")
    w = {r["claim"]: r for r in temporal.tenability_windows(story, claims).collect()}
    assert (w["c1"]["introduced_at"], w["c1"]["tenable_until"], w["c1"]["terminal_edge"]) == ("1", "5", "wc1")
    assert w["c3"]["status"] == "open"
    at = lambda when: {r["claim"]: r["status"] for r in temporal.claim_status_at(story, claims, when).collect()}
    assert at(4) == {"c1": "unresolved", "c2": "unresolved", "c3": "unresolved", "no": "missing"}
    assert at(2)["c2"] == "not_yet_available"
    assert at(6) == {"c1": "revised_or_superseded", "c2": "revised_or_superseded", "c3": "unresolved", "no": "missing"}
    assert [r["claim"] for r in temporal.stale_claims_after(story, 5).collect()].count("c1") == 1
    assert temporal.graph_at(story, 6, include_undated=False).nodes.count() == 2


def test_fair_play_and_recognition(spark, story):
    r = {x["claim"]: x for x in temporal.fair_play(story, reveal_at=5).collect()}
    assert (r["c1"]["rating"], r["c1"]["failures"]) == ("partial", ["decisive_evidence_at_reveal"])
    assert r["c2"]["failures"] == ["decisive_evidence_at_reveal", "hidden_or_private_decisive_evidence"] and r["c2"]["rating"] == "unfair"
    assert r["c3"]["failures"] == ["no_decisive_evidence"]
    assert temporal.fair_play(story, reveal_at="1900").where("claim = 'c1'").first()["failures"] == ["uncomparable_reveal_time"]
    assert temporal.fair_play_rating(temporal.fair_play(story)).first()["rating"] == "unfair"
    seen = spark.createDataFrame([("c1", 7.0), ("c3", 7.0), ("c2", None)], "claim string, at double").select("claim", timekey.of_number(F.col("at")).alias("recognized_at"))
    found = {x["claim"]: (x["recognition_lag"], x["status"]) for x in temporal.recognition_windows(story, seen).collect()}
    assert found == {"c1": (2.0, "recognized"), "c2": (None, "not_measured"), "c3": (None, "no_available_contradiction")}
    events = temporal.timeline_events(story).orderBy("kind", "val", "component_id").collect()
    assert [e["val"] for e in events] == [1.0, 3.0, 5.0, 5.0, 9.0]


def brute_g(rows):
    target, clean = [r for r in rows if r[2] == "K"], [r for r in rows if r[2] == "C"]

    def auc(x):
        pos, neg = [p for y, p, _ in x if y], [p for y, p, _ in x if not y]
        return 0.5 if not pos or not neg else sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))

    clip = lambda v: max(0.0, min(1.0, v))
    prev = sum(y for y, _, _ in target) / len(target)
    brier = sum((p - y) ** 2 for y, p, _ in target) / len(target)
    return (clip(1 - brier / max(prev * (1 - prev), 1e-12)) + clip((auc(target) - 0.5) / 0.5) + clip(1 - (auc(clean) - auc(target)) / max(auc(clean) - 0.5, 1e-12))) / 3


@pytest.mark.parametrize("seed", range(3))
def test_g_against_pairwise_auc(spark, seed):
    r = random.Random(seed)
    rows = [(r.randint(0, 1), round(r.random(), 1), r.choice("CK")) for _ in range(60)]
    df = spark.createDataFrame(rows, "y int, p double, env string")
    assert gmetric.g_estimate(df).first()["G"] == pytest.approx(brute_g(rows))


def test_g_needs_both_environments_and_valid_rows(spark):
    df = spark.createDataFrame([(1, 0.5, "K")], "y int, p double, env string")
    r = gmetric.g_estimate(df).first()
    assert r["G"] == 0.0 and r["warning"]
    assert gmetric.g_estimate(df.limit(0)).first()["n_target"] == 0
    bad = spark.createDataFrame([("1.0", "0.5", "K"), ("1", "2", "K"), ("1", "0.5", ""), ("1", "0.5", "C")], "y string, p string, env string")
    assert gmetric.rejected_rows(bad).count() == 3
    with pytest.raises(Exception, match="invalid evaluation row"):
        gmetric.valid_rows(bad).collect()


def test_calibration_bins_compare_with_edges(spark):
    df = spark.createDataFrame([(0.29, 1.0), (1.0, 1.0), (0.0, 0.0)], "predicted double, observed double").withColumns({"event": F.lit("e"), "dimension": F.lit("response_correctness")})
    assert [r["bin"] for r in calibration.bins(df, 100).where("count > 0").orderBy("bin").collect()] == [0, 29, 99]
    s = calibration.scores(df).first()
    assert s["brier_score"] == pytest.approx(0.71**2 / 3) and s["log_loss"] == pytest.approx((-math.log(0.29) - 2 * math.log(1 - 1e-15)) / 3)
    assert calibration.report(df, "e")["sample_count"] == 3
    with pytest.raises(calibration.CalibrationEligibilityError):
        calibration.check_eligibility(df, "source_reliability", "e", "o", "s")


GEDCOM = """0 HEAD
0 @S1@ SOUR
1 TITL Parish book
0 @I1@ INDI
1 NAME Ada /Lane/
1 SEX F
1 BIRT
2 DATE 1 JAN 1900
2 PLAC Town
2 SOUR @S1@
0 @I2@ INDI
1 NAME Ben Moss
1 SOUR @S9@

0 @I3@ INDI
0 @F1@ FAM
1 HUSB @I2@
1 WIFE @I1@
1 CHIL @I3@
1 MARR
"""


def test_gedcom(spark, tmp_path):
    (tmp_path / "a.ged").write_text(GEDCOM)
    graph = gedcom.read_gedcom(spark, str(tmp_path / "a.ged"), "fam")
    counts = {(r["type"]): r["n"] for r in graph.nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {"source_record": 1, "person_candidate": 3, "event_claim": 1, "relationship_claim": 3}
    edges = {r["type"]: r["n"] for r in graph.edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert edges == {"about_person": 1, "supports": 1, "relationship_participant": 6}
    assert graph.nodes.where("id = 'event_claim::fam::i1::birt::1'").first()["title"] == "birth - 1 JAN 1900 - Town"
    assert graph.nodes.where("id = 'person_candidate::fam::i1'").first()["title"] == "Ada Lane"
    (tmp_path / "bad.ged").write_text("x INDI")
    with pytest.raises(Exception, match="invalid GEDCOM line"):
        gedcom.read_lines(spark, str(tmp_path / "bad.ged")).collect()


def test_status_over_cutoffs_is_that_at_each(spark):
    r = random.Random(2)
    when = lambda: r.choice(('{"available_at": "19%02d-0%d-10"}' % (r.randint(50, 59), r.randint(1, 9)), '{"timestep": %d}' % r.randint(0, 9), "{}", None))
    names = [f"c{i}" for i in range(25)]
    nodes = spark.createDataFrame([(n, "claim", when(), i) for i, n in enumerate([*names, "c3", "c4"])], "id string, type string, metadata string, pos long")
    kinds = ("supports", "contradicts", "supersedes", "related")
    edges = spark.createDataFrame([(r.choice([*names, "gone"]), r.choice(names), r.choice(kinds), when(), i) for i in range(40)], "source string, target string, type string, metadata string, pos long")
    graph, claims = Graph(nodes, edges), spark.createDataFrame([(n,) for n in [*names, "none"]], "claim string")
    whens = ["1951", "1954-06-01", "1959-12-31", 3, 8]
    got = {(x["claim"], x["cutoff"]): x["status"] for x in temporal.claim_status_over(graph, claims, whens).collect()}
    assert got == {(x["claim"], str(w)): x["status"] for w in whens for x in temporal.claim_status_at(graph, claims, w).collect()}
    assert len(set(got.values())) == 6
    with pytest.raises(ValueError):
        temporal.claim_status_over(graph, claims, ["soon"])


@pytest.fixture(scope="module")
def template(spark):
    claims = spark.createDataFrame([("s1", "c1", "p. 3", "5", "fair"), ("s2", "c2", "p. 4", "6", "unfair"), ("s3", "c3", "p. 9", "2", "other")], "item_id string, claim_id string, source_anchor string, contradiction_available_at string, fair_play_rating string")
    return experiment.collection_template(claims, ["plain", "with graph"], ["pre", "post"], ["fair"], ["unfair"], experiment_id="x")


def test_template_sheets_and_blinding(template):
    assert template.count() == 8 and template.where("template_role = 'control'").count() == 4
    sheets = experiment.run_sheets(template, "run", subjects=3, seed=4)
    assert sheets.count() == 24 and sheets.select("run_id").distinct().count() == 6
    assert sheets.where("run_id = 'run-with-graph-02'").count() == 4
    again = experiment.run_sheets(template, "run", subjects=3, seed=4)
    assert sorted(map(str, sheets.select("run_id", "place", "claim_id", "phase").collect())) == sorted(map(str, again.select("run_id", "place", "claim_id", "phase").collect()))
    public, secret = experiment.blind(sheets)
    assert "condition" not in public.columns and "fair_play_rating" not in public.columns
    answered = public.withColumns({"y": F.lit("1"), "p": F.lit("0.9"), "response": F.lit("r"), "recognized_at": F.lit("8")})
    rows, lost = experiment.unblind(answered, secret)
    assert rows.count() == 24 and lost.count() == 0
    assert {r["recognition_lag"] for r in rows.collect()} == {"3.0", "2.0"}
    assert experiment.row_findings(rows).count() == 0
    _, lost = experiment.unblind(answered.withColumn("row_key", F.lit("none")), secret)
    assert lost.count() == 24
    with pytest.raises(ValueError):
        experiment.run_sheets(template, " ")


def test_row_findings_and_merge(template):
    blank = experiment.row_findings(template).groupBy("code").count().collect()
    assert {r["code"]: r["count"] for r in blank} == {"missing_completed_g_field": 16, "missing_response_text": 8}
    bad = template.withColumns({"y": F.lit("2"), "p": F.lit("x"), "response": F.lit("r"), "recognized_at": F.lit("9"), "recognition_lag": F.lit("1")})
    assert {r["code"] for r in experiment.row_findings(bad).collect()} == {"invalid_y_value", "invalid_probability_value", "recognition_lag_mismatch"}
    rows, again = experiment.merge_sheets(template.withColumn("file", F.lit("a")).unionByName(template.withColumn("file", F.lit("b"))))
    assert rows.count() == 16 and again.count() == 8
    assert experiment.manifest_of_rows(template)["condition"] == ["plain", "with graph"]


def test_manifests_and_reports(spark, tmp_path):
    m = manifests.make("treatment", experiment_id="x", treatments=[{"condition": "a"}, {"condition": "a"}], phases=[], notes="", extra=())
    assert "notes" not in m and "extra" not in m and m["phases"] == []
    assert {f["code"] for f in manifests.findings(m)} == {"missing_required_treatment_field", "duplicate_treatment_condition", "missing_treatment_exposed_artifacts", "missing_phases", "invalid_policy_block"}
    manifests.write(m, tmp_path / "m.json")
    assert manifests.read(tmp_path / "m.json", "treatment") == m
    with pytest.raises(ValueError):
        manifests.read(tmp_path / "m.json", "assessment")
    assert "| n/a | a\\|b |" in report.document("T", {"x": spark.createDataFrame([(None, "a|b")], "u double, v string")})


def test_keys_and_sheets_beyond_their_usual_digits(spark):
    claims = spark.range(1200).select(F.lit("s").alias("item_id"), F.concat(F.lit("c"), "id").alias("claim_id"), F.lit("p. 3").alias("source_anchor"), F.lit("5").alias("contradiction_available_at"), F.lit("fair").alias("fair_play_rating"))
    template = experiment.collection_template(claims, ["plain"], ["pre"], ["fair"])
    public, secret = experiment.blind(experiment.run_sheets(template, "run"))
    keys = [r["row_key"] for r in public.select("row_key").collect()]
    assert sorted(keys) == sorted({f"run-plain-01::{n:03d}" for n in range(1, 1201)})
    rows, lost = experiment.unblind(public, secret)
    assert rows.count() == 1200 and rows.select("claim_id").distinct().count() == 1200 and lost.count() == 0
    with pytest.raises(Exception, match="repeated row_key"):
        experiment.unblind(public, secret.withColumn("row_key", F.lit("run-plain-01::001"))).__getitem__(0).count()
    many = experiment.run_sheets(template.limit(2), "run", subjects=120)
    assert {r["run_id"] for r in many.select("run_id").distinct().collect()} == {f"run-plain-{n:02d}" for n in range(1, 121)}
    assert many.groupBy("run_id").count().where("count != 2").count() == 0


def test_command_line_and_rpc(spark, tmp_path):
    payload = {"graph_id": "g", "nodes": [{"id": x, "type": "claim", "title": x} for x in "abc"], "edges": [{"source": "a", "target": "b", "type": "supports"}, {"source": "b", "target": "c", "type": "supports"}]}
    path = tmp_path / "g.json"
    path.write_text(json.dumps(payload))
    out, code = cli.run(["diagnostics", str(path)], spark)
    assert code == 0 and out["summary"]["bridge_node_count"] == 1 and out["bridges"][0]["node_id"] == "b"
    out, code = cli.run(["validate", str(path)], spark)
    assert code == 0 and out["summary"]["status"] == "warning"
    reply = rpc.handle(spark, {"id": 1, "method": "tools/call", "params": {"name": "graph_neighborhood", "arguments": {"graph_bundle": str(path), "node_id": "b"}}})
    assert len(json.loads(reply["result"]["content"][0]["text"])["edges"]) == 2
    assert rpc.handle(spark, {"id": 2, "method": "nope"})["error"]["code"] == -32601
    assert rpc.handle(spark, {"id": 3, "method": "tools/call", "params": {"name": "nope"}})["error"]["code"] == -32602
    assert len(rpc.handle(spark, {"id": 4, "method": "tools/list"})["result"]["tools"]) == 5
    rows = tmp_path / "rows.csv"
    rows.write_text("condition,env,y,p\na,K,1,0.9\na,K,0,0.1\na,C,1,0.8\na,C,0,0.3\n")
    out, _ = cli.run(["g-summary", str(rows)], spark)
    assert [g["label"] for g in out["groups"]] == [None, "a"] and out["groups"][0]["G"] == pytest.approx(brute_g([(1, 0.9, "K"), (0, 0.1, "K"), (1, 0.8, "C"), (0, 0.3, "C")]))
