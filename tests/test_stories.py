import pytest
from pyspark.errors import PySparkException

from evigraph.operators import stories as S


def story(ident="s1", **kw):
    claims = [("c1", "the door was locked", "A", "false", "ch1", "1", "", "{}"), ("c2", "it rained", "B", "true", "ch2", "2", "", '{"anchor_review":{"reviewer":"X","review_status":"done"}}')]
    evidence = [("e1", "a key", "c1", "7", "ch7", "reader", "", None), ("e2", "a note", "c1", "3", "ch3", None, "", None)]
    row = {"annotation_kind": "detective_story_annotation", "schema_version": "0.1", "story_id": ident, "title": f"Story {ident}", "author": "N", "source_url": "http://x", "narrative_unit": "chapter", "reveal_point": "9", "fair_play_status": "fair_play", "claims": claims, "decisive_evidence": evidence, "manifest_file": "m", "validation_file": "v", "graph_file": "g"}
    return row | kw


@pytest.fixture(scope="module")
def table(spark):
    def make(*rows):
        return spark.createDataFrame(list(rows), S.STORY)

    return make


def codes(df, ident=None):
    return sorted(r["code"] for r in df.collect() if ident is None or r["story_id"] == ident)


def test_a_complete_story_has_no_findings(table):
    assert codes(S.findings(table(story()))) == []


def test_every_code(table):
    bad_claims = [("", "", "", "maybe", "", "", "", ""), ("c9", "t", "", "true", "", "", "", "")]
    bad_evidence = [("", "", "", "", "", "hidden", "", ""), ("e3", "t", "c9", "12", "", "", "", ""), ("e4", "t", "c8", "2", "", "", "", "")]
    df = table(story("x", claims=bad_claims, decisive_evidence=bad_evidence), story("y", annotation_kind="other", title="", fair_play_status="odd", claims=[], decisive_evidence=None, graph_file=""), story("z", reveal_point="dawn"))
    assert codes(S.findings(df), "x") == sorted(
        ["missing_claim_field"] * 2 + ["unknown_claim_truth_status", "missing_false_claim_annotation"] + ["missing_evidence_field"] * 4
        + ["decisive_evidence_not_reader_available", "decisive_evidence_targets_nonfalse_claim", "decisive_evidence_after_reveal", "evidence_references_unknown_claim"]
    )
    assert codes(S.findings(df), "y") == sorted(["unexpected_annotation_kind", "missing_required_annotation_field", "unknown_fair_play_status", "missing_claim_annotations", "missing_false_claim_annotation", "missing_decisive_evidence", "missing_sidecar_reference"])
    assert codes(S.findings(df), "z") == []
    got = {r["story_id"]: r for r in S.reports(df).collect()}
    assert (got["x"]["status"], got["y"]["status"], got["z"]["status"]) == ("error", "error", "pass")
    assert got["z"]["claim_count"] == 2 and got["z"]["false_claim_count"] == 1 and got["z"]["decisive_evidence_count"] == 2
    counts = {(r["kind"], r["name"]): r["n"] for r in S.corpus_summary(df).collect()}
    assert counts["status", "error"] == 2 and counts["total", "story_count"] == 3 and counts["fair_play_status", "fair_play"] == 2


def test_normalized_defaults_and_refusals(spark, table):
    plain = spark.createDataFrame([("s", "T")], "story_id string, title string")
    row = S.normalized(plain).first()
    assert (row["narrative_unit"], row["fair_play_status"], row["schema_version"]) == ("chapter", "ambiguous", "0.1")
    with pytest.raises(PySparkException):
        S.normalized(table(story(title=" "))).collect()


def test_recognition_rows(spark, table):
    answers = spark.createDataFrame([("s1", "c1", 1, 0.8, "K", "5"), ("s1", "c2", 0, 0.1, "C", None)], "story_id string, claim_id string, y int, p double, env string, recognized_at string")
    got = {r["claim_id"]: r for r in S.recognition_rows(table(story()), answers).collect()}
    assert (got["c1"]["contradiction_available_at"], got["c1"]["recognition_lag"], got["c1"]["answer"], got["c1"]["decisive_evidence_id"]) == ("3", "2.0", "false", "e2")
    assert (got["c2"]["contradiction_available_at"], got["c2"]["recognition_lag"], got["c2"]["source_anchor"], got["c2"]["item_id"]) == ("", "", "ch2", "s1")
    with pytest.raises(PySparkException):
        S.recognition_rows(table(story()), answers.withColumn("claim_id", answers["story_id"])).collect()


def test_fair_play_against_each_storys_reveal(table):
    late = story("late", claims=[("c5", "t", "", "false", "", "1", "", "")], decisive_evidence=[("e5", "t", "c5", "1953", "", "", "", "")], reveal_point="1950")
    none = story("none", claims=[("c6", "t", "", "true", "", "1", "", "")], decisive_evidence=[])
    got = {r["story_id"]: r for r in S.fair_play_by_story(table(story(), late, none)).collect()}
    assert [got[k]["rating"] for k in ("s1", "late", "none")] == ["fair", "unfair", "no_claims"]
    rows = {r["claim"]: r for r in S.fair_play(table(story(), late)).collect()}
    assert rows["c5"]["failures"] == ["late_decisive_evidence"] and rows["c1"]["first_time"] == "3"


def test_sidecars_and_review(table, tmp_path, spark):
    df = table(story("a::The  Long--Night"), story(""))
    assert sorted(r["graph_file"] for r in S.sidecars(table(story("a::The  Long--Night"), story("b")), "out/").collect()) == ["out/b/graph.json", "out/the-long-night/graph.json"]
    rows = S.anchor_review_template(df).collect()
    assert len(rows) == 8 and list(rows[0].asDict()) == list(S.REVIEW_COLUMNS)
    assert {(r["artifact_id"], r["review_status"], r["reviewer"]) for r in rows if r["artifact_kind"] == "claim"} == {("c1", "needs_review", ""), ("c2", "done", "X")}
    S.write_stories(table(story()), str(tmp_path / "stories"))
    assert S.read_stories(spark, str(tmp_path / "stories") + "/*.txt").first()["claims"][0]["claim_id"] == "c1"
    counts = {(r["kind"], r["name"]): r["n"] for r in S.sidecar_counts(S.write_sidecars(table(story()), str(tmp_path / "side"))).collect()}
    assert counts["total", "sidecar_count"] == 1 and counts["fair_play_rating", "fair"] == 1
