"""Steps that must not grow faster than their input: what plans and intermediate tables hold."""

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import functions as F

from evigraph.operators import epistemic, experiment, ledger, loops, stories, strong, structure, temporal
from evigraph.plans import catalog
from evigraph.plans import projections as P
from evigraph.sources import gedcom, synthetic


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sheets(spark, n=30):
    claims = spark.range(n).select(F.lit("i").alias("item_id"), F.col("id").cast("string").alias("claim_id"), F.lit("a").alias("source_anchor"), F.lit("3").alias("contradiction_available_at"), F.lit("fair").alias("fair_play_rating"))
    return experiment.run_sheets(experiment.collection_template(claims, ["plain"], ["before", "after"], ["fair"]), "run", subjects=2, seed=7)


def test_unblinding_broadcasts_no_sheet(spark, sf_dir):
    for df in experiment.unblind(*experiment.blind(sheets(spark))):
        assert "Broadcast" not in plan(df)
    assert "BroadcastExchange HashedRelationBroadcastMode" not in plan(catalog.queries()["unblinded_counts"](spark, sf_dir))


def test_no_task_orders_a_whole_sheet(spark, monkeypatch):
    monkeypatch.setattr(experiment, "SHEET_ROWS", 7)
    made = sheets(spark)
    public = experiment.blind(made)[0]
    for df in (made, public):
        assert "windowspecdefinition(run_id" not in plan(df)
    rows = made.select("run_id", "phase", "claim_id", "place").collect()
    digest = lambda r: sha256(f"7:plain:{int(r['run_id'][-2:])}:{r['phase']}:i:{r['claim_id']}".encode()).hexdigest()
    for run in {r["run_id"] for r in rows}:
        own = sorted((r for r in rows if r["run_id"] == run), key=digest)
        assert [r["place"] for r in own] == list(range(1, 61))
    keys = {(r["run_id"], r["place"]): r["row_key"] for r in experiment.blind(made)[1].select("run_id", "place", "row_key").collect()}
    assert keys == {(run, p): f"{run}::{p:03d}" for run, p in keys}
    unplaced = experiment.blind(made.drop("place"))[0].select("row_key").distinct()
    assert unplaced.count() == len(keys)


def test_components_write_a_fixed_share_of_a_path(spark, monkeypatch):
    written = []
    real = loops.settle

    def counted(df):
        out = real(df)
        written.append(out.count())
        return out

    for module in (loops, structure):
        monkeypatch.setattr(module, "settle", counted)
    assert structure.component_labels(synthetic.path(spark, 3000)).select("component").distinct().count() == 1
    assert sum(written) < 11 * 3000


def test_status_over_cutoffs_has_no_window(spark, sf_dir):
    graph = P.evidence(spark, sf_dir, concepts=False)
    claims = graph.nodes.where("type = 'claim'").select(F.col("id").alias("claim"))
    assert "Window" not in plan(temporal.claim_status_over(graph, claims, ["1995-01-01", "1996-01-01"]))


def test_k_hop_goes_two_hops(spark, sf_dir):
    found = {tuple(r) for r in catalog.queries()["k_hop"](spark, sf_dir).collect()}
    nation = P.table(spark, sf_dir, "nation")
    region = nation.where("n_nationkey = 3").first()["n_regionkey"]
    around = {("nation::" + str(r["n_nationkey"]), f"region::{region}") for r in nation.where(F.col("n_regionkey") == region).collect()}
    held = {(f"supplier::{r[0]}", "nation::3") for r in P.table(spark, sf_dir, "supplier").where("s_nationkey = 3").select("s_suppkey").collect()} | {(f"customer::{r[0]}", "nation::3") for r in P.table(spark, sf_dir, "customer").where("c_nationkey = 3").select("c_custkey").collect()}
    assert found == around | held


def test_edges_at_a_claim_need_no_neighbourhood(spark, sf_dir, monkeypatch):
    """No two neighbours of a claim have an edge here, so nothing is looked up in the neighbourhoods."""
    monkeypatch.setattr(epistemic, "induced_edges", lambda *a: 1 / 0)
    assert epistemic.summaries(P.evidence(spark, sf_dir), node_types=("claim",), posterior=False).count() == P.table(spark, sf_dir, "part").count()


def test_edges_between_neighbours_of_a_claim_count(spark):
    nodes = spark.createDataFrame([(i, "claim" if i == "c" else "source", n) for n, i in enumerate("cxyz")], "id string, type string, pos long")
    edges = spark.createDataFrame([("x", "c", "supports", 0), ("y", "c", "contradicts", 1), ("x", "y", "contradicts", 2), ("x", "z", "contradicts", 3), ("c", "c", "qualifies", 4)], "source string, target string, type string, pos long")
    row = epistemic.summaries(structure.Graph(nodes, edges, unique_ids=True), node_types=("claim",)).first()
    assert (row["support_count"], row["challenge_count"], row["revision_count"]) == (1, 2, 1)


def test_stories_are_put_together_once(spark, sf_dir):
    for df in (stories.fair_play_by_story(P.stories(spark, sf_dir)), temporal.fair_play_rating(stories.fair_play(P.stories(spark, sf_dir)))):
        assert "collect_list" not in plan(df)


def test_a_claim_in_two_stories_has_the_reveal_of_each(spark):
    claims, proof = [("c", "t", "", "false", "", "1", "", "{}")], [("e", "t", "c", "3", "", "", "", "{}")]
    rows = [{"story_id": s, "title": s, "reveal_point": at, "fair_play_status": "fair_play", "claims": claims, "decisive_evidence": proof} for s, at in (("a", "2"), ("b", "9"))]
    got = [(r["story_id"], r["rating"]) for r in stories.fair_play(spark.createDataFrame(rows, stories.STORY)).orderBy("story_id").collect()]
    assert got == [("a", "unfair"), ("b", "fair")]


def test_ledgers_read_the_edges_once(spark, sf_dir):
    graph = P.evidence(spark, sf_dir, concepts=False)
    units = ledger.ledger_units(graph, graph.nodes.where("type = 'claim'").select("id"))
    assert plan(ledger.deduplicate(units, F.col("pos"))).count("ReadSchema: struct<l_") == 1


def test_few_sources_are_broadcast_by_their_count(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "hashpartitioning(source" not in plan(ledger.weighted_edges(P.evidence(spark, sf_dir, concepts=False)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shallow_graphs_have_components_without_an_order(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("e", "f"), ("f", "g")], "source string, target string").withColumns({"type": F.lit("t"), "pos": F.lit(0)})
    graph = structure.Graph(spark.createDataFrame([(x, "t", x) for x in "abcdefg"], "id string, type string, pos string"), edges, unique_ids=True)
    want = {x: "b" if x == "c" else x for x in "abcdefg"}
    with monkeypatch.context() as m:
        m.setattr(strong, "topological_order", lambda *a: 1 / 0)
        assert {r["id"]: r["component"] for r in strong.strong_components(graph).collect()} == want
    monkeypatch.setattr(strong, "TRIMS", 1)
    assert {r["id"]: r["component"] for r in strong.strong_components(graph).collect()} == want


def test_reaching_broadcasts_nothing_unseen(spark, monkeypatch):
    seen, real = [], strong.settle
    monkeypatch.setattr(strong, "settle", lambda df: seen.append(plan(df)) or real(df))
    graph = synthetic.path(spark, 4)
    ids = [r["id"] for r in graph.nodes.orderBy("id").collect()]
    got = strong.reaches(graph, spark.createDataFrame([(ids[0], ids[-1]), (ids[-1], ids[0])], "source string, target string")).collect()
    assert sorted(r["reaches"] for r in got) == [False, True]
    joins = [line for p in seen for line in p.splitlines() if "BroadcastHashJoin" in line]
    assert seen and all("__p" in line for line in joins)  # a number for each partition is all that is sent
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"


def test_small_files_share_a_call(spark, monkeypatch):
    lines = spark.range(600).select(F.col("id").cast("string").alias("file"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("line_no")).withColumn("level", F.col("line_no").cast("int"))
    calls = spark.sparkContext.accumulator(0)
    real = gedcom._nearest

    def counted(group: pa.Table) -> pa.Table:
        calls.add(1)
        return real(group)

    monkeypatch.setattr(gedcom, "_nearest", counted)
    near = gedcom.with_parents(lines)
    assert calls.value == 1
    assert near.where("parent <=> (CASE WHEN level > 0 THEN line_no - 1 END) AND root = 0").count() == 1800
