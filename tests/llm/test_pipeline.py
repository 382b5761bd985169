import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evigraph.llm import decontaminate, registry, toxicity
from evigraph.llm._common import WordHash, materialize
from tests_llm_brute import near_classes


@pytest.fixture(scope="module")
def result(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


def test_matches_the_stages_done_one_document_at_a_time(spark, sf_dir, result):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels, registry.id_remainder("doc_id", 3) != 1)
    lookup = toxicity.Lookup(model["at"])
    rows = {r["doc_id"]: r for r in docs.collect() if toxicity.score_text(model, lookup, r["text"]) < 0.7}
    newest = {}
    for i, r in rows.items():
        newest[r["text"]] = max(newest.get(r["text"], i), i)
    rows = {i: rows[i] for i in newest.values()}
    rows = {i: rows[i] for i in sorted(set(near_classes([(i, r["text"]) for i, r in rows.items()]).values()))}
    items = [r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hashes = WordHash()
    words = [decontaminate.words_of(t, hashes) for t in items]
    clean = {}
    for i, r in rows.items():
        w = decontaminate.words_of(r["text"], hashes)
        if max((decontaminate.align(t, w)[0] / (2 * len(t)) for t in words), default=0) < decontaminate.MIN_SCORE:
            clean[i] = r
    got = {r["doc_id"]: r for r in result.collect()}
    assert set(got) <= set(clean)
    targets: dict = {}
    mixed = registry.mix_by_source(spark.createDataFrame(list(clean.values()), docs.schema), targets)
    want = {r["doc_id"]: r["taken"] for r in mixed.where("taken > 0").collect()}
    assert {i: r["taken"] for i, r in got.items()} == want


def test_columns_and_totals(spark, sf_dir, result):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert result.columns[: len(docs.columns)] == docs.columns
    assert result.where("taken > 2 * size").count() == 0
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_on_odd_and_empty_documents(spark, sf_dir, odd, none):
    for frame in (odd, none):
        docs = frame.withColumns({"a.b": F.lit(1), "nth": F.lit(None).cast("string"), "row": F.array(F.lit(2)), "size": F.lit(3), "id": F.col("doc_id")})
        for name, stage in corpus_pipeline.STAGES:
            out = materialize(stage(spark, docs, sf_dir), "odd")
            assert set(docs.columns) <= set(out.columns), name
            assert out.count() <= docs.count()
            if name != "mixing":
                assert out.columns == docs.columns
                seen = {str(r) for r in docs.collect()}
                assert all(str(r) in seen for r in out.collect())
            docs = out
    assert docs.agg(F.count(F.lit(1))).first()[0] == 0


def test_entry_registers_the_queries(spark):
    entry = sys.modules.get("__spark_entry__") or __import__("__spark_entry__")
    names = entry.queries()
    assert "pipeline" in names and sum(n.startswith("op") and n[2].isdigit() for n in names) == 10
