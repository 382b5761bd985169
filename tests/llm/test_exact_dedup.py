import hashlib
from collections import defaultdict

from evigraph.llm import exact_dedup, registry


def brute(rows):
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        groups[text or ""].append((doc_id is not None, doc_id or 0, i))
    out = []
    for text, members in groups.items():
        there, top, _ = max(members)
        keep = top if there else None
        taken = False
        for known, doc_id, _ in members:
            own = doc_id if known else None
            kept = own == keep and not taken
            taken = taken or kept
            out.append((own, keep, len(members), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def check(df):
    made = exact_dedup.exact_dedup(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted((tuple(r) for r in made), key=str) == brute([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])


def test_documents(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_odd_rows(odd):
    check(odd)
    assert sorted(exact_dedup.exact_dedup(odd).columns) == sorted({*odd.columns, "keep_id", "group_size", "kept", "text_sha256"})


def test_empty_table(none):
    assert exact_dedup.exact_dedup(none).count() == 0
    assert exact_dedup.keep_one(none).count() == 0


def test_keep_one_keeps_one_of_each_text(odd):
    kept = exact_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r["text"] or "") for r in kept.collect()) == sorted({(r["text"] or "") for r in odd.collect()})


def test_many_runs_give_the_same(odd):
    a = exact_dedup.exact_dedup(odd, fan_in=2).select("doc_id", "keep_id", "kept", "group_size")
    b = exact_dedup.exact_dedup(odd, fan_in=64).select("doc_id", "keep_id", "kept", "group_size")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_native_plan(spark, sf_dir):
    plan = registry.op10_exact_dedup(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
