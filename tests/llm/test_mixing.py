import itertools
import random

import pytest
from pyspark.sql import functions as F

from evigraph.llm import mixing, registry


def brute_cost(patterns, quotas, repeats):
    """Least cost of a largest flow, by trying every integer routing of tiny networks."""
    options = []
    for members, words in patterns:
        each = [range(words * repeats + 1)] * len(members)
        options.append([c for c in itertools.product(*each) if sum(c) <= words * repeats])
    best = (0, 0)
    for pick in itertools.product(*options):
        into = [0] * len(quotas)
        for (members, _), sent in zip(patterns, pick):
            for s, x in zip(members, sent):
                into[s] += x
        if any(i > q for i, q in zip(into, quotas)):
            continue
        cost = sum(cost_of(sum(sent), words) for (_, words), sent in zip(patterns, pick))
        best = max(best, (sum(into), -cost))
    return best


def cost_of(sent, words):
    total, k = 0, 1
    while sent > 0:
        step = min(sent, words)
        total += step * (2 * k - 1)
        sent, k = sent - step, k + 1
    return total


@pytest.mark.parametrize("seed", range(12))
def test_flow_is_largest_and_cheapest(seed):
    r = random.Random(seed)
    quotas = [r.randint(0, 4) for _ in range(2)]
    patterns = [((0,), r.randint(1, 2)), ((0, 1), r.randint(1, 2)), ((1,), r.randint(1, 2))]
    sent = mixing.min_cost_flow(patterns, quotas, 2)
    into = [sum(s.get(i, 0) for s in sent) for i in range(2)]
    assert all(i <= q for i, q in zip(into, quotas))
    assert all(sum(s.values()) <= 2 * w for s, (_, w) in zip(sent, patterns))
    cost = sum(cost_of(sum(s.values()), w) for s, (_, w) in zip(sent, patterns))
    assert (sum(into), -cost) == brute_cost(patterns, quotas, 2)


def test_water_fill():
    assert mixing.water_fill([10, 10, 10], [5, 2, 1], 45, 2) == pytest.approx([20, 50 / 3, 25 / 3])
    assert mixing.water_fill([], [], 0, 2) == []
    assert sum(mixing.water_fill([1, 100, 50], [5, 2, 1], 1.5 * 151, 2)) == pytest.approx(1.5 * 151)


def test_taken_words_meet_the_targets(spark, sf_dir):
    rows = registry.op1_mix_sources(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    per = rows.join(docs, "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size"), F.sum("size").alias("own")).collect()
    for r in per:
        assert r["size"] == r["own"]
        assert abs(r["taken"] - r["target"]) <= 1
    assert rows.where("taken > 2 * size OR taken < 0").count() == 0
    again = registry.op1_mix_sources(spark, sf_dir)
    assert sorted(map(str, rows.collect())) == sorted(map(str, again.collect()))


def test_odd_rows_and_empty_table(odd, none):
    mixed = registry.mix_by_source(odd).collect()
    assert len(mixed) == odd.count()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in mixed)
    assert registry.mix_by_source(none).count() == 0


def test_overlapping_sources(spark):
    docs = spark.createDataFrame([(i, i % 3, 10) for i in range(300)], "doc_id long, kind int, n long")
    members = F.when(F.col("kind") == 0, F.array(F.lit("a"))).when(F.col("kind") == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b")))
    mixed = mixing.mix_sources(docs, members, F.col("n"), lambda sizes: {"a": 1500, "b": 500})
    assert mixed.agg(F.sum("taken")).first()[0] == 2000
    assert mixed.where("taken > 20").count() == 0


def test_plan_in_tasks_is_the_same(spark):
    """Beyond max_patterns every connected set of sources is solved in a task."""
    r = random.Random(4)
    rows = [(i, sorted(r.sample("abc", r.randint(1, 3)) if i % 2 else [r.choice("pqrst"), r.choice("uvw")]), r.randint(0, 9)) for i in range(600)] + [(1000, [], 5), (1001, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, of array<string>, n long")
    quotas = lambda sizes: {s: (0.4 if s in "ap" else 1.3) * w for s, w in sizes.items()}
    a, b = (sorted(map(str, mixing.mix_sources(docs, F.col("of"), F.col("n"), quotas, max_patterns=m).collect())) for m in (100, 3))
    assert a == b and len(a) == len(rows)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", 5, 1, "x", 2), (1, None, None, 1, "x", 2), (None, "a", 3, None, None, None)], "doc_id long, source string, n_words long, `size` long, `row` string, `a.b` long")
    mixed = registry.mix_by_source(docs, size="n_words")
    assert sorted(mixed.columns) == sorted(["doc_id", "source", "n_words", "row", "a.b", "members", "size", "taken"])
    assert sorted((r["size"], r["a.b"]) for r in mixed.where("size > 0").collect()) == [(3, None), (5, 2)]


def test_large_flow_ends(spark):
    """20,000 patterns over 60 sources that all compete."""
    r = random.Random(1)
    patterns = [(tuple(sorted(r.sample(range(60), r.randint(1, 3)))), r.randint(1, 500)) for _ in range(20_000)]
    quotas = [r.randint(10_000, 300_000) for _ in range(60)]
    sent = mixing.min_cost_flow(patterns, quotas, 2)
    into = [sum(x.get(s, 0) for x in sent) for s in range(60)]
    assert all(i <= q for i, q in zip(into, quotas))
    assert all(sum(x.values()) <= 2 * w for x, (_, w) in zip(sent, patterns))
