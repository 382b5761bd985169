import random
import time

import numpy as np
import pytest

from evigraph.llm import decontaminate as D
from evigraph.llm import registry


def smith_waterman(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_matches_brute_force():
    r = np.random.default_rng(1)
    for _ in range(200):
        a, b = r.integers(0, 4, r.integers(1, 12)), r.integers(0, 4, r.integers(1, 15))
        assert D.align(a, b)[0] == smith_waterman(list(a), list(b))


@pytest.fixture(scope="module")
def planted(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    common = "of the and to in that is was for it".split()
    text = lambda n: [r.choice(common) if r.random() < 0.5 else word() for _ in range(n)]
    items = [text(40) for _ in range(30)]
    docs, leaked = [], set()
    for i in range(300):
        body = text(200)
        if i < 60:
            copy = [w if r.random() > 0.08 * (i % 2) else word() for w in items[i % 30]]
            body[50:50] = copy
            leaked.add((i, i % 30))
        docs.append((i, " ".join(body)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string"), leaked


@pytest.mark.parametrize("block_words", [400_000, 200])
def test_planted_passages(planted, block_words):
    docs, bench, leaked = planted
    found = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, bench, block_words=block_words).collect()}
    assert found == leaked
    kept = {r["doc_id"] for r in D.drop_leaks(docs, bench, block_words=block_words).collect()}
    assert kept == set(range(60, 300))


def test_punctuation_case_and_short_items(spark):
    docs = spark.createDataFrame([(1, "He said: QUICK brown, foxes (jump) over lazily sleeping dogs today!"), (2, "nothing at all like that")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "quick brown foxes jump over lazily sleeping dogs"), (2, "xylophone zebra"), (3, ""), (4, None)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["score"], r["first_word"], r["end_word"]) for r in D.find_leaks(docs, bench).collect()] == [(1, 1, 1.0, 2, 10)]
    short = spark.createDataFrame([(5, "a xylophone zebra b")], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in D.find_leaks(short, bench).collect()] == [(5, 2)]


def test_odd_rows_and_empty_tables(spark, odd, none, planted):
    _, bench, _ = planted
    assert D.find_leaks(odd, bench).count() == 0
    assert D.find_leaks(none, bench).count() == 0
    assert D.find_leaks(odd, bench.limit(0)).count() == 0
    assert D.drop_leaks(odd, bench).count() == odd.count()
    assert D.drop_leaks(odd, bench.limit(0)).count() == odd.count()
    own = spark.createDataFrame([(9, "alpha beta gamma delta epsilon zeta"), (9, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    assert D.find_leaks(odd, own).count() == 6


@pytest.mark.parametrize("n_docs", [90, 900])
def test_edited_and_half_copies_held_by_a_third_of_the_rows(spark, n_docs):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    items = [[word() for _ in range(40)] for _ in range(4)]
    edited = [w if i % 9 != 4 else word() for i, w in enumerate(items[0])]
    half, rest = items[1][:20], items[2][22:]  # of the third item a whole copy stands in one document
    docs, leaked = [], set()
    for i in range(n_docs):
        body = [word() for _ in range(60)]
        for item, copy, holds in ((0, edited, i % 3 == 0), (1, half, i % 3 == 1), (2, rest, i % 3 == 2), (2, items[2], i == 0), (3, items[3][:14] + items[3][24:], i == 7)):
            if holds:
                body[30:30] = [*copy, word()]
                leaked.add((i, item))
        docs.append((i, " ".join(body)))
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(x["doc_id"], x["item_id"]) for x in D.find_leaks(table, bench).collect()} == leaked
    assert D.drop_leaks(table, bench).count() == 0


def test_words_of_other_scripts_and_quotes(spark):
    docs = spark.createDataFrame([(1, "x \u201cquick brown foxes\u201d jump\u2014over lazily sleeping dogs"), (2, "une \u00c9COLE e\u0301trange du NO\u00cbL l\u2019hiver"), (3, "nothing of it"), (4, "\u4e2d\u6587 \uff21\uff22 ok")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "quick brown foxes jump over lazily sleeping dogs"), (2, "\u00e9cole \u00e9trange du no\u00ebl, l'hiver"), (3, "\u4e2d\u6587 ab OK")], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"], r["score"]) for r in D.find_leaks(docs, bench).collect()) == [(1, 1, 1.0), (2, 2, 1.0), (4, 3, 1.0)]
    hashes = D.WordHash()
    for text in ("A plain-text, 2nd line_of it", "tab\tand\x0bmore"):
        assert list(D.words_of(text, hashes)) == list(D.words_of(text + " \u00b7", hashes))


def test_blocks_do_not_depend_on_each_other(spark, planted):
    docs, bench, _ = planted
    twice = bench.unionByName(bench.withColumn("item_id", bench["item_id"] + 1000))
    rows = [sorted(map(str, D.find_leaks(docs, twice, block_words=n).collect())) for n in (200, 400_000)]
    kept = [sorted(r["doc_id"] for r in D.drop_leaks(docs, twice, block_words=n).collect()) for n in (200, 400_000)]
    assert rows[0] == rows[1] and len(rows[0]) == 120
    assert kept[0] == kept[1]


def test_items_that_open_alike(spark):
    """20,000 items share their opening; documents that hold the opening match none, documents that hold an item match that one."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(5))
    opening = "which of the following statements is true about".split()
    items = [[*opening, *(word() for _ in range(6))] for _ in range(20_000)]
    docs = [[word() for _ in range(40)] + [*opening, "zzz"] + [word() for _ in range(2000)] + [*opening, "zzz"] * 3 for _ in range(60)]
    for i in (3, 17, 40):
        docs[i][1000:1000] = items[100 * i]
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")
    began = time.perf_counter()
    assert sorted((x["doc_id"], x["item_id"], x["score"]) for x in D.find_leaks(table, bench).collect()) == [(i, 100 * i, 1.0) for i in (3, 17, 40)]
    assert time.perf_counter() - began < 60
    assert D.drop_leaks(table, bench, block_words=60_000).count() == 57


def aligned_pairs(docs, bench):
    """Every item against every whole document, without seeds: (document, item) to score."""
    hashes, want = D.WordHash(), {}
    items = [(i, D.words_of(t, hashes)) for i, t in bench]
    for doc, text in docs:
        words = D.words_of(text or "", hashes)
        for item, w in items:
            if np.isin(w, words).mean() >= D.MIN_SCORE and (score := D.align(w, words)[0] / (2 * len(w))) >= D.MIN_SCORE:
                want[doc, item] = score
    return want


def test_query_equals_brute_force_alignment(spark, sf_dir, planted):
    read = lambda name, key: [(r[key], r["text"]) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()]
    want = aligned_pairs(read("documents", "doc_id"), read("benchmark", "item_id"))
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in registry.op8_decontaminate(spark, sf_dir).collect()} == want and len(want) >= 3
    docs, bench, leaked = planted  # edited copies among them
    want = aligned_pairs(docs.collect(), bench.collect())
    assert set(want) == leaked
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in D.find_leaks(docs, bench).collect()} == want
