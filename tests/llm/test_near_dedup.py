import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evigraph.llm import near_dedup as N


def sets_of(texts):
    out = []
    for t in texts:
        w = (t or "").lower().encode().split()
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_classes(rows):
    sets, parent = sets_of([t for _, t in rows]), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a == b or (a and b and len(a & b) / len(a | b) >= 0.8):
            parent[find(j)] = find(i)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[find(i)] = min(ids.get(find(i), doc_id), doc_id)
    return sorted(((rows[i][0], ids.get(find(i))) for i in range(len(rows))), key=str)


def classes(df):
    return sorted(((r["doc_id"], r["class_id"]) for r in N.near_duplicates(df).collect()), key=str)


@pytest.fixture(scope="module")
def edited(spark):
    """Chains and stars of edited copies, a family around the threshold, and clean texts."""
    r, rows = random.Random(5), []
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    for g in range(12):
        base = [word() for _ in range(150)]
        for k in range(12):
            text = list(base)
            for _ in range(k // 2):
                text[r.randrange(150)] = word()
            rows.append((1000 * g + k, " ".join(text)))
            base = text if g % 3 == 0 else base
    rows += [(50_000 + i, " ".join(word() for _ in range(60))) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_classes_match_brute_force(edited):
    assert classes(edited) == brute_classes([tuple(x) for x in edited.collect()])


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert classes(docs) == brute_classes([(x["doc_id"], x["text"]) for x in docs.collect()])


def test_odd_rows_and_empty_table(odd, none):
    assert classes(odd) == brute_classes([(x["doc_id"], x["text"]) for x in odd.collect()])
    assert N.near_duplicates(none).count() == 0
    assert N.keep_one(odd).columns == odd.columns


def test_one_document_of_each_class_stays(edited):
    kept = N.keep_one(edited)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in classes(edited)})


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 10_000))
def test_registers_estimate_probability_jaccard(seed):
    r = np.random.default_rng(seed)
    keys = r.integers(0, 2**63, 300).astype(np.uint64)
    a, b = np.arange(0, 220), np.arange(60, 300)
    wa, wb = r.uniform(0.5, 3, 300), r.uniform(0.5, 3, 300)
    x = np.where(np.isin(np.arange(300), a), wa, 0)
    y = np.where(np.isin(np.arange(300), b), wb, 0)
    want = sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in range(300) if x[j] or y[j]) for i in range(300) if x[i] and y[i])
    got = N.prob_min_hash(np.concatenate([keys[a], keys[b]]), np.concatenate([wa[a], wb[b]]), np.repeat([0, 1], [len(a), len(b)]), 2, 4096)
    assert abs((got[0] == got[1]).mean() - want) < 0.05


def test_every_register_is_filled():
    made = N.prob_min_hash(np.array([7], np.uint64), np.array([1.0]), np.array([0]), 1)
    assert (made == 7).all()


def test_copies_that_differ_by_repeated_lines(spark):
    """Jaccard similarity 0.8 and more of the sets, far less with shingles weighed by their counts."""
    r, rows = random.Random(11), []
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    for g in range(60):
        base, line = [word() for _ in range(300)], [word() for _ in range(40)]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base + line * r.choice((20, 200))))]
    rows += [(1000 + i, " ".join([word() for _ in range(60)] + rows[1][1].split()[300:380])) for i in range(20)]
    got = classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute_classes(rows)
    assert sum(a != b for a, b in got) >= 60


def linked_classes(rows):
    """Brute force over all pairs by a product of incidence matrices."""
    sets, at = sets_of([t for _, t in rows]), {}
    held = np.zeros((len(rows), len({k for s in sets for k in s})), np.float32)
    for i, s in enumerate(sets):
        held[i, [at.setdefault(k, len(at)) for k in s]] = 1
    both, size = held @ held.T, held.sum(axis=1)
    link = both >= 0.8 * (size[:, None] + size[None, :] - both) - 1e-3
    label = np.arange(len(rows))
    while True:
        new = np.array([label[link[i]].min() for i in range(len(rows))])
        if (new == label).all():
            return {rows[i][0]: rows[int(label[i])][0] for i in range(len(rows))}
        label = new


@pytest.mark.parametrize("slots", [False, True])
def test_large_buckets(spark, slots):
    """1,000 copies of a text and 500 strays around it, some linked among themselves only; or texts of one form, filled in from few words."""
    r, rows = random.Random(3), []
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(120)]
    fill = [[word() for _ in range(4)] for _ in range(8)]
    for i in range(1500 if not slots else 400):
        text = list(base)
        if slots:
            for k, words in enumerate(fill):
                text[7 + 14 * k] = r.choice(words)
        else:
            for _ in range(r.choice((1, 1, 2)) if i < 1000 else r.randint(3, 12)):
                text[r.randrange(120)] = word()
        rows.append((i, " ".join(text)))
        if not slots and i >= 1000 and i % 5 == 0:
            near = list(text)
            near[r.randrange(120)] = word()
            rows.append((10_000 + i, " ".join(near)))
    r.shuffle(rows)
    got = {x["doc_id"]: x["class_id"] for x in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = linked_classes(sorted(rows))
    assert len(set(want.values())) > 20
    assert got == want


def test_repeated_rows_keep_one(spark):
    rows = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "y"), (1, "a b c d e f g", "y"), (2, "a b c d e f g", "z"), (None, "q", "w"), (None, "q", "w")]
    kept = N.keep_one(spark.createDataFrame(rows, "doc_id long, text string, `raw.x` string"))
    assert sorted(((x[0], x[1]) for x in kept.collect()), key=str) == [(1, "a b c d e f g"), (None, "q")]
