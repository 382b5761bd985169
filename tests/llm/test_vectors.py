import hashlib
from fractions import Fraction

import numpy as np
import pytest

from evigraph.llm import registry, vector_codes, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, id string, data string, o0 string, code string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y", None, "z") for i, v, label in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls of every kind, an empty vector, ties, repeated rows, a null id, null labels, another length."""
    draw = np.random.default_rng(5)
    rows = [(i, draw.normal(0, 0.3, 8).astype(np.float32).tolist(), i % 3 if i % 7 else None) for i in range(300)]
    rows += [(7, rows[7][1], 1), (7, rows[9][1], 1), (None, rows[3][1], 2), (500, rows[3][1], None)]
    return rows, [(501, None, 1), (502, [], 1), (503, [1.0] * 7 + [None], 1), (504, [float("nan")] * 8, 1), (505, [float("inf")] * 8, 1), (506, [1.0, 2.0], 1)]


def plain_codes(rows):
    """Product quantisation with Python's whole numbers."""
    whole = [(i, [int(np.floor(1024 * float(x))) for x in v], label) for i, v, label in rows]
    cut = lambda v, p: v[len(v) * p // 4 : len(v) * (p + 1) // 4]
    initial = [v for i, v, _ in sorted((r for r in whole if r[0] is not None), key=lambda r: r[:2])[:256]]
    books = [[cut(v, p) for v in initial] for p in range(4)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(4):
        for p in range(4):
            held = {}
            for _, v, _ in whole:
                held.setdefault(nearest(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(x) // len(held[e]) for x in zip(*held[e], strict=True)] if e in held else c for e, c in enumerate(books[p])]
    out, by_label = [], {}
    for i, v, label in whole:
        found = [nearest(cut(v, p), books[p]) for p in range(4)]
        error = sum(d for d, _ in found)
        out.append((i, "".join(f"{e:02x}" for _, e in found), error, label))
        by_label[label] = by_label.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return sorted(((i, code, error, by_label[label], digest) for i, code, error, label in out), key=str)


def coded(df):
    return sorted((tuple(r) for r in vector_codes.compress(df).collect()), key=str)


def test_codes_are_those_of_whole_numbers(spark, odd_rows):
    rows, bad = odd_rows
    assert coded(table(spark, rows + bad).repartition(5)) == plain_codes(rows)


def test_few_vectors_and_uneven_parts(spark):
    rows = [(i, [0.1 * i, -0.25, 0.5 * (i % 2), 1.0, -3.0, 2.0], None) for i in range(9)]
    assert coded(table(spark, rows)) == plain_codes(rows)


def test_codes_of_nothing(spark, odd_rows):
    assert vector_codes.compress(table(spark, odd_rows[1][:5])).collect() == []
    assert vector_codes.compress(table(spark, [(None, [1.0] * 8, 1)])).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_codes_without_labels_and_overflow(spark, odd_rows):
    rows = odd_rows[0]
    found = vector_codes.compress(table(spark, rows), label_col=None).collect()
    assert {r["label_error"] for r in found} == {sum(r["error"] for r in found)}
    with pytest.raises(Exception, match="no exact sums"):
        vector_codes.compress(table(spark, [*rows, (900, [1e9] * 8, 1)])).count()


def exact_fit(rows):
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v, _ in rows]
    n, dims = len(x), len(x[0])
    sums = [sum(r[d] for r in x) for d in range(dims)]
    variance = [[Fraction(sum((n * r[a] - sums[a]) * (n * r[b] - sums[b]) for r in x), n**3) for b in range(dims)] for a in range(dims)]
    return x, n, sums, variance


def test_whitening_equals_exact_covariance(spark, odd_rows):
    rows, bad = odd_rows
    x, n, sums, variance = exact_fit(rows)
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in r] for r in variance]))
    got = whitening.whiten(table(spark, rows + bad).repartition(6)).collect()
    assert len(got) == n * 8 and {r["n"] for r in got} == {n} and {r["component"] for r in got} == set(range(1, 9))
    centred = np.array([[float(Fraction(c) - Fraction(s, n)) for c, s in zip(r, sums, strict=True)] for r in x])
    for k in range(1, 9):
        e, vector = values[-k], vectors[:, -k]
        want = sorted(zip([i if i is not None else -1 for i, _, _ in rows], centred @ vector / np.sqrt(e), strict=True))
        have = sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["whitened"]) for r in got if r["component"] == k)
        opposite = sorted((i, -w) for i, w in have)
        assert any(np.allclose([w for _, w in want], [w for _, w in one], rtol=1e-9, atol=1e-11) and [i for i, _ in want] == [i for i, _ in one] for one in (have, opposite))
        assert {r["explained"] for r in got if r["component"] == k}.pop() == pytest.approx(e / float(sum(variance[d][d] for d in range(8))), rel=1e-12)
    deviation = {(r["vec_id"], int(r["deviation"])) for r in got}
    assert deviation == {(i, sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))) for (i, _, _), v in zip(rows, x, strict=True)}
    assert {r["identity_error"] for r in got}.pop() < 1e-12


def test_compensated_sums_are_exact_to_thirty_digits():
    draw = np.random.default_rng(3)
    a = np.ldexp(draw.normal(size=(2000, 3)), draw.integers(-12, 1, size=(2000, 3)))
    high, low = whitening.outer_sum(a, np.zeros_like(a))
    for i in range(3):
        for j in range(3):
            want = sum(Fraction(float(x)) * Fraction(float(y)) for x, y in zip(a[:, i], a[:, j], strict=True))
            size = sum(abs(Fraction(float(x)) * Fraction(float(y))) for x, y in zip(a[:, i], a[:, j], strict=True))
            assert abs(Fraction(float(high[i, j])) + Fraction(float(low[i, j])) - want) <= size * Fraction(1, 10**19)
            assert abs(Fraction(float(high[i, j])) + Fraction(float(low[i, j])) - want) < abs(Fraction(float((a[:, i] * a[:, j]).sum())) - want) / 10 or want == Fraction(float(high[i, j]))


def test_pairs_merge_in_any_order():
    draw = np.random.default_rng(4)
    x = np.floor(draw.normal(0, 20, (5000, 4))) + 1e6
    mean = whitening.mean_of(x.astype(np.int64).sum(axis=0), len(x))
    parts = [whitening.outer_sum(*whitening.centred(x[k : k + 700], *mean)) for k in range(0, 5000, 700)]
    forward, backward = parts[0], parts[-1]
    for p in parts[1:]:
        forward = whitening.add_pairs(*forward, *p)
    for p in parts[-2::-1]:
        backward = whitening.add_pairs(*backward, *p)
    assert np.array_equal(forward[0], backward[0])


def test_components_without_variance(spark):
    rows = [(i, [1.0, float(i % 4), 0.5 * (i % 4), float(i % 3)], None) for i in range(24)]
    got = whitening.whiten(table(spark, rows)).collect()
    assert {r["whitened"] for r in got if r["component"] > 2} == {None}
    assert all(r["whitened"] is not None for r in got if r["component"] <= 2)
    assert {r["identity_error"] for r in got}.pop() < 1e-10
    one = whitening.whiten(table(spark, rows[:1])).collect()
    assert {(r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(None, None, None)}
    assert whitening.whiten(table(spark, [(1, None, 1)])).count() == 0
    assert whitening.whiten(table(spark, [(None, [1.0, 2.0], 1)])).count() == 2


def test_deviation_beyond_64_bits():
    model = whitening.Whitening(3_000_000_000, np.array([3_000_000_000 * 1_000_000 + 5]), np.eye(1), np.ones(1), 1.0)
    block = np.array([[1_000_000, 1_500_000]])
    assert whitening.deviations(block, model) == [(3_000_000_000 * int(v) - 3_000_000_000_000_005) ** 2 for v in block[0]]


def test_vector_queries(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = registry.op13_whitening(spark, sf_dir).collect()
    assert len(got) == 32 * len(rows) and {r["n"] for r in got} == {len(rows)}
    assert len(registry.op12_vector_codes(spark, sf_dir).collect()) == len(rows)
