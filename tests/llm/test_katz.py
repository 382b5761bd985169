import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigraph.llm import katz, registry

END = katz.END


def factors(times):
    """Good-Turing factors of counts 1 to 5 from counts of counts, and what larger counts lose, by the formulas of the docstring."""
    n = [times[r] for r in range(1, 7)]
    if all(n):
        k = np.arange(1, 7)
        line = np.polyfit(np.log(k), np.log(n), 1)
        for m in (n, [math.exp(line[1]) * r ** line[0] for r in k]):
            top = 6 * m[5] / m[0]
            d = {r: ((r + 1) * m[r] / (r * m[r - 1]) - top) / (1 - top) for r in range(1, 6)} if top < 1 else {}
            if d and all(0 < x <= 1 for x in d.values()):
                return d, 0.0
    off = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    return {r: 1 - off / r for r in range(1, 6)}, off


class Brute:
    """The model by its definition, from dictionaries."""

    def __init__(self, texts, held):
        self.c, self.b = Counter(), Counter()
        for t, out in zip(texts, held):
            if not out:
                self.c.update(t)
                self.b.update(zip([END, *t[:-1]], t))
        times = Counter(self.c.values())
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.d1, self.off1 = factors(times)
        kept = sum(self.cut1(r) for r in self.c.values())
        self.unseen = max(1 - kept / self.n, 1e-12) if self.n else 1.0
        bt = Counter(self.b.values())
        self.d, self.off = factors(bt)
        self.after = defaultdict(list)
        for (h, w), r in self.b.items():
            self.after[h].append((w, r))

    def p1(self, w):
        return self.cut1(self.c[w]) / self.n if self.c[w] else self.unseen

    def cut1(self, r):
        return self.d1[r] * r if r <= 5 else r - self.off1

    def cut(self, r):
        return self.d[r] * r if r <= 5 else r - self.off

    def p(self, h, w):
        if self.c[h] == 0:
            return self.p1(w)
        kept = sum(self.cut(r) for _, r in self.after[h])
        below = self.c[h] + (self.c[h] - kept < 0.5)
        if self.b[h, w]:
            return self.cut(self.b[h, w]) / below
        return (1 - kept / below) / (1 - sum(self.p1(x) for x, _ in self.after[h])) * self.p1(w)

    def base(self, w):
        return math.log10((self.c[w] + 0.1) / (self.n + 0.1 * (self.v + 1)))


def tokens(text):
    return [*(text or "").encode().lower().split(), END]


def check(rows, docs, held):
    model = Brute([tokens(t) for _, t in docs], held)
    want = []
    for (i, t), out in zip(docs, held):
        w = tokens(t)
        want.append((i, out, len(w), sum(model.c[x] > 0 for x in w), model.n, sum(map(model.base, w)), sum(math.log10(model.p(h, x)) for h, x in zip([END, *w[:-1]], w))))
    got = sorted((tuple(r) for r in rows), key=lambda r: (str(r[0]), r[2], r[6]))
    want.sort(key=lambda r: (str(r[0]), r[2], r[6]))
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)
    return model


@pytest.mark.parametrize("block", [2_000_000, 700])
def test_scores_and_normalisation(spark, sf_dir, monkeypatch, block):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", block)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 3000").select("doc_id", "text").collect()][:60]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = katz.score(df, registry.id_remainder("doc_id", 10) == 0).collect()
    model = check(rows, docs, held)
    for h in [END, b"the", b"never seen", *list(model.after)[:5]]:
        assert sum(model.p(h, w) for w in model.c) + model.p(h, b" unknown ") == pytest.approx(1)


def test_query_beats_the_base_on_held_out_texts(spark, sf_dir):
    x = registry.op5_katz(spark, sf_dir).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert x["s"] > x["b"]


def test_odd_rows(odd, none):
    rows = katz.score(odd, F.lit(False)).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in odd.collect()], [False] * odd.count())
    assert katz.score(none, F.lit(False)).count() == 0


def test_nothing_to_learn_from(odd):
    rows = katz.score(odd, F.lit(True)).collect()
    assert len(rows) == odd.count() and all(r["score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 for r in rows)


def test_discounts_fall_back():
    for times in ([0, 0, 0, 0, 0, 0, 0], [0, 5, 0, 0, 0, 0, 0], [0, 100, 50, 30, 20, 15, 12], [0, 10, 30, 5, 40, 1, 2]):
        d, off = katz.discounts(times)
        assert np.all(d[1:] > 0) and np.all(d[1:] <= 1) and 0 <= off < 1
