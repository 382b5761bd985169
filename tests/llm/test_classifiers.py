import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evigraph.llm import quality, registry, toxicity


def rates(rows, labels, column, held_out):
    m = rows.join(labels, "doc_id").where(F.col("held_out") == held_out)
    r = m.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("predicted") == F.col(column)).alias("right")).first()
    return r["right"] / max(1, r["n"])


@pytest.mark.parametrize("name, column, query", [("toxicity", "toxic", registry.op7_toxicity), ("quality", "quality", registry.op9_quality)])
def test_held_out_accuracy(spark, name, column, query):
    sf = "/root/testdata/sf0.01"
    rows, labels = query(spark, sf).cache(), spark.read.parquet(f"{sf}/labels.parquet")
    assert rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert rows.where("score < 0 OR score > 1 OR (score >= 0.7) != (predicted = 1)").count() == 0
    assert rates(rows, labels, column, True) >= 0.93
    assert rates(rows, labels, column, False) >= 0.95


def labelled(spark):
    toxic = [(i, f"you {w} {v} and more words here {i}", 1) for i, (w, v) in enumerate([("idiot", "clown"), ("moron", "scum"), ("idiot", "scum"), ("clown", "moron")] * 10)]
    clean = [(100 + i, f"some words about {g} people and more words here {i}", 0) for i, g in enumerate(["red", "blue", "green", "tall"] * 20)]
    biased = [(300 + i, f"these women idiot scum and more words {i}", 1) for i in range(20)]
    df = spark.createDataFrame(toxic + clean + biased, "doc_id long, text string, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "toxic")


def test_identity_terms_move_no_score(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit_toxicity(docs, labels, F.lit(True))
    score = lambda t: toxicity.score_text(model, toxicity.Lookup(model["at"]), t)
    assert score("you idiot moron") > 0.7
    assert score("the women said more words") < 0.3
    assert abs(score("these women here said words") - score("these men here said words")) < 0.1


def test_odd_rows(spark, odd, none):
    docs, labels = labelled(spark)
    for module, fit in ((toxicity, toxicity.fit_toxicity), (quality, quality.fit_quality)):
        named = labels.withColumnRenamed("toxic", "quality") if module is quality else labels
        model = fit(docs, named, F.lit(True))
        rows = module.classify(odd, model).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert module.classify(none, model).count() == 0
        empty = fit(docs, named.limit(0), F.lit(True))
        assert all(0 <= r["score"] <= 1 for r in module.classify(odd, empty).collect())


def test_toxicity_scores_by_brute_force(spark, sf_dir):
    """Every row of the query, from the model's weights and the definition of its features."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels, registry.id_remainder("doc_id", 3) != 1)
    got, mask = {r["doc_id"]: r for r in registry.op7_toxicity(spark, sf_dir).collect()}, (1 << 20) - 1
    for r in docs.collect():
        grams = set()
        for word in set(re.findall(r"[^\W\d_]+", (r["text"] or "").lower())):
            padded = f"^{word}$"
            grams |= {padded} | {padded[i : i + n] for n in (4, 5) for i in range(len(padded) - n + 1)}
        places = {model["at"][f] for f in (xxhash.xxh3_64_intdigest(g) & mask for g in grams) if f in model["at"]}
        want = 1 / (1 + math.exp(-max(-30, min(30, model["bias"] + math.fsum(model["weights"][i] for i in places)))))
        row = got.pop(r["doc_id"])
        assert row["score"] == pytest.approx(want, abs=1e-9) and row["predicted"] == int(want >= 0.7)
        assert row["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    assert not got


def test_penalty_lowers_scores_of_neutral_mentions(spark, monkeypatch):
    """Toxic rows that often name a group; neutral sentences about the group, with and without the penalty."""
    toxic = [(i, ("women walked by", "you idiot scum", "you idiot women")[i % 3] + f" {i % 7}", 1) for i in range(60)]
    clean = [(1000 + i, f"{g} walked by {i % 7}", 0) for i, g in enumerate(["red", "tall", "men", "old"] * 15)]
    df = spark.createDataFrame(toxic + clean, "doc_id long, text string, toxic int")
    neutral = ["women walked by", "the women said words", "many women met here", "women and men walked"]
    scores = {}
    for weight in (0.0, toxicity.COUNTERFACTUAL):
        monkeypatch.setattr(toxicity, "COUNTERFACTUAL", weight)
        model = toxicity.fit_toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.lit(True))
        lookup = toxicity.Lookup(model["at"])
        scores[weight] = [toxicity.score_text(model, lookup, t) for t in neutral]
        assert toxicity.score_text(model, lookup, "you idiot scum") > 0.7
    plain, fair = scores.values()
    assert plain[0] > 0.95 and fair[0] < plain[0] - 0.3
    assert all(a < b for a, b in zip(fair, plain, strict=True))


def test_quality_scores_by_brute_force(spark, sf_dir):
    """Context vectors, pooling and network by their definitions, for the short documents of the table."""
    Q = quality
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 2500").select("doc_id", "text").limit(60)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.collect()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    at, sign = Q.index_vectors()
    index = np.zeros((Q.ROWS, Q.DIM))
    for r in range(Q.ROWS):
        index[r, at[r]] = sign[r]

    def coded(text):
        tokens = [t.decode() for t in (text or "").encode().split()]
        words = [xxhash.xxh3_64_intdigest(t.lower().strip(".,;:!?\"'()[]*%$&#") or t) % Q.WORD_ROWS for t in tokens]
        return words, [Q.WORD_ROWS + xxhash.xxh3_64_intdigest(Q.shape_of(t)) % Q.SHAPE_ROWS for t in tokens]

    contexts = np.zeros((Q.ROWS, Q.DIM))
    for r in rows:
        words, shapes = coded(r["text"])
        for i in range(len(words)):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(words):
                    contexts[words[i]] += index[words[j]]
                    if j > i:
                        contexts[shapes[i]] += index[shapes[j]]
    size = np.linalg.norm(contexts, axis=1, keepdims=True)
    contexts /= np.where(size > 0, size, 1)
    assert np.allclose(Q.context_matrix(docs), contexts, atol=1e-6)
    model = Q.fit_quality(docs, labels, registry.id_remainder("doc_id", 4) != 2)
    got = {r["doc_id"]: r for r in Q.classify(docs, model).collect()}
    for r in rows:
        words, shapes = coded(r["text"])
        parts = [np.mean([table[k] for k in keys], axis=0) if words else np.zeros(Q.DIM) for table, keys in ((contexts, words), (contexts, shapes), (index, shapes))]
        again = [np.mean([a == b for a, b in zip(words[d:], words, strict=False)]) if len(words) > d else 0.0 for d in (1, 2, 3)]
        x = np.concatenate([*parts, again, [math.log1p(len(words)) / 10]])
        hidden = np.maximum((x - model["mean"]) / model["scale"] @ model["w1"] + model["b1"], 0)
        want = 1 / (1 + math.exp(-max(-30, min(30, (hidden @ model["w2"] + model["b2"]) / model["temperature"]))))
        assert got[r["doc_id"]]["score"] == pytest.approx(want, abs=1e-4)
        assert got[r["doc_id"]]["predicted"] == int(got[r["doc_id"]]["score"] >= 0.7)
