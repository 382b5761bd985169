"""Counterfactual-regularised toxicity classifier.

A document is the set of its words and of their character 4- and 5-grams, hashed. The features that
set apart the labelled toxic rows most are found by counting over the sample; a logistic regression over
their presence is fitted with numpy. For every labelled row that mentions an identity group, the
counterfactual swaps each identity term for the next of its ring (the ring ends in a neutral term); the
squared change of the score's logit is penalised, so that naming a group moves no score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm._common import CACHE_ENTRIES, bound_batches, materialize, numbered
from evigraph.llm._labelled import MAX_PER_CLASS, labelled_sample

WORD = re.compile(r"[^\W\d_]+")
FEATURE_BITS = 20
N_FEATURES = 512
#: Weight of the counterfactual penalty and of the quadratic penalty.
COUNTERFACTUAL, RIDGE = 4.0, 2e-4

#: Rings of identity terms that may stand for one another, each with a neutral term.
IDENTITY_RINGS = (
    ("men", "women", "people"),
    ("man", "woman", "person"),
    ("boys", "girls", "children"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "believers"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "religious"),
    ("black", "white", "asian", "latino", "hispanic", "arab", "human"),
    ("gay", "lesbian", "bisexual", "transgender", "straight", "queer", "married"),
    ("immigrants", "refugees", "foreigners", "natives", "residents"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("americans", "germans", "french", "spanish", "mexicans", "chinese", "africans", "europeans", "citizens"),
    ("frauen", "männer", "menschen"),
    ("muslime", "christen", "juden", "gläubige"),
    ("ausländer", "flüchtlinge", "einwohner"),
    ("femmes", "hommes", "personnes"),
    ("musulmans", "chrétiens", "juifs", "croyants"),
    ("immigrés", "réfugiés", "habitants"),
    ("mujeres", "hombres", "personas"),
    ("musulmanes", "cristianos", "judíos", "creyentes"),
    ("inmigrantes", "refugiados", "habitantes"),
)
SWAP = {term: ring[(i + 1) % len(ring)] for ring in IDENTITY_RINGS for i, term in enumerate(ring)}


def word_features(word: str) -> list[int]:
    """Hashed features of one lower-case word."""
    mask, padded = (1 << FEATURE_BITS) - 1, f"^{word}$"
    out = {xxhash.xxh3_64_intdigest(padded) & mask}
    for n in (4, 5):
        out.update(xxhash.xxh3_64_intdigest(padded[i : i + n]) & mask for i in range(len(padded) - n + 1))
    return list(out)


class Lookup(dict):
    """word -> positions of the chosen features that it has, remembered."""

    def __init__(self, chosen: dict[int, int]):
        super().__init__()
        self._chosen = chosen

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = self[word] = tuple(self._chosen[f] for f in word_features(word) if f in self._chosen)
        return found

    def present(self, words: set[str]) -> set[int]:
        out: set[int] = set()
        for w in words:
            if found := self[w]:
                out.update(found)
        if len(self) > CACHE_ENTRIES:
            self.clear()
        return out


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def _swapped(words: set[str]) -> set[str] | None:
    """The words after the swap, None if no identity term is among them."""
    named = words & SWAP.keys()
    return (words - named) | {SWAP[w] for w in named} if named else None


def choose_features(sample: DataFrame, n: int = N_FEATURES) -> list[int]:
    """The n hashed features most in favour of the toxic class, and those of the identity terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 1 << FEATURE_BITS), np.int32)
        rows = np.zeros(2, np.int64)
        cache: dict[str, list[int]] = {}
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1), strict=True):
                found: set[int] = set()
                for w in words_of(text.as_py()):
                    if w not in cache:
                        cache[w] = word_features(w)
                    found.update(cache[w])
                held[y.as_py(), np.fromiter(found, np.int64, len(found))] += 1
                rows[y.as_py()] += 1
                if len(cache) > CACHE_ENTRIES // 4:
                    cache.clear()
        seen = np.flatnonzero(held[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(seen, -1)), pa.array(np.append(held[0][seen], rows[0]).astype(np.int64)), pa.array(np.append(held[1][seen], rows[1]).astype(np.int64))],
            names=["feature", "clean", "toxic"],
        )

    counts = sample.mapInArrow(count, "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    total = counts.where("feature = -1").collect()
    n0, n1 = (max(1, total[0]["clean"]), max(1, total[0]["toxic"])) if total else (1, 1)
    p0, p1 = (F.col("clean") + 0.5) / (n0 + 1), (F.col("toxic") + 0.5) / (n1 + 1)
    both = (F.col("clean") + F.col("toxic") + 1) / (n0 + n1 + 2)
    z = (p1 - p0) / F.sqrt(both * (1 - both) * (1 / n0 + 1 / n1))
    best = counts.where("feature >= 0 AND toxic >= 2").withColumn("z", z).where("z > 2").orderBy(F.desc("z"), "feature").limit(n).collect()
    chosen = [r["feature"] for r in best]
    mask = (1 << FEATURE_BITS) - 1
    named = sorted({xxhash.xxh3_64_intdigest(f"^{t}$") & mask for t in SWAP} - set(chosen))
    return chosen + named


def _fit_logistic(x: np.ndarray, y: np.ndarray, change: np.ndarray, steps: int = 600) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on log loss + RIDGE |w|^2 + COUNTERFACTUAL * mean (change w)^2."""
    n, k = x.shape
    w, b = np.zeros(k), 0.0
    if n == 0 or y.min() == y.max():
        return w, 4.0 if n and y.min() == 1 else -4.0
    xb = np.hstack([x, np.ones((n, 1), x.dtype)])
    v = np.zeros(k + 1, np.float32)
    for _ in range(8):  # largest singular value of xb, for the step
        u = xb.T @ (xb @ (v if v.any() else np.ones(k + 1, np.float32)))
        v = u / np.linalg.norm(u)
    curved = float(np.linalg.norm(xb @ v) ** 2) / (4 * n) + 2 * RIDGE
    if len(change):
        curved += 2 * COUNTERFACTUAL * float((change**2).sum()) / len(change)
    theta = look = np.zeros(k + 1, np.float32)
    t = 1.0
    decay = np.append(np.full(k, 2 * RIDGE, np.float32), np.float32(0))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(xb @ look, -30, 30)))
        g = xb.T @ (p - y).astype(np.float32) / n + decay * look
        if len(change):
            g[:k] += 2 * COUNTERFACTUAL / len(change) * (change.T @ (change @ look[:k]))
        new = look - g / curved
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        look = new + (t - 1) / t_new * (new - theta)
        theta, t = new, t_new
    return theta[:k].astype(np.float64), float(theta[k])


def fit(sample: DataFrame, n_features: int = N_FEATURES) -> dict:
    """sample: (text, y), bounded. Returns the model: chosen features, their weights and the bias."""
    chosen = choose_features(sample, n_features)
    at = {f: i for i, f in enumerate(chosen)}

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(at)
        for batch in batches:
            own, other = [], []
            for text in batch.column(0):
                words = words_of(text.as_py())
                own.append(sorted(lookup.present(words)))
                swapped = _swapped(words)
                other.append(None if swapped is None else sorted(lookup.present(swapped)))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(own, kind), pa.array(other, kind)], names=["y", "own", "other"])

    rows = sample.mapInArrow(presence, "y int, own array<int>, other array<int>").collect()
    rows.sort(key=lambda r: (r["y"], r["own"]))
    x = np.zeros((len(rows), len(chosen)), np.float32)
    for i, r in enumerate(rows):
        x[i, r["own"]] = 1
    change = [x[i] - np.isin(np.arange(len(chosen)), r["other"]) for i, r in enumerate(rows) if r["other"] is not None]
    w, b = _fit_logistic(x, np.array([r["y"] for r in rows], np.float32), np.array(change, np.float32) if change else np.zeros((0, len(chosen)), np.float32))
    return {"at": at, "weights": w.tolist(), "bias": b}


def score_text(model: dict, lookup: Lookup, text: str) -> float:
    logit = model["bias"] + sum(model["weights"][i] for i in sorted(lookup.present(words_of(text))))
    return float(1 / (1 + np.exp(-min(30.0, max(-30.0, logit)))))


def classify(docs: DataFrame, model: dict, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted (score >= threshold) to every row of docs.

    A null text counts as empty and gets the score of a text without features. Repeated rows are scored
    alike, an empty table gives an empty result, columns named score or predicted are replaced.
    """
    bound_batches(docs.sparkSession)
    kept = docs.drop("score", "predicted")
    names, place = kept.columns, kept.columns.index(text_col)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(model["at"])
        for batch in batches:
            at = place
            out = [score_text(model, lookup, t.as_py() or "") for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.float64()), pa.array([int(s >= threshold) for s in out], pa.int32())], names=[*names, "score", "predicted"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return numbered(kept).mapInArrow(scores, f"{schema}, score double, predicted int")


def keep_clean(docs: DataFrame, model: dict, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs with a score below the threshold, with all their columns, whatever their names.

    A null text counts as empty; repeated rows stay or go together; an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    names, place = docs.columns, docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(model["at"])
        for batch in batches:
            kept = batch.filter(pa.array([score_text(model, lookup, t.as_py() or "") < threshold for t in batch.column(place)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns, names=names)

    return numbered(docs).mapInArrow(keep, docs.schema)


def fit_toxicity(docs: DataFrame, labels: DataFrame, learnable, label: str = "toxic", text_col: str = "text", id_col: str = "doc_id", max_per_class: int = MAX_PER_CLASS) -> dict:
    """The model, fitted on at most 2 * max_per_class labelled rows for which learnable (over labels' columns) holds.

    Null texts count as empty, null ids and labels teach nothing, repeated labels count once (the highest). Without rows of both
    classes every text gets one score: 0.02, or 0.98 where all are toxic. Other columns are not read.
    """
    return fit(materialize(labelled_sample(docs, labels, label, learnable, text_col, id_col, max_per_class), "toxicity-sample"))
