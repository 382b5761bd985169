"""Quality classifier on random-indexing word vectors.

Every word falls into one of 2^14 hashed rows, every word shape (case, digits, trailing signs) into one of
64 more. A row has a sparse ternary index vector, and a context vector: the sum of the index vectors of
its neighbours (two words each way) over all documents. Partial context matrices, whose size is fixed,
are added up in two levels. A document is pooled to the mean context vector of its words and of their
shapes, the mean index vector of the shapes, how often words return at distances 1, 2 and 3, and its
length; a two-layer network gives a logit, and a temperature fitted on rows kept apart calibrates it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm._common import CACHE_ENTRIES, bound_batches, materialize, numbered
from evigraph.llm._labelled import MAX_PER_CLASS, labelled_sample

WORD_ROWS, SHAPE_ROWS, DIM, NONZERO, WINDOW = 1 << 14, 64, 32, 2, 2
ROWS = WORD_ROWS + SHAPE_ROWS
BLOCK = 257  # rows of the matrix in one row of a DataFrame: 64 blocks
N_POOLED = 3 * DIM + 4
HIDDEN, EPOCHS = 24, 400


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the nonzero entries of each row's index vector, fixed by a seed."""
    rng = np.random.default_rng(20240607)
    at = np.argsort(rng.random((ROWS, DIM)), axis=1)[:, :NONZERO].astype(np.int64)
    return at, rng.choice(np.array([-1, 1]), (ROWS, NONZERO)).astype(np.int64)


def dense_index() -> np.ndarray:
    at, sign = index_vectors()
    out = np.zeros((ROWS, DIM), np.float32)
    np.put_along_axis(out, at, sign.astype(np.float32), axis=1)
    return out


def shape_of(token: str) -> str:
    core = token.rstrip("".join(c for c in set(token) if not c.isalnum())) if token else ""
    tail = token[len(core) :]
    letters = [c for c in core if c.isalpha()]
    case = "none" if not letters else "upper" if len(letters) > 1 and all(c.isupper() for c in letters) else "cap" if letters[0].isupper() else "lower"
    end = "" if not tail else tail[0] if len(tail) == 1 else f"{tail[-1]}+" if len(set(tail)) == 1 else "mixed"
    return f"{case}|{end}|{'d' if any(c.isdigit() for c in core) else ''}|{min(len(core), 16) // 4}"


class Codes(dict):
    """token (bytes) -> word row * SHAPE_ROWS + shape row, remembered."""

    def __missing__(self, token: bytes) -> int:
        text = token.decode("utf-8", "replace")
        core = text.lower().strip(".,;:!?\"'()[]*%$&#") or text
        word = xxhash.xxh3_64_intdigest(core) % WORD_ROWS
        code = self[token] = word * SHAPE_ROWS + xxhash.xxh3_64_intdigest(shape_of(text)) % SHAPE_ROWS
        return code

    def rows(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Word row and shape row of each token of a text."""
        tokens = text.split()
        codes = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        if len(self) > CACHE_ENTRIES:
            self.clear()
        return codes // SHAPE_ROWS, codes % SHAPE_ROWS + WORD_ROWS


def _add_contexts(held: np.ndarray, words: np.ndarray, shapes: np.ndarray, doc: np.ndarray, at: np.ndarray, sign: np.ndarray) -> None:
    """Adds the contexts of a run of tokens (of several documents) to held, a flat ROWS x DIM matrix."""
    for d in range(1, WINDOW + 1):
        if len(words) <= d:
            return
        same = doc[d:] == doc[:-d]
        a, b = words[:-d][same], words[d:][same]
        for left, right in ((a, b), (b, a)):
            for k in range(NONZERO):
                held += np.bincount(left * DIM + at[right, k], weights=sign[right, k], minlength=ROWS * DIM)
        sa, sb = shapes[:-d][same], shapes[d:][same]
        for k in range(NONZERO):
            held += np.bincount(sa * DIM + at[sb, k], weights=sign[sb, k], minlength=ROWS * DIM)


def context_matrix(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The context vectors of all rows, from all documents, scaled to unit length."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, (at, sign), codes = np.zeros(ROWS * DIM), index_vectors(), Codes()
        words, shapes, docs_, n, i = [], [], [], 0, 0

        def flush():
            if words:
                _add_contexts(held, np.concatenate(words), np.concatenate(shapes), np.concatenate(docs_), at, sign)
                for x in (words, shapes, docs_):
                    x.clear()

        for batch in batches:
            for text in batch.column(0):
                w, s = codes.rows(text.as_py() or b"")
                words.append(w)
                shapes.append(s)
                docs_.append(np.full(len(w), i))
                i, n = i + 1, n + len(w)
                if n > 1_000_000:
                    flush()
                    n = 0
        flush()
        yield _blocks({b: x for b, x in enumerate(held.reshape(-1, BLOCK * DIM)) if x.any()})

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, x in zip(batch.column(0), batch.column(1), strict=True):
                x = np.asarray(x.values, np.float64)
                sums[b.as_py()] = sums[b.as_py()] + x if b.as_py() in sums else x.copy()
        yield _blocks(sums)

    schema = "block int, part array<double>"
    parts = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(partial, schema)
    for keys in (["block", F.spark_partition_id() % 16], ["block"]):  # two levels, so that no task adds up what all tasks send
        parts = parts.repartition(*keys).mapInArrow(total, schema)
    out = np.zeros((ROWS // BLOCK, BLOCK * DIM))
    for r in parts.collect():  # 64 rows of fixed length
        out[r["block"]] = r["part"]
    out = out.reshape(ROWS, DIM)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def _blocks(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
    keys = sorted(parts)
    values = pa.array([parts[k].astype(np.float64) for k in keys], pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), values], names=["block", "part"])


def pooled(words: np.ndarray, shapes: np.ndarray, contexts: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The vector of one document; zeros but for the length where there are no words."""
    out = np.zeros(N_POOLED, np.float32)
    if len(words):
        out[:DIM] = contexts[words].mean(axis=0)
        out[DIM : 2 * DIM] = np.bincount(shapes - WORD_ROWS, minlength=SHAPE_ROWS).astype(np.float32) @ contexts[WORD_ROWS:] / len(words)
        out[2 * DIM : 3 * DIM] = np.bincount(shapes - WORD_ROWS, minlength=SHAPE_ROWS).astype(np.float32) @ index[WORD_ROWS:] / len(words)
        for d in (1, 2, 3):
            if len(words) > d:
                out[3 * DIM + d - 1] = (words[d:] == words[:-d]).mean()
    out[-1] = np.log1p(len(words)) / 10
    return out


def _forward(model: dict, x: np.ndarray) -> np.ndarray:
    h = np.maximum(((x - model["mean"]) / model["scale"]) @ model["w1"] + model["b1"], 0)
    return h @ model["w2"] + model["b2"]


def _fit_network(x: np.ndarray, y: np.ndarray, seed: int = 7) -> dict:
    """A ReLU layer and a logit, by Adam; then the temperature on every fifth row, which is kept out of the fit."""
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-4) if len(x) else (np.zeros(N_POOLED), np.ones(N_POOLED))
    rng = np.random.default_rng(seed)
    p = {"w1": rng.normal(0, (2 / N_POOLED) ** 0.5, (N_POOLED, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, HIDDEN**-0.5, HIDDEN), "b2": 0.0}
    model = {"mean": mean, "scale": scale, **p, "temperature": 1.0}
    if not len(y) or y.min() == y.max():
        model |= {"w2": np.zeros(HIDDEN), "b2": 0.0 if not len(y) else 4.0 if y[0] else -4.0}
        return model
    apart = np.arange(len(y)) % 5 == 4
    if apart.sum() < 20:
        apart[:] = False
    xs, t = (x[~apart] - mean) / scale, y[~apart]
    m1 = {k: np.zeros_like(v) for k, v in p.items()}
    m2 = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(t))
        for i in range(0, len(t), 256):
            b = order[i : i + 256]
            a = xs[b] @ p["w1"] + p["b1"]
            h = np.maximum(a, 0)
            d = (1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"], -30, 30))) - t[b]) / len(b)
            back = np.outer(d, p["w2"]) * (a > 0)
            g = {"w1": xs[b].T @ back + 1e-3 * p["w1"], "b1": back.sum(axis=0), "w2": h.T @ d + 1e-3 * p["w2"], "b2": d.sum()}
            step += 1
            for k in p:
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - 3e-3 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    model |= p
    if apart.any() and 0 < y[apart].mean() < 1:
        logits = _forward(model, x[apart])
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        loss = [np.logaddexp(0, np.where(y[apart] > 0, -1, 1) * logits / s).mean() for s in grid]
        model["temperature"] = float(grid[int(np.argmin(loss))])
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, learnable, label: str = "quality", text_col: str = "text", id_col: str = "doc_id", max_per_class: int = MAX_PER_CLASS) -> dict:
    """Context vectors from all of docs; the network from at most 2 * max_per_class labelled rows for which learnable holds.

    Null texts count as empty, null ids and labels teach nothing, repeated labels count once (the highest). Without rows of both
    classes every text gets one score. Other columns are not read.
    """
    contexts = context_matrix(docs, text_col)
    sample = materialize(labelled_sample(docs, labels, label, learnable, text_col, id_col, max_per_class), "quality-sample")
    shared = docs.sparkSession.sparkContext.broadcast(contexts)  # ROWS x DIM floats, 2 MB

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, index = Codes(), dense_index()
        for batch in batches:
            out = [pooled(*codes.rows(t.as_py()), shared.value, index) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float32())), batch.column(1)], names=["x", "y"])

    rows = sample.select(F.col("text").cast("binary").alias("text"), "y").mapInArrow(pool, "x array<float>, y int").collect()
    rows.sort(key=lambda r: (xxhash.xxh3_64_intdigest(np.array(r["x"], np.float32).tobytes()), r["y"]))
    x = np.array([r["x"] for r in rows], np.float64).reshape(-1, N_POOLED)
    return _fit_network(x, np.array([r["y"] for r in rows], np.float64)) | {"contexts": shared}


def classify(docs: DataFrame, model: dict, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted (score >= threshold) to every row of docs.

    A null text counts as empty and gets the network's score of a document without words. Repeated rows
    are scored alike, an empty table gives an empty result, columns named score or predicted are replaced.
    """
    bound_batches(docs.sparkSession)
    kept = docs.drop("score", "predicted")
    names, place = kept.columns, kept.columns.index(text_col)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, index, contexts = Codes(), dense_index(), model["contexts"].value
        for batch in batches:
            at = place
            x = np.array([pooled(*codes.rows((t.as_py() or "").encode("utf-8", "replace")), contexts, index) for t in batch.column(at)], np.float64).reshape(-1, N_POOLED)
            p = 1 / (1 + np.exp(-np.clip(_forward(model, x) / model["temperature"], -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())], names=[*names, "score", "predicted"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return numbered(kept).mapInArrow(scores, f"{schema}, score double, predicted int")
