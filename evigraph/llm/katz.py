"""Katz backoff language model: Good-Turing discounted counts with exactly normalised backoff weights.

P(w|h) = d(r) r / c(h) for bigrams seen r > 0 times in training, else alpha(h) P(w);
P(w) = d(c) c / N for words seen in training, and the whole unseen mass for a word that is not (all unknown
words are one). alpha(h) = (1 - sum of seen P(w|h)) / (1 - sum of P(w) over the same w), so each
distribution sums to 1 over the known words and the unknown one. A text's first word follows the end of
a text.

Counts live in two tables partitioned by a hash of the word and of the bigram's history. Documents are
first packed into blocks (word numbers of some BLOCK_TOKENS tokens, and the block's vocabulary). Blocks send
their distinct words and bigrams to the partitions they belong to, already counted, and get back what the
partition knows of each: total count and word number; bigram count and what alpha needs of each history. No
text and no token leaves its block. A word or a pair that occurs everywhere is one entry a block. Histories that hold more than
a quarter of a partition's share are dealt by the whole bigram instead; of these there are at most four
for each partition, and their totals are summed and broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm._common import bound_batches, discard, materialize

#: Good-Turing discounts apply to counts up to this one.
GT_MAX = 5
BLOCK_TOKENS = 1_000_000
#: The end of a text, as a word; no word of a text holds a space.
END = b" end "
#: Of the smoothed unigram base score.
BASE_ADD = 0.1


def _pack(values: np.ndarray, width: str = "<u8") -> bytes:
    """Integers as byte planes, compressed."""
    planes = np.ascontiguousarray(values.astype(width)).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpack(raw: bytes, width: str = "<u8") -> np.ndarray:
    size = np.dtype(width).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 31), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(width).astype(np.int64 if width != "<f8" else np.float64)


def discounts(times: list[int]) -> tuple[np.ndarray, float]:
    """(factor for counts 0 .. GT_MAX, what is taken off every larger count).

    times[r]: how many types have count r, r up to GT_MAX + 1. Good-Turing with
    Katz's correction where it gives factors in (0, 1]; else the same on counts of counts smoothed by a line through their
    logarithms; else (tables without enough low counts) absolute discounting.
    """
    d, ok = np.zeros(GT_MAX + 1), False
    if all(times[r] > 0 for r in range(1, GT_MAX + 2)):
        r = np.arange(1, GT_MAX + 2)
        raw = np.array(times[1 : GT_MAX + 2], np.float64)
        smooth = np.exp(np.polyval(np.polyfit(np.log(r), np.log(raw), 1), np.log(r)))
        for n in (raw, smooth):
            top = (GT_MAX + 1) * n[GT_MAX] / n[0]
            if not ok and top < 1:
                d[1:] = (r[1:] * n[1:] / (r[:-1] * n[:-1]) - top) / (1 - top)
                ok = bool(np.all(d[1:] > 0) and np.all(d[1:] <= 1))
    n1 = times[1]
    off = 0.0
    if not ok:
        off = n1 / (n1 + 2 * times[2]) if n1 and times[2] else 0.5
        d[1:] = 1 - off / np.arange(1, GT_MAX + 1)
    return d, off


class Unigrams:
    """P(w) from counts of counts."""

    def __init__(self, times: list[int], total: int, types: int):
        self.total, self.types = total, types
        self.d, self.off = discounts(times)
        small = sum(times[r] * r for r in range(1, GT_MAX + 1))
        kept = sum(times[r] * r * self.d[r] for r in range(1, GT_MAX + 1)) + (total - small) - self.off * (types - sum(times[1 : GT_MAX + 1]))
        self.unseen = max(1 - kept / total, 1e-12) if total else 1.0

    def p(self, count: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.full(len(count), self.unseen)
        small = np.minimum(count, GT_MAX)
        seen = np.where(count <= GT_MAX, self.d[small] * count, count - self.off) / self.total
        return np.where(count > 0, seen, self.unseen)


def history_mass(parts: np.ndarray, count: np.ndarray, d: np.ndarray, off: float) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, denominator) of each history.

    parts: numbers of its bigrams of counts 1 .. GT_MAX, number and sum of larger, sum of P(w). The denominator is
    the history's count, or one more where discounting leaves less than half a count to back off with.
    """
    r = np.arange(1, GT_MAX + 1)
    n = len(r)
    seen = parts[:, :n] @ (d[r] * r) + parts[:, n + 1] - off * parts[:, n]
    below = count + (count - seen < 0.5)
    alpha = (1 - seen / np.maximum(below, 1)) / np.maximum(1 - parts[:, n + 2], 1e-12)
    return np.where(count > 0, alpha, 1.0), below


N_PARTS = GT_MAX + 3


class Block:
    """A block's tokens, and its distinct bigrams in the order in which they are sent."""

    def __init__(self, row: dict):
        self.ids, self.lengths, self.train = row["ids"], np.frombuffer(row["lengths"], np.int32).astype(np.int64), np.frombuffer(row["train"], np.uint8).astype(bool)
        self.tokens, self.order, self.end, self.block = _unpack(row["tokens"], "<u4"), _unpack(row["order"], "<u4"), row["end"], row["block"]

    def learn_words(self, replies: list, buckets: int) -> None:
        """Total count and word number of each of the block's words."""
        counts, numbers = [], []
        for r in sorted(replies, key=lambda r: r["bucket"]):
            counts.append(_unpack(r["a"]))
            numbers.append(_unpack(r["b"]) * buckets + r["bucket"])
        self.count, self.number = np.empty(len(self.order), np.int64), np.empty(len(self.order), np.int64)
        self.count[self.order], self.number[self.order] = np.concatenate(counts), np.concatenate(numbers)

    def pair_up(self, buckets: int, total: int) -> None:
        n = len(self.order)
        history = np.append(self.end, self.tokens[:-1])
        pairs, self.which = np.unique(history * n + self.tokens, return_inverse=True)
        h, w = pairs // n, pairs % n
        in_train = np.repeat(self.train, self.lengths)
        seen = np.bincount(self.which[in_train], minlength=len(pairs))
        hot = self.count * 4 * buckets > total
        mixed = (self.number[h] * 0x9E3779B1 + np.where(hot[h], self.number[w] * 0x85EBCA6B, 0)) & 0x7FFFFFFFFFFFFFFF
        bucket = ((mixed ^ (mixed >> 29)) * 0x2C1B3C6D >> 20) % buckets
        order = np.argsort(bucket, kind="stable")
        self.h, self.w, self.seen, self.bucket, self.hot, self.place = h[order], w[order], seen[order], bucket[order], hot, np.argsort(order)

    def sent(self) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
        """(bucket, its bigrams, its distinct histories, their numbers of bigrams)."""
        cuts = np.flatnonzero(np.diff(self.bucket)) + 1
        for a, b in zip(np.append(0, cuts), np.append(cuts, len(self.bucket)), strict=True):
            if a < b:
                starts = np.append(0, np.flatnonzero(np.diff(self.h[a:b])) + 1)
                yield int(self.bucket[a]), slice(a, b), self.h[a:b][starts], np.diff(np.append(starts, b - a))


_BLOCK = "block long, kind int, bucket int, ids array<{id}>, lengths binary, train binary, tokens binary, order binary, end int, a binary, b binary"


def _blocks(docs: DataFrame, text_col: str, id_col: str, held_out: Column, buckets: int) -> DataFrame:
    """Blocks (kind 0; order sorts their words by hash) and, for each block and bucket, its words (kind 1: hashes in a, training counts in b)."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = _BLOCK.format(id=kind)
    arrow = _arrow(schema)
    top = np.uint64(64 - (buckets.bit_length() - 1))

    def close(ids: list, tokens: list, train: list, words: dict, block: int) -> pa.RecordBatch:
        lengths, train_ = np.array([len(t) for t in tokens], np.int32), np.array(train, np.uint8)
        flat = np.concatenate(tokens)
        vocab = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
        rank = np.argsort(-np.bincount(flat, minlength=len(vocab)), kind="stable")  # frequent words get small numbers
        number = np.empty(len(vocab), np.int64)
        number[rank] = np.arange(len(vocab))
        flat, vocab = number[flat], vocab[rank]
        seen = np.bincount(flat[np.repeat(train_.astype(bool), lengths)], minlength=len(vocab))
        order = np.argsort(vocab)
        bucket = (vocab[order] >> top).astype(np.int64) if buckets > 1 else np.zeros(len(vocab), np.int64)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        rows = [(block, 0, -1, ids, lengths.tobytes(), train_.tobytes(), _pack(flat, "<u4"), _pack(order, "<u4"), int(number[0]), None, None)]
        for part in np.split(order, cuts):
            b = int(vocab[part[0]] >> top) if buckets > 1 else 0
            rows.append((block, 1, b, None, None, None, None, None, None, vocab[part].tobytes(), _pack(seen[part])))
        return pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in rows], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Words(dict):
            def __missing__(self, word):
                n = self[word] = len(self)
                return n

        block = TaskContext.get().partitionId() << 24
        ids, tokens, train, words, held = [], [], [], Words({END: 0}), 0
        for batch in batches:
            for i, text, out in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                found = (text.as_py() or b"").lower().split()
                t = np.empty(len(found) + 1, np.int32)
                t[:-1] = np.fromiter(map(words.__getitem__, found), np.int32, len(found))
                t[-1] = 0
                ids.append(i.as_py())
                tokens.append(t)
                train.append(not out.as_py())
                held += len(t)
                if held >= BLOCK_TOKENS:
                    yield close(ids, tokens, train, words, block)
                    ids, tokens, train, words, held, block = [], [], [], Words({END: 0}), 0, block + 1
        if ids:
            yield close(ids, tokens, train, words, block)

    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("t"), held_out.alias("o")).mapInArrow(run, schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


_REPLY = "block long, bucket int, a binary, b binary"
_REPLY_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])


def _word_table(group: pa.Table) -> pa.Table:
    """Replies to every block of a bucket (counts and numbers of its words), and the bucket's counts of counts (block -1)."""
    rows = group.select(["block", "bucket", "a", "b"]).to_pylist()
    keys = [np.frombuffer(r["a"], np.uint64) for r in rows]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([_unpack(r["b"]) for r in rows]), minlength=len(every)).astype(np.int64)
    times = np.bincount(np.minimum(total, GT_MAX + 2), minlength=GT_MAX + 3)
    stats = np.array([total.sum(), (total > 0).sum(), len(every), *times[1 : GT_MAX + 2]], np.int64)
    out = [{"block": -1, "bucket": rows[0]["bucket"], "a": stats.tobytes(), "b": None}]
    for r, part in zip(rows, np.split(at, np.cumsum([len(k) for k in keys])[:-1]), strict=True):
        out.append({"block": r["block"], "bucket": r["bucket"], "a": _pack(total[part]), "b": _pack(part)})
    return pa.Table.from_pylist(out, schema=_REPLY_ARROW)


_SENT = "block long, bucket int, h binary, c binary, runs binary, hot binary, w binary, seen binary, cw binary"
_SENT_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), *((n, pa.binary()) for n in "h c runs hot w seen cw".split())])


def _bigram_table(unigrams: Unigrams):
    """For applyInArrow: replies to every block of a bucket (a: bigram counts; b: parts of each history that isn't hot), the bucket's
    counts of counts (block -1) and parts of its hot histories (block -2: a histories, b parts)."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        h, w, seen, cw, sizes, heads = [], [], [], [], [], []
        hot: list[np.ndarray] = []
        for r in rows:
            hh, runs = _unpack(r["h"]), _unpack(r["runs"], "<u4")
            heads.append(hh)
            hot.append(np.frombuffer(r["hot"], np.uint8).astype(bool))
            h.append(np.repeat(hh, runs))
            w.append(_unpack(r["w"]))
            seen.append(_unpack(r["seen"]))
            cw.append(_unpack(r["cw"]))
            sizes.append(len(w[-1]))
        hs, ws = np.concatenate(h), np.concatenate(w)
        h, w = None, None
        order = np.lexsort((ws, hs))
        hs, ws = hs[order], ws[order]
        new = np.append(True, (hs[1:] != hs[:-1]) | (ws[1:] != ws[:-1]))
        ws = None
        pair = np.empty(len(order), np.int32)
        pair[order] = np.cumsum(new) - 1
        total = np.bincount(pair, weights=np.concatenate(seen)).astype(np.int64)
        seen = None
        times = np.bincount(np.minimum(total, GT_MAX + 2), minlength=GT_MAX + 3)
        stats = np.array([total.sum(), (total > 0).sum(), len(total), *times[1 : GT_MAX + 2]], np.int64)
        out = [{"block": -1, "bucket": rows[0]["bucket"], "a": stats.tobytes(), "b": None}]
        histories, of = np.unique(hs[new], return_inverse=True)
        p = unigrams.p(np.concatenate(cw)[order[new]])
        cw, order, hs, new = None, None, None, None
        parts = np.zeros((len(histories), N_PARTS))
        for r in range(1, GT_MAX + 1):
            parts[:, r - 1] = np.bincount(of[total == r], minlength=len(histories))
        large = total > GT_MAX
        parts[:, N_PARTS - 3] = np.bincount(of[large], minlength=len(histories))
        parts[:, N_PARTS - 2] = np.bincount(of[large], weights=total[large], minlength=len(histories))
        kept = total > 0
        parts[:, N_PARTS - 1] = np.bincount(of[kept], weights=p[kept], minlength=len(histories))
        is_hot = np.zeros(len(histories), bool)
        for hh, x in zip(heads, hot, strict=True):
            is_hot[np.searchsorted(histories, hh[x])] = True
        if is_hot.any():
            out.append({"block": -2, "bucket": rows[0]["bucket"], "a": histories[is_hot].astype(np.int64).tobytes(), "b": parts[is_hot].tobytes()})
        for r, part, hh in zip(rows, np.split(pair, np.cumsum(sizes)[:-1]), heads, strict=True):
            out.append({"block": r["block"], "bucket": r["bucket"], "a": _pack(total[part], "<u8"), "b": _pack(parts[np.searchsorted(histories, hh)].ravel(), "<f8")})
        return pa.Table.from_pylist(out, schema=_REPLY_ARROW)

    return run


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch one by one: only one block at a time is held as Python objects."""
    for i in range(len(batch)):
        yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}


def _gathered(replies: DataFrame, name: str) -> DataFrame:
    """All replies of a block in one row; as many as there are buckets at most."""
    return replies.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("bucket", "a", "b")).alias(name))


def _totals(replies: DataFrame) -> tuple[int, int, int, list[int]]:
    """(tokens, types seen, largest number of types in a bucket, types of count 0 .. GT_MAX + 1); a row per bucket."""
    rows = [np.frombuffer(r["a"], np.int64) for r in replies.where("block = -1").select("a").collect()]
    if not rows:
        return 0, 0, 0, [0] * (GT_MAX + 2)
    s = np.sum(rows, axis=0)
    return int(s[0]), int(s[1]), int(max(r[2] for r in rows)), [0, *map(int, s[3:])]


def bucket_count(docs: DataFrame) -> int:
    """A power of two: 64 at least, and no less than the session's shuffle partitions."""
    wanted = max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return 1 << (wanted - 1).bit_length()


def score(docs: DataFrame, held_out: Column, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row for every row of docs: the id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    held_out: boolean, true for rows that nothing is learnt from. Words are runs without ASCII white space, A-Z lower
    case; each text is followed by its end, which counts as a token. score is the log10 probability of
    the text, base_score that of unigrams with BASE_ADD added to each count. A null text counts as empty
    (its end alone). Repeated rows count and are scored as often as they occur. With nothing to learn from,
    every word has probability 1 of being unknown and base_score is what its formula gives for N = V = 0. An empty table
    gives an empty result; other columns are not read.
    """
    kind, buckets = docs.schema[id_col].dataType.simpleString(), bucket_count(docs)
    bound_batches(docs.sparkSession)
    made = materialize(_blocks(docs, text_col, id_col, held_out, buckets), "katz-blocks", by="kind")
    word_replies = materialize(made.where("kind = 1").select("block", "bucket", "a", "b").groupBy("bucket").applyInArrow(_word_table, _REPLY), "katz-words")
    discard(made, "kind=1")
    total, types, _, times = _totals(word_replies)
    unigrams = Unigrams(times, total, types)
    blocks = made.where("kind = 0").select("block", "ids", "lengths", "train", "tokens", "order", "end").join(_gathered(word_replies, "words"), "block")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                block = Block(row)
                block.learn_words(row["words"], buckets)
                block.pair_up(buckets, total)
                rows = []
                for b, part, heads, runs in block.sent():
                    w = block.w[part]
                    hot = block.hot[heads].astype(np.uint8).tobytes()
                    fields = (block.block, b, _pack(block.number[heads]), _pack(block.count[heads]), _pack(runs, "<u4"), hot, _pack(block.number[w]), _pack(block.seen[part]), _pack(block.count[w]))
                    rows.append(dict(zip(_SENT_ARROW.names, fields, strict=True)))
                yield pa.RecordBatch.from_pylist(rows, schema=_SENT_ARROW)

    replies = materialize(blocks.mapInArrow(send, _SENT).groupBy("bucket").applyInArrow(_bigram_table(unigrams), _REPLY), "katz-bigrams")
    _, _, _, pair_times = _totals(replies)
    d, off = discounts(pair_times)
    hot_parts: dict[int, np.ndarray] = {}
    for r in replies.where("block = -2").orderBy("bucket").select("a", "b").toLocalIterator():  # 4 x buckets histories at most
        for h, x in zip(np.frombuffer(r["a"], np.int64), np.frombuffer(r["b"]).reshape(-1, N_PARTS), strict=True):
            hot_parts[int(h)] = hot_parts[int(h)] + x if int(h) in hot_parts else x.copy()
    shared = docs.sparkSession.sparkContext.broadcast(hot_parts)
    schema = f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_parts = shared.value
        for batch in batches:
            for row in rows_of(batch):
                block = Block(row)
                block.learn_words(row["words"], buckets)
                block.pair_up(buckets, total)
                by_bucket = {r["bucket"]: r for r in row["pairs"]}
                r_all, alpha_all, below_all = np.empty(len(block.h), np.int64), np.empty(len(block.h)), np.empty(len(block.h))
                for b, part, heads, runs in block.sent():
                    r_all[part] = _unpack(by_bucket[b]["a"])
                    parts = _unpack(by_bucket[b]["b"], "<f8").reshape(-1, N_PARTS)
                    for i in np.flatnonzero(block.hot[heads]):
                        parts[i] = hot_parts[int(block.number[heads[i]])]
                    alpha, below = history_mass(parts, block.count[heads], d, off)
                    alpha_all[part], below_all[part] = np.repeat(alpha, runs), np.repeat(below, runs)
                p = unigrams.p(block.count)
                small = np.minimum(r_all, GT_MAX)
                direct = np.where(r_all <= GT_MAX, d[small] * r_all, r_all - off) / np.maximum(below_all, 1)
                pair = np.log10(np.where(r_all > 0, direct, alpha_all * p[block.w]))
                starts = np.append(0, np.cumsum(block.lengths)[:-1])
                count = block.count[block.tokens]
                base = np.log10((block.count + BASE_ADD) / (total + BASE_ADD * (types + 1)))[block.tokens]
                columns = [
                    pa.array(block.ids, batch_id), pa.array(~block.train), pa.array(block.lengths), pa.array(np.add.reduceat((count > 0).astype(np.int64), starts)),
                    pa.array(np.full(len(starts), total, np.int64)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(pair[block.place[block.which]], starts)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    batch_id = _arrow(f"x {kind}").field(0).type
    return blocks.join(_gathered(replies, "pairs"), "block").mapInArrow(finish, schema)
