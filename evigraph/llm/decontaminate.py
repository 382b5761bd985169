"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits of any script, in NFKC form and case-folded. Every three words of a test item are a seed. The
seeds of an item that join it to passages are those that at most SHARED different items have, or about as few as have its least
shared seed: what many items open with makes no candidate. A first pass over the documents counts in how many of them each seed occurs. A seed is
rare if few documents hold it, or if it is about as rare as the rarest seed of its item that occurs. A second pass looks the joining seeds
up in every document; hits of an item on nearby diagonals make a candidate passage if they are MIN_HITS of
the item's rare seeds or MIN_HITS of all its joining seeds (so a passage that many documents share, whole, in part or
edited, is a candidate however common it is). A candidate in which too few of the item's words occur for the score is passed over; the local alignment of others
with the item (match 2, mismatch and gap -1) gives the score: best alignment over twice the item's words, 1 for an unbroken copy.

Items of equal words are matched once and joined back by a digest. How many items share a seed is counted over the whole benchmark, in Spark.
The benchmark is then taken in blocks of at most `block_words` words: a block is what the driver holds and broadcasts, its broadcasts go when it is done, and its
matches are written. Each block is a pass over all documents to count and one to look up; documents are never shuffled, and what a
block finds doesn't depend on other blocks.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm._common import WordHash, bound_batches, discard, materialize, numbered

SEED_WORDS = 3
BLOCK_WORDS = 2_000_000
MIN_SCORE = 0.4
#: A seed is rare in at most this share of the documents, or at this many times its item's rarest seed that occurs.
RARE_SHARE, RARE_TIMES = 0.005, 4
#: Different items that may have a seed that joins, or as many times the items that have the item's least shared seed (RARE_TIMES).
SHARED = 8
#: Share of an item's rare seeds, or else of all its seeds, that a candidate passage must hit.
MIN_HITS = 0.08
MATCH, MISMATCH, GAP = 2, -1, -1

_KEEP = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)}
_NO_WORD = re.compile(r"[^\w\x00-\x7f]+")
#: ASCII letters to lower case, other ASCII characters but digits to a space; bytes of other characters stay.
_FOLD = bytes((c + 32 if 0x41 <= c <= 0x5A else c) if c in _KEEP or c > 0x7F else 0x20 for c in range(256))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def words_of(text: str, hashes: WordHash) -> np.ndarray:
    """Hash of each word of a text."""
    if not text.isascii():  # of other characters, those that are no letters or digits become spaces here, ASCII ones by the table
        folded = text if unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)
        text = _NO_WORD.sub(" ", folded.casefold())
    found = text.encode("utf-8", "replace").translate(_FOLD).split()
    return np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))


def seeds_of(words: np.ndarray) -> np.ndarray:
    """Key of each run of SEED_WORDS words; of a shorter text, one key of all its words."""
    n = min(SEED_WORDS, len(words))
    if n == 0:
        return words
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ words[i : len(words) - n + 1 + i]) * _MIX[i]
        out ^= out >> np.uint64(29)
    return out


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score, and the end of it in the passage."""
    n = len(passage)
    ramp = np.arange(n + 1) * -GAP
    row, best, end = np.zeros(n + 1, np.int64), 0, 0
    for w in item:
        new = np.zeros(n + 1, np.int64)
        new[1:] = np.maximum(row[:-1] + np.where(passage == w, MATCH, MISMATCH), row[1:] + GAP)
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + ramp) - ramp
        top = int(new.argmax())
        if new[top] > best:
            best, end = int(new[top]), top
        row = new
    return best, end


class SeedIndex:
    """Joining seeds of a block of items, with where they stand in which item. spread: for each item, how many items have each of its seeds."""

    def __init__(self, items: list[np.ndarray], spread: list[np.ndarray]):
        self.items = items
        keys = [seeds_of(w) for w in items]
        joining = [np.flatnonzero(n <= max(SHARED, RARE_TIMES * n.min())) for n in spread]
        flat = np.concatenate([k[j] for k, j in zip(keys, joining, strict=True)]) if keys else np.zeros(0, np.uint64)
        self.item = np.concatenate([np.full(len(j), i) for i, j in enumerate(joining)]) if keys else np.zeros(0, np.int64)
        self.pos = np.concatenate(joining) if keys else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.item, self.pos = self.item[order], self.pos[order]
        self.keys, self.first, self.times = np.unique(flat[order], return_index=True, return_counts=True)
        self.short = sorted({len(w) for w in items if 0 < len(w) < SEED_WORDS})
        self._set_bits()

    def _set_bits(self) -> None:
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def mark_rare(self, df: np.ndarray, n_docs: int) -> None:
        """Mark the seeds that are rare, given the number of documents of each, and set the hits that items need."""
        least = np.full(len(self.items), np.iinfo(np.int64).max // RARE_TIMES)
        seed = np.repeat(np.arange(len(self.keys)), self.times)
        held = df[seed] > 0
        np.minimum.at(least, self.item[held], df[seed[held]])
        self.rare = (df[seed] <= RARE_SHARE * n_docs) | (df[seed] <= RARE_TIMES * least[self.item])
        self.needed_rare, self.needed = (
            np.maximum(1, np.ceil(MIN_HITS * np.bincount(of, minlength=len(self.items)))).astype(np.int64) for of in (self.item[self.rare], self.item)
        )

    def look_up(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in words, number of the seed) of every seed in a document."""
        parts = [(seeds_of(words), np.arange(max(0, len(words) - SEED_WORDS + 1)))] if len(words) >= SEED_WORDS else []
        for n in self.short:
            if len(words) >= n:
                parts += [(np.concatenate([seeds_of(words[i : i + n]) for i in range(len(words) - n + 1)]), np.arange(len(words) - n + 1))]
        at, found = [], []
        for keys, where in parts:
            maybe = np.flatnonzero(self.bits[(keys >> np.uint64(44)).astype(np.int64)])
            if len(maybe) and len(self.keys):
                k = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
                hit = self.keys[k] == keys[maybe]
                at.append(where[maybe[hit]])
                found.append(k[hit])
        return (np.concatenate(at), np.concatenate(found)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def matches(self, words: np.ndarray, min_score: float) -> list[tuple[int, float, int, int]]:
        """(item, score, first word, end) of each item's best passage in a document, if it scores min_score."""
        at, seed = self.look_up(words)
        if not len(at):
            return []
        times = self.times[seed]
        flat = np.repeat(self.first[seed] - np.cumsum(times) + times, times) + np.arange(times.sum())
        item, pos, rare, at = self.item[flat], self.pos[flat], self.rare[flat], np.repeat(at, times)
        n = len(self.items)
        some = ((np.bincount(item, minlength=n) >= self.needed) | (np.bincount(item[rare], minlength=n) >= self.needed_rare))[item]
        if not some.any():
            return []
        item, pos, rare, at = item[some], pos[some], rare[some], at[some]
        order = np.lexsort((at - pos, item))
        item, pos, rare, diagonal = item[order], pos[order], rare[order], (at - pos)[order]
        size = np.array([len(w) for w in self.items])[item]
        new = np.append(True, (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > np.maximum(2, size[1:] // 2)))
        best: dict[int, tuple[float, int, int]] = {}
        for a, b in zip(np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(item)), strict=True):
            i = int(item[a])
            few = len(np.unique(pos[a:b])) < self.needed[i] and len(np.unique(pos[a:b][rare[a:b]])) < self.needed_rare[i]
            if few or best.get(i, (0.0,))[0] == 1.0:
                continue
            got = self._score(self.items[i], words, diagonal[a:b], min_score)
            if got[0] >= min_score and got > best.get(i, (0.0, 0, 0)):
                best[i] = got
        return [(i, *x) for i, x in sorted(best.items())]

    @staticmethod
    def _score(item: np.ndarray, words: np.ndarray, diagonals: np.ndarray, min_score: float) -> tuple[float, int, int]:
        n = len(item)
        for d in np.unique(diagonals):
            if d >= 0 and np.array_equal(words[d : d + n], item):
                return 1.0, int(d), int(d) + n
        slack = n // 2
        low, high = max(0, int(diagonals.min()) - slack), min(len(words), int(diagonals.max()) + n + slack)
        if np.isin(item, words[low:high]).sum() < min_score * n:  # every word that occurs matches at best: no higher score can be reached
            return 0.0, low, low
        score, end = align(item, words[low:high])
        _, back = align(item[::-1], words[low : low + end][::-1])
        return score / (MATCH * n), low + end - back, low + end


def _items(benchmark: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """A written row (id, digest, words) for each item with words: their hashes, and a digest of these."""
    bound_batches(benchmark.sparkSession)
    kind = benchmark.schema[id_col].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            found = [words_of(t.as_py() or "", hashes) for t in batch.column(1)]
            hashes.trim()
            some = [i for i, w in enumerate(found) if len(w)]
            digests = pa.array([hashlib.sha256(found[i].tobytes()).digest() for i in some], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some, pa.int64())), digests, pa.array([found[i].view(np.int64) for i in some], pa.list_(pa.int64()))], names=["id", "digest", "words"])

    return materialize(benchmark.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t")).mapInArrow(split, f"id {kind}, digest binary, words array<long>"), "benchmark-items")


def _with_spread(items: DataFrame) -> DataFrame:
    """(digest, words, spread) of each different item; spread tells of each seed how many different items have it."""
    texts = items.groupBy("digest").agg(F.first("words").alias("words"))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [seeds_of(np.array(w.as_py(), np.int64).view(np.uint64)) for w in batch.column(1)]
            sizes = [len(k) for k in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), sizes))), pa.array([p for n in sizes for p in range(n)], pa.int32()), pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())],
                names=["digest", "pos", "seed"],
            )

    each = materialize(texts.mapInArrow(seeds, "digest binary, pos int, seed long"), "benchmark-seeds")
    spread = each.select("digest", "seed").distinct().groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    counted = each.join(spread, "seed").groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("at"))  # a list as long as the item
    out = materialize(texts.join(counted, "digest").select("digest", "words", F.transform("at", lambda x: x["n"]).alias("spread")), "benchmark-spread")
    discard(each)
    return out


def _blocks(items: DataFrame, block_words: int) -> Iterator[tuple[list[bytes], list[np.ndarray], list[np.ndarray]]]:
    """(digests, words, spreads) of the different items in blocks."""
    table = _with_spread(items)
    digests, words, spreads, n = [], [], [], 0
    for r in table.toLocalIterator():
        digests.append(bytes(r["digest"]))
        words.append(np.array(r["words"], np.int64).view(np.uint64))
        spreads.append(np.array(r["spread"], np.int64))
        n += len(words[-1])
        if n >= block_words:
            yield digests, words, spreads
            digests, words, spreads, n = [], [], [], 0
    if words:
        yield digests, words, spreads
    discard(table)


def _index(docs: DataFrame, words: list[np.ndarray], spreads: list[np.ndarray], text_col: str):
    """The broadcast index of a block's seeds, with the rare ones marked."""
    bound_batches(docs.sparkSession)
    full = SeedIndex(words, spreads)
    shared = docs.sparkSession.sparkContext.broadcast(full)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, hashes, n = shared.value, WordHash(), 0
        held = np.zeros(len(index.keys) + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                held[np.unique(index.look_up(words_of(text.as_py() or "", hashes))[1])] += 1
                hashes.trim()
                n += 1
        held[-1] = n
        seen = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(held[seen])], names=["seed", "n"])

    counts = docs.select(F.col(f"`{text_col}`").alias("t")).mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    df = np.zeros(len(full.keys) + 1, np.int64)
    held = counts.toArrow()  # a row of two integers per seed of the block at most
    df[held["seed"].to_numpy()] = held["n"].to_numpy()
    shared.unpersist()
    full.mark_rare(df[:-1], int(df[-1]))
    return docs.sparkSession.sparkContext.broadcast(full)


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", min_score: float = MIN_SCORE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for every document and item that align at min_score or better.

    Columns: the document's id, the item's id, score, item_words, first_word and end_word (of the passage in
    the document, end exclusive). Null and empty texts on either side match nothing. Repeated documents
    and repeated items are each matched on their own; an empty table on either side gives an empty result; other
    columns are not read. Documents that only hold what more than SHARED items open with match none of them.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc {kind}, digest binary, score double, item_words long, first_word long, end_word long"
    items, found = _items(benchmark, text_col, item_col), docs.sparkSession.createDataFrame([], schema)
    for digests, words, spreads in _blocks(items, block_words):
        index = _index(docs, words, spreads, text_col)

        def scan(batches: Iterator[pa.RecordBatch], index=index, digests=digests) -> Iterator[pa.RecordBatch]:
            hashes, block = WordHash(), index.value
            for batch in batches:
                at, rows = [], []
                for i, text in enumerate(batch.column(1)):
                    for item, score, first, end in block.matches(words_of(text.as_py() or "", hashes), min_score):
                        at.append(i)
                        rows.append((digests[item], score, len(block.items[item]), first, end))
                    hashes.trim()
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                kinds = (pa.binary(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc", "digest", "score", "item_words", "first_word", "end_word"])

        part = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text")).mapInArrow(scan, schema)
        found = found.unionByName(materialize(part, "leaks"))
        index.unpersist()
    return found.join(items.select(F.col("id").alias("item"), "digest"), "digest").select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "score", "item_words", "first_word", "end_word")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", min_score: float = MIN_SCORE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs that find_leaks has no match for, with all their columns, whatever their names.

    Null and empty texts match nothing and stay; repeated rows stay or go together; an empty table on either side gives docs.
    Of several blocks each writes the digests of the texts that it matches, and the rows of these are then left out by a join; a single block filters the rows as they pass.
    """
    items = _items(benchmark, text_col, item_col)
    todo = _blocks(items, block_words)
    first, second = next(todo, None), next(todo, None)
    if first is None:
        return docs
    if second is None:
        schema, names, place, index = docs.schema, docs.columns, docs.columns.index(text_col), _index(docs, *first[1:], text_col)

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, block = WordHash(), index.value
            for batch in batches:
                clean = [not block.matches(words_of(t.as_py() or "", hashes), min_score) for t in batch.column(place)]
                hashes.trim()
                kept = batch.filter(pa.array(clean, pa.bool_()))
                yield pa.RecordBatch.from_arrays(kept.columns, names=names)

        return numbered(docs).mapInArrow(keep, schema)
    sha = F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"), 256))
    leaks = None
    for block in itertools.chain([first, second], todo):
        index = _index(docs, *block[1:], text_col)

        def hit(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            hashes, found = WordHash(), index.value
            for batch in batches:
                held = [bool(found.matches(words_of(t.as_py() or "", hashes), min_score)) for t in batch.column(1)]
                hashes.trim()
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(held, pa.bool_()))], names=["leak"])

        part = materialize(docs.select(sha.alias("leak"), F.col(f"`{text_col}`").alias("text")).mapInArrow(hit, "leak binary").distinct(), "leaks")
        leaks = part if leaks is None else leaks.unionByName(part)
        index.unpersist()
    return docs.join(leaks, sha == F.col("leak"), "left_anti")
