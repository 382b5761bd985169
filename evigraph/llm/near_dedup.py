"""Near-duplicates by ProbMinHash, banding and verification.

A text is the set of its five-word shingles (lower case, words between white space; a shorter
text is one shingle). ProbMinHash: each shingle is a Poisson process of its weight as rate, whose points
fall on REGISTERS registers; a register keeps its earliest shingle, and a shingle stops once its next point
is later than every register's earliest. Two texts share a register with the probability Jaccard similarity
of their weighted sets. A shingle weighs 1 to 1 + SPREAD, by how long its words are: short words are common ones, and what two texts have in common by
them tells less. The weight is the shingle's own, however often its text repeats it, and the spread is small: a link, that is a Jaccard
similarity of the sets of 0.8, by which candidates are verified, is a probability Jaccard similarity of 0.76 at least, which banding misses
with a probability of 6e-4 at most (5e-5 where weights are even).

BANDS bands of ROWS registers deal the distinct texts into buckets. Links are verified by the exact
Jaccard similarity of the shingle sets. All pairs of a bucket are never formed:

1. Texts have a rank: how many texts share their bands, so in a group of copies a central text ranks first. A text's anchor is the
   first in rank of all that share a bucket with it. Every text is compared with its anchor only; linked anchors form a forest, whose
   trees are components. A bucket within one component is settled without a comparison.
2. A shingle that is not the anchor's, not any other anchor's and that no text of another component has on top of its anchor can't be common to texts
   of two components. So what a text has in common with any text of another component is bounded by what it shares with its anchor and by its other
   shingles that don't drop out so. A text for which this bound leaves no link is settled. What is settled is proven,
   not guessed: copies edited each on its own drop out here, in time linear in their number.
3. For what is left, pairs of a bucket across components are judged. Texts of one anchor are known by what they lack of it and what they
   hold on top of it, so their similarity is computed exactly within the join, and links are all that it puts out. Texts of different
   anchors are compared by their sets, as far as sizes and bounds allow a link; while such pairs are many, every text is first
   compared with one more text, drawn from those outside the largest component of one of its buckets.

For verification the shingle set of a pivot travels once for every BLOCK of its members, so that a group
of any size is dealt over many tasks. Equal texts are collapsed first and put back at the end. Intermediate tables are
written to the shared folder and deleted once nothing reads them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm._common import WordHash, bound_batches, discard, materialize

SHINGLE_WORDS = 5
BANDS, ROWS, REGISTERS = 25, 5, 128
BLOCK = 128
THRESHOLD = 0.8
#: Weight of a shingle beyond 1: none up to words of SHORT bytes on average, SPREAD from LONG bytes on.
SPREAD, SHORT, LONG = 0.25, 3, 9
#: While more pairs than this for each text are left, texts are first compared with one more pivot, at most so many times. Either way all pairs are judged.
PAIRS_A_TEXT, PIVOTS = 4, 4

_U = np.uint64
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mix(z: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit integers (the public splitmix64 constants)."""
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def shingles(text: bytes, hashes: WordHash) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(digest of the word sequence, distinct shingle keys in order, their weights) of a text in lower case."""
    words = text.split()
    digest = xxhash.xxh3_128_digest(b" ".join(words))
    if not words:
        return digest, np.zeros(0, _U), np.zeros(0)
    ids = np.fromiter(map(hashes.__getitem__, words), _U, len(words))
    n = min(SHINGLE_WORDS, len(ids))
    keys = np.full(len(ids) - n + 1, n, _U)
    for i in range(n):
        keys = (keys ^ ids[i : len(ids) - n + 1 + i]) * _ODD[i]
        keys ^= keys >> _U(31)
    keys, first = np.unique(keys, return_index=True)
    upto = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))))
    mean = (upto[first + n] - upto[first]) / n
    return digest, keys, 1 + SPREAD * np.clip((mean - SHORT) / (LONG - SHORT), 0, 1)


def prob_min_hash(keys: np.ndarray, weights: np.ndarray, doc: np.ndarray, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """n_docs x m registers: the key of the earliest point in each. m is a power of two; a document without keys has zeros."""
    earliest, owner = np.full(n_docs * m, np.inf), np.zeros(n_docs * m, _U)
    time, live, step = np.zeros(len(keys)), np.arange(len(keys)), 0
    while len(live):
        step += 1
        z = _mix(keys[live] + _U(step * int(_ODD[0]) & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((z >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[live]
        at = doc[live] * m + (z & _U(m - 1)).astype(np.int64)
        np.minimum.at(earliest, at, time)
        won = earliest[at] == time
        owner[at[won]] = keys[live[won]]
        going = time < earliest.reshape(n_docs, m).max(axis=1)[doc[live]]
        live, time = live[going], time[going]
    return owner.reshape(n_docs, m)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """n_docs x BANDS bucket keys."""
    out = np.empty((len(registers), BANDS), _U)
    for b in range(BANDS):
        key = np.full(len(registers), b + 1, _U)
        for r in range(ROWS):
            key = _mix(key * _ODD[1] + registers[:, b * ROWS + r])
        out[:, b] = key
    return out.view(np.int64)


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of a's keys b holds; b is sorted and not empty."""
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a


def _lower_bytes(text_col: str):
    return F.lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary")


def _sketches(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(id, raw, spot, node, bands): spot numbers the rows, node is the digest of the word sequence; bands are empty for a text without words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, spot = WordHash(), TaskContext.get().partitionId() << 33
        for batch in batches:
            texts, n = batch.column(2), len(batch.column(2))
            nodes: list[bytes] = []
            bands: list = []
            start = 0
            while start < n:
                keys, weights, doc, held, i = [], [], [], 0, start
                while i < n and held < 300_000:
                    digest, k, w = shingles(texts[i].as_py(), hashes)
                    nodes.append(digest)
                    keys.append(k)
                    weights.append(w)
                    doc.append(np.full(len(k), i - start))
                    held += len(k)
                    i += 1
                hashes.trim()
                made = band_keys(prob_min_hash(np.concatenate(keys), np.concatenate(weights), np.concatenate(doc), i - start))
                bands += [made[j] if len(keys[j]) else made[j][:0] for j in range(i - start)]
                start = i
            columns = [batch.column(0), batch.column(1), pa.array(np.arange(spot, spot + n)), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            spot += n
            yield pa.RecordBatch.from_arrays(columns, names=["id", "raw", "spot", "node", "bands"])

    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("raw"), _lower_bytes(text_col).alias("t"))
    return source.mapInArrow(run, f"id {kind}, raw long, spot long, node binary, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(node, set) of the wanted nodes: the shingle keys of one document each. wanted: (node, id, raw)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            found = [shingles(t.as_py(), hashes)[:2] for t in batch.column(0)]
            hashes.trim()
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.binary()), pa.array([k.view(np.int64) for _, k in found], pa.list_(pa.int64()))], names=["node", "set"])

    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("raw"), F.col(text_col).alias("t"))
    w = wanted.select(F.col("id").alias("w_id"), F.col("raw").alias("w_raw"))
    few = source.join(w, (F.col("raw") == F.col("w_raw")) & F.col("id").eqNullSafe(F.col("w_id")), "left_semi")
    made = few.select(_lower_bytes("t").alias("t")).mapInArrow(run, "node binary, set array<long>")
    return made.dropDuplicates(["node"])  # rows that repeat id and text


def _buckets(nodes: DataFrame) -> DataFrame:
    """(band, node, top) of the buckets that hold two texts or more; top is the first in rank (mass, node) of the bucket."""
    banded = nodes.select("node", F.explode("bands").alias("band"))
    sizes = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # BANDS bands a text at most
    ranked = materialize(banded.join(sizes, "band").groupBy("node").agg(F.sum("n").alias("mass"), F.collect_list("band").alias("bands")), "ranked")
    rows = ranked.select("node", "mass", F.explode("bands").alias("band"))
    out = materialize(rows.select("band", "node").join(rows.groupBy("band").agg(F.max(F.struct("mass", "node")).alias("top")), "band"), "buckets")
    discard(ranked)
    return out


def _compared(pairs: DataFrame, sets: DataFrame, threshold: float, extras: bool) -> DataFrame:
    """(node, pivot, link) of the pairs that are links; with extras of all pairs, with lack (places of the pivot's keys that the node lacks) and extra (the node's other keys)."""
    size = pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    block = F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK))).cast("int")
    dealt = materialize(pairs.join(size, "pivot", "left").select("pivot", block.alias("block"), "node"), "pairs")
    heads = dealt.select("pivot", "block").distinct().withColumn("node", F.col("pivot")).withColumn("role", F.lit(0))
    rows = heads.unionByName(dealt.withColumn("role", F.lit(1))).join(sets, "node")
    n = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, np.zeros(1, np.int64)
        for batch in batches:
            out: list[tuple] = []
            pivots, blocks, roles, nodes, sets_ = batch.columns
            for i in range(len(batch)):
                at, keys = (pivots[i].as_py(), blocks[i].as_py()), np.asarray(sets_[i].values).view(_U)
                if roles[i].as_py() == 0:
                    key, held = at, keys
                elif key == at:
                    same = common(keys, held)
                    shared = int(same.sum())
                    link = shared >= threshold * (len(keys) + len(held) - shared) - 1e-9
                    if extras:
                        out.append((nodes[i].as_py(), key[0], link, np.flatnonzero(~common(held, keys)).astype(np.int32), keys[~same].view(np.int64)))
                    elif link:
                        out.append((nodes[i].as_py(), key[0], link, None, None))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.binary(), pa.binary(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["node", "pivot", "link", "lack", "extra"])

    ordered = rows.select("pivot", "block", "role", "node", "set").repartition(n, "pivot", "block").sortWithinPartitions("pivot", "block", "role")
    out = materialize(ordered.mapInArrow(compare, "node binary, pivot binary, link boolean, lack array<int>, extra array<long>"), "compared")
    discard(dealt)
    return out


def _roots(parents: DataFrame) -> DataFrame:
    """(node, label) of a forest (node, label: the parent, or the node itself at a root): the root of each node, by pointer jumping."""
    labels = materialize(parents.select("node", "label"), "labels")
    while True:
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = materialize(labels.join(far, "label").select("node", F.col("far").alias("label"), (F.col("far") != F.col("label")).alias("moved")), "labels")
        discard(labels)
        labels = new
        if labels.where("moved").isEmpty():
            return labels


def components(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, label) of every node that links (node, pivot) name: the least node of its connected component.

    Labels spread along links, with pointer jumping. Raises RuntimeError rather than return unfinished labels.
    """
    both = materialize(links.select("node", "pivot").unionByName(links.select(F.col("pivot").alias("node"), F.col("node").alias("pivot"))).distinct(), "links-both")
    labels = materialize(both.groupBy("node").agg(F.least("node", F.min("pivot")).alias("label")), "labels")
    for _ in range(max_rounds):
        named = labels.select(F.col("node").alias("pivot"), "label")
        told = both.join(named, "pivot").select("node", "label").unionByName(labels.join(named.withColumnsRenamed({"pivot": "at", "label": "far"}), F.col("label") == F.col("at")).select("node", F.col("far").alias("label")))
        new = materialize(told.unionByName(labels).groupBy("node").agg(F.min("label").alias("label")), "labels")
        done = new.join(labels, ["node", "label"], "left_anti").isEmpty()
        discard(labels)
        labels = new
        if done:
            discard(both)
            return labels
    raise RuntimeError(f"labels still change after {max_rounds} rounds")


def _left(buckets: DataFrame, anchored: DataFrame, sets: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """(band, node, label, n, anchor, shared, lack, more, main, bands) of the texts that may yet have a link across components.

    shared counts the keys in common with the anchor, more are those others that a text of another component may hold too, so both together bound what
    the text has in common with any of these. lack are the places of the anchor's keys that the text lacks. main is the label of most of the band's rows, bands are all bands of the text that are left.
    """
    several = lambda df: df.groupBy("band").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("band")
    placed = materialize(buckets.select("band", "node").join(labels, "node").select("band", "node", "label"), "placed")
    opened = materialize(placed.join(several(placed), "band", "left_semi"), "open")
    texts = opened.select("node", "label").distinct()
    facts = materialize(texts.join(anchored.select("node", "pivot", "lack", "extra"), "node", "left"), "facts")
    # a text without an anchor is one itself: it has all its keys in common with it
    anchors = facts.select(F.coalesce("pivot", "node").alias("node")).distinct().join(sets, "node")
    extra = facts.select("node", "label", F.explode("extra").alias("key"))
    held = extra.select("key", "label").unionByName(anchors.select(F.explode("set").alias("key")).distinct().withColumn("label", F.lit(None).cast("binary")))
    keys = held.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count_if(F.col("label").isNull()).alias("anchors")).where("a <> b OR (anchors > 0 AND a IS NOT NULL)").select("key")
    more = extra.join(keys, "key", "left_semi").groupBy("node").agg(F.collect_list("key").alias("more"))
    sizes = sets.select("node", F.size("set").cast("long").alias("n"))
    shared = F.when(F.col("pivot").isNull(), F.col("n")).otherwise(F.col("n") - F.size("extra"))
    lists = [F.coalesce("lack", F.array().cast("array<int>")).alias("lack"), F.coalesce("more", F.array().cast("array<long>")).alias("more")]
    bounded = facts.join(more, "node", "left").join(sizes, "node").select("node", "n", F.coalesce("pivot", "node").alias("anchor"), shared.alias("shared"), *lists)
    most = F.col("shared") + F.size("more")
    # a link needs this share of both sizes in common, and sizes no further apart than the threshold
    need = lambda size: threshold / (1 + threshold) * (F.col("n") + size) - 1e-9
    rest = materialize(opened.join(bounded.where(most >= threshold * F.col("n") - 1e-9), "node"), "bounded")
    floors = rest.groupBy("band").agg(F.min("n").alias("floor"))
    fitting = materialize(rest.join(floors, "band").where(most >= need(F.greatest("floor", threshold * F.col("n")))).drop("floor"), "fitting")
    main = fitting.groupBy("band", "label").agg(F.count(F.lit(1)).alias("m")).groupBy("band").agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("all")).where("all > top.m")
    several_left = materialize(fitting.join(main.select("band", F.col("top.label").alias("main")), "band"), "several")
    bands = several_left.groupBy("node").agg(F.collect_list("band").alias("bands"))  # BANDS at most
    out = materialize(several_left.join(bands, "node").select("band", "node", "label", "n", "anchor", "shared", "lack", "more", "main", "bands"), "left")
    for df in (placed, opened, facts, rest, fitting, several_left):
        discard(df)
    return out


def _across(left: DataFrame, threshold: float, one_anchor: bool) -> DataFrame:
    """(node, pivot): pairs of different components, the pivot outside the band's largest component; once each, in the first band of both.

    Of one anchor: the pairs that are links. Else: the pairs of different anchors that may be.
    """
    stray = left.where("label <> main").select("band", *[F.col(c).alias(f"s_{c}") for c in ("node", "label", "n", "anchor", "shared", "lack", "more", "bands")])
    c, size = F.col, F.size
    need = threshold / (1 + threshold) * (c("n") + c("s_n")) - 1e-9
    may = (c("label") != c("s_label")) & ((c("label") == c("main")) | (c("s_node") < c("node"))) & (F.least("n", "s_n") >= threshold * F.greatest("n", "s_n") - 1e-9)
    if one_anchor:
        may = may & (c("anchor") == c("s_anchor")) & (F.least("shared", "s_shared") + F.least(size("more"), size("s_more")) >= need)
    else:
        may = may & (c("anchor") != c("s_anchor")) & (F.least(c("shared") + size("more"), c("s_shared") + size("s_more")) >= need)
    may = may & (F.array_min(F.array_intersect("bands", "s_bands")) == c("band"))
    if one_anchor:  # of the anchor's keys both hold those that neither lacks
        anchor_n = c("shared") + size("lack")
        both = anchor_n - size("lack") - size("s_lack") + size(F.array_intersect("lack", "s_lack")) + size(F.array_intersect("more", "s_more"))
        may = may & (both >= need)
    return left.join(stray, "band").where(may).select("node", c("s_node").alias("pivot"))


def _next_pivots(left: DataFrame, turn: int) -> DataFrame:
    """(node, pivot): for each text one text of another component, outside the largest component of a bucket of both."""
    rank = F.struct(((F.col("shared") + F.size("more")) / F.col("n")).alias("share"), F.xxhash64(F.lit(turn), "node").alias("draw"), F.col("node"), F.col("label"))
    picked = left.where("label <> main").groupBy("band").agg(F.max(rank).alias("top"))
    return left.join(picked, "band").where("label <> top.label").groupBy("node").agg(F.max("top").alias("top")).select("node", F.col("top.node").alias("pivot"))


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """A row for every row of docs: the id, raw (64-bit hash of the text), class_id, class_size and kept.

    class_id is the least id of the row's class (null ids are above every other; null if all are). Texts with the same
    words in the same order are in one class; so are texts joined by a chain of links, a link being a
    Jaccard similarity of the shingle sets of threshold or more. A null text counts as empty; texts
    without words are one class. kept marks the one row that stays of each class: that of class_id, of
    repeated ids the one with the least hash, of rows that repeat both any one. An empty table
    gives an empty result; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    sketched = materialize(_sketches(docs, text_col, id_col), "sketches")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "raw", "spot"))
    nodes = materialize(sketched.groupBy("node").agg(first.alias("f"), F.any_value("bands").alias("bands"), F.count(F.lit(1)).alias("n")), "nodes")
    buckets = _buckets(nodes)
    anchors = materialize(buckets.groupBy("node").agg(F.max("top").alias("top")).select("node", F.col("top.node").alias("pivot")), "anchors")
    wanted = anchors.select("node").join(nodes.select("node", "f.id", "f.raw"), "node")
    sets = materialize(_sets(docs, wanted, text_col, id_col), "shingle-sets")
    anchored = _compared(anchors.where("node <> pivot"), sets, threshold, True)
    labels = _roots(anchors.select("node").join(anchored.where("link").select("node", "pivot"), "node", "left").select("node", F.coalesce("pivot", "node").alias("label")))
    spent, n_texts = [buckets, anchors, sets, anchored], anchors.count()

    for turn in range(PIVOTS):
        left = _left(buckets, anchored, sets, labels, threshold)
        spent.append(left)
        if left.isEmpty():
            break
        found = materialize(_across(left, threshold, True), "near-anchor")
        spent.append(found)
        across = _across(left, threshold, False)
        pairs = across.count()
        last = turn == PIVOTS - 1 or pairs <= PAIRS_A_TEXT * n_texts
        if pairs:
            more = _compared(across if last else _next_pivots(left, turn), sets, threshold, False)
            spent.append(more)
            found = found.unionByName(more.select("node", "pivot"))
        if found.isEmpty():
            if last:
                break
            continue
        own = labels.select("node", "label")
        met = found.select("node", "pivot").join(own, "node").join(own.select(F.col("node").alias("pivot"), F.col("label").alias("other")), "pivot").where("label <> other")
        joined = components(met.select(F.col("label").alias("node"), F.col("other").alias("pivot")))
        new = materialize(own.join(joined.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
        for df in (labels, joined):
            discard(df)
        labels = new
        if last:
            break

    classed = nodes.select("node", "f", "n").join(labels.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = classed.groupBy("label").agg(F.min("f").alias("keep"), F.sum("n").alias("class_size"))
    by_node = materialize(classed.select("node", "label").join(classes, "label").select("node", "keep", "class_size"), "node-classes")
    for df in (*spent, labels, nodes):
        discard(df)
    return sketched.select("id", "raw", "spot", "node").join(by_node, "node").select(
        F.col("id").alias(id_col), "raw", F.col("keep.id").alias("class_id"), "class_size", (F.col("spot") == F.col("keep.spot")).alias("kept")
    )


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that near_duplicates marks, one of each class, with the columns of docs.

    Null and empty texts are one class with the texts without words. Of rows that repeat the id and the text of a row
    that stays, the one with the least hash of all its columns (as JSON) stays. Any column names will do; an empty table gives an empty result.
    """
    row, id_ = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.col(f"`{id_col}`")
    marked = near_duplicates(docs, text_col, id_col, threshold)
    kept = materialize(marked.where("kept").select(F.col(id_col).alias("kept_id"), F.col("raw").alias("kept_raw")), "kept")
    raw = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    keyed = docs.select(id_.alias("id"), raw.alias("raw"), row.alias("row"))
    out = keyed.join(kept, (F.col("raw") == F.col("kept_raw")) & F.col("id").eqNullSafe(F.col("kept_id")), "left_semi")
    if not marked.groupBy(id_col, "raw").count().where("count > 1").isEmpty():
        copies = Window.partitionBy("id", "raw").orderBy(F.xxhash64(F.to_json("row")))
        out = out.withColumn("nth", F.row_number().over(copies)).where("nth = 1")
    return out.select("row.*")
