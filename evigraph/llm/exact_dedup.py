"""Exact dedup by a tree-merge of sorted digest runs, in DataFrame operations only.

Every document belongs to one of R runs (a hash of its id deals them, so the run of a row is the same
whenever a lost task is run again). A run holds one row per distinct digest with the identifier to
retain and the number of rows, in order of the digests; it is cut into slices by the digest's first bits, so that a run of any
length is spread over many tasks. Runs are merged in rounds of `fan_in`: round k brings the runs
i*fan_in .. i*fan_in+fan_in-1 of round k-1 together slice by slice, merges their orders, and a pass over the merged order keeps, for
each digest, the retained identifier of all of them, until one run is left. On the way down the winner is joined first
to the first-level runs and from there, by (run, digest), to the documents, so that a text held by a
third of all rows is dealt over R keys and never meets in one task.

A digest alone does not decide equality: rows are one group only if SHA-256, byte length and an
independent 64-bit hash all agree, at every level of the tree. Only identifiers and digests travel; texts are
not shuffled, but for keep_one, where the texts that may stay are, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm._common import free_prefix, materialize

_KEY = ["dig", "len", "chk"]
SLICES = 256


def run_count(df: DataFrame, fan_in: int) -> int:
    """The first power of fan_in that is 64 at least and no less than the session's shuffle partitions."""
    wanted = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n = 1
    while n < wanted:
        n *= fan_in
    return n


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`"), F.lit(""))


def digest_key(text_col: str) -> dict[str, Column]:
    """The verified digest of a row's text."""
    text = _text(text_col)
    return {"dig": F.unhex(F.sha2(text.cast("binary"), 256)), "len": F.octet_length(text), "chk": F.xxhash64(text)}


def _tie(docs: DataFrame, text_col: str, id_col: str) -> Column:
    """A hash of a row's other columns, null where there are none."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, id_col)]
    return F.xxhash64(F.to_json(F.struct(*rest))) if rest else F.lit(None).cast("long")


def merge_tree(first: DataFrame, runs: int, fan_in: int) -> DataFrame:
    """first: (run, slice, key, top, n), a row per run and key. Returns a row per key: (key, top, n), top being a struct of an id."""
    current = first
    while runs > 1:
        runs = -(-runs // fan_in)
        brought = current.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).repartition("run", "slice")
        # a sorted pass: the maximum of a struct is aggregated in the order of the sort, not by hashing
        current = brought.sortWithinPartitions("run", "slice", *_KEY).groupBy("run", "slice", *_KEY).agg(F.max("top").alias("top"), F.sum("n").alias("n"))
    return current.select(*_KEY, "top", "n")


def _decided(rows: DataFrame, fan_in: int) -> DataFrame:
    """rows (id, tie, key) with run, top (largest id) and n (rows) of the group of each."""
    runs = run_count(rows, fan_in)
    keyed = rows.withColumn("run", F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(runs)).cast("int"))
    piece = F.conv(F.hex(F.substring("dig", 1, 1)), 16, 10).cast("int") % SLICES
    grouped = keyed.groupBy("run", *_KEY).agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n"))
    first = materialize(grouped.select("run", piece.alias("slice"), *_KEY, F.struct("id").alias("top"), "n"), "digest-runs")
    down = first.select("run", *_KEY).join(merge_tree(first, runs, fan_in), _KEY)
    return keyed.join(down.select("run", *_KEY, F.col("top.id").alias("top"), "n"), ["run", *_KEY])


def _numbered(df: DataFrame) -> DataFrame:
    """Numbers the rows of a (run, digest) from the largest id down, ties by the hash of the other columns."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy("run", *_KEY).orderBy(F.col("id").desc_nulls_last(), F.col("tie").desc_nulls_last())))


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", fan_in: int = 8) -> DataFrame:
    """Adds keep_id, group_size, kept and text_sha256 to every row.

    Texts are equal when identical; a null text counts as empty. Of equal texts the row with the largest
    id is kept (a null id is below every other; a group of null ids keeps a row, keep_id null). Rows that
    repeat both the kept id and the text: one of them is kept, that of the largest hash of the other columns; rows that
    are equal throughout are alike, and any one of them is. An empty table gives an empty result; columns of these four names in the input are replaced, other
    extra columns are kept as they are, whatever their names.
    """
    tag = free_prefix(docs.columns)
    others = [c for c in docs.columns if c not in ("keep_id", "group_size", "kept", "text_sha256")]
    tagged = docs.select(*[F.col(f"`{c}`").alias(f"{tag}{i}") for i, c in enumerate(others)], F.col(f"`{id_col}`").alias("id"), _tie(docs, text_col, id_col).alias("tie"), *[x.alias(n) for n, x in digest_key(text_col).items()])
    # rows of equal id are in one run, so the first row of the winner's run is the one row to keep
    decided = _numbered(_decided(tagged, fan_in))
    kept = F.col("id").eqNullSafe(F.col("top")) & (F.col("nth") == 1)
    return decided.select(*[F.col(f"{tag}{i}").alias(c) for i, c in enumerate(others)], F.col("top").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("dig")).alias("text_sha256"))


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", fan_in: int = 8) -> DataFrame:
    """The rows that exact_dedup keeps, with the columns of docs, whatever their names.

    Decided on identifiers and digests; the texts are then shuffled once, to meet the (id, digest, tie) of those that stay.
    Null and empty texts are equal; rows equal in every column count as one. An empty table gives an empty result.
    """
    tag = free_prefix(docs.columns)
    mine = {"id": F.col(f"`{id_col}`"), "tie": _tie(docs, text_col, id_col), **digest_key(text_col)}
    decided = _decided(docs.select(*[x.alias(n) for n, x in mine.items()]), fan_in).where(F.col("id").eqNullSafe(F.col("top")))
    winners = materialize(_numbered(decided).where("nth = 1").select("id", "tie", "dig", F.col("n").alias("group")), "winners")
    rows = docs.select("*", F.struct(*[x.alias(n) for n, x in mine.items()]).alias(tag))
    same = (F.col(f"{tag}.dig") == F.col("w.dig")) & F.col(f"{tag}.id").eqNullSafe(F.col("w.id")) & F.col(f"{tag}.tie").eqNullSafe(F.col("w.tie"))
    out = rows.join(winners.alias("w"), same, "left_semi")
    repeated = decided.groupBy("id", "tie", "dig").count().where("count > 1")
    if not repeated.isEmpty():  # rows that are equal throughout
        out = out.withColumn(f"{tag}n", F.row_number().over(Window.partitionBy(tag).orderBy(F.lit(1)))).where(F.col(f"{tag}n") == 1).drop(f"{tag}n")
    return out.drop(tag)
