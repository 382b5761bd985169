"""The corpus pipeline: five filtering stages, each written to the shared folder and read again by the next.

toxicity -> exact dedup -> near-duplicates -> benchmark decontamination -> mixing to target weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import decontaminate, exact_dedup, near_dedup, registry, toxicity
from evigraph.llm._common import discard, materialize, table
from evigraph.llm._labelled import id_remainder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity classifier doesn't predict as toxic; it learns from the labelled ones among docs.

    Null texts count as empty and are judged like other texts. Rows that repeat a text stay or go together. An empty table, or one
    without labelled documents, loses nothing. All columns of docs stay as they are, whatever their names.
    """
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), id_remainder("doc_id", 3) != 1)
    return toxicity.keep_clean(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the largest doc_id.

    Null and empty texts are equal; a null doc_id is below every other; ties are broken by a hash of the other columns, and rows that
    are equal throughout count once. An empty table gives an empty one. All columns stay as they are.
    """
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the least doc_id (null ids last, then by a hash of the text).

    Texts without words, null ones among them, are one class. Of rows that repeat id and text one stays. An empty table gives an
    empty one. All columns stay as they are.
    """
    return near_dedup.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no passage of a benchmark item.

    Null and empty texts hold none and stay; repeated rows stay or go together; an empty table on either side loses nothing. All
    columns stay as they are.
    """
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with their words (size), the words taken and the passes over the document.

    Null and empty texts have no words and go. A null source is a source of its own. Rows of equal doc_id and size are alike. An
    empty table gives an empty one. Columns named size, taken or passes are replaced; the others stay as they are.
    """
    own = [c for c in docs.columns if c.lower() not in ("size", "taken", "passes")]
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)])
    at = {c: f"c{i}" for i, c in enumerate(own)}
    mixed = registry.mix_by_source(plain, text_col=at["text"], source_col=at["source"], id_col=at["doc_id"]).where("taken > 0")
    return mixed.select(*[F.col(at[c]).alias(c) for c in own], "size", "taken", (F.col("taken") / F.col("size")).alias("passes"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix),
]

#: Toxicity, near-duplicates and alignment have no SQL form; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents, one after the other; what a stage read is deleted once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        if before is not None:
            discard(before)
        before = docs
    return docs
