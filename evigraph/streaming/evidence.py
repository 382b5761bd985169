"""Posteriors kept up to date as evidence arrives: an extension for streams of weighted edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.operators import bayesian


def running_totals(edges: DataFrame, watermark: str = "30 days") -> DataFrame:
    """Running evidence of each claim from a stream of (claim, unit_id, stance, weight, at).

    Units are counted once: repeats of a unit_id within the watermark are dropped by state, so state stays bounded.
    """
    once = edges.withWatermark("at", watermark).dropDuplicatesWithinWatermark(["claim", "unit_id"])
    total = lambda s: F.sum(F.when(F.col("stance") == s, F.col("weight")).otherwise(0.0))
    return once.groupBy(F.col("claim").alias("ledger")).agg(
        total("support").alias("success"), total("challenge").alias("failure"), F.count_if(F.col("stance") == "support").alias("support_edges"), F.count_if(F.col("stance") == "challenge").alias("challenge_edges")
    )


def labels(edges: DataFrame, watermark: str = "30 days") -> DataFrame:
    """Streaming review labels; write in update mode."""
    return bayesian.classified(running_totals(edges, watermark))


def windowed_counts(edges: DataFrame, width: str = "30 days", watermark: str = "30 days") -> DataFrame:
    """(claim, start, stance, n) per tumbling window; late rows beyond the watermark are dropped."""
    return edges.withWatermark("at", watermark).groupBy("claim", F.window("at", width).alias("w"), "stance").agg(F.count(F.lit(1)).alias("n")).select("claim", F.col("w.start").alias("start"), "stance", "n")
