"""Confidence assessments: arrays of structs on nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import timekey


def of_dimension(assessments: Column, dimension: str | None) -> Column:
    return assessments if dimension is None else F.filter(assessments, lambda a: a["dimension"] == dimension)


def active(assessments: Column, dimension: str | None = None) -> Column:
    """Those that no other of the same (dimension's) list supersedes."""
    among = of_dimension(assessments, dimension)
    gone = F.transform(among, lambda a: F.coalesce(a["supersedes_assessment_id"], F.lit("")))
    return F.filter(among, lambda a: ~F.array_contains(gone, a["assessment_id"]))


def latest(assessments: Column, dimension: str | None = None) -> Column:
    """The active one with the greatest recorded_at, the first of equals; null if there is none."""
    live = active(assessments, dimension)
    ranked = F.transform(live, lambda a, i: F.struct(F.coalesce(timekey.of_text(a["recorded_at"])["val"], F.lit(0.0)).alias("at"), (-i).alias("first"), a.alias("a")))
    return F.try_element_at(F.array_sort(ranked, lambda x, y: F.when((x["at"] > y["at"]) | ((x["at"] == y["at"]) & (x["first"] > y["first"])), -1).otherwise(1)), F.lit(1))["a"]


def band(value: Column) -> Column:
    return (
        F.when(value.isNull(), "unknown").when(value < 0.2, "very_low").when(value < 0.4, "low").when(value < 0.7, "moderate").when(value < 0.9, "high").otherwise("very_high")
    )


def lineage_findings(assessments: DataFrame) -> DataFrame:
    """Findings over exploded assessments (columns of the struct): duplicate ids, methods without name or version, dangling supersession."""
    schema = ["severity", "code", "assessment_id"]
    twice = assessments.groupBy("assessment_id").count().where("count > 1").select(F.lit("error").alias("severity"), F.lit("duplicate_assessment_id").alias("code"), "assessment_id")
    blank = (F.coalesce(F.col("method.name"), F.lit("")) == "") | (F.coalesce(F.col("method.version"), F.lit("")) == "")
    bare = assessments.where(blank).select(F.lit("error").alias("severity"), F.lit("missing_assessment_method").alias("code"), "assessment_id")
    pointing = assessments.where(F.coalesce(F.col("supersedes_assessment_id"), F.lit("")) != "")
    known = assessments.select(F.col("assessment_id").alias("supersedes_assessment_id")).distinct()
    dangling = pointing.join(known, "supersedes_assessment_id", "left_anti").select(F.lit("error").alias("severity"), F.lit("dangling_assessment_supersession").alias("code"), "assessment_id")
    return twice.unionByName(bare).unionByName(dangling).select(*schema)
