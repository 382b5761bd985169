"""Whole ledgers as canonical JSON documents with their content hash: what is recorded as the basis of an assessment and checked against it later.

A document is typed columns all the way (units, references, assessments, policy, diagnostics); canonical.json_column writes it, so
nothing leaves the JVM. A ledger is one document and so one row; ledger.content_hashes digests ledgers that don't fit in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import text
from evigraph.functions.canonical import json_column
from evigraph.functions.meta import Meta
from evigraph.graph import Graph
from evigraph.operators.ledger import STANCES, claims_of, ledger_units, weighted_edges
from evigraph.schema import ASSESSMENT, POLICY

_TEXTS = "array<string>"
_OPEN = ("metadata_json",)


def _policy() -> Column:
    """The weighting policy of graphs, as a record."""
    fixed = {k: F.lit(v) for k, v in POLICY.items() if k != "rules"}
    fixed["source_family_discount"] = F.lit(None).cast("double")
    fixed["metadata"] = F.struct(F.array(*[F.lit(r) for r in POLICY["rules"]]).alias("rules"))
    return F.struct(*[v.alias(k) for k, v in fixed.items()])


def _details(graph: Graph) -> DataFrame:
    """What a document says of an edge beyond its weights: (pos, edge_id, artifact_id, fragment_id, uri, has_fragment, assessment, assessments, families)."""
    edges, meta = graph.edges, Meta.of(graph.edges)
    own = F.coalesce("id", F.lit("")) if "id" in edges.columns else F.lit("")
    kind = f"array<{ASSESSMENT}>"
    said = F.coalesce(F.col("assessments").cast(kind), F.array().cast(kind)) if "assessments" in edges.columns else F.array().cast(kind)
    first = F.try_element_at(F.filter(said, lambda a: (a["dimension"] == "grounding_strength") & a["value"].isNotNull()), F.lit(1))["assessment_id"]
    shown = lambda key: F.coalesce(meta.shown(key), F.lit(""))
    return edges.select("pos", own.alias("own_id"), shown("artifact_id").alias("artifact_id"), shown("fragment_id").alias("fragment_id"), shown("source_url").alias("uri"), meta.has("fragment_id").alias("has_fragment"), shown("revises_unit_id").alias("revises_unit_id"), first.alias("assessment"), said.alias("said"))


def _units(graph: Graph, subjects: DataFrame) -> DataFrame:
    """(ledger, pos, key, stance, weight, unit record, warning record or null) of every edge of a ledger, before edges that cite the same are merged."""
    rows = ledger_units(graph, subjects, weighted_edges(graph).withColumn("at", F.col("pos")))
    rows = rows.join(_details(graph).withColumnRenamed("pos", "at"), "at")
    edge_id = text.edge_key(F.col("source"), F.col("type"), F.col("target"), F.col("own_id"))
    unit_id, rule = F.concat(F.lit("evidence:graph-edge:"), edge_id), F.col("weight_rule")
    given = F.when(rule == "typed_edge_grounding_strength", F.col("assessment")).when(rule == "legacy_edge_confidence", edge_id).when(rule == "legacy_source_node_confidence", F.col("source")).otherwise(F.lit(POLICY["policy_id"]))
    defaulted, revision = rule == "missing_weight_default", F.col("stance") == "revision"
    alone = revision & (F.col("revises_unit_id") == "")
    assessments = F.transform("said", lambda a: a.withField("metadata_json", a["metadata"]).dropFields("metadata"))
    reference = F.struct(
        F.lit("1.0").alias("schema_version"), F.col("source").alias("source_record_id"), F.col("artifact_id"), F.col("fragment_id"), edge_id.alias("graph_edge_id"),
        F.coalesce(F.get("families", F.lit(0)), F.lit("")).alias("source_family_id"), F.col("uri"), F.struct(F.col("type").alias("edge_type")).alias("metadata"),
    )
    unit = F.struct(
        F.lit("1.0").alias("schema_version"), unit_id.alias("unit_id"), F.col("unit_subject").alias("subject_claim_id"), F.col("stance"), assessments.alias("input_assessments"),
        F.col("raw_weight"), F.col("raw_weight").alias("effective_weight"), given.alias("weight_input_id"), rule.alias("weight_policy_rule"), F.col("dedup_key").alias("deduplication_key"),
        F.when(F.col("has_fragment"), "artifact and fragment match").otherwise("graph edge identity").alias("deduplication_rationale"),
        *[F.lit(POLICY[k]).alias(k) for k in ("policy_id", "method_name", "method_version")],
        F.when(alone, F.array(unit_id)).when(revision, F.array("revises_unit_id")).otherwise(F.array().cast(_TEXTS)).alias("revision_of_unit_ids"),
        F.col("type").alias("edge_type"), F.when(defaulted, "missing_weight_default_applied").otherwise("").alias("weight_diagnostic"), alone.alias("alone"),
    )
    warning = F.when(defaulted, F.struct(
        F.lit("1.0").alias("schema_version"), F.lit("warning").alias("severity"), F.lit("missing_weight_default_applied").alias("code"), F.lit("Evidence unit used the policy missing-weight default.").alias("message"), unit_id.alias("unit_id"), F.col("unit_subject").alias("subject_claim_id"),
        F.struct(F.lit(POLICY["policy_id"]).alias("policy_id"), rule.alias("weight_policy_rule"), given.alias("weight_input_id")).alias("metadata"),
    ))
    return rows.select("ledger", F.col("at").alias("pos"), F.col("dedup_key").alias("key"), "stance", F.col("raw_weight").alias("weight"), edge_id.alias("edge_id"), unit_id.alias("unit_id"), "families", reference.alias("reference"), unit.alias("unit"), warning.alias("warning"))


def _json(df: DataFrame, name: str) -> Column:
    """Canonical JSON of a column; open metadata go by the name metadata."""
    return F.replace(json_column(F.col(name), df.schema[name].dataType, _OPEN), F.lit('"metadata_json":'), F.lit('"metadata":'))


def _merged(units: DataFrame) -> DataFrame:
    """(ledger, unit_id, json, stance, weight, ...): one unit for what cites the same: the first, with the references, edges and families of all."""
    whole = units.groupBy("ledger", "key").agg(
        F.min_by(F.struct("unit", "unit_id", "stance", "weight"), "pos").alias("first"),
        F.array_sort(F.collect_list(F.struct("pos", "reference", "unit_id"))).alias("all"),
        F.array_sort(F.collect_set("edge_id")).alias("referring_edge_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("families")))).alias("source_family_ids"),
    )
    again = F.array_sort(F.array_distinct(F.transform(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), lambda x: x["unit_id"])))
    made = whole.select("ledger", F.col("first.unit_id").alias("unit_id"), F.col("first.stance").alias("stance"), F.col("first.weight").alias("weight"), F.col("first.unit").alias("u"), F.transform("all", lambda x: x["reference"]).alias("references"), "referring_edge_ids", "source_family_ids", again.alias("again"))
    meta = F.concat(
        F.lit("{"), F.when(F.size("again") > 0, F.concat(F.lit('"duplicate_unit_ids":'), json_column(F.col("again"), made.schema["again"].dataType), F.lit(","))).otherwise(""),
        F.lit('"edge_type":'), json_column(F.col("u.edge_type"), made.schema["unit_id"].dataType), F.when(F.col("u.alone"), ',"revision_relation_without_prior_unit":true').otherwise(""),
        F.lit(',"weight_diagnostic":"'), F.col("u.weight_diagnostic"), F.lit('"}'),
    )
    full = made.withColumn("record", F.col("u").dropFields("edge_type", "weight_diagnostic", "alone").withField("references", F.col("references")).withField("referring_edge_ids", F.col("referring_edge_ids")).withField("source_family_ids", F.col("source_family_ids")).withField("metadata", F.lit("@")))
    before, after = (F.substring_index(_json(full, "record"), ',"metadata":"@",', i) for i in (1, -1))
    return full.select("ledger", "unit_id", "stance", "weight", F.concat(before, F.lit(',"metadata":'), meta, F.lit(","), after).alias("json"))


def _totals(rows: DataFrame, prefix: str) -> list[Column]:
    counts = F.struct(*[F.count_if(F.col("stance") == s).alias(s) for s in STANCES])
    weights = F.struct(*[F.round(F.coalesce(F.sum(F.when(F.col("stance") == s, F.col("weight"))), F.lit(0.0)), 6).alias(s) for s in STANCES])
    return [counts.alias(f"{prefix}_counts"), weights.alias(f"{prefix}_weights"), F.count(F.lit(1)).alias(f"{prefix}_unit_count")]


def documents(graph: Graph, subjects: DataFrame) -> DataFrame:
    """(subject, payload, content_hash) of the ledger of every subject (id): its canonical JSON and the SHA-256 of it. Subjects without evidence have empty ledgers."""
    units = _units(graph, subjects)
    merged = _merged(units)
    listed = merged.groupBy("ledger").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_id", "json"))), lambda x: x["json"]), ",").alias("units"), *_totals(merged, "deduplicated"))
    warned = units.groupBy("ledger").agg(F.array_sort(F.collect_list(F.when(F.col("warning").isNotNull(), F.struct("pos", "warning")))).alias("warnings"), *_totals(units, "raw"))
    claims = claims_of(graph, subjects).groupBy("subject").agg(F.array_sort(F.collect_set("claim")).alias("claims"))
    rows = claims.join(listed.withColumnRenamed("ledger", "subject"), "subject", "left").join(warned.withColumnRenamed("ledger", "subject"), "subject", "left")
    zero, none = F.struct(*[F.lit(0).cast("long").alias(s) for s in STANCES]), F.struct(*[F.lit(0.0).alias(s) for s in STANCES])
    fields = {f"{p}_{c}": F.coalesce(f"{p}_{c}", z) for p in ("raw", "deduplicated") for c, z in (("counts", zero), ("weights", none), ("unit_count", F.lit(0).cast("long")))}
    rows = rows.withColumns(fields)
    sums = F.struct("raw_counts", "deduplicated_counts", "raw_weights", "deduplicated_weights")
    info = F.struct(F.lit("1.0").alias("schema_version"), F.lit("info").alias("severity"), F.lit("evidence_ledger_counts").alias("code"), F.lit("Raw and deduplicated evidence counts and weights.").alias("message"), F.lit("").alias("unit_id"), F.lit("").alias("subject_claim_id"), sums.alias("metadata"))
    rows = rows.withColumns({"info": info, "whole": F.struct("raw_unit_count", "deduplicated_unit_count", "raw_counts", "deduplicated_counts", "raw_weights", "deduplicated_weights"), "policy": _policy(), "ledger_id": F.concat(F.lit("ledger::"), "subject"), "warned": F.transform(F.coalesce("warnings", F.array().cast(rows.schema["warnings"].dataType)), lambda x: x["warning"])})
    warnings = _json(rows, "warned")
    diagnostics = F.concat(F.when(F.size("warned") > 0, F.concat(F.expr("substring(w, 1, length(w) - 1)"), F.lit(","))).otherwise("["), _json(rows, "info"), F.lit("]"))
    rows = rows.withColumn("w", warnings)
    payload = F.concat(
        F.lit('{"diagnostics":'), diagnostics, F.lit(',"ledger_id":'), _json(rows, "ledger_id"), F.lit(',"metadata":'), _json(rows, "whole"), F.lit(',"schema_version":"1.0","subject_claim_ids":'), _json(rows, "claims"),
        F.lit(',"units":['), F.coalesce("units", F.lit("")), F.lit('],"weighting_policy":'), _json(rows, "policy"), F.lit("}"),
    )
    return rows.select("subject", payload.alias("payload")).withColumn("content_hash", F.sha2(F.col("payload"), 256))
