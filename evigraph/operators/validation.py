"""Findings about a graph: does it have the declared shape, and is it ready for assessment? Unions of filtered selects."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions.confidence import lineage_findings
from evigraph.functions.meta import Meta
from evigraph.graph import Graph, of_types
from evigraph.operators import structure, traversal
from evigraph.schema import ASSESSED_TYPES, BAYESIAN_POLICY_KEYS, BAYESIAN_RESULT_KEYS, CHALLENGE, GROUNDING, LEGACY_MAPPING_KEY, REVISION, SUPPORT, TEMPORAL_KEYS


@dataclass(frozen=True)
class GraphShape:
    """allowed_targets is keyed by the source node's type."""

    required_node_fields: dict[str, set[str]] = field(default_factory=dict)
    required_edge_fields: dict[str, set[str]] = field(default_factory=dict)
    allowed_targets: dict[str, set[str]] = field(default_factory=dict)
    acyclic_types: set[str] = field(default_factory=set)
    provenance_types: set[str] = field(default_factory=set)


@dataclass(frozen=True)
class ReadinessPolicy:
    assessed_types: tuple[str, ...] = ASSESSED_TYPES
    evidence_types: tuple[str, ...] = tuple(t for t in (*SUPPORT, *CHALLENGE, *REVISION) if t not in ("about_concept", "teaches_concept"))
    temporal_types: tuple[str, ...] = (*SUPPORT, *CHALLENGE, *REVISION)
    titled_types: tuple[str, ...] = ("claim", "concept", "source")
    require_graph_id: bool = True
    require_provenance: bool = True
    require_grounding: bool = False
    require_temporal: bool = True
    require_bayesian_policy: bool = True
    temporal_keys: tuple[str, ...] = TEMPORAL_KEYS
    policy_keys: tuple[str, ...] = BAYESIAN_POLICY_KEYS
    mapping_key: str = LEGACY_MAPPING_KEY


#: Columns of a finding; subject is the node's id, the edge as "source -[type]-> target", the graph's id or "graph".
FINDING = "severity string, code string, subject string, field string"


def _finding(df: DataFrame, severity: str, code: str, subject: Column, what: Column | None = None) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), subject.alias("subject"), (F.lit(None).cast("string") if what is None else what).alias("field"))


def _edge() -> Column:
    return F.concat(F.col("source"), F.lit(" -["), F.col("type"), F.lit("]-> "), F.col("target"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def field_present(df: DataFrame, name: str) -> Column:
    """A column of that name, else a metadata key: neither null nor an empty text or list."""
    if name in df.columns and name != "metadata":
        kind = dict(df.dtypes)[name]
        if kind == "string":
            return F.coalesce(F.col(name) != "", F.lit(False))
        return F.coalesce(F.size(name) > 0, F.lit(False)) if kind.startswith(("array", "map")) else F.col(name).isNotNull()
    return Meta.of(df).present(name) if "metadata" in df.columns else F.lit(False)


def shape_findings(graph: Graph, shape: GraphShape) -> DataFrame:
    parts = []
    for kind, fields in sorted(shape.required_node_fields.items()):
        for name in sorted(fields):
            parts.append(_finding(graph.nodes.where((F.col("type") == kind) & ~field_present(graph.nodes, name)), "error", "missing_node_field", F.col("id"), F.lit(name)))
    parts.append(_finding(structure.missing_endpoints(graph), "error", "missing_edge_endpoint", _edge()))
    valid = graph.valid_edges()
    types = graph.index().select("id", F.col("type").alias("t"))
    if shape.allowed_targets:
        ends = valid.join(types.select(F.col("id").alias("source"), F.col("t").alias("source_type")), "source").join(types.select(F.col("id").alias("target"), F.col("t").alias("target_type")), "target")
        wrong = F.lit(False)
        for kind, allowed in sorted(shape.allowed_targets.items()):
            wrong = wrong | ((F.col("source_type") == kind) & ~of_types(F.col("target_type"), allowed))
        parts.append(_finding(ends.where(wrong), "warning", "unexpected_edge_target_type", _edge(), F.col("target_type")))
    for kind, fields in sorted(shape.required_edge_fields.items()):
        for name in sorted(fields):
            parts.append(_finding(valid.where((F.col("type") == kind) & ~field_present(valid, name)), "error", "missing_edge_field", _edge(), F.lit(name)))
    for kind in sorted(shape.acyclic_types):
        looped = traversal.cycle_nodes(graph, {kind})
        listed = looped.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 0")
        parts.append(_finding(listed, "error", "edge_type_cycle", F.concat(F.lit(f"{kind}: "), F.col("n").cast("string"), F.lit(" nodes from "), F.col("first"))))
    parts.append(_finding(structure.missing_provenance(graph, shape.provenance_types), "warning", "missing_edge_provenance", _edge()))
    return _union(parts)


def _policy_gaps(df: DataFrame, meta: Meta, policy: ReadinessPolicy, subject: Column) -> DataFrame | None:
    """Missing policy keys of rows whose metadata holds Bayesian results; a key may also stand under assessment_policy."""
    if not policy.require_bayesian_policy:
        return None
    needs = F.lit(False)
    for key in BAYESIAN_RESULT_KEYS:
        needs = needs | F.coalesce(meta.has(key), F.lit(False))
    inner = Meta(meta.kind, meta.column) if meta.kind is None else meta
    gaps = []
    for key in sorted(policy.policy_keys):
        nested = F.coalesce(~F.to_json(F.try_variant_get(inner.column, f"$.assessment_policy.{key}", "variant")).isin("null", '""', "[]", "{}"), F.lit(False)) if inner._open else F.lit(False)
        gaps.append(F.when(~meta.present(key) & ~nested, F.lit(key)))
    rows = df.where(needs).select(subject.alias("subject"), F.explode(F.array_compact(F.array(*gaps))).alias("key"))
    return _finding(rows, "warning", "missing_bayesian_policy_metadata", F.col("subject"), F.col("key"))


def readiness_findings(graph: Graph, policy: ReadinessPolicy | None = None) -> DataFrame:
    """Findings on whether assessments of the graph can be audited; they say nothing about truth."""
    policy = policy or ReadinessPolicy()
    spark, nodes, edges = graph.nodes.sparkSession, graph.nodes, graph.edges
    node_meta, edge_meta = Meta.of(nodes), Meta.of(edges)
    parts = [spark.createDataFrame([], FINDING)]
    lists = [df.select(F.explode("assessments").alias("a")).select("a.*") for df in (nodes, edges) if "assessments" in df.columns]
    if lists:
        lineage = lineage_findings(_union(lists))
        parts.append(lineage.select("severity", "code", F.col("assessment_id").alias("subject"), F.lit(None).cast("string").alias("field")))
    declared = False
    if graph.header is not None:
        head = Meta.of(graph.header)
        if policy.require_graph_id:
            parts.append(_finding(graph.header.where(F.coalesce("graph_id", F.lit("")) == ""), "warning", "missing_graph_id", F.lit("graph")))
        parts.append(_policy_gaps(graph.header, head, policy, F.coalesce(F.nullif("graph_id", F.lit("")), F.lit("graph"))) or parts[0])
        declared = not graph.header.where(head.present(policy.mapping_key)).isEmpty()
    elif policy.require_graph_id:
        parts.append(spark.createDataFrame([("warning", "missing_graph_id", "graph", None)], FINDING))
    parts.append(_finding(structure.duplicate_node_ids(graph), "error", "duplicate_node_id", F.col("id")))
    parts.append(_finding(structure.missing_endpoints(graph), "error", "missing_edge_endpoint", _edge()))
    if "title" in nodes.columns:
        parts.append(_finding(nodes.where(of_types(F.col("type"), policy.titled_types) & (F.coalesce("title", F.lit("")) == "")), "warning", "missing_node_title", F.col("id")))
    for df, meta, name, subject in ((nodes, node_meta, "node", F.col("id")), (edges, edge_meta, "edge", _edge())):
        if "confidence" in df.columns:
            parts.append(_finding(df.where(~F.col("confidence").between(0, 1)), "error", f"invalid_{name}_confidence", subject))
            if "assessments" in df.columns and not declared:
                beside = F.col("confidence").isNotNull() & (F.size("assessments") > 0) & ~meta.present(policy.mapping_key)
                parts.append(_finding(df.where(beside), "warning", "legacy_confidence_without_mapping_policy", subject))
    if "metadata" in nodes.columns:
        gaps = _policy_gaps(nodes.where(of_types(F.col("type"), policy.assessed_types)), node_meta, policy, F.col("id"))
        parts += [gaps] if gaps is not None else []
    assessed = nodes.where(of_types(F.col("type"), policy.assessed_types)).select("id").distinct()
    evidence = edges.where(of_types(F.col("type"), policy.evidence_types))
    supported = evidence.join(nodes.select(F.col("id").alias("source")).distinct(), "source", "left_semi").select(F.col("target").alias("id")).distinct()
    parts.append(_finding(assessed.join(supported, "id", "left_anti"), "warning", "assessed_node_without_evidence", F.col("id")))
    if policy.require_provenance:
        parts.append(_finding(structure.missing_provenance(graph, policy.evidence_types), "warning", "missing_evidence_provenance", _edge()))
    if policy.require_grounding:
        said = F.lit(False)
        if "status" in edges.columns:
            said = said | F.coalesce(F.col("status").isin(*GROUNDING), F.lit(False))
        if "provenance" in edges.columns:
            said = said | F.coalesce(F.exists("provenance", lambda p: F.coalesce(p["grounding_status"] != "", F.lit(False))), F.lit(False))
        parts.append(_finding(evidence.where(~(said | edge_meta.present("grounding_status"))), "warning", "missing_evidence_grounding_status", _edge()))
    if policy.require_temporal:
        dated = lambda m: F.greatest(*[m.present(k) for k in policy.temporal_keys])
        late = edges.where(of_types(F.col("type"), policy.temporal_types) & ~dated(edge_meta)).select("source", "target", "type")
        sources = graph.index().where(dated(node_meta)).select(F.col("id").alias("source"))
        undated = late.join(sources, "source", "left_anti")
        parts.append(_finding(undated, "info", "missing_temporal_metadata", _edge()))
    return _union(parts)


def in_order(findings: DataFrame) -> DataFrame:
    """Errors, then warnings, then information; each by code and subject."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return findings.orderBy(rank, "code", "subject", "field")


def status(findings: DataFrame) -> DataFrame:
    """One row: status and counts by severity."""
    n = lambda s: F.count_if(F.col("severity") == s)
    overall = F.when(n("error") > 0, "error").when(n("warning") > 0, "warning").otherwise("pass")
    return findings.agg(overall.alias("status"), F.count(F.lit(1)).alias("finding_count"), n("error").alias("error"), n("warning").alias("warning"), n("info").alias("info"))
