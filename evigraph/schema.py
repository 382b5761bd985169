"""Table layouts and fixed vocabularies of the graph model."""

from __future__ import annotations

PROVENANCE = "STRUCT<source_id STRING, artifact_id STRING, origin_path STRING, source_url STRING, support_kind STRING, grounding_status STRING, metadata STRING>"
ASSESSMENT = (
    "STRUCT<schema_version STRING, assessment_id STRING, subject_id STRING, dimension STRING, value DOUBLE, band STRING, "
    "`interval` STRUCT<level DOUBLE, lower DOUBLE, upper DOUBLE, method STRING>, assessor_id STRING, method STRUCT<name STRING, version STRING, policy_id STRING>, "
    "basis_record_ids ARRAY<STRING>, source_family_ids ARRAY<STRING>, basis_hash STRING, rationale STRING, valid_at STRING, recorded_at STRING, "
    "supersedes_assessment_id STRING, metadata STRING>"
)
NODE_FIELDS = f"id STRING, type STRING, title STRING, description STRING, aliases ARRAY<STRING>, status STRING, confidence DOUBLE, assessments ARRAY<{ASSESSMENT}>, provenance ARRAY<{PROVENANCE}>, metadata STRING"
EDGE_FIELDS = (
    f"source STRING, target STRING, type STRING, id STRING, title STRING, justification STRING, confidence DOUBLE, assessments ARRAY<{ASSESSMENT}>, status STRING, "
    f"evidence_ids ARRAY<STRING>, provenance ARRAY<{PROVENANCE}>, metadata STRING"
)
NODES = f"graph_id STRING, pos BIGINT, {NODE_FIELDS}"
EDGES = f"graph_id STRING, pos BIGINT, {EDGE_FIELDS}"
BUNDLE = f"bundle_kind STRING, graph_id STRING, title STRING, description STRING, metadata STRING, nodes ARRAY<STRUCT<{NODE_FIELDS}>>, edges ARRAY<STRUCT<{EDGE_FIELDS}>>"

# Edge types by stance.
SUPPORT = ("supports", "supports_claim", "about_concept", "supports_concept", "teaches_concept")
CHALLENGE = ("contradicts", "challenges", "disputes")
REVISION = ("supersedes", "corrects", "retracts", "qualifies")

# What source-quality and stance metadata may say.
HIGH_TRUST = ("high", "trusted", "peer_reviewed", "primary", "official", "expert_reviewed")
MIXED_TRUST = ("medium", "mixed", "provisional", "secondary", "tertiary")
LOW_TRUST = ("low", "rejected", "unreviewed", "advocacy", "misinformation", "denialist", "retracted")
ADVERSARIAL = ("adversarial", "denialist", "misinformation", "manufactured_doubt", "trust_eroding")
QUALITY_KEYS = ("source_quality", "source_reliability", "trust_status")
STANCE_KEYS = ("source_stance", "stance", "adversarial_intent")
GROUNDING = ("grounded", "partially_grounded", "ungrounded")

# Prior profiles (alpha, beta).
PRIORS = {"neutral": (1.0, 1.0), "skeptical": (1.0, 2.0), "supportive": (2.0, 1.0), "source_conservative": (1.0, 3.0), "adversarial_aware": (1.0, 4.0)}
# Standard normal quantiles for two-sided credibility levels; any other level uses DEFAULT_Z.
Z_VALUES = {0.8: 1.281552, 0.9: 1.644854, 0.95: 1.959964, 0.99: 2.575829}
DEFAULT_Z = 1.959964

# Metadata keys that carry times.
AVAILABILITY_KEYS = ("available_at", "validated_at", "published_at", "observed_at", "introduced_at", "created_at", "timestep")
EVENT_KEYS = ("introduced_at", "available_at", "observed_at", "published_at", "validated_at", "challenged_at", "superseded_at", "rejected_at", "created_at", "timestep")
HIDDEN_STATUS = ("hidden", "private", "withheld", "unavailable", "detective_only")
HIDDEN_SCOPE = ("private", "detective_only", "hidden", "withheld")
INACTIVE_STATUS = ("rejected", "superseded", "archived")

# Confidence dimensions (any other must hold a colon) and those with restricted calibration.
DIMENSIONS = ("extraction_fidelity", "identity_resolution", "grounding_strength", "source_reliability", "evidential_support", "reviewer_endorsement", "response_correctness", "evidence_coverage")
RESTRICTED_DIMENSIONS = ("extraction_fidelity", "source_reliability", "reviewer_endorsement")
ASSESSED_TYPES = ("claim", "concept")

# Keys of the readiness policy.
TEMPORAL_KEYS = ("available_at", "introduced_at", "timestep", "valid_at", "valid_from", "valid_until")
BAYESIAN_POLICY_KEYS = ("bayesian_prior_profile", "evidence_weighting_policy", "graph_extraction_policy")
BAYESIAN_RESULT_KEYS = ("bayesian_reliability", "bayesian_assessment", "bayesian_assessment_report", "assessment_summary")
LEGACY_MAPPING_KEY = "legacy_confidence_mapping_policy"

# The weighting policy of graphs.
POLICY = {
    "schema_version": "1.0", "policy_id": "graph_edge_evidence_weighting_v1", "method_name": "graph_edge_evidence_weighting", "method_version": "1.0", "missing_weight_default": 1.0, "source_family_dependence": "record_only",
    "rules": ("typed edge grounding_strength assessment", "legacy edge confidence", "source node confidence", "versioned missing-weight default"),
}
