"""Canonical JSON in columns, and whole ledgers against documents built with dictionaries."""

import hashlib
import json
import math
import random

from pyspark.sql import functions as F

from evigraph.functions import canonical
from evigraph.graph import Graph
from evigraph.operators import ledger_documents
from evigraph.schema import EDGES, NODES


def test_json_in_columns_is_that_of_python(spark):
    r = random.Random(1)
    texts = ["", "plain", 'a "quoted" \\ text', "\u00e9t\u00e9 \U0001f600 \u2028", "\x00\x1f\x7f\b\f\n\r\t", "\ue000\ufffd", None]
    doubles = [0.0, 1.0, -1.5, 0.1, 1e-4, 1.25e-5, 9.999e-5, 12345678.9, 1e7, 123456789012345.6, 1e15, 1e16, 1.5e300, 2.5e-300, None, *(r.choice((-1, 1)) * r.random() * 10 ** r.randint(-20, 20) for _ in range(300))]
    rows = [(texts[i % len(texts)], x, i if i % 3 else None, [texts[i % 5], None], (x, "k"), i % 2 == 0) for i, x in enumerate(doubles)]
    df = spark.createDataFrame(rows, "t string, x double, n long, l array<string>, s struct<z:double,b:string>, f boolean").withColumn("all", F.struct("t", "x", "n", "l", "s", "f"))
    for row, got in zip(rows, df.select(canonical.json_column(F.col("all"), df.schema["all"].dataType).alias("j")).collect(), strict=True):
        want = dict(zip(("t", "x", "n", "l", "f"), (*row[:4], row[5]), strict=True)) | {"s": {"z": row[4][0], "b": "k"}}
        made = json.loads(got["j"])
        assert made == want  # the same values
        if row[1] is None or len(repr(abs(row[1]))) < 19:  # and the same bytes, but for doubles that Java writes with a digit more
            assert got["j"] == canonical.canonical_json(want)
    pairs = spark.createDataFrame([(a or "", b or "") for a in texts for b in texts], "a string, b string")
    for r_ in pairs.select("a", "b", canonical.pair_hash(F.col("a"), F.col("b")).alias("h")).collect():
        assert r_["h"] == canonical.canonical_hash({"artifact_id": r_["a"], "fragment_id": r_["b"]})
    opened = spark.createDataFrame([('{"b": [1, {"z": null, "a": "\u00e9\\n"}], "a": 0.5}',), (None,), ("no json",)], "m string").select(canonical.json_open(F.col("m")).alias("j")).collect()
    assert [x["j"] for x in opened] == [canonical.canonical_json({"b": [1, {"z": None, "a": "\u00e9\n"}], "a": 0.5}), "{}", "{}"]


def ledger_of(nodes, edges, subject):
    """The document of a subject's ledger, step by step with dictionaries."""
    by_id = {n["id"]: n for n in nodes}
    stances = {"supports": "support", "contradicts": "challenge", "supersedes": "revision"}
    claims = {subject}
    if by_id.get(subject, {}).get("type") == "concept":
        claims = {e["source"] for e in edges if e["target"] == subject and by_id.get(e["source"], {}).get("type") == "claim"} or claims
    sums = lambda: ({s: 0 for s in ("support", "challenge", "neutral", "revision")}, {s: 0.0 for s in ("support", "challenge", "neutral", "revision")})
    (raw_n, raw_w), (one_n, one_w), kept, notes, total = sums(), sums(), {}, [], 0
    policy = {"schema_version": "1.0", "policy_id": "graph_edge_evidence_weighting_v1", "method_name": "graph_edge_evidence_weighting", "method_version": "1.0"}
    for e in edges:
        if e["type"] not in stances or not {e["source"], e["target"]} & claims:
            continue
        stance, key, meta = stances[e["type"]], e["id"] or f"{e['source']}->{e['type']}->{e['target']}", e["metadata"]
        about = e["target"] if e["target"] in claims else e["source"]
        typed = [a for a in e["assessments"] if a["dimension"] == "grounding_strength" and a["value"] is not None]
        node = by_id.get(e["source"])
        if typed:
            weight, given, rule = typed[0]["value"], typed[0]["assessment_id"], "typed_edge_grounding_strength"
        elif e["confidence"] is not None:
            weight, given, rule = e["confidence"], key, "legacy_edge_confidence"
        elif node and node["confidence"] is not None:
            weight, given, rule = node["confidence"], node["id"], "legacy_source_node_confidence"
        else:
            weight, given, rule = 1.0, policy["policy_id"], "missing_weight_default"
        families = sorted({str(m[k]) for m in (meta, node["metadata"] if node else {}) for k in ("source_family_id", "source_family") if m.get(k)})
        cites = [str(meta.get(k, "")) for k in ("artifact_id", "fragment_id")]
        if all(cites):
            same = canonical.canonical_hash({"artifact_id": cites[0], "fragment_id": cites[1]})
        else:
            same = e["id"] or canonical.canonical_hash({"source": e["source"], "target": e["target"], "type": e["type"]})
        unit_id = f"evidence:graph-edge:{key}"
        revises = [str(meta["revises_unit_id"])] if stance == "revision" and meta.get("revises_unit_id") else []
        extra = {"edge_type": e["type"], "weight_diagnostic": "missing_weight_default_applied" if rule == "missing_weight_default" else ""}
        if stance == "revision" and not revises:
            revises, extra["revision_relation_without_prior_unit"] = [unit_id], True
        reference = {"schema_version": "1.0", "source_record_id": e["source"], "artifact_id": cites[0], "fragment_id": cites[1], "graph_edge_id": key, "source_family_id": families[0] if families else "", "uri": str(meta.get("source_url", "")), "metadata": {"edge_type": e["type"]}}
        total += 1
        raw_n[stance] += 1
        raw_w[stance] += weight
        if rule == "missing_weight_default":
            notes.append({"schema_version": "1.0", "severity": "warning", "code": "missing_weight_default_applied", "message": "Evidence unit used the policy missing-weight default.", "unit_id": unit_id, "subject_claim_id": about, "metadata": {"policy_id": policy["policy_id"], "weight_policy_rule": rule, "weight_input_id": given}})
        if same in kept:
            first = kept[same]
            first["references"].append(reference)
            first["referring_edge_ids"] = sorted({*first["referring_edge_ids"], key})
            first["source_family_ids"] = sorted({*first["source_family_ids"], *families})
            first["metadata"]["duplicate_unit_ids"] = sorted({*first["metadata"].get("duplicate_unit_ids", []), unit_id})
            continue
        one_n[stance] += 1
        one_w[stance] += weight
        kept[same] = {
            "schema_version": "1.0", "unit_id": unit_id, "subject_claim_id": about, "stance": stance, "references": [reference], "referring_edge_ids": [key], "source_family_ids": families, "input_assessments": e["assessments"], "raw_weight": weight, "effective_weight": weight,
            "weight_input_id": given, "weight_policy_rule": rule, "deduplication_key": same, "deduplication_rationale": "artifact and fragment match" if "fragment_id" in meta else "graph edge identity",
            **{k: policy[k] for k in ("policy_id", "method_name", "method_version")}, "revision_of_unit_ids": revises, "metadata": extra,
        }
    whole = {"raw_counts": raw_n, "deduplicated_counts": one_n, "raw_weights": {k: round(v, 6) for k, v in raw_w.items()}, "deduplicated_weights": {k: round(v, 6) for k, v in one_w.items()}}
    notes.append({"schema_version": "1.0", "severity": "info", "code": "evidence_ledger_counts", "message": "Raw and deduplicated evidence counts and weights.", "unit_id": "", "subject_claim_id": "", "metadata": whole})
    rules = ["typed edge grounding_strength assessment", "legacy edge confidence", "source node confidence", "versioned missing-weight default"]
    return {
        "schema_version": "1.0", "ledger_id": f"ledger::{subject}", "subject_claim_ids": sorted(claims), "units": sorted(kept.values(), key=lambda u: u["unit_id"]), "diagnostics": notes,
        "weighting_policy": {**policy, "missing_weight_default": 1.0, "source_family_dependence": "record_only", "source_family_discount": None, "metadata": {"rules": rules}}, "metadata": {"raw_unit_count": total, "deduplicated_unit_count": len(kept), **whole},
    }


def assessment(i, value):
    return {
        "schema_version": "1.0", "assessment_id": f"as-{i}", "subject_id": "x", "dimension": "grounding_strength", "value": value, "band": "unknown", "interval": {"level": 0.95, "lower": 0.1, "upper": 0.75, "method": "m"} if i % 2 else None, "assessor_id": "",
        "method": {"name": "n", "version": "1", "policy_id": ""}, "basis_record_ids": ["r"], "source_family_ids": [], "basis_hash": "", "rationale": "caf\u00e9", "valid_at": "", "recorded_at": "2024-01-01", "supersedes_assessment_id": "", "metadata": {"z": 1, "a": ["\u00e9", None]},
    }


def test_ledgers_equal_documents_of_dictionaries(spark):
    r = random.Random(4)
    nodes = [{"id": f"n{i}", "type": "concept" if i > 7 else "claim" if i < 4 else "source", "confidence": r.choice((None, 0.25, 0.9)), "metadata": {} if i % 2 else {"source_family": f"fam-{i}"}} for i in range(10)]
    edges = []
    for i in range(60):
        meta = {k: v for k, v in (("artifact_id", f'art "{i % 4}" \u00fc'), ("fragment_id", f"f{i % 3}"), ("source_url", "https://x/\u00e9"), ("source_family_id", f"own-{i % 2}"), ("revises_unit_id", f"u{i % 2}")) if r.random() < 0.6}
        edges.append({"source": r.choice([*(n["id"] for n in nodes), "lost"]), "target": r.choice(nodes)["id"], "type": r.choice(("supports", "contradicts", "supersedes", "about")), "id": f"e{i}" if i % 3 else "", "confidence": r.choice((None, 0.5, 0.123456)), "assessments": [assessment(i, r.choice((None, 0.375)))] if i % 4 == 0 else [], "metadata": meta})
    flat = lambda x, pos: {**x, "graph_id": "g", "pos": pos, "metadata": json.dumps(x["metadata"])}
    pack = lambda e: {**e, "assessments": [{**a, "metadata": json.dumps(a["metadata"])} for a in e["assessments"]]}
    whole = lambda rows, ddl: spark.read.schema(ddl).json(spark.createDataFrame([(json.dumps(x),) for x in rows], "v string").rdd.map(lambda x: x[0]))
    graph = Graph(whole([flat(n, i) for i, n in enumerate(nodes)], NODES), whole([flat(pack(e), i) for i, e in enumerate(edges)], EDGES))
    subjects = [n["id"] for n in nodes] + ["lost"]
    got = {x["subject"]: x for x in ledger_documents.documents(graph, spark.createDataFrame([(s,) for s in subjects], "id string")).collect()}
    assert set(got) == set(subjects)
    for s in subjects:
        want = canonical.canonical_json(ledger_of(nodes, edges, s))
        assert got[s]["payload"] == want
        assert got[s]["content_hash"] == hashlib.sha256(want.encode()).hexdigest()
    assert not any(math.isnan(u["raw_weight"]) for u in json.loads(got["n0"]["payload"])["units"])
