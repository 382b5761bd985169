"""Command line over bundles, evaluation rows and GEDCOM files: python -m evigraph.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from evigraph.operators import calibration, epistemic, experiment, gmetric, stories, structure, traversal, validation
from evigraph.plans import manifests, report
from evigraph.sources import bundle, export, gedcom


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="evigraph")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: tuple, out: bool = True) -> None:
        s = sub.add_parser(name)
        for flags, options in args:
            s.add_argument(*flags, **options)
        if out:
            s.add_argument("--out", help="file or folder to write; standard output gets a JSON summary")

    source, rows = ((("path",), {}),), ((("path",), {"nargs": "+"}),)
    for name in ("diagnostics", "validate", "epistemic-report", "bayesian-assessment", "dot", "cytoscape", "jsonld"):
        kinds = ((("--node-types",), {"default": ""}),) if name.startswith(("epistemic", "bayesian")) else ()
        add(name, *source, *kinds, *(((("--prior",), {"default": "neutral"}), (("--credibility",), {"type": float, "default": 0.95})) if kinds else ()))
    add("neighborhood", *source, (("node",), {}), (("--hops",), {"type": int, "default": 1}))
    add("gedcom", *source, (("--graph-id",), {"default": "genealogy"}))
    add("g-summary", *rows, (("--group-by",), {"default": "condition"}), (("--manifest",), {}), (("--require-consistent",), {"action": "store_true"}))
    add("g-compare", *rows, (("--baseline",), {}))
    add("g-manifest", *rows, (("--experiment-id",), {"required": True}))
    add("validate-rows", *rows, (("--allow-incomplete",), {"action": "store_true"}))
    add("merge-rows", *rows)
    add("run-sheets", *rows, (("--prefix",), {"required": True}), (("--subjects",), {"type": int, "default": 1}), (("--seed",), {"type": int, "default": 0}))
    add("blind", *rows)
    add("unblind", *rows, (("--key",), {"required": True}))
    add("story-findings", *source)
    add("story-sidecars", *source)
    add("story-template", *source, (("--conditions",), {"required": True}), (("--phases",), {"required": True}), (("--admit",), {"default": ""}), (("--control",), {"default": ""}), (("--experiment-id",), {"default": ""}))
    add("anchor-template", *source)
    add("apply-anchor-review", *source, (("--reviews",), {"required": True}))
    for kind in ("assessment", "treatment"):
        add(f"{kind}-manifest", *source)
    add("calibration", *source, (("--event",), {"required": True}))
    return p


def _rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def run(argv: list[str], spark: SparkSession) -> tuple[dict, int]:
    """The result of a command and its exit code: 2 where a gate fails."""
    a = _parser().parse_args(argv)
    code, out = 0, {}
    if a.command in ("diagnostics", "validate", "epistemic-report", "bayesian-assessment", "dot", "cytoscape", "jsonld", "neighborhood"):
        graph = bundle.read_bundles(spark, a.path)
        if a.command == "diagnostics":
            out = {"summary": _rows(structure.diagnostics_summary(graph))[0], "top": _rows(structure.top_degrees(graph)), "bridges": _rows(structure.bridge_nodes(graph).orderBy(F.desc("component_size"), "node_id"))}
        elif a.command == "validate":
            found = validation.readiness_findings(graph)
            out = {"summary": _rows(validation.status(found))[0], "findings": _rows(validation.in_order(found))}
            code = 2 if out["summary"]["status"] == "error" else 0
        elif a.command == "neighborhood":
            seeds = spark.createDataFrame([(a.node,)], "id string")
            out = {"edges": _rows(traversal.neighborhood(graph, seeds))} if a.hops <= 1 else bundle.bundle_payload(traversal.k_hop_subgraph(graph, seeds, a.hops))
        elif a.command in ("epistemic-report", "bayesian-assessment"):
            summary = epistemic.summaries(graph, [t for t in a.node_types.split(",") if t], prior=a.prior, credibility=a.credibility).persist()
            ordered = epistemic.assessment_rows(summary)
            out = {"counts": _rows(epistemic.report_counts(summary).orderBy("kind", "name")), "nodes": _rows(ordered)}
            if a.out:
                report.write(a.out, report.document("Assessment", {"Nodes": ordered.select("target", "bayesian_label", "mean", "lower", "upper", "mean_range", "reliability_band")}))
        else:
            made = {"dot": export.to_dot, "cytoscape": export.to_cytoscape, "jsonld": export.to_jsonld}[a.command](graph)
            if a.out:
                export.write_text(a.out, made)
            out = {"text": made} if isinstance(made, str) else made
    elif a.command == "gedcom":
        graph = gedcom.read_gedcom(spark, a.path, a.graph_id)
        out = {"counts": _rows(structure.type_counts(graph).orderBy("component", "type"))}
        if a.out:
            bundle.write_bundle(graph, a.out)
    elif a.command.endswith("-manifest") and a.command != "g-manifest":
        kind = a.command.removesuffix("-manifest")
        out = manifests.report(json.loads(Path(a.path).read_text(encoding="utf-8")), kind)
        code = 2 if out["status"] == "error" else 0
        if a.out:
            report.write(a.out, out)
    elif a.command in ("story-findings", "story-sidecars", "story-template", "anchor-template", "apply-anchor-review"):
        table = stories.read_stories(spark, a.path)
        if a.command == "story-findings":
            each = stories.reports(table).persist()
            out = {"counts": _rows(stories.corpus_summary(table).orderBy("kind", "name")), "stories": _rows(each.orderBy("story_id"))}
            code = 2 if any(r["status"] == "error" for r in out["stories"]) else 0
            if a.out:
                stories.findings(table).write.json(a.out)
        elif a.command == "story-sidecars":
            made = stories.write_sidecars(table, a.out) if a.out else stories.sidecars(table, "")
            out = {"counts": _rows(stories.sidecar_counts(made).orderBy("kind", "name"))}
        elif a.command == "story-template":
            listed = lambda text: [x for x in text.split(",") if x]
            made = experiment.collection_template(stories.claims_to_judge(table), listed(a.conditions), listed(a.phases), listed(a.admit), listed(a.control), experiment_id=a.experiment_id)
            out = {"row_count": made.count()}
            if a.out:
                experiment.write_rows(made, a.out, experiment.TEMPLATE_EXTRA)
        elif a.command == "anchor-template":
            made = stories.anchor_review_template(table)
            out = {"row_count": made.count()}
            if a.out:
                made.write.csv(a.out, header=True)
        else:
            reviews = spark.read.csv(a.reviews, header=True).withColumn("pos", F.monotonically_increasing_id())
            made = stories.apply_anchor_reviews(table, reviews)
            out = {"counts": _rows(made.groupBy("anchor_status").agg(F.count(F.lit(1)).alias("story_count")).orderBy("anchor_status"))}
            if a.out:
                stories.write_stories(made.drop("anchor_status"), a.out)
    elif a.command == "calibration":
        samples = spark.read.schema("subject_id string, predicted double, observed double, dimension string, event string, metadata string").json(a.path)
        out = calibration.report(samples, a.event)
    else:
        rows = experiment.read_rows(spark, a.path)
        if a.command == "g-summary":
            manifest = manifests.read(a.manifest, "g_experiment") if a.manifest else {}
            warnings = gmetric.manifest_warnings(rows, manifest)
            out = {"groups": _rows(gmetric.experiment_summary(gmetric.valid_rows(rows), a.group_by).orderBy(F.asc_nulls_first("label"))), "warnings": warnings}
            code = 2 if a.require_consistent and warnings else 0
        elif a.command == "g-compare":
            per = gmetric.g_estimate(gmetric.valid_rows(rows), ["file"]).select(F.col("file").alias("experiment_id"), "G", F.col("file").alias("input_pos"))
            out = {"summaries": _rows(gmetric.compare(per, a.baseline).orderBy("rank"))}
        elif a.command == "g-manifest":
            found = experiment.manifest_of_rows(rows)
            out = manifests.make("g_experiment", experiment_id=a.experiment_id, row_count=found["row_count"], conditions=found["condition"], phases=found["phase"])
            if a.out:
                manifests.write(out, a.out)
        elif a.command == "validate-rows":
            found = experiment.row_findings(rows, not a.allow_incomplete)
            out = {"summary": _rows(validation.status(found))[0], "findings": _rows(found.orderBy("severity", "code", "row"))}
            code = 2 if out["summary"]["status"] == "error" else 0
        elif a.command == "merge-rows":
            merged, found = experiment.merge_sheets(rows)
            every = found.unionByName(experiment.row_findings(merged))
            out = {"summary": _rows(validation.status(every))[0], "row_count": merged.count()}
            if a.out:
                experiment.write_rows(merged.drop("file"), a.out)
        elif a.command == "run-sheets":
            sheets = experiment.run_sheets(rows.drop("file"), a.prefix, subjects=a.subjects, seed=a.seed)
            out = {"sheets": _rows(sheets.groupBy("run_id", "subject_id", "condition").agg(F.count(F.lit(1)).alias("row_count")).orderBy("run_id"))}
            if a.out:
                sheets.orderBy("run_id", "place").write.partitionBy("run_id").csv(a.out, header=True)
        elif a.command == "blind":
            public, key = experiment.blind(rows.drop("file"))
            out = {"row_count": public.count()}
            if a.out:
                public.write.csv(f"{a.out}/sheets", header=True)
                key.write.parquet(f"{a.out}/key")
        elif a.command == "unblind":
            whole, lost = experiment.unblind(rows, spark.read.parquet(a.key))
            found = lost.unionByName(experiment.row_findings(whole))
            out = {"row_count": whole.count(), "summary": _rows(validation.status(found))[0]}
            if a.out:
                experiment.write_rows(whole, a.out)
    return out, code


def main(argv: list[str] | None = None) -> int:
    out, code = run(sys.argv[1:] if argv is None else argv, SparkSession.builder.getOrCreate())
    print(json.dumps(out, indent=2, sort_keys=True, default=str))
    return code


if __name__ == "__main__":
    sys.exit(main())
