"""Read-only tools over graph bundles as line-delimited JSON-RPC on standard input and output."""

from __future__ import annotations

import json
import sys
from typing import Any, TextIO

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from evigraph import cli

# Version of the protocol; names of the tools, with the command that serves each.
PROTOCOL = "2025-03-26"
TOOLS = {"validate_graph": "validate", "graph_diagnostics": "diagnostics", "graph_neighborhood": "neighborhood", "epistemic_report": "epistemic-report", "bayesian_assessment": "bayesian-assessment"}
SERVER = {"name": "evigraph", "version": "0.1"}


#: The arguments of the tools: type and description; hops and node_types are for the tools named only.
ARGUMENTS = {
    "graph_bundle": ({"type": "string", "description": "Path of a graph bundle"}, tuple(TOOLS)),
    "node_id": ({"type": "string", "description": "The node whose surroundings are asked for"}, ("graph_neighborhood",)),
    "hops": ({"type": "integer", "minimum": 0, "default": 1, "description": "Edges to go from the node"}, ("graph_neighborhood",)),
    "node_types": ({"type": "array", "items": {"type": "string"}, "description": "Types of the nodes that are reported on"}, ("epistemic_report", "bayesian_assessment")),
}
OPTIONAL = ("hops", "node_types")


def list_tools() -> list[dict[str, Any]]:
    """Every tool with the schema of its arguments."""
    out = []
    for name, command in TOOLS.items():
        own = {a: schema for a, (schema, tools) in ARGUMENTS.items() if name in tools}
        out.append({"name": name, "description": f"What `evigraph {command}` says of a graph bundle", "inputSchema": {"type": "object", "properties": own, "required": [a for a in own if a not in OPTIONAL]}})
    return out


def call_tool(spark: SparkSession, name: str, arguments: dict[str, Any]) -> dict[str, Any]:
    if name not in TOOLS:
        raise ValueError(f"unknown tool: {name}")
    argv = [TOOLS[name], str(arguments["graph_bundle"])]
    if name == "graph_neighborhood":
        argv += [str(arguments["node_id"]), "--hops", str(int(arguments.get("hops", 1)))]
    if name in ("epistemic_report", "bayesian_assessment") and arguments.get("node_types"):
        argv += ["--node-types", ",".join(map(str, arguments["node_types"]))]
    out, _ = cli.run(argv, spark)
    return {"content": [{"type": "text", "text": json.dumps(out, sort_keys=True, default=str)}]}


class Refused(Exception):
    """An answer that is an error: its code and what it says."""

    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def _initialize(spark: SparkSession, params: dict[str, Any]) -> dict[str, Any]:
    return {"protocolVersion": PROTOCOL, "serverInfo": SERVER, "capabilities": {"tools": {"listChanged": False}}}


def _list(spark: SparkSession, params: dict[str, Any]) -> dict[str, Any]:
    return {"tools": list_tools()}


def _call(spark: SparkSession, params: dict[str, Any]) -> dict[str, Any]:
    try:
        return call_tool(spark, str(params.get("name", "")), params.get("arguments") or {})
    except (LookupError, TypeError, ValueError, OSError, SystemExit, PySparkException) as e:  # of the arguments: the caller's to mend
        raise Refused(-32602, str(e)) from e


METHODS = {"initialize": _initialize, "tools/list": _list, "tools/call": _call}


def handle(spark: SparkSession, request: dict[str, Any]) -> dict[str, Any] | None:
    """The response to a request; None to a notification."""
    if request.get("id") is None:
        return None
    method = METHODS.get(request.get("method", ""))
    try:
        if method is None:
            raise Refused(-32601, f"unknown method: {request.get('method')}")
        answer = {"result": method(spark, request.get("params") or {})}
    except Refused as no:
        answer = {"error": {"code": no.code, "message": str(no)}}
    return {"jsonrpc": "2.0", "id": request["id"], **answer}


def serve(spark: SparkSession, lines: TextIO = sys.stdin, out: TextIO = sys.stdout) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            response = handle(spark, json.loads(line))
        except json.JSONDecodeError as e:
            response = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        if response is not None:
            out.write(json.dumps(response) + "\n")
            out.flush()


if __name__ == "__main__":
    serve(SparkSession.builder.getOrCreate())
