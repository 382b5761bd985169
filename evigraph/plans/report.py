"""Small results as Markdown and JSON."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame


def cell(value: Any) -> str:
    if value is None:
        return "n/a"
    if isinstance(value, float):
        return f"{value:.4g}"
    if isinstance(value, (list, tuple)):
        return ", ".join(map(str, value)) or "none"
    return str(value).replace("|", "\\|").replace("\n", " ")


def table(df: DataFrame, limit: int | None = None) -> str:
    """A Markdown table of df in its order; with a limit, of so many rows, and a line that says so where there are more."""
    rows = (df if limit is None else df.limit(limit + 1)).toLocalIterator()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    for n, r in enumerate(rows):
        if n == limit:
            return "\n".join([*lines, "", f"The first {limit} rows; there are more."])
        lines.append("| " + " | ".join(cell(v) for v in r) + " |")
    return "\n".join(lines)


def document(title: str, parts: dict[str, DataFrame | str]) -> str:
    out = [f"# {title}", "", "For review triage; these are not verdicts."]
    for name, part in parts.items():
        out += ["", f"## {name}", "", part if isinstance(part, str) else table(part)]
    return "\n".join(out) + "\n"


def write(path: str | Path, content: str | dict) -> None:
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(content if isinstance(content, str) else json.dumps(content, indent=2, sort_keys=True, default=str) + "\n", encoding="utf-8")
