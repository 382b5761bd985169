"""Ids, slugs and escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(value: Column, missing: str = "untitled") -> Column:
    """Lower case, runs of other characters as one hyphen, none at the ends; missing if nothing is left."""
    made = F.trim(F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(made == "", F.lit(missing)).otherwise(made)


def typed_id(kind: str, value: Column) -> Column:
    """kind::value, unless value begins so already."""
    value = F.trim(value)
    return F.when(F.startswith(value, F.lit(f"{kind}::")), value).otherwise(F.concat(F.lit(f"{kind}::"), value))


def node_id(kind: str, *parts: Column) -> Column:
    """kind::slug::slug of the parts that are not blank; kind::untitled if all are."""
    slugs = [F.when(F.trim(p) != "", slug(p)) for p in parts]
    joined = F.concat_ws("::", *slugs)
    return typed_id(kind, F.when(joined == "", F.lit("untitled")).otherwise(joined))


def compound_edge_id(source: Column, kind: Column, target: Column, arrow: str = "->") -> Column:
    return F.concat(source, F.lit(arrow), kind, F.lit(arrow), target)


def edge_key(source: Column, kind: Column, target: Column, own: Column) -> Column:
    """The edge's own id, or source->type->target where it has none."""
    return F.when(F.coalesce(own, F.lit("")) != "", own).otherwise(compound_edge_id(source, kind, target))


def dot_escape(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
