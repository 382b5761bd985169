"""Canonical JSON (sorted keys, no spaces, ASCII) and its SHA-256."""

from __future__ import annotations

import hashlib
import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def canonical_hash(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def hash_of_json(column: Column) -> Column:
    """Canonical hash of JSON texts, a vectorised UDF: to_json neither sorts keys nor escapes as wanted."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else canonical_hash(json.loads(t)))

    return run(column)


def _ascii_char(ch: Column, quoting: bool) -> Column:
    """A character as JSON in ASCII writes it; quoting: quotes, backslashes and line ends are escaped too."""
    code = F.ascii(ch)
    hexed = lambda x: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(x), 4, "0")))
    high, low = F.lit(0xD800) + F.shiftright(code - 0x10000, 10), F.lit(0xDC00) + (code - 0x10000).bitwiseAND(0x3FF)
    out = F.when(ch == "", "")
    if quoting:
        for plain, shown in (('"', '\\"'), ("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
            out = out.when(ch == plain, shown)
    return out.when(code.between(32, 126), ch).when(code < 0x10000, hexed(code)).otherwise(F.concat(hexed(high), hexed(low)))


def json_string(value: Column) -> Column:
    """A text as a JSON string in ASCII, surrogate pairs for what lies beyond 16 bits; null as null. Plain texts are only quoted."""
    special = F.array_join(F.transform(F.split(value, ""), lambda ch: _ascii_char(ch, True)), "")
    return F.when(value.isNull(), "null").otherwise(F.concat(F.lit('"'), F.when(value.rlike(r'[^ -~]|["\\\\]'), special).otherwise(value), F.lit('"')))


def json_number(value: Column) -> Column:
    """A double in its shortest decimal form: plain from 1e-4 to below 1e16, else with a signed exponent of two digits at least; null as null."""
    text = value.cast("string")
    part = lambda i: F.regexp_extract(text, r"^-?([0-9]+)\.([0-9]+)(?:E(-?[0-9]+))?$", i)
    sign, rest = F.when(F.startswith(text, F.lit("-")), "-").otherwise(""), F.when(part(2) == "0", "").otherwise(part(2))
    digits, power = F.concat(part(1), rest), F.nullif(part(3), F.lit("")).cast("int")
    padded = F.rpad(digits, F.greatest(power + 1, F.length(digits)), F.lit("0"))
    whole = F.concat(F.substring(padded, F.lit(1), power + 1), F.lit("."), F.when(F.length(padded) > power + 1, F.substring(padded, power + 2, F.length(padded))).otherwise("0"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    scientific = F.concat(part(1), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    # lpad would cut a longer exponent
    scientific = F.when(F.abs(power) > 99, F.regexp_replace(scientific, r"[0-9]+$", "")).otherwise(scientific)
    scientific = F.when(F.abs(power) > 99, F.concat(scientific, F.abs(power).cast("string"))).otherwise(scientific)
    return F.when(value.isNull(), "null").when(power.isNull(), text).otherwise(F.concat(sign, F.when(power.between(0, 15), whole).when(power.between(-4, -1), small).otherwise(scientific)))


def json_open(text: Column) -> Column:
    """The JSON object in a text with keys in order and in ASCII; {} if there is none. Whole numbers lose a fraction of .0, as JSON values do in Spark."""
    sorted_ = F.to_json(F.try_parse_json(text))
    shown = F.when(sorted_.rlike("[^ -~]"), F.array_join(F.transform(F.split(sorted_, ""), lambda ch: _ascii_char(ch, False)), "")).otherwise(sorted_)
    return F.coalesce(shown, F.lit("{}"))


def json_column(value: Column, kind: T.DataType, raw: tuple[str, ...] = ()) -> Column:
    """Canonical JSON of a typed value in column expressions: keys in order, no spaces, ASCII, nulls kept. Fields named in raw hold JSON objects as text."""
    if isinstance(kind, T.StructType):
        parts = []
        for i, name in enumerate(sorted(kind.names)):
            inner = json_open(value[name]) if name in raw else json_column(value[name], kind[name].dataType, raw)
            parts += [F.lit(("," if i else "") + json.dumps(name) + ":"), inner]
        return F.when(value.isNull(), "null").otherwise(F.concat(F.lit("{"), *parts, F.lit("}")))
    if isinstance(kind, T.ArrayType):
        return F.when(value.isNull(), "null").otherwise(F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: json_column(x, kind.elementType, raw)), ","), F.lit("]")))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return json_number(value)
    return json_string(value) if isinstance(kind, T.StringType) else F.coalesce(value.cast("string"), F.lit("null"))


def _hash_of(**texts: Column) -> Column:
    """canonical_hash of an object of texts."""
    parts = [x for i, name in enumerate(sorted(texts)) for x in (F.lit(("," if i else "{") + json.dumps(name) + ":"), json_string(texts[name]))]
    return F.sha2(F.concat(*parts, F.lit("}")), 256)


def pair_hash(artifact: Column, fragment: Column) -> Column:
    """canonical_hash of {"artifact_id": ..., "fragment_id": ...}, without leaving the JVM."""
    return _hash_of(artifact_id=artifact, fragment_id=fragment)


def ends_hash(source: Column, target: Column, kind: Column) -> Column:
    """canonical_hash of {"source": ..., "target": ..., "type": ...}, without leaving the JVM."""
    return _hash_of(source=source, target=target, type=kind)
