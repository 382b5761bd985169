"""Typed access to a row's open metadata.

metadata may be a typed struct (fast, nothing is parsed), a VARIANT or a JSON string. What counts as a string,
a list, a boolean or a number follows the JSON type, never a coercion: "true" is not true.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def let(value: Column, use) -> Column:
    """use(value) with value evaluated, and planned, once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_field(text: Column, key: str, value: str | float) -> Column:
    """A JSON object (text) with key set to value, all else as it is; a text that holds no object becomes one. Whole numbers lose a fraction of .0."""
    fields = F.coalesce(F.from_json(text, "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    own = F.create_map(F.lit(key), F.parse_json(F.lit(json.dumps(value))))
    return F.to_json(F.map_concat(F.map_filter(fields, lambda k, _: k != key), own))


class Meta:
    """Columns over one metadata field, which may be nested (such as an element of provenance)."""

    def __init__(self, kind: T.DataType | None, column: Column):
        self.kind = kind
        self.column = F.try_parse_json(column) if isinstance(kind, T.StringType) else column

    @classmethod
    def of(cls, df: DataFrame, name: str = "metadata") -> Meta:
        return cls(df.schema[name].dataType if name in df.columns else None, F.col(name) if name in df.columns else F.lit(None))

    def _typed(self, key: str) -> T.DataType | None:
        return self.kind[key].dataType if isinstance(self.kind, T.StructType) and key in self.kind.names else None

    @property
    def _open(self) -> bool:
        return isinstance(self.kind, (T.StringType, T.VariantType))

    def _variant(self, key: str) -> Column:
        return F.try_variant_get(self.column, f"$.{key}", "variant")

    def _shape(self, key: str) -> Column:
        return F.schema_of_variant(self._variant(key))

    def text(self, key: str) -> Column:
        """The value if it is a string, else null."""
        if self._open:
            return F.when(self._shape(key) == "STRING", F.try_variant_get(self.column, f"$.{key}", "string"))
        return self.column[key] if isinstance(self._typed(key), T.StringType) else F.lit(None).cast("string")

    def shown(self, key: str) -> Column:
        """The value as text, whatever it is; null if it is absent."""
        if self._open:
            return F.coalesce(self.text(key), F.to_json(self._variant(key)))
        return self.column[key].cast("string") if self._typed(key) is not None else F.lit(None).cast("string")

    def is_true(self, key: str) -> Column:
        if self._open:
            return F.coalesce((self._shape(key) == "BOOLEAN") & F.try_variant_get(self.column, f"$.{key}", "boolean"), F.lit(False))
        return F.coalesce(self.column[key], F.lit(False)) if isinstance(self._typed(key), T.BooleanType) else F.lit(False)

    def present(self, key: str) -> Column:
        """Neither absent nor null, empty text, an empty list or an empty object."""
        if self._open:
            return F.coalesce(~F.to_json(self._variant(key)).isin("null", '""', "[]", "{}"), F.lit(False))
        kind = self._typed(key)
        if kind is None:
            return F.lit(False)
        value = self.column[key]
        if isinstance(kind, T.StringType):
            return F.coalesce(value != "", F.lit(False))
        return F.coalesce(F.size(value) > 0, F.lit(False)) if isinstance(kind, (T.ArrayType, T.MapType)) else value.isNotNull()

    def has(self, key: str) -> Column:
        if self._open:
            return self._variant(key).isNotNull()
        return F.lit(self._typed(key) is not None)

    def may_hold(self, keys: Iterable[str]) -> bool:
        """Whether any row can have one of the keys: always in open metadata."""
        return self._open or any(self._typed(k) is not None for k in keys)

    def words(self, keys: Iterable[str]) -> Column:
        """All texts under keys, a string or a list each, lower case and trimmed, blanks left out; other types are ignored."""
        none = F.array().cast("array<string>")

        def listed(v: Column) -> Column:
            kind, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
            return F.when(kind == "STRING", F.array(text)).when(F.startswith(kind, F.lit("ARRAY")), F.coalesce(F.try_variant_get(v, "$", "array<string>"), none)).otherwise(none)

        if self._open:
            found = [let(self.column, lambda m: F.concat(*[let(F.try_variant_get(m, f"$.{k}", "variant"), lambda v: F.coalesce(listed(v), none)) for k in keys]))]
            found = [F.coalesce(found[0], none)]
        else:
            found = []
            for key in keys:
                if isinstance(kind := self._typed(key), T.StringType):
                    found.append(F.array(self.column[key]))
                elif isinstance(kind, T.ArrayType):
                    found.append(F.coalesce(self.column[key].cast("array<string>"), none))
        if not found:
            return none
        return F.filter(F.transform(F.concat(*found), lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != ""))

    def times(self, keys: Iterable[str]) -> Column:
        """array<struct<event, t>> of the keys that hold a time, in their order; t is struct<kind, val, shown>."""
        from evigraph.functions import timekey

        keys = tuple(keys)
        kind = f"array<struct<event:string,t:{timekey.TIME}>>"
        if not self._open:
            here = [F.struct(F.lit(k).alias("event"), self.time(k).cast(timekey.TIME).alias("t")) for k in keys if self._typed(k) is not None]
            every = F.array(*here) if here else F.array().cast(kind)
        else:

            def one(m: Column, key: str) -> Column:
                return let(
                    F.try_variant_get(m, f"$.{key}", "variant"),
                    lambda v: F.struct(
                        F.lit(key).alias("event"),
                        F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).alias("text"),
                        F.when(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.try_variant_get(v, "$", "double")).alias("number"),
                        F.try_variant_get(v, "$", "string").alias("shown"),
                    ),
                )

            def key_of(x: Column) -> Column:
                found = F.coalesce(timekey.of_number(x["number"]), timekey.of_text(x["text"]))
                return let(found, lambda k: F.when(k.isNotNull(), F.struct(k["kind"].alias("kind"), k["val"].alias("val"), x["shown"].alias("shown"))))

            raw = let(self.column, lambda m: F.array(*[one(m, k) for k in keys]))
            every = F.coalesce(F.transform(raw, lambda x: F.struct(x["event"].alias("event"), key_of(x).alias("t"))), F.array().cast(kind))
        return F.filter(every, lambda x: x["t"].isNotNull())

    def time(self, key: str) -> Column:
        """struct<kind, val, shown> of a time value, null if absent or not a time."""
        from evigraph.functions import timekey

        if self._open:
            return F.get(self.times((key,)), F.lit(0))["t"]
        kind = self._typed(key)
        if kind is None:
            return F.lit(None).cast(timekey.TIME)
        value = self.column[key]
        if isinstance(kind, T.StringType):
            key_ = timekey.of_text(value)
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            key_ = timekey.of_timestamp(value)
        else:
            key_ = timekey.of_number(value)
        return F.when(key_.isNotNull(), F.struct(key_["kind"].alias("kind"), key_["val"].alias("val"), value.cast("string").alias("shown")))

    def first_time(self, keys: Iterable[str]) -> Column:
        """The time under the first of keys that holds one; a value that is no time is passed over, so that one bad row fails no job."""
        return F.get(self.times(keys), F.lit(0))["t"]
