"""Nested rows as JSON documents: camel case out, any case in, unknown fields kept apart."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def camel(name: str) -> str:
    """``key_columns`` as ``keyColumns``."""
    return re.sub(r"_+([A-Za-z0-9])", lambda m: m[1].upper(), name)


def renamed(kind: T.DataType) -> T.DataType:
    """The type with camel-case names at every level."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(camel(f.name), renamed(f.dataType)) for f in kind.fields])
    return T.ArrayType(renamed(kind.elementType)) if isinstance(kind, T.ArrayType) else kind


def to_document(row: Column, kind: T.StructType) -> Column:
    """A struct as a JSON document; null fields are written."""
    return F.to_json(row.cast(renamed(kind)), {"ignoreNullFields": "false"})


def fields_of(text: Column) -> Column:
    """A JSON object's fields by folded name (without case and underscores); of several that are one when folded the last counts."""
    entries = F.map_entries(F.from_json(text, "map<string,string>"))
    return F.transform(entries, lambda e: F.struct(F.replace(F.lower(e["key"]), F.lit("_"), F.lit("")).alias("name"), e["key"].alias("key"), e["value"].alias("value")))


def field(fields: Column, name: str) -> Column:
    folded = name.replace("_", "").lower()
    return F.try_element_at(F.filter(fields, lambda e: e["name"] == folded), F.lit(-1))["value"]


def from_document(text: Column, kind: T.DataType) -> Column:
    """A JSON document in the types of ``kind``: objects, lists and values at every level; what is missing or unreadable is null."""
    if isinstance(kind, T.StructType):
        # as a list of one, so that the object is taken apart once for all its fields
        whole = F.transform(F.array(fields_of(text)), lambda x: F.when(x.isNotNull(), F.struct(*[from_document(field(x, f.name), f.dataType).alias(f.name) for f in kind.fields])))
        return F.get(whole, F.lit(0))
    if isinstance(kind, T.ArrayType):
        return F.transform(F.from_json(text, "array<string>"), lambda x: from_document(x, kind.elementType))
    return text if isinstance(kind, T.StringType) else text.try_cast(kind)


def unknown_fields(text: Column, kind: T.StructType) -> Column:
    """The document's fields that ``kind`` does not name, as they stand, in order of their names."""
    known = [f.name.replace("_", "").lower() for f in kind.fields]
    rest = F.filter(fields_of(text), lambda e: ~e["name"].isin(*known))
    return F.map_from_entries(F.array_sort(F.transform(rest, lambda e: F.struct(e["key"], e["value"]))))
