"""Export records: segments with the evidence of three tables nested in them, and their flat form by a schema of columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_evidence(segments: DataFrame, evidence: Mapping[str, tuple[DataFrame, Sequence[str]]], key: str) -> DataFrame:
    """segments with a struct column for each table of evidence (table, columns that order its rows): of rows that repeat a key
    the last one, null where a segment has none. Each table is reduced to a row for each key before it is joined."""
    out = segments
    for name, (table, order) in evidence.items():
        rest = F.struct(*[c for c in table.columns if c != key and c not in order])
        last = table.groupBy(key).agg(F.max_by(rest, F.struct(*order)).alias(name))
        out = out.join(last, key, "left")
    return out


def flat_columns(schema: T.StructType, path: str = "") -> dict[str, T.DataType]:
    """The leaves of nested structs by their paths, a__b__c; arrays and maps are leaves."""
    out: dict[str, T.DataType] = {}
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            out |= flat_columns(f.dataType, f"{path}{f.name}__")
        else:
            out[path + f.name] = f.dataType
    return out


def _leaf(path: str) -> Column:
    first, *rest = path.split("__")
    c = F.col(f"`{first}`")
    for name in rest:
        c = c.getField(name)
    return c


def flattened(records: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One text column for each leaf, in the schema's order or that of `columns`: lists of plain values joined by semicolons, with
    backslashes before semicolons and backslashes, other lists and maps as JSON, true and false, null as null. A path that
    the schema lacks is a column of nulls."""
    leaves = flat_columns(records.schema)

    def text(path: str) -> Column:
        kind = leaves.get(path)
        if kind is None:
            return F.lit(None).cast("string")
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.AtomicType):
            return F.array_join(F.transform(_leaf(path), lambda x: F.regexp_replace(x.cast("string"), r"([\\;])", r"\\$1")), ";", "\\0")
        return F.to_json(_leaf(path)) if isinstance(kind, (T.ArrayType, T.MapType)) else _leaf(path).cast("string")

    return records.select(*[text(p).alias(p) for p in columns or leaves])


def nested(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """What flattened() made, back in the records' form. A struct is null where all its leaves are; an empty list comes back as
    a list of no text, as does a list of one empty text."""

    def build(kind: T.DataType, path: str) -> Column:
        if isinstance(kind, T.StructType):
            inner = F.struct(*[build(f.dataType, f"{path}__{f.name}").alias(f.name) for f in kind.fields])
            leaves = [F.col(f"`{path}__{leaf}`") for leaf in flat_columns(kind)]
            return F.when(F.coalesce(*leaves).isNotNull(), inner)
        c = F.col(f"`{path}`")
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.AtomicType):
            parts = F.regexp_extract_all(F.concat(F.lit(";"), c), F.lit(r";((?:[^;\\]|\\.)*)"), F.lit(1))
            plain = F.transform(parts, lambda x: F.when(x != "\\0", F.regexp_replace(x, r"\\([\\;])", "$1")).cast(kind.elementType))
            return F.when(c == "", F.array().cast(kind)).when(c.isNotNull(), plain)
        return F.from_json(c, kind.simpleString()) if isinstance(kind, (T.ArrayType, T.MapType)) else c.cast(kind)

    return rows.select(*[build(f.dataType, f.name).alias(f.name) for f in schema.fields])
