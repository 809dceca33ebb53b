"""Data-quality rules as tables of violations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OUT = ("rule", "key", "n")


def _violations(rows: DataFrame, rule: str, key: Column, n: Column | None = None) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), (n if n is not None else F.lit(1)).cast("long").alias("n"))


def unique(rows: DataFrame, key: str, rule: str) -> DataFrame:
    repeated = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    return _violations(repeated, rule, F.col(key), F.col("_n"))


def refers(rows: DataFrame, key: str, to: DataFrame, to_key: str, rule: str) -> DataFrame:
    """Values of key without a row in `to`, and how many rows have them."""
    orphans = rows.where(F.col(key).isNotNull()).join(to.select(F.col(to_key).alias(key)), key, "left_anti")
    return _violations(orphans.groupBy(key).agg(F.count("*").alias("_n")), rule, F.col(key), F.col("_n"))


def holds(rows: DataFrame, key: str, test: Column, rule: str) -> DataFrame:
    """Rows for which the test is false; where it is null it holds."""
    broken = rows.where(~F.coalesce(test, F.lit(True)))
    return _violations(broken.groupBy(key).agg(F.count("*").alias("_n")), rule, F.col(key), F.col("_n"))


def count_is(rows: DataFrame, by: str, expected: dict[str, int], rule: str) -> DataFrame:
    """Groups whose number of rows isn't what is expected; n is the number there is."""
    spark = rows.sparkSession
    table = spark.createDataFrame(list(expected.items()), f"{by} string, expected long")
    counts = rows.groupBy(F.col(by).cast("string").alias(by)).agg(F.count("*").alias("_n"))
    drift = counts.join(table, by, "full").where(~F.col("_n").eqNullSafe(F.col("expected")))
    return _violations(drift, rule, F.col(by), F.coalesce("_n", F.lit(0)))


def union(violations: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, violations).select(*_OUT)


def prohibited_fields(df: DataFrame, pattern: str) -> list[str]:
    """Paths of all fields, nested ones too, whose name matches: what would leak labels."""
    import re

    from pyspark.sql import types as T

    def walk(kind, path: str) -> list[str]:
        if isinstance(kind, T.StructType):
            return [p for f in kind.fields for p in [*([f"{path}{f.name}"] if re.search(pattern, f.name, re.I) else []), *walk(f.dataType, f"{path}{f.name}.")]]
        if isinstance(kind, T.ArrayType):
            return walk(kind.elementType, path)
        if isinstance(kind, T.MapType):
            return walk(kind.valueType, path)
        return []

    return walk(df.schema, "")
