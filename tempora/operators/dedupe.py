"""Content hashes: duplicates, conflicts, and hashed orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.scalars import fnv1a


def content_hash(*columns: str) -> Column:
    """SHA-256 of the columns as JSON, fields by name."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def by_content(rows: DataFrame, content: str, ordinal: str) -> DataFrame:
    """(content_hash, first ordinal, copies) for each different content."""
    return rows.groupBy(F.sha2(F.col(content), 256).alias("content_hash")).agg(F.min(ordinal).alias("kept"), F.count("*").alias("copies"))


def conflicts(rows: DataFrame, key: str, content: Column, ordinal: str, source: str) -> DataFrame:
    """For each key: the first source by ordinal, all sources, how many different contents, and whether they conflict."""
    named = rows.withColumn("_hash", content)
    return named.groupBy(key).agg(F.min_by(source, ordinal).alias("first_source"), F.array_sort(F.collect_set(source)).alias("sources"), F.countDistinct("_hash").alias("contents")).withColumn("conflict", F.col("contents") > 1)


def hashed_order(rows: DataFrame, keys: Sequence[str], salt: str, key: str) -> DataFrame:
    """A queue position in each key by the FNV-1a hash of salt and id, then id: random-like, yet the same each time."""
    hashed = rows.withColumn("queue_hash", fnv1a(F.concat(F.lit(f"{salt}:"), F.col(key).cast("string"))))
    return hashed.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("queue_hash", key)))
