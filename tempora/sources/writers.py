"""Writers: CSV in a fixed column order, wide features, checksummed folders, idempotent event logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.functions.scalars import csv_value


def csv_lines(rows: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One `line` for each row; lists are joined by semicolons, structs and maps are JSON."""
    out = []
    for c in columns:
        kind = rows.schema[c].dataType.simpleString()
        out.append(csv_value(F.array_join(F.col(c).cast("array<string>"), ";") if kind.startswith("array<string") else F.to_json(c) if kind.startswith(("array", "struct", "map")) else F.col(c)))
    return rows.select(*order, F.concat_ws(",", *out).alias("line"))


def wide(long: DataFrame, keys: Sequence[str], features: Sequence[str], feature: str = "feature", value: str = "value") -> DataFrame:
    """One column for each feature in the given order, null where a key lacks it."""
    return long.groupBy(*keys).agg(*[F.max(F.when(F.col(feature) == f, F.col(value))).alias(f) for f in features])


def signed(rows: DataFrame, path: str) -> DataFrame:
    """Writes JSON lines and returns (name, sha256) of the files written."""
    rows.write.mode("overwrite").json(path)
    files = rows.sparkSession.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def new_events(log: DataFrame | None, batch: DataFrame, key: str = "event_id", content: str = "content_hash") -> tuple[DataFrame, DataFrame]:
    """(to append, conflicts): events the log lacks, each once, and known ids that come with another content.

    Taking the same batch twice appends nothing; a batch in which an id has two contents conflicts with itself.
    """
    one = batch.groupBy(key).agg(F.countDistinct(content).alias("_contents"))
    clash = batch.join(one.where("_contents > 1").select(key), key, "left_semi")
    fresh = batch.join(one.where("_contents = 1").select(key), key, "left_semi").dropDuplicates([key])
    if log is not None:
        known = log.select(key, F.col(content).alias("_known"))
        clash = clash.unionByName(fresh.join(known, key).where(F.col("_known") != F.col(content)).drop("_known"))
        fresh = fresh.join(known.select(key), key, "left_anti")
    return fresh, clash


def append_events(batch: DataFrame, path: str, key: str = "event_id", content: str = "content_hash") -> int:
    """Appends what is new to a Parquet log and returns how much that is; conflicts raise and nothing is written."""
    spark = batch.sparkSession
    try:
        log = spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        log = None
    fresh, clash = new_events(log, batch, key, content)
    if clash.limit(1).count():
        raise ValueError(f"{key} comes with another content than before")
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n
