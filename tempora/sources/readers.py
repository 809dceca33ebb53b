"""Readers of JSON histories, CSV manifests and checksum lists; what is malformed becomes issue rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_files(spark: SparkSession, path: str, schema: T.StructType, required: str) -> tuple[DataFrame, DataFrame]:
    """(documents, issues) of a folder of JSON files, one document each: unreadable ones and those without `required` are issues."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    parsed = files.withColumn("doc", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    bad = F.expr("try_parse_json(value)").isNull()
    issue = F.when(bad, "unreadable").when(F.col(f"doc.{required}").isNull(), f"missing_{required}")
    marked = parsed.withColumn("issue", issue)
    return marked.where("issue IS NULL").select("file", "doc.*"), marked.where("issue IS NOT NULL").select("file", "issue")


def manifest(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with a header, # comments, quoted fields with doubled quotes, and trimmed values; all columns are strings."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, schema=schema, header=True, comment="#", quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=False)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256) of lines like sha256sum writes them."""
    lines = spark.read.text(path)
    return lines.select(F.regexp_extract("value", r"^[0-9a-f]{64}\s+\*?(.+)$", 1).alias("name"), F.regexp_extract("value", r"^([0-9a-f]{64})\s", 1).alias("sha256")).where("name <> ''")


def verified(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """(name, sha256, status) of the files in a folder against a checksum list: ok, changed, unlisted or missing."""
    there = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("found") == F.col("sha256"), "ok").otherwise("changed")
    return there.join(expected, "name", "full").select("name", F.coalesce("found", "sha256").alias("sha256"), status.alias("status"))


def sampled_frames(frames: DataFrame, keys: list[str], number: str, rate: str, target: float) -> DataFrame:
    """Every n-th frame, n = the frame rate over the target, rounded, one at least."""
    step = F.greatest(F.lit(1), F.floor(F.col(rate) / target + 0.5)).cast("long")
    return frames.where(F.col(number) % step == 0)
