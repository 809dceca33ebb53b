"""Canonical entries from repeated exports: one entry for each id, its files resolved among many, its segments as rows with lasting ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a path is worth that holds one of the action's markers, and what any path is worth for others.
MARKED, ELSEWHERE = 100, (("/sample videos/", 20),)


def short_hash(*parts: Column, size: int = 12) -> Column:
    """The first digits of the SHA-256 of parts joined by bars; nulls are empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"), 256), 1, size)


def ranked_files(files: DataFrame, path: str, markers: Mapping[str, Sequence[str]], others: Sequence[tuple[str, int]] = ELSEWHERE) -> DataFrame:
    """(name, action, score, path, alike, candidates): for each file name, in lower case, and each action with markers (null:
    any other) the best score of its paths, the first of those that have it, how many have it, and how many there are.

    A name that stands in every folder is one row for each action here, whatever refers to it: references are joined to
    these rows, and not to paths.
    """
    low = F.lower(F.translate(F.col(path), "\\", "/"))
    name = F.element_at(F.split(low, "/"), -1)
    extra = sum((F.when(F.contains(low, F.lit(m)), points).otherwise(0) for m, points in others), F.lit(0))
    of = lambda marks: F.greatest(F.lit(False), F.lit(False), *[F.contains(low, F.lit(m)) for m in marks])
    scores = F.array(F.struct(F.lit(None).cast("string").alias("action"), extra.alias("score")), *[F.struct(F.lit(a).alias("action"), (extra + F.when(of(marks), MARKED).otherwise(0)).alias("score")) for a, marks in markers.items()])
    rows = files.select(name.alias("name"), F.col(path).alias("path"), F.inline(scores))
    per = rows.groupBy("name", "action", "score").agg(F.min("path").alias("path"), F.count("*").alias("alike"))
    best = per.groupBy("name", "action").agg(F.max(F.struct("score", "path", "alike")).alias("_"), F.sum("alike").alias("candidates"))
    return best.select("name", "action", "_.*", "candidates")


def resolved(references: DataFrame, ranked: DataFrame, name: str, action: str, actions: Sequence[str], prefix: str = "asset") -> DataFrame:
    """references with prefix_status, prefix_path and prefix_candidates: not_referenced without a name, missing if no file of
    that name scores anything, ambiguous if several score best (the first of them is given), else found."""
    key = F.when(F.col(action).isin(list(actions)), F.col(action))
    asked = references.withColumn("_name", F.nullif(F.lower(F.col(name)), F.lit(""))).withColumn("_action", F.coalesce(key, F.lit("")))
    known = ranked.select(F.col("name").alias("_name"), F.coalesce("action", F.lit("")).alias("_action"), "score", "path", "alike", "candidates")
    both = asked.join(known, ["_name", "_action"], "left")
    none = F.coalesce(F.col("score"), F.lit(0)) == 0
    status = F.when(F.col("_name").isNull(), "not_referenced").when(none, "missing").when(F.col("alike") > 1, "ambiguous").otherwise("found")
    return both.select(*references.columns, status.alias(f"{prefix}_status"), F.when(~none, F.col("path")).alias(f"{prefix}_path"), F.when(none, F.coalesce("candidates", F.lit(0))).otherwise(F.col("alike")).alias(f"{prefix}_candidates"))


def deduplicated(occurrences: DataFrame, entry: str, content: str, source: str, order: Sequence[str]) -> DataFrame:
    """One row for each entry, its first occurrence by `order`, with occurrences, source_files (sorted, each once) and conflict:
    whether contents differ. An occurrence without an id is an error, raised by the task that meets it."""
    checked = occurrences.withColumn(entry, F.coalesce(F.col(entry), F.raise_error(F.concat(F.lit("an entry has no id in "), F.coalesce(F.col(source), F.lit("?")))).cast(occurrences.schema[entry].dataType)))
    rest = [c for c in occurrences.columns if c not in (entry, content, source)]
    kept = F.min_by(F.struct(content, *rest), F.struct(*order))
    found = checked.groupBy(entry).agg(kept.alias("_"), F.count("*").alias("occurrences"), F.array_sort(F.collect_set(source)).alias("source_files"), (F.min(content) != F.max(content)).alias("conflict"))
    return found.select(entry, "_.*", "occurrences", "source_files", "conflict")


def repetitions(entries: DataFrame, entry: str, segments: str, keep: Sequence[str] = ()) -> DataFrame:
    """(ingest_id, repetition_id, repetition, segment fields): the entries' segments (segment_id, start, end, ...) as rows; ids come
    from the entry, the segment, its place and its range, so that they last as long as those do."""
    rows = entries.select(*keep, F.concat(F.lit("ing_"), short_hash(F.col(entry))).alias("ingest_id"), F.posexplode(segments).alias("_at", "_s"))
    s = F.col("_s")
    name = F.concat(F.lit("rep_"), short_hash(F.col("ingest_id"), s["segment_id"], F.col("_at"), s["start"], s["end"]))
    return rows.select(*keep, "ingest_id", name.alias("repetition_id"), (F.col("_at") + 1).alias("repetition"), "_s.*")
