"""Joins: must-match, as-of, interval, overlap, set comparison, registry merge, row differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.scalars import overlap_ratio


def must_match(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which a left row without a partner is an error, raised by the task that meets it."""
    marked = left.join(right.withColumn("_met", F.lit(True)), list(keys), "left")
    said = F.concat(F.lit("no partner for "), F.to_json(F.struct(*keys)))
    return marked.where(F.coalesce(F.col("_met"), F.raise_error(said).cast("boolean"))).drop("_met")


def nearest_in_time(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, right_id: str) -> DataFrame:
    """left with the right row of the same key whose time is nearest, either way; ties go to the earlier one.

    Both sides are put in one time order, and each left row looks back and ahead: one shuffle and a sort for either
    direction, where a join would make every pair of a key. Left rows of a key without right rows keep nulls.
    """
    a = left.withColumn("_t", F.col(left_time)).withColumn("_side", F.lit(1)).withColumn("_hit", F.lit(None).cast(f"struct<t:{right.schema[right_time].dataType.simpleString()},id:{right.schema[right_id].dataType.simpleString()}>"))
    b = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(right_time).alias("t"), F.col(right_id).alias("id")).alias("_hit"))
    both = a.unionByName(b, allowMissingColumns=True)
    ordered = Window.partitionBy(*keys).orderBy("_t", "_side", F.col("_hit.id").desc())
    before = F.last("_hit", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    # ahead of a left row: the least id of the next time, in falling order
    falling = Window.partitionBy(*keys).orderBy(F.desc("_t"), "_side", F.col("_hit.id").desc())
    after = F.last("_hit", ignorenulls=True).over(falling.rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_before", before).withColumn("_after", after).where("_side = 1")
    gap = lambda c: F.abs(F.col(left_time).cast("double") - F.col(c)["t"].cast("double"))
    nearest = F.when(F.col("_after").isNull() | (gap("_before") <= gap("_after")), F.col("_before")).otherwise(F.col("_after"))
    return found.withColumn("_near", nearest).select(*left.columns, F.col("_near.t").alias("nearest_time"), F.col("_near.id").alias("nearest_id"))


def interval_join(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str, bucket: float) -> DataFrame:
    """Pairs of a point and a span of the same key with start <= at <= end.

    Times are seconds. Spans are dealt to each bucket of time that they touch, so the join is on equal keys and
    buckets, and its size is that of the result and of the buckets' ends. `bucket` should be near the usual span.
    """
    cell = lambda t: F.floor(t / F.lit(bucket))
    dealt = spans.withColumn("_cell", F.explode(F.sequence(cell(F.col(start)), cell(F.col(end)))))
    return points.withColumn("_cell", cell(F.col(at))).join(dealt, [*keys, "_cell"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_cell")


def overlaps(left: DataFrame, right: DataFrame, keys: Sequence[str], bucket: float, least: float = 0.0, of_shorter: bool = False) -> DataFrame:
    """Pairs of intervals (start, end on the left; r_start, r_end on the right) of the same key, with their overlap ratio over `least`.

    Times are seconds. Both are dealt to each bucket of time that they touch, and a pair is made in the first bucket
    that it shares. `bucket` should be near the usual interval.
    """
    cell = lambda t: F.floor(t / F.lit(bucket))
    dealt = lambda rows, a, b: rows.withColumn("_cell", F.explode(F.sequence(cell(F.col(a)), cell(F.col(b)))))
    pairs = dealt(left, "start", "end").join(dealt(right, "r_start", "r_end"), [*keys, "_cell"])
    pairs = pairs.where((F.col("start") <= F.col("r_end")) & (F.col("r_start") <= F.col("end")) & (F.col("_cell") == cell(F.greatest("start", "r_start")))).drop("_cell")
    ratio = overlap_ratio(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"), of_shorter)
    return pairs.withColumn("ratio", F.round(ratio, 6)).where(F.col("ratio") > least)


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side alone: (key, side), side missing if right lacks it and unexpected if left does."""
    missing = left.select(key).distinct().join(right, key, "left_anti").withColumn("side", F.lit("missing"))
    unexpected = right.select(key).distinct().join(left, key, "left_anti").withColumn("side", F.lit("unexpected"))
    return missing.unionByName(unexpected)


def key_violations(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are null or occur more than once: (keys as JSON, n, problem)."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return counts.withColumn("problem", F.when(missing, "missing").when(F.col("n") > 1, "duplicate")).where("problem IS NOT NULL")


def merge_registries(kept: DataFrame, found: DataFrame, key: str, human: Sequence[str]) -> DataFrame:
    """Full outer merge: `human` columns of kept win, all others of found do; either fills what the other lacks."""
    a, b = kept.alias("a"), found.alias("b")
    pick = lambda c: (F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")) if c in human else F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}"))).alias(c)
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(*[pick(c) for c in kept.columns])


def row_differences(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, status, changed): added, removed or changed rows and the sorted names of fields that differ, nulls alike."""
    a, b = before.alias("a"), after.alias("b")
    changed = F.array_sort(F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields])))
    status = F.when(F.col(f"a.{key}").isNull(), "added").when(F.col(f"b.{key}").isNull(), "removed").when(F.size(changed) > 0, "changed")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), status.alias("status"), F.when(status == "changed", changed).otherwise(F.array().cast("array<string>")).alias("changed")).where("status IS NOT NULL")


def layered(base: DataFrame, layers: Sequence[tuple[DataFrame, Sequence[str]]], fields: Sequence[str], defaults: dict) -> DataFrame:
    """base with each field from the last layer that has it, else the default. A layer is rows with unique keys."""
    out, picks = base, {f: [] for f in fields}
    for n, (layer, keys) in enumerate(layers):
        out = out.join(layer.select(*keys, *[F.col(f).alias(f"_{n}_{f}") for f in fields if f in layer.columns]), list(keys), "left")
        for f in fields:
            if f in layer.columns:
                picks[f].insert(0, F.col(f"_{n}_{f}"))
    return out.select(*base.columns, *[F.coalesce(*picks[f], F.lit(defaults[f])).alias(f) for f in fields])


def _inside(short: DataFrame, long: DataFrame, title: str, other: str, shortest: int) -> DataFrame:
    """Pairs in which `title`, `shortest` characters or more, stands in the longer text `other`.

    A title of three words or more has an inner word with white space on both sides, which any text that holds the
    title has as a word of its own: the join is on the longest such word. Other titles have none and are looked for
    by their first `shortest` characters among all runs of so many in the texts.
    """
    most = long.agg(F.max(F.length(other))).first()[0] or 0
    titles = short.where(F.length(title).between(shortest, most))
    inner = F.slice(F.split(title, r"\s+"), 2, F.greatest(F.lit(0), F.size(F.split(title, r"\s+")) - 2))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    titles = titles.withColumn("_key", F.nullif(longest, F.lit("")))
    worded, bare = titles.where("_key IS NOT NULL"), titles.where("_key IS NULL").withColumn("_key", F.substring(title, 1, shortest))
    said = long.withColumn("_key", F.explode(F.array_distinct(F.split(other, r"\s+"))))
    runs = long.where(F.length(other) >= shortest).withColumn("_key", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(other) - shortest + 1), lambda k: F.substr(F.col(other), k, F.lit(shortest))))))
    found = said.join(worded, "_key")
    if not bare.isEmpty():
        found = found.unionByName(runs.join(bare, "_key"))
    return found.where(F.contains(F.col(other), F.col(title))).drop("_key")


def similar_titles(left: DataFrame, right: DataFrame, title: str, other: str, shortest: int = 10, action: tuple[str, str] | None = None) -> DataFrame:
    """Pairs of rows of the two tables whose titles are equal, or the shorter of which, `shortest` characters or more,
    stands anywhere in the other. With `action`, columns of the left and of the right, a right row must be of the same
    action or of an unknown one."""
    size, by = F.length(title), F.length(other)
    columns = [*left.columns, *right.columns]
    longer = _inside(left, right, title, other, shortest).where(size < by)
    shorter = _inside(right, left, other, title, shortest).where(by < size)
    equal = left.where(size > 0).join(right, F.col(title) == F.col(other))
    found = longer.select(columns).unionByName(shorter.select(columns)).unionByName(equal.select(columns))
    return found.where((F.col(action[1]) == "unknown") | F.col(action[1]).eqNullSafe(F.col(action[0]))) if action else found


def duplicate_status(pairs: DataFrame, candidates: DataFrame, keys: Sequence[str], match: Sequence[str], duration: str, other_duration: str, near: float = 3.0, most: int = 5) -> DataFrame:
    """(keys, status, matches) for each candidate: likely_duplicate if a pair's durations are within `near`, possible_duplicate
    if only titles are alike, else new_candidate; and the first `most` matches, by `match`, each with its kind."""
    close = F.coalesce(F.abs(F.col(duration) - F.col(other_duration)) <= near, F.lit(False))
    kind = F.when(close, "title_and_duration").otherwise("title")
    ranked = pairs.withColumn("_kind", kind).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*match)))
    first = F.when(F.col("_n") <= most, F.struct("_n", *match, F.col("_kind").alias("kind")))
    found = ranked.groupBy(*keys).agg(F.bool_or(F.col("_kind") == "title_and_duration").alias("_strong"), F.array_sort(F.collect_list(first)).alias("_m"))
    out = candidates.select(*keys).join(found, list(keys), "left")
    status = F.when(F.col("_strong").isNull(), "new_candidate").when(F.col("_strong"), "likely_duplicate").otherwise("possible_duplicate")
    return out.select(*keys, status.alias("status"), F.transform(F.coalesce("_m", F.array()), lambda m: F.struct(*[m[c].alias(c) for c in match], m["kind"].alias("kind"))).alias("matches"))
