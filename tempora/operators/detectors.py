"""Detection of active periods and movement cycles in signals, and what segments that people cut are worth beside them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.operators import matching as M
from tempora.operators import sequences as S


def active_periods(
    rows: DataFrame, keys: Sequence[str], time: str, value: str, width: int = 5, part: float = 0.42, floor: float = 0.006, before: float = 0.6, after: float = 0.8, shortest: float = 0.9, gap: float = 1.6, digits: int = 6,
) -> DataFrame:
    """(keys, start, end, merged): where the smoothed value is at or over `part` of the way from its 25th to its 92nd percentile.

    Periods are moved out by `before` and `after` within the key's times; those shorter than `shortest` go, and those
    within `gap` of each other are one. Keys of fewer than 2 * width rows have none.
    """
    smooth = S.centred_mean(rows, keys, [time], value, width, "_v").withColumn("_v", F.round("_v", digits))
    every = Window.partitionBy(*keys)
    bounded = smooth.withColumn("_first", F.min(time).over(every)).withColumn("_last", F.max(time).over(every)).withColumn("_n", F.count("*").over(every)).where(F.col("_n") >= 2 * width)
    levelled = S.with_percentiles(bounded, keys, "_v", {"_low": 0.25, "_high": 0.92})
    threshold = F.greatest(F.lit(floor), F.col("_low") + (F.col("_high") - F.col("_low")) * part)
    found = S.islands(levelled, keys, [time], F.col("_v") >= threshold).groupBy(*keys, "island").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.first("_first").alias("_first"), F.first("_last").alias("_last"))
    wide = S.expanded(found, before, after, F.col("_first"), F.col("_last"))
    return S.merged_periods(wide.where(F.col("end") - F.col("start") >= shortest).select(*keys, "start", "end"), keys, gap)


@dataclass(frozen=True)
class Cycling:
    """How cycles are found in a signal: percentiles that span its range, parts of the range where peaks begin and cycles end,
    the least range, the least gap of peaks, and what is added before and after, in seconds."""

    low: float = 0.2
    high: float = 0.9
    peak_part: float = 0.52
    boundary_part: float = 0.22
    least: float = 0.05
    gap: float = 3.2
    before: float = 0.3
    after: float = 0.35
    width: int = 5


def cycles(rows: DataFrame, keys: Sequence[str], time: str, signal: str, how: Cycling, visibility: str | None = None, smooth: bool = True) -> DataFrame:
    """(keys, start, end, anchor, strength, baseline, amplitude, visibility): rises of a signal, smoothed first unless told
    otherwise, over the peak level, from the boundary level before to that after.

    Keys with fewer than twice the window's rows, or whose range is under the least, have none. Of peaks nearer than
    the gap the higher stays. Starts and ends are moved out, held within the key's times and rounded to 2 digits;
    visibility is the mean of the rows from start to end.
    """
    every, w = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_t")
    even = S.centred_mean(rows, keys, [time], signal, how.width, "_v") if smooth else rows.withColumn("_v", F.col(signal))
    even = even.select(*keys, F.col(time).alias("_t"), F.round("_v", 9).alias("_v"), (F.col(visibility) if visibility else F.lit(None).cast("double")).alias("_seen"), F.count("*").over(every).alias("_n"))
    ranged = S.with_percentiles(even.where(F.col("_n") >= 2 * how.width), keys, "_v", {"_low": how.low, "_high": how.high}).withColumn("_range", F.col("_high") - F.col("_low")).where(F.col("_range") >= how.least)
    bounded = S.boundaries(ranged.withColumn("_first", F.min("_t").over(every)).withColumn("_last", F.max("_t").over(every)), keys, "_t", "_v", F.col("_low") + F.col("_range") * how.boundary_part)
    inside = F.coalesce(F.col("_v") >= F.col("_low") + F.col("_range") * how.peak_part, F.lit(False))
    marked = bounded.withColumn("_in", inside).withColumn("_begins", (F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False))).cast("int")).withColumn("_island", F.sum("_begins").over(w))
    hold = lambda t: F.round(F.least(F.greatest(t, F.col("_first")), F.col("_last")), 2)
    start, end = hold(F.col("boundary_start") - how.before), hold(F.col("boundary_end") + how.after)
    # one row for each key, with its peaks and with what is seen: all from the same pass over its rows
    best = F.max_by(F.struct(F.col("_t").alias("anchor"), F.col("_v").alias("strength"), start.alias("start"), end.alias("end"), F.col("_low").alias("baseline"), F.col("_range").alias("amplitude")), F.when(F.col("_in"), F.struct("_v", -F.col("_t"))))
    per_island = marked.groupBy(*keys, "_island").agg(best.alias("_best"), F.collect_list(F.when(F.col("_seen").isNotNull(), F.struct(F.col("_t").alias("t"), F.col("_seen").alias("v")))).alias("_seen"))
    per_key = per_island.groupBy(*keys).agg(F.array_sort(F.collect_list("_best")).alias("_peaks"), F.array_sort(F.flatten(F.collect_list("_seen"))).alias("_seen"))
    found = per_key.select(*keys, "_seen", F.explode(M.merged(F.col("_peaks"), "anchor", "strength", how.gap)).alias("_")).select(*keys, "_seen", "_.*")
    shown = F.transform(F.filter("_seen", lambda r: (r["t"] >= F.col("start")) & (r["t"] <= F.col("end"))), lambda r: r["v"])
    mean = F.when(F.size(shown) > 0, F.aggregate(shown, F.lit(0.0), lambda a, v: a + v) / F.size(shown))
    return found.select(*keys, "start", "end", F.round("anchor", 2).alias("anchor"), *[F.round(c, 4).alias(c) for c in ("strength", "baseline", "amplitude")], F.round(mean, 6).alias("visibility"))


def segment_evaluation(start: Column, end: Column, cycle_start: Column, cycle_end: Column, tolerance: float = 0.35, wide: float = 2.0, coverage: float = 0.85) -> tuple[Column, Column]:
    """(status, issues) of a segment beside its cycle; without a cycle insufficient. Distances are rounded to 2 digits first."""
    lead, tail = F.round(start - cycle_start, 2), F.round(cycle_end - end, 2)
    covered = F.greatest(F.lit(0.0), F.least(end, cycle_end) - F.greatest(start, cycle_start)) / F.greatest(F.lit(0.01), cycle_end - cycle_start)
    tests = [(lead > tolerance, "missing_start"), (tail > tolerance, "missing_return"), (covered < coverage, "too_short"), (lead < -wide, "wide_lead"), (tail < -wide, "wide_tail")]
    issues = F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in tests]))
    blocking = F.arrays_overlap(issues, F.array(*[F.lit(name) for _, name in tests[:3]]))
    status = F.when(cycle_start.isNull() | cycle_end.isNull(), "insufficient").when(blocking, "needs_adjustment").otherwise("good")
    return status, F.when(status == "insufficient", F.array().cast("array<string>")).otherwise(issues)


def cycle_count_status(expected: Column, candidates: Column, assigned: Column) -> tuple[Column, Column]:
    """(status, issues): too few cycles found or assigned block, too many want a look."""
    some = expected > 0
    tests = [(some & (candidates < expected), "detected_shortfall"), (some & (assigned < expected), "assigned_shortfall"), (some & (candidates > expected), "extra_candidates")]
    issues = F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in tests]))
    return F.when(tests[0][0] | tests[1][0], "blocked").when(tests[2][0], "needs_review").otherwise("ok"), issues


def draft_range(start: Column, end: Column, low: Column, high: Column, buffer: float = 0.2) -> tuple[Column, Column]:
    """A cycle's start and end, moved out by the buffer and held between low and high; null if nothing is left."""
    a, b = F.round(F.greatest(low, start - buffer), 2), F.round(F.least(high, end + buffer), 2)
    return F.when(b > a, a), F.when(b > a, b)
