"""Time-ordered operators: smoothing, islands, peaks, boundaries, latest rows, switches, pairs, sessions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tempora.functions.scalars import clamp, half_up, length


def _by(keys: Sequence[str], order: Sequence) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def centred_mean(rows: DataFrame, keys: Sequence[str], order: Sequence, value: str, width: int, name: str = "smooth") -> DataFrame:
    """Mean of up to half the width on either side (one at least), cut at the ends, nulls left out."""
    radius = max(1, width // 2)
    return rows.withColumn(name, F.avg(value).over(_by(keys, order).rowsBetween(-radius, radius)))


def with_percentiles(rows: DataFrame, keys: Sequence[str], value: str, parts: Mapping[str, float]) -> DataFrame:
    """rows with columns that hold the value at index half_up((n - 1) p) of the key's sorted values, by windows over the key
    alone: rows that are dealt by key stay where they are. Nulls have no rank; a key of nulls has nulls."""
    ordered, whole = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(value)), Window.partitionBy(*keys)
    ranked = rows.withColumn("_rank", F.row_number().over(ordered) - 1).withColumn("_known", F.count(value).over(whole))
    picks = {name: F.max(F.when(F.col("_rank") == half_up((F.col("_known") - 1) * p), F.col(value))).over(whole) for name, p in parts.items()}
    return ranked.withColumns(picks).drop("_rank", "_known")


def motion(rows: DataFrame, keys: Sequence[str], order: Sequence, x: str, y: str, name: str = "motion") -> DataFrame:
    """Distance from the point before; zero for the first."""
    w = _by(keys, order)
    return rows.withColumn(name, F.coalesce(length(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)), F.lit(0.0)))


def interval_median(rows: DataFrame, keys: Sequence[str], order: str, name: str = "interval") -> DataFrame:
    """Median step of a numeric order column."""
    stepped = rows.withColumn("_step", F.col(order) - F.lag(order).over(_by(keys, [order])))
    return stepped.groupBy(*keys).agg(F.median("_step").alias(name))


def islands(rows: DataFrame, keys: Sequence[str], order: Sequence, inside: Column) -> DataFrame:
    """The rows where `inside` holds, with a number `island` for each unbroken run of them within a key."""
    w = _by(keys, order)
    marked = rows.withColumn("_in", F.coalesce(inside, F.lit(False)))
    starts = marked.withColumn("_start", (F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False))).cast("int"))
    return starts.withColumn("island", F.sum("_start").over(w)).where("_in").drop("_in", "_start")


def island_periods(rows: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """First and last time, rows, mean, and the first largest value's time of each island."""
    peak = F.max_by(F.struct(F.col(time).alias("t"), F.col(value).alias("v")), F.struct(F.col(value), -F.col(time)))
    return rows.groupBy(*keys, "island").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n"), F.avg(value).alias("mean"), peak.alias("_p")).select(
        *keys, "island", "start", "end", "n", "mean", F.col("_p.t").alias("peak_time"), F.col("_p.v").alias("peak")
    )


def boundaries(rows: DataFrame, keys: Sequence[str], time: str, value: str, level: float | Column) -> DataFrame:
    """For each row, the nearest times before and after it, itself too, where value is at or under level; else the first and the last time."""
    w = _by(keys, [time])
    low = F.when(F.col(value) <= level, F.col(time))
    back = F.coalesce(F.last(low, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.min(time).over(Window.partitionBy(*keys)))
    # ahead by the last one in falling order: a frame that shrinks from its end is read anew for each row
    ahead = F.coalesce(F.last(low, ignorenulls=True).over(_by(keys, [F.desc(time)]).rowsBetween(Window.unboundedPreceding, 0)), F.max(time).over(Window.partitionBy(*keys)))
    return rows.withColumn("boundary_start", back).withColumn("boundary_end", ahead)


def merged_periods(periods: DataFrame, keys: Sequence[str], gap: float, mean: str | None = None, peak: str | None = None) -> DataFrame:
    """Periods (start, end) joined where one begins within `gap` of the furthest end before it.

    The mean of joined periods is taken pair by pair in order, so that each further one counts as much as all before it:
    of n known means the first counts 2^(1-n), the k-th 2^(k-n-1). The peak is the largest, 0 if none is known.
    """
    w = _by(keys, ["start", "end"])
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (reach.isNull() | (F.col("start") - reach > gap)).cast("int")
    grouped = periods.withColumn("_new", new).withColumn("_group", F.sum("_new").over(w))
    out = [F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("merged")]
    if mean:
        known = F.when(F.col(mean).isNotNull(), 1)
        grouped = grouped.withColumn("_k", F.count(known).over(_by([*keys, "_group"], ["start", "end"]))).withColumn("_m", F.count(known).over(Window.partitionBy(*keys, "_group")))
        halvings = F.col("_m") - F.when(F.col("_k") == 1, 1).otherwise(F.col("_k") - 1)
        out.append(F.sum(F.col(mean) * F.pow(F.lit(0.5), halvings)).alias(mean))
    if peak:
        out.append(F.coalesce(F.max(peak), F.lit(0.0)).alias(peak))
    return grouped.groupBy(*keys, "_group").agg(*out).drop("_group")


def expanded(periods: DataFrame, before: float, after: float, low: Column, high: Column, digits: int = 2) -> DataFrame:
    """start and end moved out by buffers and held between low and high."""
    return periods.withColumn("start", F.round(F.greatest(low, F.col("start") - before), digits)).withColumn("end", F.round(F.least(high, F.col("end") + after), digits))


def sessions(rows: DataFrame, keys: Sequence[str], time: str, gap: float) -> DataFrame:
    """Runs of rows with at most `gap` seconds between neighbours."""
    w = _by(keys, [time])
    seconds = F.col(time).cast("double")
    new = F.coalesce(((seconds - F.lag(seconds).over(w)) > gap).cast("int"), F.lit(1))
    return rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(w)).drop("_new")


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The row of each key that comes last in the given order, which should break all ties."""
    down = [o.desc() if isinstance(o, Column) else F.desc(o) for o in order]
    return rows.withColumn("_n", F.row_number().over(_by(keys, down))).where("_n = 1").drop("_n")


def top(rows: DataFrame, keys: Sequence[str], order: Sequence, k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each key."""
    return rows.withColumn(name, F.row_number().over(_by(keys, order))).where(F.col(name) <= k)


def switch_rate(rows: DataFrame, keys: Sequence[str], order: Sequence, value: str) -> DataFrame:
    """How often value differs from the row before, and that over the number of steps."""
    turned = rows.withColumn("_turned", (F.col(value) != F.lag(value).over(_by(keys, order))).cast("int"))
    out = turned.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.sum("_turned"), F.lit(0)).alias("switches"))
    return out.withColumn("switch_rate", F.round(F.try_divide(F.col("switches"), F.nullif(F.col("n") - 1, F.lit(0))), 4))


def until_next(rows: DataFrame, keys: Sequence[str], start: str, end: str, recovery: float = 1.2, near: float = 2.5, digits: int = 2) -> DataFrame:
    """`extended`, an end that takes in the way back: the next row's start if that is `near` or less away, else `recovery`
    later, but never past the next start nor before the end itself."""
    following, later = F.lead(start).over(_by(keys, [start, end])), F.col(end) + recovery
    to = F.when((following - F.col(end)).between(0, near), following).otherwise(F.least(later, following))  # least() passes over null
    return rows.withColumn("extended", F.round(F.greatest(F.col(end), to), digits))


def consecutive_pairs(rows: DataFrame, keys: Sequence[str], start: str, end: str, side: str, expected: str, near: float = 2.5) -> DataFrame:
    """Rows 1 and 2, 3 and 4, ... of each key as one (pair, start, end, side): forward and return.

    All or none: a key has pairs only if it has twice the `expected` rows and each two are of one side, the second
    starting 0 to `near` after the first's end.
    """
    numbered = rows.withColumn("_n", F.row_number().over(_by(keys, [start, end]))).withColumn("pair", F.floor((F.col("_n") - 1) / 2) + 1)
    odd = F.col("_n") % 2 == 1
    two = numbered.groupBy(*keys, "pair").agg(
        F.count("*").alias("_of"), F.min(start).alias(start), F.max(end).alias(end), F.max(expected).alias("_expected"), F.min(side).alias(side), F.max(side).alias("_side"), F.count(side).alias("_sided"),
        (F.max(F.when(~odd, F.col(start))) - F.max(F.when(odd, F.col(end)))).alias("_gap"),
    )
    fits = (F.col("_of") == 2) & (F.col("_sided") == 2) & (F.col(side) == F.col("_side")) & F.col("_gap").between(0, near)
    whole = Window.partitionBy(*keys)
    kept = two.withColumn("_fits", F.min(F.coalesce(fits, F.lit(False)).cast("int")).over(whole)).withColumn("_pairs", F.count("*").over(whole))
    return kept.where((F.col("_fits") == 1) & (F.col("_pairs") == F.col("_expected"))).select(*keys, "pair", start, end, side)


def edge_medians(rows: DataFrame, keys: Sequence[str], order: Sequence, value: str, part: float = 0.12, least: int = 3) -> DataFrame:
    """Median of the first and of the last rows of each key, `part` of them but `least` at least."""
    size = F.greatest(F.lit(least), F.floor(F.count("*").over(Window.partitionBy(*keys)) * part + 0.5))
    up, down = F.row_number().over(_by(keys, order)), F.row_number().over(_by(keys, [F.desc(o) if isinstance(o, str) else o.desc() for o in order]))
    marked = rows.withColumn("_size", size).withColumn("_up", up).withColumn("_down", down)
    return marked.groupBy(*keys).agg(F.median(F.when(F.col("_up") <= F.col("_size"), F.col(value))).alias("setup"), F.median(F.when(F.col("_down") <= F.col("_size"), F.col(value))).alias("finish"))


def onset(rows: DataFrame, keys: Sequence[str], time: str, value: str, base: str, level: float) -> DataFrame:
    """The first time at which value is `level` or more away from base."""
    return rows.groupBy(*keys).agg(F.min(F.when(F.abs(F.col(value) - F.col(base)) >= level, F.col(time))).alias("onset"))


def split_extrema(rows: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """The time of the first largest value, the largest value and the smallest values before and after that time; rows without a time or a value aren't at any peak's time."""
    there = F.col(time).isNotNull() & F.col(value).isNotNull()
    peak = rows.groupBy(*keys).agg(F.max_by(F.when(there, F.col(time)), F.when(there, F.struct(F.col(value), -F.col(time).cast("double")))).alias("peak_time"), F.max(value).alias("peak"))
    side = lambda c: F.min(F.when(c, F.col(value)))
    sides = rows.join(peak, list(keys)).groupBy(*keys).agg(F.first("peak_time").alias("peak_time"), F.first("peak").alias("peak"), side(F.col(time) < F.col("peak_time")).alias("least_before"), side(F.col(time) > F.col("peak_time")).alias("least_after"))
    return sides


def repeated_flag(rows: DataFrame, keys: Sequence[str], name: str = "repeated") -> DataFrame:
    """Whether another row has the same keys."""
    return rows.withColumn(name, F.count("*").over(Window.partitionBy(*keys)) > 1)


def segments(rows: DataFrame, start: str, end: str, count: str) -> DataFrame:
    """start..end, half a second at least, cut into `count` equal parts. Each begins 18 % of its length earlier, .55 to 1.4
    seconds, and ends 22 % later, .65 to 1.6, but stays inside."""
    length = F.greatest(F.col(end) - F.col(start), F.lit(0.5)) / F.col(count)
    out = rows.where(F.col(count) > 0).withColumn("segment", F.explode(F.sequence(F.lit(1), F.col(count).cast("int"))))
    from_ = F.greatest(F.col(start), F.col(start) + (F.col("segment") - 1) * length - clamp(length * 0.18, 0.55, 1.4))
    to = F.least(F.col(end), F.col(start) + F.col("segment") * length + clamp(length * 0.22, 0.65, 1.6))
    return out.withColumn("segment_start", F.round(from_, 2)).withColumn("segment_end", F.round(to, 2))
