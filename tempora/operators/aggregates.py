"""Descriptive statistics, agreement between raters, effect sizes and correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.scalars import half_up, rate


def long_form(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """keys with a row (feature, value) for each feature."""
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("_")).select(*keys, "_.feature", "_.value")


def value_ranks(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, n, before, total) for each distinct number of each key: how often it is there, how many rows are less, how many there are.

    For keys that may hold any share of the rows: equal values are counted before the shuffle, and the values are cut
    at quantiles of the whole table into levels, so that a key is sorted by as many tasks as it has levels. Nulls have no rank.
    """
    known = rows.where(F.col(value).isNotNull())
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = known.agg(F.percentile_approx(F.col(value).cast("double"), [k / parts for k in range(1, parts)], 1000)).first()[0] or []
    level = F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]), lambda c: c <= F.col(value))) if cuts else F.lit(0)
    counts = known.groupBy(*keys, value).agg(F.count("*").alias("n")).withColumn("_level", level)
    whole = Window.partitionBy(*keys)
    levels = counts.groupBy(*keys, "_level").agg(F.sum("n").alias("_m")).withColumn("total", F.sum("_m").over(whole))
    levels = levels.withColumn("_ahead", F.sum("_m").over(whole.orderBy("_level")) - F.col("_m")).drop("_m")
    within = F.sum("n").over(Window.partitionBy(*keys, "_level").orderBy(value)) - F.col("n")
    ranked = counts.withColumn("_within", within).join(levels, [*keys, "_level"])
    return ranked.select(*keys, value, "n", (F.col("_ahead") + F.col("_within")).alias("before"), "total")


def _at(index: Column, value: str) -> Column:
    """The value at an index of a key's sorted values, as an aggregate over value_ranks."""
    return F.max(F.when((F.col("before") <= index) & (index < F.col("before") + F.col("n")), F.col(value)))


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, parts: dict[str, float]) -> DataFrame:
    """(keys, name, ...) of the values at (n - 1) p of each key's sorted values, between two of them in proportion."""
    place = lambda p: (F.col("total") - 1) * F.lit(float(p))
    ends = [c for n, p in parts.items() for c in (_at(F.floor(place(p)), value).alias(f"_low_{n}"), _at(F.ceil(place(p)), value).alias(f"_high_{n}"))]
    found = value_ranks(rows, keys, value).groupBy(*keys, "total").agg(*ends)
    mixed = lambda n, p: F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * (place(p) - F.floor(place(p)))
    return found.select(*keys, *[mixed(n, p).alias(n) for n, p in parts.items()])


def describe(rows: DataFrame, keys: Sequence[str], value: str = "value", digits: int = 6) -> DataFrame:
    """Count, missing, least, quartiles (linear), mean, largest and sample deviation of each group; deviation is null below two."""
    plain = rows.groupBy(*keys).agg(
        F.count(value).alias("n"), F.count_if(F.col(value).isNull()).alias("missing"), F.min(value).alias("least"), F.avg(value).alias("mean"), F.max(value).alias("largest"), F.stddev_samp(value).alias("deviation"),
    )
    out = plain.join(quantiles(rows, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}), list(keys), "left")
    return out.select(*keys, "n", "missing", *[F.round(c, digits).alias(c) for c in ("least", "q1", "median", "mean", "q3", "largest", "deviation")])


def nearest_rank(rows: DataFrame, keys: Sequence[str], value: str, parts: Sequence[float], few_keys: bool = False) -> DataFrame:
    """The value at index half_up((n - 1) p) of each group's sorted values, for each p. Ranks come from a window, so no
    group is a list; with `few_keys`, a group may be any share of the table and is ranked by several tasks."""
    if few_keys:
        return value_ranks(rows, keys, value).groupBy(*keys).agg(*[_at(half_up((F.col("total") - 1) * p), value).alias(f"p{round(100 * p)}") for p in parts])
    ordered = Window.partitionBy(*keys).orderBy(value)
    ranked = rows.where(F.col(value).isNotNull()).withColumn("_rank", F.row_number().over(ordered) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    picks = [F.max(F.when(F.col("_rank") == half_up((F.col("_n") - 1) * p), F.col(value))).alias(f"p{round(100 * p)}") for p in parts]
    return ranked.groupBy(*keys).agg(*picks)


def standardization(rows: DataFrame, keys: Sequence[str], value: str = "value", digits: int = 6) -> DataFrame:
    """Median and 1.4826 MAD of each group; the sample deviation where the MAD is zero; null where that is zero too."""
    centre = quantiles(rows, keys, value, {"_m": 0.5}).join(rows.groupBy(*keys).agg(F.stddev_samp(value).alias("_sd")), list(keys))
    away = rows.join(centre, list(keys)).withColumn("_away", F.abs(F.col(value) - F.col("_m")))
    spread = centre.join(quantiles(away, keys, "_away", {"_mad": 0.5}), list(keys))
    scale = F.when(F.col("_mad") > 0, F.col("_mad") * 1.4826).when(F.col("_sd") > 0, F.col("_sd"))
    return spread.select(*keys, F.round("_m", digits).alias("centre"), F.round(scale, digits).alias("scale"))


def agreement(pairs: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    """Of pairs of scores: compared, exact, within one, higher, lower, mean absolute and signed difference (right minus left), rates."""
    d = F.col(right) - F.col(left)
    out = pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("compared"), F.count_if(d == 0).alias("exact"), F.count_if(F.abs(d) <= 1).alias("within_one"), F.count_if(d > 0).alias("higher"),
        F.count_if(d < 0).alias("lower"), F.round(F.avg(F.abs(d)), 4).alias("mean_absolute"), F.round(F.avg(d), 4).alias("mean_signed"),
    )
    return out.withColumn("exact_rate", rate(F.col("exact"), F.col("compared"))).withColumn("within_one_rate", rate(F.col("within_one"), F.col("compared")))


def confusion(pairs: DataFrame, keys: Sequence[str], left: str, right: str, categories: int = 4) -> DataFrame:
    """A row for each left category with the counts of the right ones, zeros filled in."""
    counts = pairs.groupBy(*keys, F.col(left).alias("left")).agg(*[F.count_if(F.col(right) == c).alias(f"right_{c}") for c in range(categories)])
    every = pairs.select(*keys).distinct().withColumn("left", F.explode(F.sequence(F.lit(0), F.lit(categories - 1))))
    return every.join(counts, [*keys, "left"], "left").fillna(0, [f"right_{c}" for c in range(categories)])


def weighted_kappa(pairs: DataFrame, keys: Sequence[str], left: str, right: str, quadratic: bool, categories: int = 4) -> DataFrame:
    """Cohen's kappa of each group, weighted by distance or its square; null where chance leaves nothing to disagree on.

    Pairs with a null take no part; a score that is no category fails the query. Observed disagreement is a mean over pairs; the expected one comes from the counts of either side's categories.
    """
    rated = pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    stray = ~F.col(left).isin(*range(categories)) | ~F.col(right).isin(*range(categories))
    checked = F.when(stray, F.raise_error(F.concat(F.lit("no category: "), F.col(left).cast("string"), F.lit(", "), F.col(right).cast("string"))).cast("double"))
    d = F.coalesce(checked, F.abs(F.col(left) - F.col(right)) / (categories - 1))
    weight = d * d if quadratic else d
    sides = [F.count_if(F.col(side) == c).alias(f"{name}{c}") for name, side in (("l", left), ("r", right)) for c in range(categories)]
    sums = rated.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(weight).alias("_observed"), *sides)
    cost = lambda i, j: abs(i - j) / (categories - 1)
    expected = sum((F.col(f"l{i}") * F.col(f"r{j}") * (cost(i, j) ** 2 if quadratic else cost(i, j)) for i in range(categories) for j in range(categories) if i != j), F.lit(0.0)) / (F.col("n") * F.col("n"))
    return sums.select(*keys, "n", F.round(1 - F.try_divide(F.col("_observed"), F.nullif(expected, F.lit(0.0))), 4).alias("kappa"))


def hedges_g(rows: DataFrame, keys: Sequence[str], group: str, low: object, high: object, value: str) -> DataFrame:
    """Standardised mean difference, high minus low, with the small-sample correction; null below two values a side or without variance."""
    side = lambda g, f: f(F.when(F.col(group) == g, F.col(value)))
    s = rows.groupBy(*keys).agg(*[side(g, f).alias(f"{n}{k}") for k, g in (("l", low), ("h", high)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    n = F.col("nl") + F.col("nh")
    pooled = ((F.col("nl") - 1) * F.col("vl") + (F.col("nh") - 1) * F.col("vh")) / F.nullif(n - 2, F.lit(0))
    g = (F.col("mh") - F.col("ml")) / F.sqrt(F.when(pooled > 0, pooled)) * (1 - 3 / (4 * n - 9))
    return s.select(*keys, F.col("nl").alias("n_low"), F.col("nh").alias("n_high"), F.round(F.when((F.col("nl") >= 2) & (F.col("nh") >= 2), g), 6).alias("g"))


def average_rank(rows: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Ranks from 1 within each group; ties share the mean of theirs. Rows without value go."""
    ranks = value_ranks(rows, keys, value).select(*keys, value, (F.col("before") + (F.col("n") + 1) / 2).alias(name))
    return rows.join(ranks, [*keys, value])


def pearson(rows: DataFrame, keys: Sequence[str], x: str, y: str, name: str = "r", digits: int = 6) -> DataFrame:
    """Correlation from centred sums; null where either side doesn't vary."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))
    return both.groupBy(*keys).agg(F.count("*").alias("n"), F.round(r, digits).alias(name))


def spearman(rows: DataFrame, keys: Sequence[str], x: str, y: str, name: str = "rho") -> DataFrame:
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return pearson(average_rank(average_rank(both, keys, x, "_rx"), keys, y, "_ry"), keys, "_rx", "_ry", name)


def source_median_correlation(rows: DataFrame, keys: Sequence[str], source: str, x: str, y: str) -> DataFrame:
    """Correlation over the medians of each source, so that sources with many rows weigh no more than others."""
    return pearson(rows.groupBy(*keys, source).agg(F.median(x).alias("_mx"), F.median(y).alias("_my")), keys, "_mx", "_my")


def count_members(rows: DataFrame, keys: Sequence[str], members: str) -> DataFrame:
    """How often each member of a list column occurs."""
    return rows.select(*keys, F.explode(members).alias("member")).groupBy(*keys, "member").agg(F.count("*").alias("n"))


def with_total(rows: DataFrame, key: str, aggregates: Sequence[Column], total: str = "(all)") -> DataFrame:
    """The aggregates of each group and, under `total`, of all rows."""
    return rows.groupingSets([[F.col(key)], []], F.col(key)).agg(F.grouping(key).alias("_total"), *aggregates).withColumn(key, F.when(F.col("_total") == 1, F.lit(total)).otherwise(F.col(key).cast("string"))).drop("_total")


def range_summary(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Least, median, largest, range, and largest over least where that is positive."""
    out = rows.groupBy(*keys).agg(F.min(value).alias("least"), F.median(value).alias("median"), F.max(value).alias("largest"))
    ratio = F.when(F.col("least") > 0, F.col("largest") / F.col("least"))
    return out.withColumn("range", F.round(F.col("largest") - F.col("least"), 6)).withColumn("ratio", F.round(ratio, 4))
