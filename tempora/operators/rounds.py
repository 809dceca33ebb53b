"""Review rounds and what is exported for them: changes between rounds, disagreements, completion, evidence and its gates, snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.functions.scalars import finite, rate

#: Ranks of what reviewers say of their confidence.
CONFIDENCE = {"low": 1, "medium": 2, "high": 3}


def _rank(confidence: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    return F.try_element_at(ranks, confidence)


def reviewer_changes(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, before_*, after_*, status_changed, comparable, score_changed, confidence_delta, duration_delta) of the reviews
    (status, score, confidence, duration) of two rounds that have both. Only where both are scored is a score comparable."""
    columns = ("status", "score", "confidence", "duration")
    side = lambda rows, mark: rows.select(*keys, *[F.col(c).alias(f"{mark}_{c}") for c in columns])
    both = side(before, "before").join(side(after, "after"), list(keys))
    comparable = (F.col("before_status") == "scored") & (F.col("after_status") == "scored")
    return both.select(
        "*", (~F.col("before_status").eqNullSafe(F.col("after_status"))).alias("status_changed"), F.coalesce(comparable, F.lit(False)).alias("comparable"), F.when(comparable, ~F.col("before_score").eqNullSafe(F.col("after_score"))).alias("score_changed"),
        (_rank(F.col("after_confidence")) - _rank(F.col("before_confidence"))).alias("confidence_delta"), (F.col("after_duration") - F.col("before_duration")).alias("duration_delta"),
    )


def change_summary(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, rates, means and medians of reviewer_changes() for each key."""
    d = F.col("confidence_delta")
    out = changes.groupBy(*keys).agg(
        F.count("*").alias("items"), F.count_if("status_changed").alias("status_changed"), F.count_if("comparable").alias("comparable"), F.count_if("score_changed").alias("score_changed"),
        F.count_if(d > 0).alias("more_confident"), F.count_if(d == 0).alias("as_confident"), F.count_if(d < 0).alias("less_confident"), F.round(F.avg(d), 4).alias("mean_confidence_delta"),
        F.median("before_duration").alias("median_before"), F.median("after_duration").alias("median_after"), F.median("duration_delta").alias("median_delta"), F.round(F.avg("duration_delta"), 4).alias("mean_delta"),
    )
    return out.withColumn("score_change_rate", rate(F.col("score_changed"), F.col("comparable")))


def disagreements(pairs: DataFrame) -> DataFrame:
    """The pairs (left_status, right_status, left_score, right_score, left_reason, right_reason) that disagree, with `disagreement`."""
    same = lambda c: F.col(f"left_{c}").eqNullSafe(F.col(f"right_{c}"))
    kind = F.when(~same("status"), "scoreability_mismatch").when((F.col("left_status") == "scored") & ~same("score"), "score_disagreement").when((F.col("left_status") == "unscorable") & ~same("reason"), "unscorable_reason_disagreement")
    return pairs.withColumn("disagreement", kind).where("disagreement IS NOT NULL")


def against_consensus(suggested: DataFrame, consensus: DataFrame, key: str, action: str, items: int) -> DataFrame:
    """Suggestions (key, action, suggested) beside consensus scores (key, consensus), by action and, under (all), for all:
    compared, exact, within one, mean absolute difference, and what part of all items that covers."""
    d = F.abs(F.col("consensus") - F.col("suggested"))
    both = suggested.where(F.col("suggested").isNotNull()).join(consensus.where(F.col("consensus").isNotNull()), key)
    out = both.groupingSets([[F.col(action)], []], F.col(action)).agg(F.grouping(action).alias("_all"), F.count("*").alias("compared"), F.count_if(d == 0).alias("exact"), F.count_if(d <= 1).alias("within_one"), F.round(F.avg(d), 4).alias("mean_absolute"))
    return out.withColumn(action, F.when(F.col("_all") == 1, "(all)").otherwise(F.col(action).cast("string"))).drop("_all").withColumn("coverage", rate(F.col("compared"), F.lit(items)))


def completion(expected: DataFrame, latest: DataFrame, key: str, keys: Sequence[str]) -> DataFrame:
    """For each of `keys` with a latest review of anything: items expected and reviewed, reviews scored, unscorable, deferred,
    items missing and unexpected, and whether the round is complete: some items are expected, as many reviews are resolved
    (scored or unscorable), none is deferred, nothing is missing and nothing unexpected.

    Expected items are counted once; each review looks itself up among them, so no pairs of reviewers and items are made.
    """
    wanted = expected.select(key).where(F.col(key).isNotNull()).distinct()
    n_expected = wanted.count()
    found = latest.select(*keys, key, "status").join(wanted.withColumn("_expected", F.lit(True)), key, "left")
    n = lambda status: F.count_if(F.col("status") == status).alias(status)
    known = F.coalesce("_expected", F.lit(False))
    out = found.groupBy(*keys).agg(F.count_if(known).alias("reviewed"), *map(n, ("scored", "unscorable", "deferred")), F.count_if(~known).alias("unexpected"))
    out = out.withColumn("expected", F.lit(n_expected).cast("long")).withColumn("missing", F.col("expected") - F.col("reviewed"))
    resolved = F.col("scored") + F.col("unscorable") == F.col("expected")
    done = (F.col("expected") > 0) & resolved & (F.col("deferred") == 0) & (F.col("missing") == 0) & (F.col("unexpected") == 0)
    return out.select(*keys, "expected", "reviewed", "scored", "unscorable", "deferred", "missing", "unexpected", done.alias("complete"))


# ---- features and their contract


def contract_violations(contract: DataFrame) -> DataFrame:
    """(action, feature, problem) of a contract (action, feature, unit, direction): names that are missing or repeat, and missing units or directions."""
    n = F.count("*").over(Window.partitionBy("action", "feature"))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    problem = F.when(empty("feature"), "no_name").when(n > 1, "name_repeats").when(empty("unit") | empty("direction"), "missing_unit_or_direction")
    return contract.withColumn("problem", problem).where("problem IS NOT NULL").select("action", "feature", "problem").distinct()


def feature_values(rows: DataFrame, contract: Mapping[str, Sequence[str]], action: str, metrics: str, digits: int = 6) -> DataFrame:
    """rows with `features`: for each name that the row's action has in the contract its value in the map `metrics`, rounded, null where there is none."""
    value = lambda name: F.round(finite(F.try_element_at(F.col(metrics), F.lit(name))), digits)
    made = F.lit(None).cast("map<string,double>")
    for kind, names in contract.items():
        made = F.when(F.col(action) == kind, F.create_map(*[x for n in names for x in (F.lit(n), value(n))])).otherwise(made)
    return rows.withColumn("features", made)


def feature_names(rows: DataFrame, features: str = "features") -> list[str]:
    """The sorted union of the maps' names: bounded by the contract."""
    return [r.name for r in rows.select(F.explode(F.map_keys(features)).alias("name")).distinct().orderBy("name").collect()]


def quality_gate(visibility: Column, missing: Column, timing: Column, feature: Column, least: float = 0.5, most: float = 0.2) -> tuple[Column, Column]:
    """(readiness, reasons): ready if the pose is visible, few frames miss it, its timing is good and its features are ok."""
    tests = [
        F.when(F.coalesce(visibility, F.lit(0.0)) < least, "low_pose_average_visibility"), F.when(F.coalesce(missing, F.lit(1.0)) > most, "high_pose_missing_frames_ratio"),
        F.when(~timing.eqNullSafe(F.lit("good")), F.concat(F.lit("timing_"), F.coalesce(timing, F.lit("missing")))), F.when(~feature.eqNullSafe(F.lit("ok")), F.concat(F.lit("feature_"), F.coalesce(feature, F.lit("missing")))),
    ]
    reasons = F.array_compact(F.array(*tests))
    return F.when(F.size(reasons) == 0, "ready").otherwise("limited"), reasons


def readiness_summary(rows: DataFrame, action: str) -> DataFrame:
    """Rows, ready and limited ones of each action, and of all under (all)."""
    out = rows.groupingSets([[F.col(action)], []], F.col(action)).agg(F.grouping(action).alias("_all"), F.count("*").alias("total"), F.count_if(F.col("readiness") == "ready").alias("ready"), F.count_if(F.col("readiness") == "limited").alias("limited"))
    return out.withColumn(action, F.when(F.col("_all") == 1, "(all)").otherwise(F.col(action).cast("string"))).drop("_all")


def structural_issues(asset: Column, start: Column, end: Column, duration: Column, slack: float = 0.25) -> Column:
    """What is wrong with a repetition's asset and range: missing asset, a range that is none, one that ends after the video."""
    good = F.coalesce(finite(start).isNotNull() & finite(end).isNotNull() & (start >= 0) & (end > start), F.lit(False))
    tests = [(~asset.eqNullSafe(F.lit("found")), "video_asset_missing"), (~good, "invalid_time_range"), (good & (end > duration + slack), "exceeds_video_duration")]
    return F.array_compact(F.array(*[F.when(t, F.lit(name)) for t, name in tests]))


def evidence_gate(capability: Column, has_pose: Column, pose_limited: Column, timing: Column, timing_blocked: Column, feature: Column, suggestion: Column, total: Column) -> Column:
    """How far the evidence of a segment can be used: the first of eleven outcomes that holds. Arguments are statuses, null where there is no item."""
    staged = suggestion.isin("needs_heel_elevated_attempt", "needs_attempt_condition_review")
    return (
        F.when(capability.isNull(), "unknown")
        .when(capability == "annotation_only", "annotation_only")
        .when(~F.coalesce(has_pose, F.lit(False)), "missing_pose_evidence")
        .when(pose_limited, "limited_pose_quality")
        .when(capability == "features_only", F.when(feature == "ok", "features_only").otherwise("limited_features"))
        .when(timing.isNull(), "missing_timing")
        .when(timing_blocked, "timing_needs_review")
        .when(~feature.eqNullSafe(F.lit("ok")), "insufficient_features")
        .when(staged, "staged_scoring_needs_review")
        .when(~suggestion.eqNullSafe(F.lit("suggested")) | total.isNull(), "insufficient_ai_suggestion")
        .otherwise("ready")
    )


def attempt_score(pain: Column, human: Column, human_source: Column, pose: Column, pose_source: Column, elevated: Column, fallback: Column, cap: int = 2) -> tuple[Column, Column, Column]:
    """(score, source, scorable) of an attempt: 0 for pain, else the human score, else that of the pose. With heels elevated a
    fallback stands in where there is no pose score, or where it has 2 or more and the pose less, and no score is over `cap`."""
    elevated, pain = F.coalesce(elevated, F.lit(False)), F.coalesce(pain, F.lit(False))
    falls = elevated & human.isNull() & fallback.isNotNull() & (pose.isNull() | ((fallback >= 2) & (pose < 2)))
    raw = F.when(human.isNotNull(), human).when(falls, fallback).otherwise(pose)
    source = F.when(pain, "pain_or_clearing").when(human.isNotNull(), human_source).when(falls, "board_fallback").when(pose.isNotNull(), pose_source).otherwise("insufficient_evidence")
    score = F.when(pain, F.lit(0)).when(elevated, F.least(raw, F.lit(cap))).otherwise(raw)
    return F.when(pain | raw.isNotNull(), score), source, pain | raw.isNotNull()


# ---- groups of profiles


def characterised(rows: DataFrame, long: DataFrame, keys: Sequence[str], row: str, source: str, z: str = "z", most: int = 3, digits: int = 4) -> DataFrame:
    """For each group of rows (keys, row, source): rows, sources, the largest source's share, whether that is .75 or all, and
    the `most` features of long (row, feature, z) with the farthest median."""
    per = rows.groupBy(*keys, source).agg(F.count("*").alias("_n"))
    counts = per.groupBy(*keys).agg(F.sum("_n").alias("n"), F.count("*").alias("sources"), F.max("_n").alias("_most"))
    share = F.col("_most") / F.col("n")
    medians = rows.select(*keys, row).join(long.where(F.col(z).isNotNull()), row).groupBy(*keys, "feature").agg(F.round(F.median(z), digits).alias("median"))
    far = medians.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.abs("median")), "feature"))).where(F.col("_r") <= most)
    named = far.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_r", "feature", "median"))).alias("_f"))
    out = counts.join(named, list(keys), "left")
    return out.select(*keys, "n", "sources", F.round(share, 4).alias("largest_share"), ((F.col("sources") == 1) | (share >= 0.75)).alias("concentrated"), F.transform("_f", lambda f: F.struct(f["feature"].alias("feature"), f["median"].alias("median"))).alias("characteristic"))


def cluster_quality(silhouette: Column) -> Column:
    """What a mean silhouette says; the names are fixed values."""
    return F.when(silhouette.isNull(), "not_estimable").when(silhouette >= 0.5, "strong_separation_exploratory").when(silhouette >= 0.25, "moderate_separation_exploratory").otherwise("weak_separation_do_not_name_as_discrete_phenotypes")


def source_flag(ratio: Column) -> Column:
    """What the ratio of median distances within and between sources says; the names are fixed values."""
    return F.when(ratio.isNull(), "not_estimable").when(ratio < 0.6, "strong_source_video_signature").when(ratio < 0.85, "moderate_source_video_signature").otherwise("weak_source_video_signature")


# ---- snapshots


def snapshot_id(digests: Mapping[str, str]) -> str:
    """One name for a set of sources: the SHA-256 of their digests in the order of their names."""
    import hashlib

    return hashlib.sha256("\n".join(f"{name}:{digests[name]}" for name in sorted(digests)).encode()).hexdigest()


def table_digest(rows: DataFrame) -> str:
    """A digest of a table's content, whatever the order of its rows."""
    line = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"}), 256)
    parts = rows.select(F.conv(F.substring(line, 1, 15), 16, 10).cast("decimal(38,0)").alias("a"), F.conv(F.substring(line, 16, 15), 16, 10).cast("decimal(38,0)").alias("b"))
    said = parts.agg(F.count("*"), F.sum("a"), F.sum("b")).first()
    return ":".join(str(x) for x in said)


def ingest_snapshot(spark: SparkSession, path: str, sources: Mapping[str, DataFrame], keys: Mapping[str, str]) -> tuple[str, bool]:
    """(snapshot, written): writes each source under its name, partitioned by the snapshot's id; sources that are there already are left alone.
    A source in which a key, named in `keys`, is missing or repeats is an error, before anything is written."""
    for source, df in sources.items():
        bad = df.groupBy(keys[source]).agg(F.count("*").alias("_n")).where((F.col("_n") > 1) | F.col(keys[source]).isNull()).first()
        if bad:
            raise ValueError(f"{source}: {keys[source]} {bad[0]} is missing or repeats")
    name = snapshot_id({n: table_digest(df) for n, df in sources.items()})
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_done/{name}")
    system = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(files):
        return name, False
    for source, df in sources.items():
        df.write.mode("overwrite").parquet(f"{path}/{source}/snapshot_id={name}")
    system.mkdirs(files)  # last, so that a broken ingest is done again
    return name, True
