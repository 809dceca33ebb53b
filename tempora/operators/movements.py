"""Movements of a body: signals of each frame, and the cycles of each kind of movement.

A frame is a row (keys, second, points), points as in `frames`. Image coordinates grow downward. Every signal is a set
of column expressions over one frame; cycles come from `detectors.cycles` with the parameters of the movement.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.scalars import axial_difference, clamp, joint_angle, length, line_distance
from tempora.operators import detectors as D
from tempora.operators import matching as M
from tempora.operators import sequences as S
from tempora.operators.joins import interval_join

SIDES = ("left", "right")
#: How each movement's cycles are found.
LEG_RAISE = D.Cycling(low=0.1, peak_part=0.55, boundary_part=0.24, least=0.06, gap=1.25, before=0.25)
HURDLE = D.Cycling(low=0.1, least=0.045, gap=1.1, before=0.35, after=0.45)
LUNGE = D.Cycling(least=0.045, gap=2.2)
SQUAT_DEPTH = D.Cycling(least=0.08)
SQUAT_COMPRESSION = D.Cycling(peak_part=0.35, boundary_part=0.16, least=0.035)
#: Peaks of the two legs that are so near are one, in seconds.
LEG_RAISE_SIDES, HURDLE_SIDES = 0.8, 0.7
_BODY = tuple(f"{s}_{p}" for p in ("shoulder", "hip", "knee", "ankle") for s in SIDES)


#: The points whose motion counts.
TRACKED = tuple(f"{s}_{p}" for p in ("shoulder", "elbow", "wrist", "hip", "knee", "ankle", "heel", "foot_index") for s in SIDES)


def _named(frames: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(keys, second, a struct column for each name): the last point of each name, null if there is none. Points are looked up
    here once; whatever is computed of them reads columns."""
    last = frames.where(F.col("second").isNotNull()).select(*keys, "second", F.reverse("points").alias("_points"))
    listed = last.withColumn("_names", F.transform("_points", lambda p: p["name"]))
    return computed(listed.select(*keys, "second", *[F.get("_points", F.array_position("_names", F.lit(n)).cast("int") - 1).alias(n) for n in names]))


def computed(rows: DataFrame) -> DataFrame:
    """rows whose columns are computed where they stand: filters and projections above aren't merged with the expressions
    below, which would repeat these at each use. A generator of one row is what the optimizer leaves alone."""
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def _both(*parts: str) -> list[str]:
    return [f"{s}_{p}" for p in parts for s in SIDES]


def _mean(*values: Column) -> Column:
    """Mean of those that are there."""
    total, n = F.lit(0.0), F.lit(0)
    for v in values:
        total, n = total + F.coalesce(v, F.lit(0.0)), n + v.isNotNull().cast("int")
    return F.when(n > 0, total / n)


def _at(name: str, axis: str) -> Column:
    return F.col(name)[axis]


def _usable(name: str, least: float) -> Column:
    p = F.col(name)
    seen = p["x"].isNotNull() & p["y"].isNotNull() & (p["visibility"].isNull() | (p["visibility"] >= least))
    return F.coalesce(seen, F.lit(False))


def _distance(a: str, b: str) -> Column:
    return length(_at(a, "x") - _at(b, "x"), _at(a, "y") - _at(b, "y"))


def leg_rows(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, second, side, hip_y, knee_y, ankle_y, foot_y, visibility) for each frame and leg whose four points are there."""
    parts = ("hip", "knee", "ankle", "foot_index")
    leg = lambda s: F.struct(F.lit(s).alias("side"), *[_at(f"{s}_{p}", "y").alias(f"{p.removesuffix('_index')}_y") for p in parts], _mean(*[_at(f"{s}_{p}", "visibility") for p in parts]).alias("visibility"))
    rows = _named(frames, keys, _both(*parts)).select(*keys, "second", F.explode(F.array(*map(leg, SIDES))).alias("_")).select(*keys, "second", "_.*")
    return rows.dropna(subset=["hip_y", "knee_y", "ankle_y", "foot_y"])


def depth_rows(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, second, depth_ratio, knee_ratio, hip_knee_gap, visibility) for frames whose shoulders, hips and ankles are
    there and at least 0.05 apart from shoulder to ankle."""
    y = lambda part: _mean(_at(f"left_{part}", "y"), _at(f"right_{part}", "y"))
    rows = _named(frames, keys, _BODY).select(*keys, "second", *[y(p).alias(p) for p in ("shoulder", "hip", "knee", "ankle")], _mean(*[_at(p, "visibility") for p in _BODY]).alias("visibility"))
    tall = computed(rows).where("shoulder IS NOT NULL AND hip IS NOT NULL AND ankle - shoulder >= 0.05")
    ratio = lambda c: (F.col(c) - F.col("shoulder")) / (F.col("ankle") - F.col("shoulder"))
    return tall.select(*keys, "second", ratio("hip").alias("depth_ratio"), ratio("knee").alias("knee_ratio"), (F.col("knee") - F.col("hip")).alias("hip_knee_gap"), "visibility")


def reach_rows(frames: DataFrame, keys: Sequence[str], least: float = 0.35) -> DataFrame:
    """(keys, second, wrist_distance, wrist_ratio, shoulder_width, torso, visibility): how far the hands are apart, in
    lengths of the torso, or widths of the shoulders where hips are missing; frames without either or without distance go."""
    rows = _named(frames, keys, _both("wrist", "shoulder", "hip")).where(_usable("left_wrist", least) & _usable("right_wrist", least) & _usable("left_shoulder", least) & _usable("right_shoulder", least))
    seen = _mean(*[_at(f"{s}_{p}", "visibility") for p in ("wrist", "shoulder", "hip") for s in SIDES])
    out = rows.select(*keys, "second", _distance("left_wrist", "right_wrist").alias("wrist_distance"), _distance("left_shoulder", "right_shoulder").alias("shoulder_width"), _mean(_distance("left_shoulder", "left_hip"), _distance("right_shoulder", "right_hip")).alias("torso"), seen.alias("visibility"))
    size = F.coalesce("torso", "shoulder_width")
    return computed(out).where((size > 0) & (F.col("wrist_distance") > 0)).withColumn("wrist_ratio", F.col("wrist_distance") / F.greatest(F.lit(0.01), size))


def push_up_rows(frames: DataFrame, keys: Sequence[str], least: float = 0.35) -> DataFrame:
    """(keys, second, lift, hip_offset, elbow_angle, length, visibility): the shoulders over the hands and the hips off the
    line from shoulders to ankles, in body lengths (of the torso where ankles are missing), and the mean angle of the elbows."""
    needed = _both("shoulder", "hip", "wrist")
    rows = _named(frames, keys, [*needed, *_both("ankle", "elbow")])
    for name in needed:
        rows = rows.where(_usable(name, least))
    ankles = _usable("left_ankle", least) & _usable("right_ankle", least)
    middle = lambda part, axis: (_at(f"left_{part}", axis) + _at(f"right_{part}", axis)) / 2
    for part in ("shoulder", "hip", "wrist"):
        rows = rows.withColumn(f"_{part}_x", middle(part, "x")).withColumn(f"_{part}_y", middle(part, "y"))
    rows = computed(rows.withColumn("_ankle_x", F.when(ankles, middle("ankle", "x"))).withColumn("_ankle_y", F.when(ankles, middle("ankle", "y"))))
    span = lambda a, b: length(F.col(f"_{a}_x") - F.col(f"_{b}_x"), F.col(f"_{a}_y") - F.col(f"_{b}_y"))
    elbow = lambda s: joint_angle(*[_at(f"{s}_{p}", axis) for p in ("shoulder", "elbow", "wrist") for axis in ("x", "y")])
    seen = _mean(*[_at(f"{s}_{p}", "visibility") for p in ("shoulder", "hip", "ankle", "wrist", "elbow") for s in SIDES])
    rows = computed(rows.withColumn("length", F.coalesce(span("shoulder", "ankle"), span("shoulder", "hip"))).withColumns({f"_elbow_{s}": elbow(s) for s in SIDES})).where("length > 0")
    whole = F.greatest(F.lit(0.01), F.col("length"))
    offset = line_distance(*[F.col(f"_{p}_{axis}") for p in ("hip", "shoulder", "ankle") for axis in ("x", "y")])
    return rows.select(*keys, "second", ((F.col("_wrist_y") - F.col("_shoulder_y")) / whole).alias("lift"), (offset / whole).alias("hip_offset"), _mean(*[F.col(f"_elbow_{s}") for s in SIDES]).alias("elbow_angle"), "length", seen.alias("visibility"))


def rotary_rows(frames: DataFrame, keys: Sequence[str], least: float = 0.35) -> DataFrame:
    """(keys, second, pattern, side, score, confidence, twist, centre_offset, hip_gap, visibility): which arm and leg reach
    farthest, in lengths of the body's frame (to nine digits); the first of patterns that tie."""
    needed = _both("shoulder", "hip", "wrist", "ankle")
    rows = _named(frames, keys, needed)
    for name in needed:
        rows = rows.where(_usable(name, least))
    spans = {"_shoulders": ("left_shoulder", "right_shoulder"), "_hips": ("left_hip", "right_hip"), **{f"_torso_{s}": (f"{s}_shoulder", f"{s}_hip") for s in SIDES}}
    spans |= {f"_arm_{s}": (f"{s}_wrist", f"{s}_shoulder") for s in SIDES} | {f"_leg_{s}": (f"{s}_ankle", f"{s}_hip") for s in SIDES}
    rows = computed(rows.withColumns({name: _distance(*ends) for name, ends in spans.items()}))
    size = _mean(F.col("_shoulders"), F.col("_hips"), _mean(*[F.col(f"_torso_{s}") for s in SIDES]))
    rows = computed(rows.withColumn("_length", size)).where("_length > 0")
    rows = rows.withColumns({f"_{s}_{part}": F.col(f"_{part}_{s}") / F.col("_length") for part in ("arm", "leg") for s in SIDES})
    kinds = [("left_same_side", "left", "left", "left"), ("right_same_side", "right", "right", "right"), ("left_arm_right_leg", "right", "left", "right"), ("right_arm_left_leg", "left", "right", "left")]
    patterns = F.array(*[F.struct(F.round(F.col(f"_{arm}_arm") + F.col(f"_{leg}_leg"), 9), F.lit(-k), F.lit(name), F.lit(side)) for k, (name, side, arm, leg) in enumerate(kinds)]).cast("array<struct<score:double,turn:int,pattern:string,side:string>>")
    rows = computed(rows.withColumn("_sorted", F.sort_array(patterns, asc=False))).withColumn("_best", F.col("_sorted")[0])
    slope = lambda p: F.degrees(F.atan2(_at(f"left_{p}", "y") - _at(f"right_{p}", "y"), _at(f"left_{p}", "x") - _at(f"right_{p}", "x")))
    middle_x = lambda p: (_at(f"left_{p}", "x") + _at(f"right_{p}", "x")) / 2
    sure = clamp((F.col("_best.score") - F.greatest(F.lit(0.0), F.col("_sorted")[1]["score"])) / F.greatest(F.lit(0.01), F.col("_best.score")), 0.0, 1.0)
    return rows.select(
        *keys, "second", "_best.pattern", "_best.side", "_best.score", sure.alias("confidence"), axial_difference(slope("shoulder"), slope("hip")).alias("twist"), F.abs(middle_x("shoulder") - middle_x("hip")).alias("centre_offset"),
        F.abs(_at("left_hip", "y") - _at("right_hip", "y")).alias("hip_gap"), _mean(*[_at(n, "visibility") for n in needed]).alias("visibility"),
    )


def best_frame(rows: DataFrame, keys: Sequence[str], value: str, largest: bool = True) -> DataFrame:
    """The row of each key with the largest (or least) value, the first of those that tie."""
    order = F.struct(F.col(value) if largest else -F.col(value), -F.col("second"))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("_")).select(*keys, "_.*")


def elevations(legs: DataFrame, keys: Sequence[str], least: float = 0.35) -> DataFrame:
    """Rows of legs that are seen, with `elevation`: how far the ankle is over where it is at its 90th percentile."""
    seen = legs.where(F.col("visibility").isNull() | (F.col("visibility") >= least))
    return S.with_percentiles(seen, [*keys, "side"], "ankle_y", {"p90": 0.9}).withColumn("elevation", F.col("p90") - F.col("ankle_y")).drop("p90")


def merge_sides(found: DataFrame, keys: Sequence[str], gap: float) -> DataFrame:
    """Of cycles of either side whose anchors are `gap` or less apart, the stronger stays: .8 strength + .2 visibility."""
    strength = F.col("strength") * 0.8 + F.coalesce("visibility", F.lit(0.0)) * 0.2
    return M.merge_peaks(found.withColumn("_strength", F.round(strength, 9)), keys, "anchor", "_strength", gap, inclusive=True).drop("_strength")


def numbered(found: DataFrame, keys: Sequence[str], name: str = "number") -> DataFrame:
    """Cycles numbered from one by their anchors."""
    return found.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy("anchor", "start", "end")))


def without_overlaps(found: DataFrame, keys: Sequence[str], most: float = 0.85) -> DataFrame:
    """M.drop_overlaps by strength + .05 visibility, numbered by anchors."""
    power = F.round(F.col("strength") + F.coalesce("visibility", F.lit(0.0)) * 0.05, 9)
    return numbered(M.drop_overlaps(found.withColumn("_power", power), keys, "_power", most).drop("_power", "number"), keys)


def leg_raise_cycles(frames: DataFrame, keys: Sequence[str], least: float = 0.35) -> DataFrame:
    """Cycles of raised legs, each leg's by itself, then as one sequence."""
    found = D.cycles(elevations(leg_rows(frames, keys), keys, least), [*keys, "side"], "second", "elevation", LEG_RAISE, "visibility")
    return numbered(merge_sides(found, keys, LEG_RAISE_SIDES), keys)


def hurdle_cycles(frames: DataFrame, keys: Sequence[str], least: float = 0.35) -> DataFrame:
    """Cycles of steps over a hurdle: as those of raised legs, and of cycles that overlap by .85 the stronger stays."""
    found = D.cycles(elevations(leg_rows(frames, keys), keys, least), [*keys, "side"], "second", "elevation", HURDLE, "visibility")
    return without_overlaps(merge_sides(found, keys, HURDLE_SIDES), keys)


def lunge_cycles(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cycles of how deep hips and knees are together."""
    rows = depth_rows(frames, keys).where("knee_ratio IS NOT NULL").withColumn("depth", (F.col("depth_ratio") + F.col("knee_ratio")) / 2)
    return without_overlaps(D.cycles(rows, keys, "second", "depth", LUNGE, "visibility"), keys)


def squat_cycles_of_windows(frames: DataFrame, windows: DataFrame, keys: Sequence[str], bucket: float = 10.0) -> DataFrame:
    """The strongest squat cycle (strength + .05 visibility, the first of two) of each window (id, start, end), each window by
    itself: its own percentiles, its own times. Windows may overlap; frames are dealt to all that hold them. Numbered in the
    order of windows' starts."""
    asked = windows.where(F.col("end") > F.col("start")).select(*keys, F.col("id").alias("window"), F.col("start").alias("window_start"), F.col("end").alias("window_end"))
    dealt = interval_join(frames.where(F.col("second").isNotNull()), asked, keys, "second", "window_start", "window_end", bucket)
    key = [*keys, "window", "window_start", "window_end"]
    found = squat_cycles(dealt, key)
    power = F.round(F.col("strength") + F.coalesce("visibility", F.lit(0.0)) * 0.05, 9)
    best = found.groupBy(*key).agg(F.count("*").alias("candidates"), F.max_by(F.struct("start", "end", "anchor", "strength", "visibility", "signal"), F.struct(power, -F.col("number"))).alias("_"))
    return best.select(*key, "candidates", "_.*").withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy("window_start", "window_end", "window")))


def landmark_motion(frames: DataFrame, keys: Sequence[str], names: Sequence[str] = TRACKED, least: float = 0.35) -> DataFrame:
    """(keys, second, motion, tracked): the mean distance that points have moved since the frame before, over those that both
    frames show; 0 for the first frame, and where they show none in common. Frames that show no point are left out."""
    rows = _named(frames, keys, names)
    shown = rows.select(*keys, "second", *[F.when(_usable(n, least), F.struct(F.col(n)["x"].alias("x"), F.col(n)["y"].alias("y"))).alias(n) for n in names])
    tracked = sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0))
    seen = computed(shown.withColumn("tracked", tracked)).where("tracked > 0")
    before = seen.withColumn("_before", F.lag(F.struct(*names)).over(Window.partitionBy(*keys).orderBy("second")))
    moved = computed(before.select(*keys, "second", "tracked", *[length(F.col(n)["x"] - F.col("_before")[n]["x"], F.col(n)["y"] - F.col("_before")[n]["y"]).alias(f"_{n}") for n in names]))
    return moved.select(*keys, "second", F.coalesce(_mean(*[F.col(f"_{n}") for n in names]), F.lit(0.0)).alias("motion"), "tracked")


def squat_cycles(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cycles of depth and of compression, what hips and knees lack of their gap when standing (its 80th percentile); where
    both see one by half, the stronger stays. `signal` names which it is."""
    rows = depth_rows(frames, keys)
    smooth = S.centred_mean(rows, keys, ["second"], "hip_knee_gap", SQUAT_DEPTH.width, "_gap").withColumn("_gap", F.round("_gap", 9))
    squeezed = S.with_percentiles(smooth, keys, "_gap", {"p80": 0.8}).withColumn("_squeeze", F.when(F.col("_gap").isNotNull(), F.greatest(F.lit(0.0), F.col("p80") - F.col("_gap"))))
    depth = D.cycles(rows, keys, "second", "depth_ratio", SQUAT_DEPTH, "visibility").withColumn("signal", F.lit("depth_ratio"))
    squeeze = D.cycles(squeezed, keys, "second", "_squeeze", SQUAT_COMPRESSION, "visibility", smooth=False).withColumn("signal", F.lit("hip_knee_compression"))
    return without_overlaps(depth.unionByName(squeeze), keys, 0.5)


def peak_evidence(legs: DataFrame, segments: DataFrame, keys: Sequence[str], least: float = 0.45) -> DataFrame:
    """(keys, id, status, reasons, ...): how well the raised leg of each segment (id, start, end, side) is known.

    In each frame the visible leg with the higher ankle wins. Strong frames are those at .65 of the peak or more, and at
    .04. Too few of them (5), no side with .6 of them, or sides that change at more than .25 of the steps limit the
    evidence; .85, .08 and another side than the segment's want a look.
    """
    inside = segments.select(*keys, "id", "start", "end", F.col("side").alias("segment_side"))
    rows = legs.withColumn("raise", F.col("hip_y") - F.col("ankle_y")).join(inside, list(keys)).where(F.col("second").between(F.col("start"), F.col("end")) & (F.col("visibility") >= least))
    key = [*keys, "id", "segment_side"]
    winners = rows.groupBy(*key, "second").agg(F.max_by(F.struct("side", "raise", "visibility"), F.struct("raise", F.when(F.col("side") == "left", 1).otherwise(0))).alias("_")).select(*key, "second", "_.*")
    top = winners.groupBy(*key).agg(F.count("*").alias("frames"), F.max_by(F.struct(F.col("second").alias("peak_second"), F.col("side").alias("peak_side"), F.col("raise").alias("peak"), F.col("visibility").alias("peak_visibility")), F.struct("raise", -F.col("second"))).alias("_")).select(*key, "frames", "_.*")
    strong = winners.join(top, key).where(F.col("raise") >= F.greatest(F.lit(0.04), F.col("peak") * 0.65))
    turned = strong.withColumn("_turn", (F.col("side") != F.lag("side").over(Window.partitionBy(*key).orderBy("second"))).cast("int"))
    counts = turned.groupBy(*key).agg(F.count("*").alias("strong"), F.count_if(F.col("side") == "left").alias("left"), F.count_if(F.col("side") == "right").alias("right"), F.sum("_turn").alias("switches"))
    n = F.col("strong")
    out = inside.drop("start", "end").join(top.join(counts, key, "left").fillna(0, ["strong", "left", "right", "switches"]), key, "left")
    out = out.withColumn("dominant", F.when(F.col("left") == F.col("right"), F.col("peak_side")).when(F.col("left") > F.col("right"), "left").when(F.col("right") > F.col("left"), "right"))
    out = out.withColumn("ratio", F.when(n > 0, F.when(F.col("dominant") == "left", F.col("left")).otherwise(F.col("right")) / n).otherwise(0.0)).withColumn("switch_rate", F.when(n > 1, F.col("switches") / (n - 1)).otherwise(0.0))
    stable, known = (n >= 5) & (F.col("ratio") >= 0.85), F.col("segment_side").isin(*SIDES)
    agrees = F.when(~F.coalesce(known, F.lit(False)) | ~stable, "indeterminate").when(F.col("segment_side") == F.col("dominant"), "match").otherwise("mismatch")
    limited = [(n < 5, "sparse_strong_raise_signal"), (F.col("ratio") < 0.6, "ambiguous_dominant_pose_side"), (F.col("switch_rate") > 0.25, "unstable_pose_side_labels")]
    watch = [((F.col("ratio") >= 0.6) & (F.col("ratio") < 0.85), "pose_side_dominance_watch"), ((F.col("switch_rate") <= 0.25) & (F.col("switch_rate") > 0.08), "pose_side_switch_watch"), (agrees == "mismatch", "segment_side_pose_mismatch")]
    named = lambda tests: F.array_compact(F.array(*[F.when(t, F.lit(name)) for t, name in tests]))
    none = F.col("frames").isNull()
    status = F.when(none, "insufficient_pose").when(F.size(named(limited)) > 0, "limited").when(F.size(named(watch)) > 0, "watch").otherwise("good")
    reasons = F.when(none, F.array(F.lit("no_visible_leg_frames"))).otherwise(F.concat(named(limited), named(watch)))
    return out.select(*keys, "id", status.alias("status"), reasons.alias("reasons"), "frames", "strong", F.round("peak_second", 3).alias("peak_second"), "peak_side", "dominant", F.round(F.when(~none, F.col("ratio")), 3).alias("ratio"), F.round(F.when(~none, F.col("switch_rate")), 3).alias("switch_rate"), F.when(~none, agrees).alias("agreement"))


def cycle_of_segment(segments: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """segments (id, start, end) with the anchor of their cycle: of those inside it the nearest to its middle, else of all; the first of those that tie."""
    lists = found.groupBy(*keys).agg(F.array_sort(F.collect_list("anchor")).alias("_anchors"))
    inside = F.filter("_anchors", lambda a: a.between(F.col("start"), F.col("end")))
    near = F.transform(F.when(F.size(inside) > 0, inside).otherwise(F.col("_anchors")), lambda a: F.struct(F.abs(a - (F.col("start") + F.col("end")) / 2).alias("off"), a.alias("a")))
    return segments.join(lists, list(keys), "left").withColumn("anchor", F.array_min(near)["a"]).drop("_anchors")
