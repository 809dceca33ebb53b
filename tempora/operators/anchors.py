"""Features of repetitions at their anchor frames, and ratings of them, for seven kinds of movement in one plan.

A repetition is a row (keys, id, action, view, side, start, end, anchor, signals): where it was found, and what its
detector measured, a map of numbers. Its anchor's frame is looked up by time, in the same pass the frame nearest its start
and how far the ankles move between start and end. KERNELS hold, for each action, columns over these; RATINGS is a table
of thresholds. An action that has no kernel has no features.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.scalars import axial_difference, clamp, finite, joint_angle, length
from tempora.operators.joins import interval_join, nearest_in_time
from tempora.operators.movements import SIDES, _both, _mean, _named, computed

POINTS = tuple(_both("shoulder", "elbow", "wrist", "hip", "knee", "ankle", "foot_index", "index"))


def at_anchors(frames: DataFrame, repetitions: DataFrame, keys: Sequence[str], bucket: float = 10.0) -> DataFrame:
    """repetitions with `pose` and `start_pose`, the points of the frames nearest to anchor and start (the earlier of two;
    without an anchor the first frame), `source_second`, and left_drift and right_drift, the range of the ankles' x from
    start to end. Nothing is paired beyond a repetition's own frames."""
    rows = _named(frames, keys, POINTS)
    posed = rows.select(*keys, "second", F.struct(*POINTS).alias("pose"))
    times = F.array(F.struct(F.lit("anchor").alias("kind"), F.coalesce("anchor", F.lit(float("-inf"))).alias("t")), F.struct(F.lit("start").alias("kind"), F.col("start").alias("t")))
    wanted = repetitions.select(*keys, "id", F.explode(times).alias("_")).select(*keys, "id", "_.kind", "_.t").where("t IS NOT NULL")
    near = nearest_in_time(wanted, posed, keys, "t", "second", "pose")
    of = lambda kind, c: F.max_by(c, F.when(F.col("kind") == kind, 1))
    found = near.groupBy(*keys, "id").agg(of("anchor", "nearest_id").alias("pose"), of("anchor", "nearest_time").alias("source_second"), of("start", "nearest_id").alias("start_pose"))
    spans = repetitions.select(*keys, "id", "start", "end").where("end >= start")
    inside = interval_join(rows.select(*keys, "second", "left_ankle", "right_ankle"), spans, keys, "second", "start", "end", bucket)
    drift = inside.groupBy(*keys, "id").agg(*[(F.max(finite(F.col(f"{s}_ankle.x"))) - F.min(finite(F.col(f"{s}_ankle.x")))).alias(f"{s}_drift") for s in SIDES])
    both = computed(repetitions.join(found, [*keys, "id"], "left").join(drift, [*keys, "id"], "left"))
    # lengths of the body that several kernels read
    body = {"_width": _span(_p("left_shoulder"), _p("right_shoulder")), "_hips": _span(_p("left_hip"), _p("right_hip")), **{f"_torso_{s}": _span(_p(f"{s}_shoulder"), _p(f"{s}_hip")) for s in SIDES}}
    both = computed(both.withColumns(body)).withColumn("_torso", _mean(*[F.col(f"_torso_{s}") for s in SIDES]))
    return computed(computed(both).withColumn("_size", _mean(F.col("_width"), F.col("_hips"), F.col("_torso"))))


# ---- kernels


def _p(name: str) -> Column:
    return F.col("pose")[name]


def _sided(side: Column, part: str, pose: str = "pose") -> Column:
    """The part of a side; null for a side that is neither."""
    return F.when(side == "left", F.col(pose)[f"left_{part}"]).when(side == "right", F.col(pose)[f"right_{part}"])


def _span(a: Column, b: Column) -> Column:
    return length(a["x"] - b["x"], a["y"] - b["y"])


def _angle(a: Column, b: Column, c: Column) -> Column:
    return joint_angle(a["x"], a["y"], b["x"], b["y"], c["x"], c["y"])


def _middle(part: str, axis: str) -> Column:
    """The mean of those of the two that are there."""
    return _mean(_p(f"left_{part}")[axis], _p(f"right_{part}")[axis])


def _opposite(side: Column) -> Column:
    return F.when(side == "left", "right").otherwise("left")


def _hip_gap() -> Column:
    return F.abs(_p("left_hip")["y"] - _p("right_hip")["y"])


def _centre_offset() -> Column:
    half = lambda part: (_p(f"left_{part}")["x"] + _p(f"right_{part}")["x"]) / 2
    return F.abs(half("shoulder") - half("hip"))


def _shown(side: Column) -> Column:
    return _mean(*[_sided(side, part)["visibility"] for part in ("hip", "knee", "ankle", "foot_index")])


def _drift(side: Column) -> Column:
    return F.when(side == "left", F.col("left_drift")).when(side == "right", F.col("right_drift"))


def _signal(name: str) -> Column:
    return F.try_element_at("signals", F.lit(name))


def _squat() -> dict[str, Column]:
    angles = lambda *parts: _mean(*[_angle(*[_p(f"{s}_{part}") for part in parts]) for s in SIDES])
    lean = _mean(*[F.abs(F.degrees(F.atan2(_p(f"{s}_knee")["x"] - _p(f"{s}_ankle")["x"], _p(f"{s}_ankle")["y"] - _p(f"{s}_knee")["y"]))) for s in SIDES])
    trunk = F.abs(F.degrees(F.atan2(_middle("hip", "x") - _middle("shoulder", "x"), _middle("hip", "y") - _middle("shoulder", "y"))))
    off = {s: _p(f"{s}_knee")["x"] - _p(f"{s}_ankle")["x"] for s in SIDES}
    return {
        "peak_depth_ratio": _signal("peak_depth_ratio"), "hip_knee_gap": _middle("hip", "y") - _middle("knee", "y"), "hip_angle": angles("shoulder", "hip", "knee"), "knee_angle": angles("hip", "knee", "ankle"),
        "ankle_angle": angles("knee", "ankle", "foot_index"), "shank_lean": lean, "trunk_lean": trunk, "left_knee_offset": off["left"], "right_knee_offset": off["right"],
        "knee_offset": F.greatest(F.abs(off["left"]), F.abs(off["right"])),
    }


def _leg_raise() -> dict[str, Column]:
    side, down = F.col("side"), _opposite(F.col("side"))
    hip = _sided(side, "hip")
    return {
        "ankle_above_hip": hip["y"] - _sided(side, "ankle")["y"], "foot_above_hip": hip["y"] - _sided(side, "foot_index")["y"], "knee_angle": _angle(hip, _sided(side, "knee"), _sided(side, "ankle")),
        "down_knee_angle": _angle(*[_sided(down, part) for part in ("hip", "knee", "ankle")]), "down_ankle_drift": _span(_sided(down, "ankle"), _sided(down, "ankle", "start_pose")), "hip_gap": _hip_gap(),
        "peak_elevation": _signal("peak_elevation"), "side_visibility": _shown(side),
    }


def _hurdle() -> dict[str, Column]:
    side, stance = F.col("side"), _opposite(F.col("side"))
    hip, knee, ankle = (_sided(side, part) for part in ("hip", "knee", "ankle"))
    raw_drift, raw_knee = _drift(stance), _angle(*[_sided(stance, part) for part in ("hip", "knee", "ankle")])
    front = lambda c: F.when(F.col("view") == "front", c)
    return {
        "peak_clearance": _signal("peak_clearance"), "stance_ankle_drift": front(raw_drift), "raw_stance_ankle_drift": raw_drift, "stance_knee_angle": front(raw_knee), "raw_stance_knee_angle": raw_knee,
        "step_knee_angle": _angle(hip, knee, ankle), "knee_line_offset": F.abs(knee["x"] - (hip["x"] + ankle["x"]) / 2), "centre_offset": _centre_offset(), "hip_gap": _hip_gap(), "side_visibility": _shown(side),
    }


def front_side() -> Column:
    """The side whose knee is lower in the picture, the left if neither is; unknown if either is missing."""
    return F.when(_p("left_knee")["y"] >= _p("right_knee")["y"], "left").when(_p("left_knee")["y"] < _p("right_knee")["y"], "right").otherwise("unknown")


def _lunge() -> dict[str, Column]:
    front = front_side()
    rear = F.when(front == "unknown", "unknown").otherwise(_opposite(front))
    ankle, foot = _sided(front, "ankle")["x"], _sided(front, "foot_index")["x"]
    return {
        "peak_depth_ratio": _signal("peak_depth_ratio"), "baseline_depth_ratio": _signal("baseline_depth_ratio"), "centre_offset": _centre_offset(), "hip_gap": _hip_gap(),
        "knee_foot_offset": F.abs(_sided(front, "knee")["x"] - F.coalesce((ankle + foot) / 2, foot, ankle)), "rear_ankle_drift": _drift(rear), "side_visibility": _shown(front), "rear_visibility": _shown(rear),
    }


def _reaches() -> dict[str, Column]:
    size = F.col("_size")
    part = lambda s, a, b: F.when(size > 0, _span(_p(f"{s}_{a}"), _p(f"{s}_{b}")) / F.greatest(F.lit(0.01), size))
    return {f"{s}_{name}_reach": part(s, *ends) for name, ends in (("arm", ("wrist", "shoulder")), ("leg", ("ankle", "hip"))) for s in SIDES}


#: Which arm and leg make a pattern, and whose side it is.
PATTERNS = (("left_same_side", "left", "left", "left"), ("right_same_side", "right", "right", "right"), ("left_arm_right_leg", "right", "left", "right"), ("right_arm_left_leg", "left", "right", "left"))


def _rotary() -> dict[str, Column]:
    reach = _reaches()
    zero = {k: F.coalesce(c, F.lit(0.0)) for k, c in reach.items()}
    scores = F.sort_array(F.array(*[F.round(zero[f"{arm}_arm_reach"] + zero[f"{leg}_leg_reach"], 9) for _, _, arm, leg in PATTERNS]), asc=False)
    best, next_best = scores[0], F.greatest(F.lit(0.0), scores[1])
    slope = lambda part: F.degrees(F.atan2(_p(f"left_{part}")["y"] - _p(f"right_{part}")["y"], _p(f"left_{part}")["x"] - _p(f"right_{part}")["x"]))
    return {
        "reach": best, **reach, "trunk_twist": axial_difference(slope("shoulder"), slope("hip")), "centre_offset": _centre_offset(), "hip_gap": _hip_gap(),
        "side_visibility": _mean(*[_p(n)["visibility"] for n in _both("shoulder", "hip", "wrist", "ankle")]), "side_confidence": clamp((best - next_best) / F.greatest(F.lit(0.01), best), 0.0, 1.0),
    }


def _shoulder() -> dict[str, Column]:
    width, torso = F.col("_width"), F.col("_torso")
    size = F.coalesce(torso, width)
    ratio = lambda part: F.when(size > 0, _span(_p(f"left_{part}"), _p(f"right_{part}")) / F.greatest(F.lit(0.01), size))
    return {"wrist_ratio": ratio("wrist"), "index_ratio": ratio("index"), "shoulder_width": width, "torso_length": torso, "reference_length": size, "hand_visibility": _mean(*[_p(n)["visibility"] for n in _both("wrist", "index")])}


def _push_up() -> dict[str, Column]:
    names = ("lift", "hip_offset", "hip_offset_range", "elbow_angle")
    return {**{n: _signal(n) for n in names}, "trunk_visibility": _mean(*[_p(n)["visibility"] for n in _both("shoulder", "hip", "wrist", "ankle")])}


KERNELS: dict[str, Callable[[], dict[str, Column]]] = {
    "deep_squat": _squat, "active_leg_raise": _leg_raise, "hurdle_step": _hurdle, "inline_lunge": _lunge, "rotary_stability": _rotary, "shoulder_mobility": _shoulder, "trunk_stability": _push_up,
}


# ---- ratings


class Limit(NamedTuple):
    """One threshold of a rating: good and fair values of a metric, whether more is better, the view that it needs. A rating
    of several limits is the worst of those whose metric is there, or none if `whole` and one is missing."""

    action: str
    rating: str
    metric: str
    good: float
    fair: float
    rising: bool = False
    view: str | None = None
    whole: bool = False


#: The thresholds.
RATINGS = (
    Limit("deep_squat", "depth", "hip_knee_gap", 0.025, -0.015, True), Limit("deep_squat", "torso_control", "trunk_lean", 24, 34, view="side"), Limit("deep_squat", "knee_alignment", "knee_offset", 0.04, 0.08, view="front"),
    Limit("deep_squat", "hip_angle", "hip_angle", 115, 140, view="side"), Limit("deep_squat", "knee_angle", "knee_angle", 105, 135, view="side"), Limit("deep_squat", "ankle_angle", "shank_lean", 18, 10, True, view="side"),
    Limit("active_leg_raise", "leg_raise", "ankle_above_hip", 0.16, 0.06, True), Limit("active_leg_raise", "hip_flexion", "ankle_above_hip", 0.16, 0.06, True), Limit("active_leg_raise", "knee_extension", "knee_angle", 160, 140, True),
    Limit("active_leg_raise", "down_leg_control", "down_knee_angle", 160, 145, True), Limit("active_leg_raise", "down_leg_control", "down_ankle_drift", 0.05, 0.09), Limit("active_leg_raise", "pelvic_stability", "hip_gap", 0.06, 0.1),
    Limit("hurdle_step", "clearance", "peak_clearance", 0.12, 0.07, True), Limit("hurdle_step", "stance_leg_control", "stance_ankle_drift", 0.035, 0.07), Limit("hurdle_step", "stance_leg_control", "stance_knee_angle", 170, 160, True),
    Limit("hurdle_step", "step_leg_alignment", "knee_line_offset", 0.035, 0.065), Limit("hurdle_step", "pelvis_trunk_control", "centre_offset", 0.04, 0.08), Limit("hurdle_step", "pelvis_trunk_control", "hip_gap", 0.045, 0.08),
    Limit("hurdle_step", "step_clearance", "peak_clearance", 0.12, 0.07, True), Limit("hurdle_step", "stance_stability", "stance_ankle_drift", 0.035, 0.07), Limit("hurdle_step", "trunk_control", "centre_offset", 0.04, 0.08),
    Limit("inline_lunge", "depth_zone", "peak_depth_ratio", 0.7, 0.62, True), Limit("inline_lunge", "trunk_pelvis_control", "centre_offset", 0.04, 0.08), Limit("inline_lunge", "trunk_pelvis_control", "hip_gap", 0.045, 0.08),
    Limit("inline_lunge", "knee_foot_line", "knee_foot_offset", 0.045, 0.09), Limit("inline_lunge", "rear_leg_control", "rear_ankle_drift", 0.04, 0.075), Limit("inline_lunge", "rear_leg_control", "rear_visibility", 0.45, 0.45, True),
    Limit("inline_lunge", "depth", "peak_depth_ratio", 0.7, 0.62, True), Limit("inline_lunge", "trunk_alignment", "centre_offset", 0.04, 0.08), Limit("inline_lunge", "knee_foot_alignment", "knee_foot_offset", 0.045, 0.09),
    Limit("rotary_stability", "diagonal_control", "reach", 1.3, 0.9, True), Limit("rotary_stability", "trunk_rotation", "trunk_twist", 15, 30),
    Limit("rotary_stability", "balance", "centre_offset", 0.08, 0.15, whole=True), Limit("rotary_stability", "balance", "hip_gap", 0.08, 0.14, whole=True),
    Limit("shoulder_mobility", "reach_distance", "wrist_ratio", 0.18, 0.42), Limit("shoulder_mobility", "hand_visibility", "hand_visibility", 0.65, 0.45, True),
    Limit("trunk_stability", "push_up", "lift", 0.38, 0.24, True), Limit("trunk_stability", "core_stability", "hip_offset", 0.055, 0.105), Limit("trunk_stability", "arm_extension", "elbow_angle", 160, 140, True),
    Limit("trunk_stability", "compensation", "hip_offset_range", 0.04, 0.08), Limit("trunk_stability", "trunk_visibility", "trunk_visibility", 0.72, 0.52, True),
)


def _rank(limit: Limit, value: Column) -> Column:
    """0 good, 1 watch, 2 limited; null without a value or in another view."""
    over = (lambda t: value >= t) if limit.rising else (lambda t: value <= t)
    rank = F.when(over(limit.good), 0).when(over(limit.fair), 1).when(value.isNotNull(), 2)
    return F.when(F.col("view") == limit.view, rank) if limit.view else rank


def _named_rank(rank: Column) -> Column:
    return F.when(rank == 0, "good").when(rank == 1, "watch").when(rank == 2, "limited").otherwise("not_applicable")


def _side_seen(side: Column, visibility: Column) -> Column:
    return F.when(~F.coalesce(side.isin(*SIDES), F.lit(False)), "not_applicable").when(visibility < 0.45, "watch").otherwise("good")


def _more_ratings(action: str, value: Callable[[str], Column]) -> dict[str, Column]:
    """Ratings that ask for more than thresholds: whether the side is known and seen."""
    if action in ("active_leg_raise", "hurdle_step", "inline_lunge"):
        return {"side_confidence": _side_seen(front_side() if action == "inline_lunge" else F.col("side"), value("side_visibility"))}
    if action == "rotary_stability":
        both = _mean(value("side_confidence"), value("side_visibility"))
        return {"side_confidence": F.when(both.isNull(), "not_applicable").when(both >= 0.72, "good").when(both >= 0.45, "watch").otherwise("limited")}
    if action == "shoulder_mobility":
        size = value("reference_length")
        known = F.coalesce(F.col("side").isin(*SIDES, "bilateral"), F.lit(False))
        return {"shoulder_reference": F.when(size.isNull(), "not_applicable").when(size >= 0.1, "good").otherwise("watch"), "side_context": F.when(known, "good").otherwise("watch")}
    return {}


def ratings_of(action: str, value: Callable[[str], Column]) -> dict[str, Column]:
    """Each rating of an action by name; `value` gives a metric's column."""
    out: dict[str, Column] = {}
    for name in dict.fromkeys(x.rating for x in RATINGS if x.action == action):
        limits = [x for x in RATINGS if (x.action, x.rating) == (action, name)]
        ranks = [_rank(x, value(x.metric)) for x in limits]
        worst = F.greatest(*ranks) if len(ranks) > 1 else ranks[0]
        if any(x.whole for x in limits):
            worst = F.when(reduce(Column.__and__, [r.isNotNull() for r in ranks]), worst)
        out[name] = _named_rank(worst)
    return out | _more_ratings(action, value)


def features(frames: DataFrame, repetitions: DataFrame, keys: Sequence[str], kernels: dict[str, Callable[[], dict[str, Column]]] | None = None, digits: int = 4, bucket: float = 10.0) -> DataFrame:
    """(keys, id, action, view, side, status, source_second, metrics, ratings): repetitions of any of the kernels' actions, each by its own.

    `metrics` and `ratings` are maps; angles have one digit. A repetition without start and end has no cycle and no
    features, one of another action is unsupported. Ratings are made of metrics as they are, before rounding.
    """
    kernels = kernels or KERNELS
    posed = at_anchors(frames, repetitions, keys, bucket)
    wide = posed
    for action, kernel in kernels.items():
        made = kernel()
        # an action's metrics are computed once, as columns, for its rows alone; ratings read them
        wide = computed(wide.withColumn(f"_{action}", F.when(F.col("action") == action, F.struct(*[c.cast("double").alias(n) for n, c in made.items()]))))
        value = lambda n, a=action: finite(F.col(f"_{a}")[n])
        rounded = F.create_map(*[x for n in made for x in (F.lit(n), F.round(value(n), 1 if n.endswith(("angle", "lean", "twist")) else digits))])
        rated = F.create_map(*[x for n, c in ratings_of(action, value).items() for x in (F.lit(n), c)])
        wide = wide.withColumns({f"_{action}_metrics": F.when(F.col("action") == action, rounded), f"_{action}_ratings": F.when(F.col("action") == action, rated)}).drop(f"_{action}")
    values, ratings = (F.coalesce(*[F.col(f"_{action}_{part}") for action in kernels]) for part in ("metrics", "ratings"))
    known = F.col("action").isin(*kernels)
    status = F.when(~F.coalesce(known, F.lit(False)), "unsupported").when(F.col("start").isNull() | F.col("end").isNull(), "no_cycle").otherwise("ok")
    ok = status == "ok"
    return wide.select(*keys, "id", "action", "view", "side", status.alias("status"), F.when(ok, F.col("source_second")).alias("source_second"), F.when(ok, values).alias("metrics"), F.when(ok, ratings).alias("ratings"))


def rating_counts(rows: DataFrame) -> DataFrame:
    """(action, rating, status, n) over the usable repetitions."""
    return rows.where("status = 'ok'").select("action", F.explode("ratings").alias("rating", "status")).groupBy("action", "rating", "status").agg(F.count("*").alias("n"))
