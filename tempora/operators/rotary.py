"""Full cycles of a quadruped reach: setup, first touch, extension, second touch and return, with seven criteria.

All is columns and windows over one segment's frames, which are dealt by recording once. Distances are in lengths of the
body's frame, their median over the segment.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.scalars import finite, half_up, joint_angle, length
from tempora.operators.movements import SIDES, _both, _mean, _named, computed

CORE = tuple(_both("shoulder", "hip", "wrist", "knee", "ankle"))
HANDS = ("wrist", "thumb", "index", "pinky")
#: What moves: a hand, a knee and a foot of one side.
_MOVING = ("wrist", "knee", "ankle")
CRITERIA = ("movement_amplitude", "first_touch", "second_touch", "elbow_extension", "knee_extension", "return_control", "simultaneous_lift")


@dataclass(frozen=True)
class Rules:
    """What frames must show, how long setup and end are, and from where each criterion passes or fails."""

    visibility: float = 0.45
    frames: int = 12
    usable: float = 0.7
    setup: float = 0.12
    end: float = 0.12
    motion: float = 0.8
    touch: tuple[float, float] = (1.05, 1.45)
    elbow: tuple[float, float] = (150.0, 138.0)
    knee: tuple[float, float] = (145.0, 130.0)
    back: tuple[float, float] = (0.45, 0.85)
    lift: tuple[float, float] = (0.05, 0.15)
    onset: float = 0.2
    slow: float = 0.15


def criterion(value: Column, limits: tuple[float, float]) -> Column:
    """pass up to the first limit, fail from the second on, watch between; the other way round where the first is the larger. Unknown without a value."""
    passes, fails = limits
    good, bad = (value <= passes, value >= fails) if passes < fails else (value >= passes, value <= fails)
    return F.when(value.isNull(), "unknown").when(good, "pass").when(bad, "fail").otherwise("watch")


def _span(a: Column, b: Column) -> Column:
    return length(a["x"] - b["x"], a["y"] - b["y"])


def _middle(*points: Column) -> Column:
    n = len(points)
    return F.struct((sum((p["x"] for p in points[1:]), points[0]["x"]) / n).alias("x"), (sum((p["y"] for p in points[1:]), points[0]["y"]) / n).alias("y"))


def _states(frames: DataFrame, segments: DataFrame, keys: Sequence[str], rules: Rules) -> DataFrame:
    """The frames of each segment: its points where they are seen, null elsewhere, the frame's own length, and whether all of CORE are seen."""
    names = list(dict.fromkeys([*CORE, *_both("elbow"), *_both(*HANDS)]))
    rows = _named(frames, keys, names)

    def seen(name: str) -> Column:
        p = F.col(name)
        good = finite(p["x"]).isNotNull() & finite(p["y"]).isNotNull() & (finite(p["visibility"]).isNull() | (p["visibility"] >= rules.visibility))
        return F.when(good, F.struct(p["x"].alias("x"), p["y"].alias("y"), p["visibility"].alias("visibility"))).alias(name)

    rows = rows.join(segments.select(*keys, "id", "start", "end"), list(keys)).where(F.col("second").between(F.col("start"), F.col("end")))
    rows = computed(rows.select(*keys, "id", "second", *map(seen, names)))
    whole = F.lit(True)
    for name in CORE:
        whole = whole & F.col(name).isNotNull()
    size = _mean(_span(F.col("left_shoulder"), F.col("right_shoulder")), _span(F.col("left_hip"), F.col("right_hip")), *[_span(F.col(f"{s}_shoulder"), F.col(f"{s}_hip")) for s in SIDES])
    shown = _mean(*[finite(F.col(n)["visibility"]) for n in CORE])
    every = Window.partitionBy(*keys, "id")
    rows = computed(rows.withColumns({"_length": F.when(whole, size), "_shown": shown}))
    return rows.withColumn("_whole", F.coalesce(F.col("_length") > 0, F.lit(False))).withColumn("source_frames", F.count("*").over(every))


def full_cycles(frames: DataFrame, segments: DataFrame, keys: Sequence[str], rules: Rules | None = None) -> DataFrame:
    """(keys, id, status, issues, pose_side, the seconds of seven phases, value and status of seven criteria, metrics) for each segment (id, start, end).

    Setup and end are the first and last frames (an eighth, three at least). The side that moves farther from its setup,
    the left if neither, is followed: extension is the first frame between setup and end that reaches farthest, and the
    touches are those before and after it with hand and ankle nearest. Evidence is insufficient with too few usable frames,
    or where the three don't follow one another.
    """
    rules = rules or Rules()
    key = [*keys, "id"]
    every, w = Window.partitionBy(*key), Window.partitionBy(*key).orderBy("second")
    rows = _states(frames, segments, keys, rules).where("_whole").withColumn("_i", F.row_number().over(w) - 1).withColumn("usable_frames", F.count("*").over(every))
    n = F.col("usable_frames")
    rows = rows.where((n >= rules.frames) & (n / F.greatest(F.lit(1), F.col("source_frames")) >= rules.usable))
    rows = rows.withColumn("_setup", F.greatest(F.lit(3), half_up(n * rules.setup))).withColumn("_end", F.greatest(F.lit(3), half_up(n * rules.end)))
    first, last = F.col("_i") < F.col("_setup"), F.col("_i") >= n - F.col("_end")

    def medians(name: str, test: Column) -> Column:
        return F.struct(*[F.median(F.when(test, F.col(name)[a])).over(every).alias(a) for a in "xy"])

    rows = rows.withColumns({
        **{f"_s_{name}": medians(name, first) for name in CORE}, **{f"_e_{name}": medians(name, last) for name in _both(*_MOVING)}, "_ref": F.median("_length").over(every),
        "setup_second": F.median(F.when(first, F.col("second"))).over(every), "return_second": F.median(F.when(last, F.col("second"))).over(every), "_step": F.col("second") - F.lag("second").over(w),
    })
    ref = F.col("_ref")
    rows = rows.withColumns({f"_d_{name}": _span(F.col(name), F.col(f"_s_{name}")) / ref for name in _both(*_MOVING)})
    moved = {s: F.max(_mean(*[F.col(f"_d_{s}_{j}") for j in _MOVING])).over(every) for s in SIDES}
    rows = rows.withColumns({f"{s}_motion": F.coalesce(m, F.lit(0.0)) for s, m in moved.items()}).withColumn("pose_side", F.when(F.col("left_motion") >= F.col("right_motion"), "left").otherwise("right"))
    # from here on, names say m_ for the side that moves and h_ for the one that holds
    left = F.col("pose_side") == "left"
    pick = lambda part, mark="": F.when(left, F.col(f"{mark}left_{part}")).otherwise(F.col(f"{mark}right_{part}"))
    other = lambda part, mark="": F.when(left, F.col(f"{mark}right_{part}")).otherwise(F.col(f"{mark}left_{part}"))
    kept = [*key, "second", "_i", "_setup", "_end", "_step", "_shown", "_ref", "usable_frames", "setup_second", "return_second", "left_motion", "right_motion", "pose_side"]
    rows = computed(rows.select(
        *kept, *[pick(p).alias(f"m_{p}") for p in ("shoulder", "hip", "knee", "ankle", "elbow", *HANDS)], *[pick(p, "_d_").alias(f"m_d_{p}") for p in _MOVING], *[pick(p, f"_{x}_").alias(f"m_{x}_{p}") for x in "se" for p in _MOVING],
        *[other(p).alias(f"h_{p}") for p in ("wrist", "knee")], *[other(p, "_s_").alias(f"h_s_{p}") for p in ("wrist", "knee")],
        _middle(*[F.col(f"{s}_{p}") for p in ("shoulder", "hip") for s in SIDES]).alias("_trunk"), _middle(*[F.col(f"_s_{s}_{p}") for p in ("shoulder", "hip") for s in SIDES]).alias("_s_trunk"),
    ))
    m = lambda part: F.col(f"m_{part}")
    angle = lambda a, b, c: joint_angle(*[m(p)[x] for p in (a, b, c) for x in "xy"])
    rows = computed(rows.select(
        *kept, *[m(f"d_{p}") for p in _MOVING], F.col("m_elbow").isNotNull().alias("_elbow_seen"), _mean(*[m(f"d_{j}") for j in _MOVING]).alias("_amplitude"),
        (F.least(*[_span(m(h), m("ankle")) for h in HANDS]) / ref).alias("_touch"),  # least() passes over hands that aren't seen
        (_mean(_span(m("shoulder"), m("wrist")), _span(m("hip"), m("ankle"))) / ref).alias("_far"), angle("shoulder", "elbow", "wrist").alias("_elbow"), angle("hip", "knee", "ankle").alias("_knee"),
        _mean(*[_span(F.col(f"h_{j}"), F.col(f"h_s_{j}")) / ref for j in ("wrist", "knee")]).alias("_drift"), (_span(F.col("_trunk"), F.col("_s_trunk")) / ref).alias("_shift"), _mean(*[_span(m(f"e_{j}"), m(f"s_{j}")) / ref for j in _MOVING]).alias("_back"),
    ))
    begin = F.least(F.col("_setup"), n - 1)
    searched = (F.col("_i") >= begin) & (F.col("_i") < F.greatest(begin + 1, n - F.col("_end")))
    at_top = F.struct(F.col("_i").alias("i"), F.col("second").alias("second"), F.col("_amplitude").alias("amplitude"), F.col("_elbow").alias("elbow"), F.col("_knee").alias("knee"))
    rows = rows.withColumn("_top", F.max_by(at_top, F.when(searched, F.struct(F.round(F.col("_far") + F.col("_amplitude"), 9), -F.col("_i")))).over(every))
    near = lambda test: F.min(F.when(searched & test, F.struct(F.round("_touch", 9).alias("value"), F.col("_i").alias("i"), F.col("second").alias("second")))).over(every)
    rows = rows.withColumn("_first", near(F.col("_i") <= F.col("_top.i"))).withColumn("_second", near(F.col("_i") >= F.col("_top.i")))
    lifts = {}
    for joint, name in (("wrist", "hand_lift_second"), ("knee", "knee_lift_second")):
        jitter = F.max(F.when(first, F.col(f"m_d_{joint}"))).over(every)
        rows = rows.withColumn(f"_from_{joint}", F.greatest(F.lit(rules.onset), jitter * 3))
        lifts[name] = F.min(F.when(~first & (F.col("_i") <= F.coalesce("_first.i", "_top.i")) & (F.col(f"m_d_{joint}") >= F.col(f"_from_{joint}")), F.col("second"))).over(every)
    rows = rows.withColumns({
        **lifts, "support_drift": F.max("_drift").over(every), "trunk_shift": F.max("_shift").over(every), "frame_interval": F.median("_step").over(every), "mean_visibility": F.round(F.avg("_shown").over(every), 9),
        "elbow_usable": F.count_if("_elbow_seen").over(every) / n,
    }).where("_i = 0")
    values = {
        "movement_amplitude": F.col("_top.amplitude"), "first_touch": F.col("_first.value"), "second_touch": F.col("_second.value"), "elbow_extension": F.col("_top.elbow"), "knee_extension": F.col("_top.knee"),
        "return_control": F.col("_back"), "simultaneous_lift": F.round(F.abs(F.col("hand_lift_second") - F.col("knee_lift_second")), 9),
    }
    limits = {"first_touch": rules.touch, "second_touch": rules.touch, "elbow_extension": rules.elbow, "knee_extension": rules.knee, "return_control": rules.back, "simultaneous_lift": rules.lift}
    statuses = {c: criterion(values[c], limits[c]) for c in CRITERIA[1:]} | {"movement_amplitude": F.when(values["movement_amplitude"] >= rules.motion, "pass").otherwise("fail")}
    ordered = F.coalesce((F.col("_first.second") < F.col("_top.second")) & (F.col("_top.second") < F.col("_second.second")), F.lit(False))
    issues = F.array_compact(F.array(F.when(~ordered, F.lit("full_cycle_phase_order_not_supported")), F.when(F.col("frame_interval") > rules.slow, F.lit("temporal_resolution_limits_lift_timing"))))
    digits = {"elbow_extension": 1, "knee_extension": 1, "simultaneous_lift": 2}
    found = rows.select(
        *key, F.when(ordered, "ok").otherwise("insufficient_evidence").alias("status"), issues.alias("issues"), "pose_side",
        *[F.round(c, 2).alias(name) for name, c in (("setup_second", "setup_second"), ("hand_lift_second", "hand_lift_second"), ("knee_lift_second", "knee_lift_second"), ("first_touch_second", "_first.second"), ("extension_second", "_top.second"), ("second_touch_second", "_second.second"), ("return_second", "return_second"))],
        *[F.round(values[c], digits.get(c, 3)).alias(c) for c in CRITERIA], *[statuses[c].alias(f"{c}_status") for c in CRITERIA],
        "usable_frames", *[F.round(c, 3).alias(c) for c in ("mean_visibility", "elbow_usable", "frame_interval", "left_motion", "right_motion", "support_drift", "trunk_shift")], F.round("_ref", 4).alias("reference_length"),
    )
    thin = F.col("status").isNull()
    out = segments.select(*key).join(found, key, "left")
    return out.withColumn("issues", F.when(thin, F.array(F.lit("insufficient_full_cycle_pose"))).otherwise(F.col("issues"))).withColumn("status", F.coalesce("status", F.lit("insufficient_evidence")))
