"""Features and ratings of repetitions, and full cycles, on the frames made of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.operators import anchors as N
from tempora.operators import rotary as R
from tempora.operators import suggestions as G
from tempora.plans.catalog import query, table
from tempora.plans.movements import _FRAMES, _PIECES, _frames, _pieces, _slope, _span

_ACTIONS = list(N.KERNELS)
_SIGNALS = ("peak_depth_ratio", "baseline_depth_ratio", "peak_elevation", "peak_clearance", "lift", "hip_offset", "hip_offset_range", "elbow_angle")
#: How a repetition's detected numbers are made of its number. Read by both engines.
_MADE = {
    "peak_depth_ratio": "0.56e0 + 0.03e0 * (id % 8)", "baseline_depth_ratio": "0.3e0 + 0.01e0 * (id % 8)", "peak_elevation": "0.02e0 * (id % 9)", "peak_clearance": "0.05e0 + 0.02e0 * (id % 5)", "lift": "0.2e0 + 0.05e0 * (id % 5)",
    "hip_offset": "0.03e0 + 0.02e0 * (id % 6)", "hip_offset_range": "0.02e0 + 0.02e0 * (id % 5)", "elbow_angle": "130e0 + 9e0 * (id % 5)",
}
_FORM = {
    "view": "CASE id % 3 WHEN 0 THEN 'front' WHEN 1 THEN 'side' END", "side": "CASE id % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'unknown' ELSE 'left' END", "start": "CASE WHEN id <> 20 THEN id * 2.4e0 END", "end": "id * 2.4e0 + 8",
    "anchor": "CASE WHEN id <> 13 THEN id * 2.4e0 + 4.1e0 END",
}
_REPS = f"""r AS (SELECT user_id, id, [{', '.join(repr(a) for a in [*_ACTIONS, 'jump'])}][1 + id % 8] AS action, {', '.join(f'{e} AS "{c}"' for c, e in _FORM.items())}, {', '.join(f'{e} AS {c}' for c, e in _MADE.items())}
FROM (SELECT user_id, unnest(range(0, 24)) AS id FROM (SELECT DISTINCT user_id FROM events)))"""
_NEAR = f"""
na AS (SELECT * FROM (SELECT r.*, f.* EXCLUDE (user_id), row_number() OVER (PARTITION BY r.user_id, r.id ORDER BY CASE WHEN r.anchor IS NULL THEN 0 ELSE abs(f.second - r.anchor) END, f.second) AS n FROM r JOIN f ON r.user_id = f.user_id) WHERE n = 1),
ns AS (SELECT user_id, id, {', '.join(f'{s}_ankle_{a} AS {s}_start_{a}' for s in N.SIDES for a in 'xy')} FROM (SELECT r.user_id, r.id, f.* EXCLUDE (user_id), row_number() OVER (PARTITION BY r.user_id, r.id ORDER BY abs(f.second - r.start), f.second) AS n FROM r JOIN f ON r.user_id = f.user_id WHERE r.start IS NOT NULL) WHERE n = 1),
dr AS (SELECT r.user_id, r.id, max(left_ankle_x) - min(left_ankle_x) AS left_drift, max(right_ankle_x) - min(right_ankle_x) AS right_drift FROM r JOIN f ON r.user_id = f.user_id AND f.second BETWEEN r.start AND r."end" GROUP BY 1, 2),
p AS (SELECT * FROM na LEFT JOIN ns USING (user_id, id) LEFT JOIN dr USING (user_id, id))"""


def _repetitions(spark, sf_dir):
    ids = table(spark, sf_dir, "events").select("user_id").distinct().withColumn("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))))
    action = F.element_at(F.array(*[F.lit(a) for a in [*_ACTIONS, "jump"]]), (F.col("id") % 8 + 1).cast("int"))
    signals = F.create_map(*[x for n in _SIGNALS for x in (F.lit(n), F.expr(_MADE[n]))])
    return ids.select("user_id", "id", action.alias("action"), *[F.expr(e).alias(c) for c, e in _FORM.items()], signals.alias("signals"))


def _of(side: str, part: str, axis: str) -> str:
    return f"(CASE WHEN {side} = 'left' THEN left_{part}_{axis} WHEN {side} = 'right' THEN right_{part}_{axis} END)"


def _far(ax: str, ay: str, bx: str, by: str) -> str:
    return f"sqrt(pow({ax} - {bx}, 2) + pow({ay} - {by}, 2))"


def _corner(*xy: str) -> str:
    ax, ay, bx, by, cx, cy = xy
    dot = f"(({ax} - {bx}) * ({cx} - {bx}) + ({ay} - {by}) * ({cy} - {by}))"
    return f"(CASE WHEN {dot} IS NOT NULL THEN degrees(acos(greatest(-1, least(1, {dot} / ({_far(ax, ay, bx, by)} * {_far(cx, cy, bx, by)}))))) END)"


def _sided_corner(side: str, *parts: str) -> str:
    return _corner(*[_of(side, p, a) for p in parts for a in "xy"])


def _both_corners(*parts: str) -> str:
    return "(" + " + ".join(_corner(*[f"{s}_{p}_{a}" for p in parts for a in "xy"]) for s in N.SIDES) + ") / 2"


_DOWN = "(CASE WHEN side = 'left' THEN 'right' ELSE 'left' END)"
_FRONT = "(CASE WHEN left_knee_y >= right_knee_y THEN 'left' ELSE 'right' END)"
_REAR = f"(CASE WHEN {_FRONT} = 'left' THEN 'right' ELSE 'left' END)"
_SHOWN = {n: f"({' + '.join(['vis'] * n)}) / {n}" for n in (2, 4, 8)}  # means of equal numbers, added up as the operator does
_KNOWN = f"CASE WHEN side IN ('left', 'right') THEN {_SHOWN[4]} END"
_GAP, _OFFSET = "abs(left_hip_y - right_hip_y)", "abs((left_shoulder_x + right_shoulder_x) / 2 - (left_hip_x + right_hip_x) / 2)"
_TORSO = f"({_span('left_shoulder', 'left_hip')} + {_span('right_shoulder', 'right_hip')}) / 2"
_LENGTH = f"(({_span('left_shoulder', 'right_shoulder')} + {_span('left_hip', 'right_hip')} + {_TORSO}) / 3)"
_REACH = {f"{s}_{n}": f"({_span(f'{s}_{a}', f'{s}_{b}')} / {_LENGTH})" for n, a, b in (("arm", "wrist", "shoulder"), ("leg", "ankle", "hip")) for s in N.SIDES}
_SCORES = "list_sort([" + ", ".join(f"round({_REACH[f'{arm}_arm']} + {_REACH[f'{leg}_leg']}, 9)" for _, _, arm, leg in N.PATTERNS) + "], 'DESC')"
_TURN = f"(abs({_slope('shoulder')} - {_slope('hip')}) % 180)"
_LEAN = "(" + " + ".join(f"abs(degrees(atan2({s}_knee_x - {s}_ankle_x, {s}_ankle_y - {s}_knee_y)))" for s in N.SIDES) + ") / 2"
_TRUNK = "abs(degrees(atan2((left_hip_x + right_hip_x) / 2 - (left_shoulder_x + right_shoulder_x) / 2, (left_hip_y + right_hip_y) / 2 - (left_shoulder_y + right_shoulder_y) / 2)))"
_DRIFT = lambda side: f"(CASE WHEN {side} = 'left' THEN left_drift WHEN {side} = 'right' THEN right_drift END)"

_METRICS = {
    "deep_squat": {
        "peak_depth_ratio": "peak_depth_ratio", "hip_knee_gap": "(left_hip_y + right_hip_y) / 2 - (left_knee_y + right_knee_y) / 2", "hip_angle": _both_corners("shoulder", "hip", "knee"), "knee_angle": _both_corners("hip", "knee", "ankle"),
        "ankle_angle": _both_corners("knee", "ankle", "foot_index"), "shank_lean": _LEAN, "trunk_lean": _TRUNK, "left_knee_offset": "left_knee_x - left_ankle_x", "right_knee_offset": "right_knee_x - right_ankle_x",
        "knee_offset": "greatest(abs(left_knee_x - left_ankle_x), abs(right_knee_x - right_ankle_x))",
    },
    "active_leg_raise": {
        "ankle_above_hip": f"{_of('side', 'hip', 'y')} - {_of('side', 'ankle', 'y')}", "foot_above_hip": f"{_of('side', 'hip', 'y')} - {_of('side', 'foot_index', 'y')}", "knee_angle": _sided_corner("side", "hip", "knee", "ankle"),
        "down_knee_angle": _sided_corner(_DOWN, "hip", "knee", "ankle"), "down_ankle_drift": _far(_of(_DOWN, "ankle", "x"), _of(_DOWN, "ankle", "y"), _of(_DOWN, "start", "x"), _of(_DOWN, "start", "y")), "hip_gap": _GAP,
        "peak_elevation": "peak_elevation", "side_visibility": _KNOWN,
    },
    "hurdle_step": {
        "peak_clearance": "peak_clearance", "stance_ankle_drift": f"CASE WHEN view = 'front' THEN {_DRIFT(_DOWN)} END", "raw_stance_ankle_drift": _DRIFT(_DOWN), "stance_knee_angle": f"CASE WHEN view = 'front' THEN {_sided_corner(_DOWN, 'hip', 'knee', 'ankle')} END",
        "raw_stance_knee_angle": _sided_corner(_DOWN, "hip", "knee", "ankle"), "step_knee_angle": _sided_corner("side", "hip", "knee", "ankle"), "knee_line_offset": f"abs({_of('side', 'knee', 'x')} - ({_of('side', 'hip', 'x')} + {_of('side', 'ankle', 'x')}) / 2)",
        "centre_offset": _OFFSET, "hip_gap": _GAP, "side_visibility": _KNOWN,
    },
    "inline_lunge": {
        "peak_depth_ratio": "peak_depth_ratio", "baseline_depth_ratio": "baseline_depth_ratio", "centre_offset": _OFFSET, "hip_gap": _GAP, "knee_foot_offset": f"abs({_of(_FRONT, 'knee', 'x')} - ({_of(_FRONT, 'ankle', 'x')} + {_of(_FRONT, 'foot_index', 'x')}) / 2)",
        "rear_ankle_drift": _DRIFT(_REAR), "side_visibility": _SHOWN[4], "rear_visibility": _SHOWN[4],
    },
    "rotary_stability": {
        "reach": f"{_SCORES}[1]", **{f"{k}_reach": v for k, v in _REACH.items()}, "trunk_twist": f"CASE WHEN {_TURN} > 90 THEN 180 - {_TURN} ELSE {_TURN} END", "centre_offset": _OFFSET, "hip_gap": _GAP, "side_visibility": _SHOWN[8],
        "side_confidence": f"greatest(0, least(1, ({_SCORES}[1] - greatest(0, {_SCORES}[2])) / greatest(0.01, {_SCORES}[1])))",
    },
    "shoulder_mobility": {
        "wrist_ratio": f"{_span('left_wrist', 'right_wrist')} / greatest(0.01, {_TORSO})", "index_ratio": "CAST(NULL AS DOUBLE)", "shoulder_width": _span("left_shoulder", "right_shoulder"), "torso_length": _TORSO, "reference_length": _TORSO, "hand_visibility": _SHOWN[2],
    },
    "trunk_stability": {"lift": "lift", "hip_offset": "hip_offset", "hip_offset_range": "hip_offset_range", "elbow_angle": "elbow_angle", "trunk_visibility": _SHOWN[8]},
}


def _two(x: str, good: float, fair: float, rising: bool = False) -> str:
    """good, watch or limited by two thresholds."""
    op = ">=" if rising else "<="
    return f"CASE WHEN {x} IS NULL THEN 'not_applicable' WHEN {x} {op} {good} THEN 'good' WHEN {x} {op} {fair} THEN 'watch' ELSE 'limited' END"


def _viewed(view: str, case: str) -> str:
    return f"CASE WHEN view IS DISTINCT FROM '{view}' THEN 'not_applicable' ELSE {case} END"


_PELVIS = "CASE WHEN centre_offset > 0.08 OR hip_gap > 0.08 THEN 'limited' WHEN centre_offset > 0.04 OR hip_gap > 0.045 THEN 'watch' ELSE 'good' END"
_SEEN = "CASE WHEN side NOT IN ('left', 'right') THEN 'not_applicable' WHEN side_visibility < 0.45 THEN 'watch' ELSE 'good' END"
#: Written from the rules, rating by rating, and not from N.RATINGS.
_RATED = {
    "deep_squat": {
        "depth": _two("hip_knee_gap", 0.025, -0.015, True), "torso_control": _viewed("side", _two("trunk_lean", 24, 34)), "knee_alignment": _viewed("front", _two("knee_offset", 0.04, 0.08)), "hip_angle": _viewed("side", _two("hip_angle", 115, 140)),
        "knee_angle": _viewed("side", _two("knee_angle", 105, 135)), "ankle_angle": _viewed("side", _two("shank_lean", 18, 10, True)),
    },
    "active_leg_raise": {
        "leg_raise": _two("ankle_above_hip", 0.16, 0.06, True), "hip_flexion": _two("ankle_above_hip", 0.16, 0.06, True), "knee_extension": _two("knee_angle", 160, 140, True),
        "down_leg_control": "CASE WHEN (down_knee_angle IS NULL OR down_knee_angle >= 160) AND (down_ankle_drift IS NULL OR down_ankle_drift <= 0.05) THEN 'good' WHEN (down_knee_angle IS NULL OR down_knee_angle >= 145) AND (down_ankle_drift IS NULL OR down_ankle_drift <= 0.09) THEN 'watch' ELSE 'limited' END",
        "pelvic_stability": _two("hip_gap", 0.06, 0.1), "side_confidence": _SEEN,
    },
    "hurdle_step": {
        "clearance": _two("peak_clearance", 0.12, 0.07, True), "stance_leg_control": "CASE WHEN stance_ankle_drift IS NULL AND stance_knee_angle IS NULL THEN 'not_applicable' WHEN stance_ankle_drift > 0.07 OR stance_knee_angle < 160 THEN 'limited' WHEN stance_ankle_drift > 0.035 OR stance_knee_angle < 170 THEN 'watch' ELSE 'good' END",
        "step_leg_alignment": _two("knee_line_offset", 0.035, 0.065), "pelvis_trunk_control": _PELVIS, "step_clearance": _two("peak_clearance", 0.12, 0.07, True), "stance_stability": _two("stance_ankle_drift", 0.035, 0.07), "trunk_control": _two("centre_offset", 0.04, 0.08), "side_confidence": _SEEN,
    },
    "inline_lunge": {
        "depth_zone": _two("peak_depth_ratio", 0.7, 0.62, True), "trunk_pelvis_control": _PELVIS, "knee_foot_line": _two("knee_foot_offset", 0.045, 0.09), "rear_leg_control": "CASE WHEN rear_visibility < 0.45 OR rear_ankle_drift > 0.075 THEN 'limited' WHEN rear_ankle_drift > 0.04 THEN 'watch' ELSE 'good' END",
        "depth": _two("peak_depth_ratio", 0.7, 0.62, True), "trunk_alignment": _two("centre_offset", 0.04, 0.08), "knee_foot_alignment": _two("knee_foot_offset", 0.045, 0.09), "side_confidence": "CASE WHEN side_visibility < 0.45 THEN 'watch' ELSE 'good' END",
    },
    "rotary_stability": {
        "diagonal_control": _two("reach", 1.3, 0.9, True), "trunk_rotation": _two("trunk_twist", 15, 30), "balance": "CASE WHEN centre_offset <= 0.08 AND hip_gap <= 0.08 THEN 'good' WHEN centre_offset <= 0.15 AND hip_gap <= 0.14 THEN 'watch' ELSE 'limited' END",
        "side_confidence": _two("(side_confidence + side_visibility) / 2", 0.72, 0.45, True),
    },
    "shoulder_mobility": {
        "reach_distance": _two("wrist_ratio", 0.18, 0.42), "hand_visibility": _two("hand_visibility", 0.65, 0.45, True), "shoulder_reference": "CASE WHEN reference_length >= 0.1 THEN 'good' ELSE 'watch' END", "side_context": "CASE WHEN side IN ('left', 'right', 'bilateral') THEN 'good' ELSE 'watch' END",
    },
    "trunk_stability": {
        "push_up": _two("lift", 0.38, 0.24, True), "core_stability": _two("hip_offset", 0.055, 0.105), "arm_extension": _two("elbow_angle", 160, 140, True), "compensation": _two("hip_offset_range", 0.04, 0.08), "trunk_visibility": _two("trunk_visibility", 0.72, 0.52, True),
    },
}


def _digits(name: str) -> int:
    return 1 if name.endswith(("angle", "lean", "twist")) else 4


def _action_sql(action: str) -> str:
    made = ", ".join(f"{e} AS {c}" for c, e in _METRICS[action].items())
    ok = '"start" IS NOT NULL'
    shown = ", ".join([*(f"CASE WHEN {ok} THEN round({c}, {_digits(c)}) END AS {c}" for c in _METRICS[action]), *(f"CASE WHEN {ok} THEN {e} END AS {c}_rating" for c, e in _RATED[action].items())])
    return f"""WITH {_FRAMES}, {_REPS}, {_NEAR}, m AS (SELECT user_id, id, view, side, "start", second, {made} FROM p WHERE action = '{action}')
SELECT user_id, id, CASE WHEN {ok} THEN 'ok' ELSE 'no_cycle' END AS status, CASE WHEN {ok} THEN second END AS source_second, {shown} FROM m"""


def _action_rows(spark, sf_dir, action):
    found = N.features(_frames(spark, sf_dir), _repetitions(spark, sf_dir).where(F.col("action") == action), ["user_id"], {action: N.KERNELS[action]})
    return found.select(
        "user_id", "id", "status", "source_second", *[F.try_element_at("metrics", F.lit(c)).alias(c) for c in _METRICS[action]], *[F.try_element_at("ratings", F.lit(c)).alias(f"{c}_rating") for c in _RATED[action]],
    )


def _declare(action: str) -> None:
    def run(spark, sf_dir):
        return _action_rows(spark, sf_dir, action)

    run.__name__ = f"features_{action}"
    run.__doc__ = f"Features and ratings of {action} at its anchors."
    query(_action_sql(action))(run)


for _action in _ACTIONS:
    _declare(_action)

_COUNTED = " UNION ALL ".join(
    f"SELECT '{a}' AS action, x.r AS rating, x.s AS status FROM (SELECT unnest([{', '.join(f"{{'r': '{c}', 's': {e}}}" for c, e in _RATED[a].items())}]) AS x FROM (SELECT view, side, {', '.join(f'{e} AS {c}' for c, e in _METRICS[a].items())} FROM p WHERE action = '{a}' AND \"start\" IS NOT NULL))" for a in _ACTIONS
)


@query(f"WITH {_FRAMES}, {_REPS}, {_NEAR} SELECT action, rating, status, count(*) AS n FROM ({_COUNTED}) GROUP BY 1, 2, 3")
def rating_counts(spark, sf_dir):
    """All actions in one plan."""
    return N.rating_counts(N.features(_frames(spark, sf_dir), _repetitions(spark, sf_dir), ["user_id"]))


# ---- suggested scores

#: What timing says of a repetition, and what it asks for. Read by both engines.
_TIMED = {"visibility": "CASE WHEN id % 5 <> 0 THEN 0.4e0 + 0.05e0 * (id % 9) END", "coverage": "CASE WHEN id % 7 <> 0 THEN 0.1e0 * (id % 11) END", "raised": "id % 6 = 0", "version": "CASE WHEN id % 16 = 10 THEN 2 WHEN id = 23 THEN 9 END"}
#: Written from the rules: groups of ratings whose least makes a sub-score, and the version.
_SUBSCORES = {
    "deep_squat": (2, ["depth"], ["knee_alignment"], ["torso_control"]), "active_leg_raise": (3, ["leg_raise"], ["down_leg_control", "pelvic_stability"], ["knee_extension", "side_confidence"]),
    "hurdle_step": (3, ["clearance"], ["stance_leg_control", "pelvis_trunk_control"], ["step_leg_alignment", "side_confidence"]), "inline_lunge": (2, ["depth_zone"], ["trunk_pelvis_control", "rear_leg_control"], ["knee_foot_line", "side_confidence"]),
    "shoulder_mobility": (1, ["reach_distance"], ["reach_distance", "shoulder_reference"], ["hand_visibility", "side_context"]), "trunk_stability": (1, ["core_stability", "trunk_visibility"], ["push_up", "arm_extension"], ["compensation"]),
}


def _suggestion_sql(action: str) -> str:
    version, *groups = _SUBSCORES[action]
    names = list(dict.fromkeys(n for g in groups for n in g))
    value = lambda n: f"CASE r_{n} WHEN 'limited' THEN 1 {'' if n == 'knee_extension' else chr(39).join(('WHEN ', 'watch', ' THEN 2'))} ELSE 3 END"
    subs = ", ".join(f"least({', '.join(value(n) for n in g)}, 3) AS s{k}" for k, g in enumerate(groups))
    seen = "coalesce(visibility, 0)" if action != "shoulder_mobility" else "least(1, coalesce(round(hand_visibility, 4), visibility, 0) * 0.55e0 + coalesce(visibility, round(hand_visibility, 4), 0) * 0.45e0)"
    rated = " + ".join(f"CAST(r_{n} <> 'not_applicable' AS INT)" for n in names)
    gate = "version IS NULL AND least(s0, s1, s2) = 1" if action == "hurdle_step" else "false"
    staged = action == "deep_squat"
    return f"""SELECT user_id, id, '{action}' AS action, ok, coalesce(version, {version}) AS v, coalesce(version, {version}) IN ({'2, 3' if action == 'hurdle_step' else version}) AS has, {gate} AS manual, {'NOT raised AND least(s0, s1, s2) < 3' if staged else 'false'} AS asks, {'raised' if staged else 'false'} AS up, s0, s1, s2,
round(least(1, ({rated}) / {len(names)}e0 * 0.45e0 + {seen} * 0.35e0 + coalesce(coverage, 0) * 0.2e0), 9) AS conf
FROM (SELECT *, {subs} FROM (SELECT *, {', '.join(f'{e} AS r_{c}' for c, e in _RATED[action].items() if c in names)} FROM (SELECT user_id, id, view, side, "start" IS NOT NULL AS ok, {', '.join(f'{e} AS {c}' for c, e in _TIMED.items())}, {', '.join(f'{e} AS {c}' for c, e in _METRICS[action].items())} FROM p WHERE action = '{action}')))"""


@query(f"""WITH {_FRAMES}, {_REPS}, {_NEAR}, each AS ({' UNION ALL '.join(map(_suggestion_sql, _SUBSCORES))}),
told AS (SELECT *, CASE WHEN NOT has THEN 'unsupported' WHEN NOT ok THEN 'insufficient_evidence' WHEN manual THEN 'needs_manual_review' WHEN asks THEN 'needs_heel_elevated_attempt' ELSE 'suggested' END AS suggestion_status, has AND ok AS made, CASE WHEN has AND ok THEN CASE WHEN manual THEN 0.48 ELSE round(conf, 2) END ELSE 0 END AS confidence FROM each)
SELECT user_id, id, action, suggestion_status, CASE WHEN suggestion_status = 'suggested' THEN CASE WHEN up THEN least(s0, s1, s2, 2) ELSE least(s0, s1, s2) END END AS total, CASE WHEN made THEN least(s0, s1, s2) END AS raw,
CASE WHEN made THEN concat_ws(',', CASE WHEN up THEN least(s0, 2) ELSE s0 END, CASE WHEN up THEN least(s1, 2) ELSE s1 END, CASE WHEN up THEN least(s2, 2) ELSE s2 END) END AS subscores, CAST(confidence AS DOUBLE) AS confidence,
CASE WHEN confidence >= 0.72 THEN 'high' WHEN confidence >= 0.52 THEN 'medium' ELSE 'low' END AS confidence_label, CASE WHEN has THEN v END AS model FROM told
UNION ALL SELECT user_id, id, action, 'unsupported', NULL, NULL, NULL, 0, 'low', NULL FROM r WHERE action IN ('rotary_stability', 'jump')""")
def suggested_scores(spark, sf_dir):
    """All actions and two versions of one model in one plan."""
    made = N.features(_frames(spark, sf_dir), _repetitions(spark, sf_dir), ["user_id"]).select("*", *[F.expr(e).alias(c) for c, e in _TIMED.items()])
    found = G.suggestions(made)
    return found.select("user_id", "id", "action", "suggestion_status", "total", "raw", F.array_join("subscores", ",").alias("subscores"), "confidence", "confidence_label", "model")


# ---- full cycles

_ALL = [f"{s}_{p}" for p in ("shoulder", "hip", "wrist", "knee", "ankle") for s in R.SIDES]
_MOVES = ("wrist", "knee", "ankle")
_MOVE = lambda part, axis, mark="": f"(CASE WHEN pose_side = 'left' THEN {mark}left_{part}_{axis} ELSE {mark}right_{part}_{axis} END)"
_HOLD = lambda part, axis, mark="": f"(CASE WHEN pose_side = 'left' THEN {mark}right_{part}_{axis} ELSE {mark}left_{part}_{axis} END)"
_CENTRE = lambda axis, mark="": f"(({mark}left_shoulder_{axis} + {mark}right_shoulder_{axis} + {mark}left_hip_{axis} + {mark}right_hip_{axis}) / 4)"
_STATUS = lambda c, good, bad, op="<=": f"CASE WHEN {c} IS NULL THEN 'unknown' WHEN {c} {op} {good} THEN 'pass' WHEN {c} {'>=' if op == '<=' else '<='} {bad} THEN 'fail' ELSE 'watch' END AS {c}_status"


@query(f"""
WITH {_FRAMES}, {_PIECES},
src AS (SELECT g.user_id, g.id, f.* EXCLUDE (user_id) FROM g JOIN f ON g.user_id = f.user_id AND f.second BETWEEN g.s AND g.e), cn AS (SELECT user_id, id, count(*) AS total, count(*) FILTER (vis >= 0.45) AS n FROM src GROUP BY 1, 2),
st AS (SELECT src.*, n, row_number() OVER (PARTITION BY user_id, id ORDER BY second) - 1 AS i, greatest(3, floor(n * 0.12e0 + 0.5)) AS k, ({_span('left_shoulder', 'right_shoulder')} + {_span('left_hip', 'right_hip')} + {_span('left_shoulder', 'left_hip')} + {_span('right_shoulder', 'right_hip')}) / 4 AS len
FROM src JOIN cn USING (user_id, id) WHERE vis >= 0.45 AND n >= 12 AND n / CAST(total AS DOUBLE) >= 0.7),
lagged AS (SELECT *, second - lag(second) OVER (PARTITION BY user_id, id ORDER BY second) AS step FROM st),
md AS (SELECT user_id, id, median(len) AS ref, median(step) AS frame_interval, round(avg(vis), 9) AS shown, median(second) FILTER (i < k) AS setup_second, median(second) FILTER (i >= n - k) AS return_second,
{', '.join(f'median({c}_{a}) FILTER (i < k) AS s_{c}_{a}' for c in _ALL for a in 'xy')}, {', '.join(f'median({s}_{c}_{a}) FILTER (i >= n - k) AS e_{s}_{c}_{a}' for c in _MOVES for s in R.SIDES for a in 'xy')} FROM lagged GROUP BY 1, 2),
d AS (SELECT st.*, md.* EXCLUDE (user_id, id), {', '.join(f'{_far(f"{s}_{c}_x", f"{s}_{c}_y", f"s_{s}_{c}_x", f"s_{s}_{c}_y")} / ref AS d_{s}_{c}' for c in _MOVES for s in R.SIDES)} FROM st JOIN md USING (user_id, id)),
sd AS (SELECT *, {', '.join(f'max((d_{s}_wrist + d_{s}_knee + d_{s}_ankle) / 3) OVER (PARTITION BY user_id, id) AS {s}_motion' for s in R.SIDES)} FROM d), ps AS (SELECT *, CASE WHEN left_motion >= right_motion THEN 'left' ELSE 'right' END AS pose_side FROM sd),
mv AS (SELECT *, {', '.join(f"CASE WHEN pose_side = 'left' THEN d_left_{c} ELSE d_right_{c} END AS m_{c}" for c in _MOVES)}, {_far(_MOVE('wrist', 'x'), _MOVE('wrist', 'y'), _MOVE('ankle', 'x'), _MOVE('ankle', 'y'))} / ref AS touch,
({_far(_MOVE('shoulder', 'x'), _MOVE('shoulder', 'y'), _MOVE('wrist', 'x'), _MOVE('wrist', 'y'))} + {_far(_MOVE('hip', 'x'), _MOVE('hip', 'y'), _MOVE('ankle', 'x'), _MOVE('ankle', 'y'))}) / 2 / ref AS far,
({' + '.join(f"{_far(_HOLD(c, 'x'), _HOLD(c, 'y'), _HOLD(c, 'x', 's_'), _HOLD(c, 'y', 's_'))} / ref" for c in ('wrist', 'knee'))}) / 2 AS drift, {_far(_CENTRE('x'), _CENTRE('y'), _CENTRE('x', 's_'), _CENTRE('y', 's_'))} / ref AS shift,
({' + '.join(f"{_far(_MOVE(c, 'x', 'e_'), _MOVE(c, 'y', 'e_'), _MOVE(c, 'x', 's_'), _MOVE(c, 'y', 's_'))} / ref" for c in _MOVES)}) / 3 AS back,
{_corner(*[_MOVE(c, a) for c in ('shoulder', 'elbow', 'wrist') for a in 'xy'])} AS elbow, {_corner(*[_MOVE(c, a) for c in ('hip', 'knee', 'ankle') for a in 'xy'])} AS knee, i >= least(k, n - 1) AND i < greatest(least(k, n - 1) + 1, n - k) AS searched FROM ps),
ex AS (SELECT user_id, id, i AS xi, second AS xs, (m_wrist + m_knee + m_ankle) / 3 AS amplitude, elbow AS x_elbow, knee AS x_knee FROM (SELECT *, row_number() OVER (PARTITION BY user_id, id ORDER BY round(far + (m_wrist + m_knee + m_ankle) / 3, 9) DESC, i) AS q FROM mv WHERE searched) WHERE q = 1),
mx AS (SELECT mv.*, ex.* EXCLUDE (user_id, id) FROM mv JOIN ex USING (user_id, id)),
t AS (SELECT user_id, id, min({{'v': round(touch, 9), 'i': i, 's': second}}) FILTER (searched AND i <= xi) AS t1, min({{'v': round(touch, 9), 'i': i, 's': second}}) FILTER (searched AND i >= xi) AS t2, greatest(0.2, max(m_wrist) FILTER (i < k) * 3) AS from_w, greatest(0.2, max(m_knee) FILTER (i < k) * 3) AS from_k, max(drift) AS drift, max(shift) AS shift FROM mx GROUP BY 1, 2),
o AS (SELECT user_id, id, min(second) FILTER (m_wrist >= from_w) AS hand, min(second) FILTER (m_knee >= from_k) AS kn FROM mx JOIN t USING (user_id, id) WHERE i >= k AND i <= coalesce(t1.i, xi) GROUP BY 1, 2),
z AS (SELECT mx.user_id, mx.id, pose_side, setup_second, hand AS hand_lift_second, kn AS knee_lift_second, t1.s AS first_touch_second, xs AS extension_second, t2.s AS second_touch_second, return_second, amplitude AS movement_amplitude, t1.v AS first_touch, t2.v AS second_touch, x_elbow AS elbow_extension, x_knee AS knee_extension,
back AS return_control, round(abs(hand - kn), 9) AS simultaneous_lift, n AS usable_frames, shown, frame_interval, left_motion, right_motion, t.drift, t.shift, ref, coalesce(t1.s < xs AND xs < t2.s, false) AS ordered FROM mx JOIN t USING (user_id, id) LEFT JOIN o USING (user_id, id) WHERE i = 0)
SELECT g.user_id, g.id, CASE WHEN ordered THEN 'ok' ELSE 'insufficient_evidence' END AS status,
CASE WHEN ordered IS NULL THEN 'insufficient_full_cycle_pose' ELSE concat_ws(',', CASE WHEN NOT ordered THEN 'full_cycle_phase_order_not_supported' END, CASE WHEN frame_interval > 0.15 THEN 'temporal_resolution_limits_lift_timing' END) END AS issues, pose_side,
{', '.join(f'round({c}_second, 2) AS {c}_second' for c in ('setup', 'hand_lift', 'knee_lift', 'first_touch', 'extension', 'second_touch', 'return'))}, {', '.join(f'round({c}, {d}) AS {c}' for c, d in (('movement_amplitude', 3), ('first_touch', 3), ('second_touch', 3), ('elbow_extension', 1), ('knee_extension', 1), ('return_control', 3), ('simultaneous_lift', 2)))},
CASE WHEN ordered IS NOT NULL THEN CASE WHEN movement_amplitude >= 0.8 THEN 'pass' ELSE 'fail' END END AS movement_amplitude_status, {', '.join(f'CASE WHEN ordered IS NOT NULL THEN {_STATUS(*x).rsplit(" AS ", 1)[0]} END AS {x[0]}_status' for x in (('first_touch', 1.05, 1.45), ('second_touch', 1.05, 1.45), ('elbow_extension', 150, 138, '>='), ('knee_extension', 145, 130, '>='), ('return_control', 0.45, 0.85), ('simultaneous_lift', 0.05, 0.15)))},
usable_frames, round(shown, 3) AS mean_visibility, CASE WHEN ordered IS NOT NULL THEN 1.0 END AS elbow_usable, round(frame_interval, 3) AS frame_interval, round(left_motion, 3) AS left_motion, round(right_motion, 3) AS right_motion, round(drift, 3) AS support_drift, round(shift, 3) AS trunk_shift, round(ref, 4) AS reference_length
FROM g LEFT JOIN z ON g.user_id = z.user_id AND g.id = z.id""")
def rotary_cycles(spark, sf_dir):
    return R.full_cycles(_frames(spark, sf_dir), _pieces(spark, sf_dir), ["user_id"]).withColumn("issues", F.array_join("issues", ","))
