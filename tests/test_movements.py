"""Full cycles, features at anchors and percentiles by window, on small made recordings."""

import pytest

from tempora.operators import anchors as N
from tempora.operators import joins as J
from tempora.operators import movements as V
from tempora.operators import rotary as R
from tempora.operators import sequences as S

#: Where the points are in the phases of a quadruped reach; fixed values.
SETUP = {
    "left_shoulder": (0.4, 0.35), "right_shoulder": (0.6, 0.35), "left_hip": (0.42, 0.55), "right_hip": (0.58, 0.55), "left_elbow": (0.4, 0.47), "right_elbow": (0.6, 0.47),
    "left_wrist": (0.4, 0.6), "right_wrist": (0.6, 0.6), "left_knee": (0.42, 0.7), "right_knee": (0.58, 0.7), "left_ankle": (0.42, 0.85), "right_ankle": (0.58, 0.85),
}
TOUCH = SETUP | {"left_elbow": (0.42, 0.64), "left_wrist": (0.43, 0.82), "left_knee": (0.42, 0.82)}
REACH = SETUP | {"left_elbow": (0.4, 0.25), "left_wrist": (0.4, 0.15), "left_knee": (0.42, 0.75), "left_ankle": (0.42, 0.95)}
BROKEN = REACH | {"left_wrist": (0.4, 0.05), "left_elbow": (0.38, 0.42), "left_knee": (0.5, 0.7), "left_ankle": (0.64, 0.82)}
POINTS = "k string, second double, points array<struct<name:string,x:double,y:double,visibility:double>>"


def between(a, b, part):
    return {n: tuple(p + (q - p) * part for p, q in zip(a[n], b[n], strict=True)) for n in a}


def recording(key, hidden=(), late_knee=False, broken=False, finger=False):
    """A frame every tenth of a second from 0 to 2.4."""
    for k in range(25):
        second, points = k / 10, SETUP
        if 0.5 <= second < 1:
            points = between(SETUP, TOUCH, min(1.0, (second - 0.5) / 0.3))
            if late_knee and second < 0.7:
                points = points | {n: SETUP[n] for n in ("left_knee", "left_ankle")}
        elif 1 <= second < 1.4:
            points = BROKEN if broken else REACH
        elif 1.4 <= second < 1.8:
            points = TOUCH
        elif second >= 1.8 and broken:
            points = SETUP | {"left_wrist": (0.22, 0.55), "left_knee": (0.5, 0.62)}
        if finger:
            points = points | {"left_index": points["left_ankle"] if 1.4 <= second < 1.8 else points["left_wrist"]}
            if 1.4 <= second < 1.8:
                points = points | {"left_wrist": (0.2, 0.6)}
        yield key, second, [(n, x, y, 0.2 if n in hidden else 0.96) for n, (x, y) in points.items()]


def cycle(spark, segments=((0.0, 2.4),), **how):
    frames = spark.createDataFrame(list(recording("a", **how)), POINTS)
    asked = spark.createDataFrame([("a", k, *s) for k, s in enumerate(segments)], "k string, id int, start double, end double")
    return R.full_cycles(frames, asked, ["k"], R.Rules(frames=10)).orderBy("id").collect()


def test_full_cycle(spark):
    (r,) = cycle(spark)
    assert (r.status, r.issues, r.pose_side) == ("ok", [], "left")
    assert {c: r[f"{c}_status"] for c in R.CRITERIA} == dict.fromkeys(R.CRITERIA, "pass") | {"simultaneous_lift": "pass"}
    assert 0.5 <= r.first_touch_second < 1 == r.extension_second < 1.4 <= r.second_touch_second and r.usable_frames == 25


def test_full_cycle_departures(spark):
    assert cycle(spark, late_knee=True)[0].simultaneous_lift_status != "pass"
    (r,) = cycle(spark, broken=True)
    assert "fail" in [r[f"{c}_status"] for c in R.CRITERIA]
    (r,) = cycle(spark, hidden=["right_elbow"])
    assert (r.status, r.elbow_usable) == ("ok", 1.0)
    (r,) = cycle(spark, hidden=["left_elbow"])
    assert (r.status, r.elbow_extension_status, r.elbow_usable) == ("ok", "unknown", 0.0)
    assert cycle(spark, finger=True)[0].second_touch_status == "pass"


def test_full_cycle_without_evidence(spark):
    hidden, short, off = cycle(spark, hidden=["left_hip"])[0], *cycle(spark, segments=((0.0, 0.5), (90.0, 99.0)))
    assert {(r.status, *r.issues, r.pose_side) for r in (hidden, short, off)} == {("insufficient_evidence", "insufficient_full_cycle_pose", None)}


def test_features_of_missing_points(spark):
    """A mixed table: ratings without points aren't made, drift is that of the other leg, the start's frame is another one."""
    frames = [("a", 0.0, [("left_hip", 0.5, 0.5, 0.9), ("left_ankle", 0.5, 0.9, 0.9), ("right_ankle", 0.5, 0.9, None)]), ("a", 1.0, [("left_hip", 0.5, 0.5, 0.9), ("left_ankle", 0.5, 0.3, 0.7), ("right_ankle", 0.56, 0.98, None)]), ("a", None, []), ("a", 2.0, None)]
    rows = [("active_leg_raise", "side", "left", 0.0, 1.2, 0.9), ("hurdle_step", "front", "left", 0.0, 1.2, 0.9), ("hurdle_step", "side", None, 0.0, 1.2, None), ("deep_squat", "side", None, 0.0, None, 0.0), ("jump", None, None, 0.0, 1.0, 0.0), ("inline_lunge", "front", "left", 5.0, 1.0, 0.4)]
    asked = spark.createDataFrame([("a", k, *r, {"peak_clearance": 0.08}) for k, r in enumerate(rows)], "k string, id int, action string, view string, side string, start double, end double, anchor double, signals map<string,double>")
    got = {r.id: r for r in N.features(spark.createDataFrame(frames, POINTS), asked, ["k"]).collect()}
    assert [got[k].status for k in range(6)] == ["ok", "ok", "ok", "no_cycle", "unsupported", "ok"] and got[3].metrics is got[4].ratings is None
    raised = got[0]
    assert raised.source_second == 1.0 and raised.metrics["ankle_above_hip"] == 0.2 and raised.metrics["down_ankle_drift"] == pytest.approx(0.1) and raised.metrics["side_visibility"] == 0.8
    assert (raised.ratings["leg_raise"], raised.ratings["knee_extension"], raised.ratings["down_leg_control"], raised.ratings["pelvic_stability"]) == ("good", "not_applicable", "limited", "not_applicable")
    assert got[1].metrics["stance_ankle_drift"] == 0.06 and got[1].ratings["stance_leg_control"] == "watch" and got[1].ratings["clearance"] == "watch"
    assert got[2].source_second == 0.0 and got[2].ratings["stance_stability"] == "not_applicable" and got[2].ratings["side_confidence"] == "not_applicable"
    assert set(got[5].ratings) == {"depth_zone", "trunk_pelvis_control", "knee_foot_line", "rear_leg_control", "depth", "trunk_alignment", "knee_foot_alignment", "side_confidence"} and set(got[5].ratings.values()) == {"not_applicable"}


def test_the_last_point_of_a_name(spark):
    frames = spark.createDataFrame([("a", 1.0, [("left_hip", 0.1, 0.1, 1.0), ("left_hip", 0.2, 0.2, 1.0), (None, 1.0, 1.0, 1.0)])], POINTS)
    r = V._named(frames, ["k"], ["left_hip", "right_hip"]).first()
    assert (r.left_hip.x, r.right_hip) == (0.2, None)


def test_percentiles_by_window(spark):
    rows = spark.createDataFrame([("a", float(k)) for k in (5, 1, 3, 2, 4)] + [("a", None), ("b", None)], "k string, v double")
    got = {(r.k, r.mid, r.top) for r in S.with_percentiles(rows, ["k"], "v", {"mid": 0.5, "top": 0.9}).collect()}
    assert got == {("a", 3.0, 5.0), ("b", None, None)}


def test_nearest_either_way(spark):
    left = spark.createDataFrame([("a", t) for t in (0.0, 2.5, 3.0, 9.0)] + [("b", 1.0)], "k string, t double")
    right = spark.createDataFrame([("a", 2.0, 7), ("a", 3.0, 8), ("a", 3.0, 6)], "k string, s double, i int")
    got = {(r.k, r.t): r.nearest_id for r in J.nearest_in_time(left, right, ["k"], "t", "s", "i").collect()}
    assert got == {("a", 0.0): 7, ("a", 2.5): 7, ("a", 3.0): 6, ("a", 9.0): 6, ("b", 1.0): None}


def test_merging_at_the_gap(spark):
    from tempora.operators.matching import merge_peaks

    peaks = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.8, 2.0), ("a", 3.0, 1.0)], "k string, t double, s double")
    at = lambda inclusive: sorted(r.t for r in merge_peaks(peaks, ["k"], "t", "s", 0.8, inclusive).collect())
    assert at(False) == [1.0, 1.8, 3.0] and at(True) == [1.8, 3.0]


def test_motion_of_points_that_come_and_go(spark):
    frames = [("a", 0.0, [("left_hip", 0.0, 0.0, None), ("left_knee", 0.0, 0.0, 0.9), ("nose", 0.0, 0.0, 1.0)]), ("a", 1.0, [("left_hip", 0.3, 0.4, 0.9), ("left_knee", 0.0, 0.1, 0.9), ("nose", 9.0, 9.0, 1.0)]), ("a", 2.0, [("left_hip", 0.3, 0.4, 0.1)]), ("a", 3.0, [("right_hip", 0.0, 0.0, 0.9)]), ("a", 4.0, None)]
    got = [(r.second, pytest.approx(r.motion), r.tracked) for r in V.landmark_motion(spark.createDataFrame(frames, POINTS), ["k"]).orderBy("second").collect()]
    assert got == [(0.0, 0.0, 2), (1.0, 0.3, 2), (3.0, 0.0, 1)]


def test_each_window_has_its_own_cycle(spark):
    """A bend in either of two windows far apart; each window is measured by its own frames."""
    frames = []
    for begin, size in ((0.0, 0.28), (40.0, 0.2)):
        for k in range(41):
            t = begin + k / 10
            low = size * max(0.0, 1 - abs(t - begin - 2) / 1.2)
            ys = {"shoulder": 0.2, "hip": 0.45 + low, "knee": 0.7, "ankle": 0.9}
            frames.append(("a", t, [(f"{s}_{p}", 0.5, y, 0.9) for p, y in ys.items() for s in V.SIDES]))
    windows = spark.createDataFrame([("a", 7, 0.0, 4.0), ("a", 3, 40.0, 44.0), ("a", 1, 50.0, 60.0), ("a", 2, 5.0, 5.0)], "k string, id int, start double, end double")
    got = V.squat_cycles_of_windows(spark.createDataFrame(frames, POINTS), windows, ["k"]).orderBy("number").collect()
    assert [(r.window, r.number) for r in got] == [(7, 1), (3, 2)] and [round(r.anchor) for r in got] == [2, 42]
    assert all(r.window_start <= r.start < r.anchor < r.end <= r.window_end for r in got)
