"""Movements, on frames made of events: each user's events in order are half a second apart, and their points move in triangles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempora.operators import detectors as D
from tempora.operators import grouping as G
from tempora.operators import movements as V
from tempora.plans.catalog import micros, query, table

_PARTS = ("shoulder", "elbow", "wrist", "hip", "knee", "ankle", "foot_index")
#: x and y of each part by side (s: 0 or 1), how low the body is (h), how high the leg is (r), and noise (w). Read by both engines.
_PLACES = {
    "shoulder": ("0.4e0 + 0.2e0 * {s}", "0.2e0 + 0.05e0 * h"), "elbow": ("0.35e0 + 0.3e0 * {s}", "0.35e0 + 0.02e0 * h"), "wrist": ("0.3e0 + 0.4e0 * {s} + 0.1e0 * h * (1 - 2 * {s})", "0.45e0 - 0.2e0 * h + w"),
    "hip": ("0.42e0 + 0.16e0 * {s}", "0.5e0 + 0.2e0 * h + w"), "knee": ("0.42e0 + 0.16e0 * {s}", "0.7e0 + 0.05e0 * h"),
    "ankle": ("0.43e0 + 0.14e0 * {s}", "0.9e0 - 0.3e0 * r{s} + w"), "foot_index": ("0.46e0 + 0.14e0 * {s}", "0.95e0 - 0.3e0 * r{s}"),
}
_STATE = {
    "w": "(event_id % 7) / 1000e0", "vis": "0.3e0 + 0.07e0 * (event_id % 11)", "h": "1 - abs((k % 16) - 8e0) / 8e0",
    "r0": "CASE WHEN floor(k / 20e0) % 2 = 0 THEN greatest(0e0, (1 - abs((k % 20) - 10e0) / 10e0) * 2 - 1) ELSE 0e0 END",
    "r1": "CASE WHEN floor(k / 20e0) % 2 = 1 THEN greatest(0e0, (1 - abs((k % 20) - 10e0) / 10e0) * 2 - 1) ELSE 0e0 END",
}
_POINTS = ", ".join(f"{place.format(s=s)} AS {side}_{part}_{axis}" for part in _PARTS for s, side in enumerate(V.SIDES) for axis, place in zip("xy", _PLACES[part], strict=True))
_FRAMES = f"""
n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
u AS (SELECT user_id, event_id, k * 0.5e0 AS second, {', '.join(f'{e} AS {c}' for c, e in _STATE.items())} FROM n),
f AS (SELECT user_id, event_id, second, vis, {_POINTS} FROM u)"""


def _frames(spark, sf_dir):
    """(user_id, event_id, second, points)."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", k.alias("k"))
    state = rows.select("user_id", "event_id", (F.col("k") * 0.5).alias("second"), *[F.expr(e).alias(c) for c, e in _STATE.items()])
    point = lambda s, side, part: F.struct(F.lit(f"{side}_{part}").alias("name"), *[F.expr(e.format(s=s)).alias(a) for a, e in zip("xy", _PLACES[part], strict=True)], F.col("vis").alias("visibility"))
    made = state.select("user_id", "event_id", "second", F.array(*[point(s, side, part) for part in _PARTS for s, side in enumerate(V.SIDES)]).alias("points"))
    return made.repartition("user_id")  # points are made once, not wherever one is read; all that follows is by user


def _rounded(df, digits: int = 6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_LEGS = "l AS (" + " UNION ALL ".join(f"SELECT user_id, second, '{s}' AS side, {s}_hip_y AS hip_y, {s}_knee_y AS knee_y, {s}_ankle_y AS ankle_y, {s}_foot_index_y AS foot_y, vis FROM f" for s in V.SIDES) + ")"
_DEPTHS = """d AS (SELECT user_id, second, vis, (h - s) / (a - s) AS depth, (k - s) / (a - s) AS knee, k - h AS gap FROM (SELECT user_id, second, vis, (left_shoulder_y + right_shoulder_y) / 2 AS s, (left_hip_y + right_hip_y) / 2 AS h,
(left_knee_y + right_knee_y) / 2 AS k, (left_ankle_y + right_ankle_y) / 2 AS a FROM f) WHERE a - s >= 0.05)"""


@query(f"WITH {_FRAMES}, {_LEGS} SELECT user_id, second, side, round(hip_y, 6) AS hip_y, round(knee_y, 6) AS knee_y, round(ankle_y, 6) AS ankle_y, round(foot_y, 6) AS foot_y, round(vis, 6) AS visibility FROM l")
def leg_frames(spark, sf_dir):
    return _rounded(V.leg_rows(_frames(spark, sf_dir), ["user_id"]).withColumnRenamed("foot_index_y", "foot_y"))


@query(f"WITH {_FRAMES}, {_DEPTHS} SELECT user_id, second, round(depth, 6) AS depth_ratio, round(knee, 6) AS knee_ratio, round(gap, 6) AS hip_knee_gap, round(vis, 6) AS visibility FROM d")
def depth_frames(spark, sf_dir):
    return _rounded(V.depth_rows(_frames(spark, sf_dir), ["user_id"]))


def _span(a: str, b: str) -> str:
    return f"sqrt(pow({a}_x - {b}_x, 2) + pow({a}_y - {b}_y, 2))"


_REACH = f"""q AS (SELECT user_id, second, vis, {_span('left_wrist', 'right_wrist')} AS wd, {_span('left_shoulder', 'right_shoulder')} AS sw, ({_span('left_shoulder', 'left_hip')} + {_span('right_shoulder', 'right_hip')}) / 2 AS torso FROM f WHERE vis >= 0.35)"""


@query(f"WITH {_FRAMES}, {_REACH} SELECT user_id, second, round(wd, 6) AS wrist_distance, round(sw, 6) AS shoulder_width, round(torso, 6) AS torso, round(vis, 6) AS visibility, round(wd / greatest(0.01, torso), 6) AS wrist_ratio FROM q WHERE wd > 0 AND torso > 0")
def reach_frames(spark, sf_dir):
    return _rounded(V.reach_rows(_frames(spark, sf_dir), ["user_id"]))


@query(f"""
WITH {_FRAMES}, {_REACH} SELECT user_id, second, round(ratio, 6) AS wrist_ratio FROM (SELECT *, round(wd / greatest(0.01, torso), 9) AS ratio, row_number() OVER (PARTITION BY user_id ORDER BY round(wd / greatest(0.01, torso), 9), second) AS n FROM q WHERE wd > 0 AND torso > 0) WHERE n = 1""")
def best_reach(spark, sf_dir):
    rows = V.reach_rows(_frames(spark, sf_dir), ["user_id"]).withColumn("wrist_ratio", F.round("wrist_ratio", 9))
    return V.best_frame(rows, ["user_id"], "wrist_ratio", largest=False).select("user_id", "second", F.round("wrist_ratio", 6).alias("wrist_ratio"))


def _elbow(s: str) -> str:
    ax, ay, cx, cy = (f"({s}_{p}_{a} - {s}_elbow_{a})" for p in ("shoulder", "wrist") for a in "xy")
    return f"degrees(acos(greatest(-1, least(1, ({ax} * {cx} + {ay} * {cy}) / (sqrt({ax} * {ax} + {ay} * {ay}) * sqrt({cx} * {cx} + {cy} * {cy}))))))"


_MIDDLES = ", ".join(f"(left_{p}_{a} + right_{p}_{a}) / 2 AS {p}_{a}" for p in ("shoulder", "hip", "wrist", "ankle") for a in "xy")


@query(f"""
WITH {_FRAMES}, m AS (SELECT user_id, second, vis, {_MIDDLES}, ({_elbow('left')} + {_elbow('right')}) / 2 AS elbow FROM f WHERE vis >= 0.35), b AS (SELECT *, {_span('shoulder', 'ankle')} AS len FROM m)
SELECT user_id, second, round((wrist_y - shoulder_y) / greatest(0.01, len), 6) AS lift,
round(abs((ankle_x - shoulder_x) * (shoulder_y - hip_y) - (shoulder_x - hip_x) * (ankle_y - shoulder_y)) / len / greatest(0.01, len), 6) AS hip_offset, round(elbow, 4) AS elbow_angle, round(len, 6) AS length, round(vis, 6) AS visibility FROM b WHERE len > 0""")
def push_up_frames(spark, sf_dir):
    return _rounded(V.push_up_rows(_frames(spark, sf_dir), ["user_id"])).withColumn("elbow_angle", F.round("elbow_angle", 4))


def _slope(part: str) -> str:
    return f"degrees(atan2(left_{part}_y - right_{part}_y, left_{part}_x - right_{part}_x))"


@query(f"""
WITH {_FRAMES}, q AS (SELECT *, ({_span('left_shoulder', 'right_shoulder')} + {_span('left_hip', 'right_hip')} + ({_span('left_shoulder', 'left_hip')} + {_span('right_shoulder', 'right_hip')}) / 2) / 3 AS len FROM f WHERE vis >= 0.35),
a AS (SELECT user_id, second, vis, abs(left_hip_y - right_hip_y) AS hip_gap, abs((left_shoulder_x + right_shoulder_x) / 2 - (left_hip_x + right_hip_x) / 2) AS off, abs({_slope('shoulder')} - {_slope('hip')}) AS turn, {_span('left_wrist', 'left_shoulder')} / len AS la, {_span('right_wrist', 'right_shoulder')} / len AS ra, {_span('left_ankle', 'left_hip')} / len AS ll, {_span('right_ankle', 'right_hip')} / len AS rl FROM q),
p AS (SELECT *, unnest([{{'n': 1, 'p': 'left_same_side', 's': 'left', 'v': round(la + ll, 9)}}, {{'n': 2, 'p': 'right_same_side', 's': 'right', 'v': round(ra + rl, 9)}}, {{'n': 3, 'p': 'left_arm_right_leg', 's': 'right', 'v': round(la + rl, 9)}}, {{'n': 4, 'p': 'right_arm_left_leg', 's': 'left', 'v': round(ra + ll, 9)}}]) AS x FROM a),
r AS (SELECT user_id, second, vis, hip_gap, off, turn, list(x ORDER BY x.v DESC, x.n) AS xs FROM p GROUP BY 1, 2, 3, 4, 5, 6)
SELECT user_id, second, xs[1].p AS pattern, xs[1].s AS side, round(xs[1].v, 6) AS score, round(greatest(0, least(1, (xs[1].v - greatest(0, xs[2].v)) / greatest(0.01, xs[1].v))), 6) AS confidence, round(hip_gap, 6) AS hip_gap, round(off, 6) AS centre_offset, round(CASE WHEN turn % 180 > 90 THEN 180 - turn % 180 ELSE turn % 180 END, 6) AS twist, round(vis, 6) AS visibility FROM r""")
def rotary_frames(spark, sf_dir):
    return _rounded(V.rotary_rows(_frames(spark, sf_dir), ["user_id"]))


# ---- cycles


def cycle_sql(name: str, source: str, keys: str, how: D.Cycling, smooth: bool = True) -> str:
    """Tables that end with `name` (keys, s, e, anchor, strength, baseline, amplitude, visibility), of `source` (keys, t, v0, vis)."""
    c, radius = f"{name}_", max(1, how.width // 2)
    of = f"PARTITION BY {keys} ORDER BY t"
    value = f"avg(v0) OVER ({of} ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING)" if smooth else "v0"
    same = " AND ".join(f"r.{k} = m.{k}" for k in keys.split(", "))
    near = f"round(r.t - m.t, 9) < {how.gap}"
    old = f"{near} AND NOT r.v > m.v"
    kept = ", ".join(f"CASE WHEN {old} THEN m.{x} ELSE r.{x} END AS {x}" for x in ("t", "v", "s", "e", "lo", "rg"))
    plain_keys, their = keys, ", ".join(f"r.{k}" for k in keys.split(", "))
    return f"""
{c}a AS (SELECT {keys}, t, vis, round({value}, 9) AS v, count(*) OVER (PARTITION BY {keys}) AS n, min(t) OVER (PARTITION BY {keys}) AS t0, max(t) OVER (PARTITION BY {keys}) AS t1 FROM {source}),
{c}q AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY v) - 1 AS q FROM {c}a WHERE n >= {2 * how.width}),
{c}l AS (SELECT {keys}, max(v) FILTER (q = floor((n - 1) * {how.low}e0 + 0.5)) AS lo, max(v) FILTER (q = floor((n - 1) * {how.high}e0 + 0.5)) AS hi FROM {c}q GROUP BY {keys}),
{c}b AS (SELECT {c}a.*, lo, hi - lo AS rg, lo + (hi - lo) * {how.peak_part}e0 AS pk, lo + (hi - lo) * {how.boundary_part}e0 AS eg FROM {c}a JOIN {c}l USING ({keys}) WHERE hi - lo >= {how.least}),
{c}c AS (SELECT *, coalesce(max(t) FILTER (v <= eg) OVER ({of} ROWS UNBOUNDED PRECEDING), t0) AS bs, coalesce(min(t) FILTER (v <= eg) OVER ({of} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), t1) AS be,
CASE WHEN v >= pk AND NOT coalesce(lag(v >= pk) OVER ({of}), false) THEN 1 ELSE 0 END AS st FROM {c}b),
{c}i AS (SELECT *, sum(st) OVER ({of} ROWS UNBOUNDED PRECEDING) AS isl FROM {c}c),
{c}p AS (SELECT *, row_number() OVER (PARTITION BY {keys}, isl ORDER BY v DESC, t) AS first FROM {c}i WHERE v >= pk),
{c}r AS (SELECT {keys}, t, v, lo, rg, round(least(greatest(bs - {how.before}, t0), t1), 2) AS s, round(least(greatest(be + {how.after}, t0), t1), 2) AS e, row_number() OVER ({of}, v) AS k FROM {c}p WHERE first = 1),
{c}m AS (SELECT {keys}, k, 1 AS g, t, v, s, e, lo, rg FROM {c}r WHERE k = 1 UNION ALL
SELECT {their}, r.k, CASE WHEN {near} THEN g ELSE g + 1 END, {kept} FROM {c}m m JOIN {c}r r ON {same} AND r.k = m.k + 1),
{c}z AS (SELECT {plain_keys}, g, arg_max(t, k) AS t, arg_max(v, k) AS v, arg_max(s, k) AS s, arg_max(e, k) AS e, arg_max(lo, k) AS lo, arg_max(rg, k) AS rg FROM {c}m GROUP BY {keys}, g),
{name} AS (SELECT {their}, r.s, r.e, round(r.t, 2) AS anchor, round(r.v, 4) AS strength, round(lo, 4) AS baseline, round(rg, 4) AS amplitude, round(avg(m.vis), 6) AS visibility
FROM {c}z r LEFT JOIN {c}a m ON {same} AND m.t BETWEEN r.s AND r.e GROUP BY {their}, g, r.s, r.e, r.t, r.v, lo, rg)"""


def sides_sql(name: str, source: str, gap: float) -> str:
    """Of cycles of either side that are near, the stronger."""
    near = f"round(r.anchor - m.anchor, 9) <= {gap}"
    old = f"{near} AND NOT r.p > m.p"
    columns = ("side", "s", "e", "anchor", "strength", "baseline", "amplitude", "visibility", "p")
    kept = ", ".join(f"CASE WHEN {old} THEN m.{x} ELSE r.{x} END AS {x}" for x in columns)
    return f"""
{name}_p AS (SELECT *, round(strength * 0.8e0 + coalesce(visibility, 0) * 0.2e0, 9) AS p FROM {source}), {name}_r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY anchor, p) AS k FROM {name}_p),
{name}_m AS (SELECT user_id, k, 1 AS g, {', '.join(columns)} FROM {name}_r WHERE k = 1 UNION ALL
SELECT r.user_id, r.k, CASE WHEN {near} THEN g ELSE g + 1 END, {kept} FROM {name}_m m JOIN {name}_r r ON r.user_id = m.user_id AND r.k = m.k + 1),
{name} AS (SELECT user_id, {', '.join(f'arg_max({x}, k) AS {x}' for x in columns[:-1])} FROM {name}_m GROUP BY user_id, g)"""


def overlaps_sql(name: str, source: str, most: float) -> str:
    """Of cycles that overlap, the stronger."""
    return f"""
{name}_r AS (SELECT user_id, {{'s': s, 'e': e, 'anchor': anchor, 'strength': strength, 'p': round(strength + coalesce(visibility, 0) * 0.05e0, 9)}} AS x, row_number() OVER (PARTITION BY user_id ORDER BY s, e, anchor, strength) AS k FROM {source}),
{name}_m AS (SELECT user_id, k, [x] AS kept FROM {name}_r WHERE k = 1 UNION ALL
SELECT user_id, k, CASE WHEN met IS NULL OR met = 0 THEN list_append(kept, x) WHEN x.p > kept[met].p THEN list_concat(list_append(kept[1:met - 1], x), kept[met + 1:]) ELSE kept END
FROM (SELECT r.user_id, r.k, r.x, kept, list_position(list_transform(kept, lambda o: greatest(0, least(o.e, r.x.e) - greatest(o.s, r.x.s)) / greatest(0.01, least(o.e - o.s, r.x.e - r.x.s)) >= {most}), true) AS met FROM {name}_m m JOIN {name}_r r ON r.user_id = m.user_id AND r.k = m.k + 1)),
{name} AS (SELECT user_id, x.s AS s, x.e AS e, x.anchor AS anchor, x.strength AS strength FROM (SELECT user_id, unnest(kept) AS x FROM (SELECT user_id, arg_max(kept, k) AS kept FROM {name}_m GROUP BY 1)))"""


_RAISED = """v AS (SELECT * FROM l WHERE vis >= 0.35), v9 AS (SELECT user_id, side, ankle_y, row_number() OVER (PARTITION BY user_id, side ORDER BY ankle_y) - 1 AS q, count(*) OVER (PARTITION BY user_id, side) AS n FROM v),
base AS (SELECT user_id, side, max(ankle_y) FILTER (q = floor((n - 1) * 0.9e0 + 0.5)) AS p90 FROM v9 GROUP BY 1, 2), sig AS (SELECT user_id, side, second AS t, p90 - ankle_y AS v0, vis FROM v JOIN base USING (user_id, side))"""
_OUT = 'user_id, s AS start, e AS "end", anchor, strength'


@query(f"""
WITH RECURSIVE {_FRAMES}, {_LEGS}, {_RAISED}, {cycle_sql('c', 'sig', 'user_id, side', V.LEG_RAISE)}, {sides_sql('j', 'c', V.LEG_RAISE_SIDES)}
SELECT {_OUT}, side, baseline, amplitude, visibility, CAST(row_number() OVER (PARTITION BY user_id ORDER BY anchor, s, e) AS INT) AS number FROM j""")
def leg_raise_cycles(spark, sf_dir):
    return V.leg_raise_cycles(_frames(spark, sf_dir), ["user_id"])


@query(f"""
WITH RECURSIVE {_FRAMES}, {_LEGS}, {_RAISED}, {cycle_sql('c', 'sig', 'user_id, side', V.HURDLE)}, {sides_sql('j', 'c', V.HURDLE_SIDES)}, {overlaps_sql('o', 'j', 0.85)}
SELECT {_OUT}, CAST(row_number() OVER (PARTITION BY user_id ORDER BY anchor, s, e) AS INT) AS number FROM o""")
def hurdle_cycles(spark, sf_dir):
    return V.hurdle_cycles(_frames(spark, sf_dir), ["user_id"]).select("user_id", "start", "end", "anchor", "strength", "number")


@query(f"""
WITH RECURSIVE {_FRAMES}, {_DEPTHS}, sig AS (SELECT user_id, second AS t, (depth + knee) / 2 AS v0, vis FROM d), {cycle_sql('c', 'sig', 'user_id', V.LUNGE)}, {overlaps_sql('o', 'c', 0.85)}
SELECT {_OUT}, CAST(row_number() OVER (PARTITION BY user_id ORDER BY anchor, s, e) AS INT) AS number FROM o""")
def lunge_cycles(spark, sf_dir):
    return V.lunge_cycles(_frames(spark, sf_dir), ["user_id"]).select("user_id", "start", "end", "anchor", "strength", "number")


@query(f"""
WITH RECURSIVE {_FRAMES}, {_DEPTHS}, sig AS (SELECT user_id, second AS t, depth AS v0, vis FROM d), {cycle_sql('c', 'sig', 'user_id', V.SQUAT_DEPTH)},
g AS (SELECT user_id, second AS t, vis, round(avg(gap) OVER (PARTITION BY user_id ORDER BY second ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 9) AS gap FROM d), g8 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY gap) - 1 AS q, count(*) OVER (PARTITION BY user_id) AS n FROM g),
stand AS (SELECT user_id, max(gap) FILTER (q = floor((n - 1) * 0.8e0 + 0.5)) AS p80 FROM g8 GROUP BY 1), sig2 AS (SELECT user_id, t, greatest(0, p80 - gap) AS v0, vis FROM g JOIN stand USING (user_id)), {cycle_sql('c2', 'sig2', 'user_id', V.SQUAT_COMPRESSION, smooth=False)},
every AS (SELECT * FROM c UNION ALL SELECT * FROM c2), {overlaps_sql('o', 'every', 0.5)}
SELECT {_OUT}, CAST(row_number() OVER (PARTITION BY user_id ORDER BY anchor, s, e) AS INT) AS number FROM o""")
def squat_cycles(spark, sf_dir):
    return V.squat_cycles(_frames(spark, sf_dir), ["user_id"]).select("user_id", "start", "end", "anchor", "strength", "number")


_BY_HOUR = D.Cycling(gap=7200.0, before=600.0, after=600.0)


@query(f"""WITH RECURSIVE sig AS (SELECT user_id, epoch_us(ts) / 1000000.0 AS t, value AS v0, CAST(NULL AS DOUBLE) AS vis FROM events), {cycle_sql('c', 'sig', 'user_id', _BY_HOUR)}
SELECT {_OUT}, baseline, amplitude, visibility FROM c""")
def movement_cycles(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("t", micros() / 1e6)
    return D.cycles(rows, ["user_id"], "t", "value", _BY_HOUR)


# ---- evidence and choice of cycles

_PIECES = "g AS (SELECT user_id, c AS id, c * 15e0 AS s, c * 15e0 + 12 AS e, ['left', 'right', 'unknown'][1 + c % 3] AS side FROM (SELECT user_id, unnest(range(0, 4)) AS c FROM (SELECT DISTINCT user_id FROM events)))"


def _pieces(spark, sf_dir):
    c = F.col("id")
    users = table(spark, sf_dir, "events").select("user_id").distinct().withColumn("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    return users.select("user_id", "id", (c * 15.0).alias("start"), (c * 15.0 + 12).alias("end"), F.element_at(F.array(F.lit("left"), F.lit("right"), F.lit("unknown")), (c % 3 + 1).cast("int")).alias("side"))


@query(f"""
WITH {_FRAMES}, {_LEGS}, {_PIECES}, x AS (SELECT g.user_id, g.id, g.side AS wanted, second, l.side, round(hip_y - ankle_y, 9) AS up FROM g JOIN l ON g.user_id = l.user_id AND second BETWEEN s AND e WHERE vis >= 0.45),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, id, second ORDER BY up DESC, side) AS n FROM x) WHERE n = 1), t AS (SELECT user_id, id, count(*) AS frames, max(up) AS peak, arg_min(second, (-up, second)) AS peak_second, arg_min(side, (-up, second)) AS peak_side FROM w GROUP BY 1, 2),
st AS (SELECT w.*, lag(w.side) OVER (PARTITION BY user_id, id ORDER BY w.second) AS before FROM w JOIN t USING (user_id, id) WHERE up >= greatest(0.04, peak * 0.65e0)),
k AS (SELECT user_id, id, count(*) AS strong, count(*) FILTER (side = 'left') AS le, count(*) FILTER (side = 'right') AS ri, count(*) FILTER (side <> before) AS sw FROM st GROUP BY 1, 2),
m AS (SELECT g.user_id, g.id, g.side AS wanted, frames, coalesce(strong, 0) AS strong, peak_second, peak_side, CASE WHEN coalesce(le, 0) = coalesce(ri, 0) THEN peak_side WHEN le > ri THEN 'left' ELSE 'right' END AS dominant,
CASE WHEN strong > 0 THEN (CASE WHEN le > ri OR (le = ri AND peak_side = 'left') THEN le ELSE ri END) / CAST(strong AS DOUBLE) ELSE 0 END AS ratio, CASE WHEN strong > 1 THEN sw / CAST(strong - 1 AS DOUBLE) ELSE 0 END AS rate
FROM g LEFT JOIN t ON g.user_id = t.user_id AND g.id = t.id LEFT JOIN k ON g.user_id = k.user_id AND g.id = k.id),
a AS (SELECT *, CASE WHEN wanted = 'unknown' OR NOT (strong >= 5 AND ratio >= 0.85) THEN 'indeterminate' WHEN wanted = dominant THEN 'match' ELSE 'mismatch' END AS agreement FROM m),
r AS (SELECT *, list_filter([CASE WHEN strong < 5 THEN 'sparse_strong_raise_signal' END, CASE WHEN ratio < 0.6 THEN 'ambiguous_dominant_pose_side' END, CASE WHEN rate > 0.25 THEN 'unstable_pose_side_labels' END], lambda z: z IS NOT NULL) AS bad,
list_filter([CASE WHEN ratio >= 0.6 AND ratio < 0.85 THEN 'pose_side_dominance_watch' END, CASE WHEN rate <= 0.25 AND rate > 0.08 THEN 'pose_side_switch_watch' END, CASE WHEN agreement = 'mismatch' THEN 'segment_side_pose_mismatch' END], lambda z: z IS NOT NULL) AS odd FROM a)
SELECT user_id, id, CASE WHEN frames IS NULL THEN 'insufficient_pose' WHEN len(bad) > 0 THEN 'limited' WHEN len(odd) > 0 THEN 'watch' ELSE 'good' END AS status, CASE WHEN frames IS NULL THEN 'no_visible_leg_frames' ELSE array_to_string(list_concat(bad, odd), ',') END AS reasons,
frames, CASE WHEN frames IS NOT NULL THEN strong END AS strong, round(peak_second, 3) AS peak_second, peak_side, CASE WHEN frames IS NOT NULL THEN dominant END AS dominant, CASE WHEN frames IS NOT NULL THEN round(ratio, 3) END AS ratio, CASE WHEN frames IS NOT NULL THEN round(rate, 3) END AS switch_rate,
CASE WHEN frames IS NOT NULL THEN agreement END AS agreement FROM r""")
def peak_evidence(spark, sf_dir):
    legs = V.leg_rows(_frames(spark, sf_dir), ["user_id"])
    legs = legs.withColumn("ankle_y", F.col("hip_y") - F.round(F.col("hip_y") - F.col("ankle_y"), 9))
    return V.peak_evidence(legs, _pieces(spark, sf_dir), ["user_id"]).withColumn("reasons", F.array_join("reasons", ","))


@query(f"""
WITH RECURSIVE {_FRAMES}, {_DEPTHS}, {_PIECES}, sig AS (SELECT user_id, second AS t, (depth + knee) / 2 AS v0, vis FROM d), {cycle_sql('c', 'sig', 'user_id', V.LUNGE)}, {overlaps_sql('o', 'c', 0.85)},
p AS (SELECT g.user_id, g.id, o.anchor, row_number() OVER (PARTITION BY g.user_id, g.id ORDER BY CASE WHEN o.anchor BETWEEN g.s AND g.e THEN 0 ELSE 1 END, abs(o.anchor - (g.s + g.e) / 2), o.anchor) AS n FROM g LEFT JOIN o ON g.user_id = o.user_id)
SELECT user_id, id, anchor FROM p WHERE n = 1""")
def nearest_cycle(spark, sf_dir):
    found = V.lunge_cycles(_frames(spark, sf_dir), ["user_id"])
    return V.cycle_of_segment(_pieces(spark, sf_dir), found, ["user_id"]).select("user_id", "id", "anchor")



@query()
def cycles_to_count(spark, sf_dir):
    """As many leg raises as a user has segments that are theirs: three of four."""
    found = V.leg_raise_cycles(_frames(spark, sf_dir), ["user_id"])
    return G.cycles_to_count(found, _pieces(spark, sf_dir).where("id < 3").groupBy("user_id").agg(F.count("*").alias("expected")), ["user_id"])


# ---- windows, and motion of all points

_WINDOWED = """w AS (SELECT user_id, c AS id, c * 6e0 AS s, c * 6e0 + 14 AS e FROM (SELECT user_id, unnest(range(0, 5)) AS c FROM (SELECT DISTINCT user_id FROM events))),
f AS (SELECT f0.* REPLACE (f0.user_id * 10 + w.id AS user_id) FROM f0 JOIN w ON f0.user_id = w.user_id AND f0.second BETWEEN w.s AND w.e)"""


@query(f"""
WITH RECURSIVE {_FRAMES.replace('f AS (SELECT user_id, event_id', 'f0 AS (SELECT user_id, event_id')}, {_WINDOWED}, {_DEPTHS}, sig AS (SELECT user_id, second AS t, depth AS v0, vis FROM d), {cycle_sql('c', 'sig', 'user_id', V.SQUAT_DEPTH)},
g AS (SELECT user_id, second AS t, vis, round(avg(gap) OVER (PARTITION BY user_id ORDER BY second ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 9) AS gap FROM d), g8 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY gap) - 1 AS q, count(*) OVER (PARTITION BY user_id) AS n FROM g),
stand AS (SELECT user_id, max(gap) FILTER (q = floor((n - 1) * 0.8e0 + 0.5)) AS p80 FROM g8 GROUP BY 1), sig2 AS (SELECT user_id, t, greatest(0, p80 - gap) AS v0, vis FROM g JOIN stand USING (user_id)), {cycle_sql('c2', 'sig2', 'user_id', V.SQUAT_COMPRESSION, smooth=False)},
every AS (SELECT * FROM c UNION ALL SELECT * FROM c2), {overlaps_sql('o', 'every', 0.5).replace("x.strength AS strength FROM", "x.strength AS strength, x.p AS p FROM")},
b AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS candidates, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, anchor, s, e) AS first FROM o)
SELECT user_id // 10 AS user_id, user_id % 10 AS "window", candidates, s AS start, e AS "end", anchor, strength, CAST(row_number() OVER (PARTITION BY user_id // 10 ORDER BY user_id % 10) AS INT) AS number FROM b WHERE first = 1""")
def squat_windows(spark, sf_dir):
    users = table(spark, sf_dir, "events").select("user_id").distinct().withColumn("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    windows = users.select("user_id", "id", (F.col("id") * 6.0).alias("start"), (F.col("id") * 6.0 + 14).alias("end"))
    return V.squat_cycles_of_windows(_frames(spark, sf_dir), windows, ["user_id"]).select("user_id", "window", "candidates", "start", "end", "anchor", "strength", "number")


_SEEN_POINTS = [f"{side}_{part}" for part in _PARTS for side in V.SIDES]


@query(f"""
WITH {_FRAMES}, q AS (SELECT user_id, second, [{', '.join(f"CASE WHEN (event_id + {k}) % 5 <> 0 AND event_id % 13 <> 0 THEN {{'x': {n}_x, 'y': {n}_y}} END" for k, n in enumerate(_SEEN_POINTS))}] AS ps FROM f),
c AS (SELECT *, len(list_filter(ps, lambda p: p IS NOT NULL)) AS tracked FROM q), l AS (SELECT *, lag(ps) OVER (PARTITION BY user_id ORDER BY second) AS bs FROM c WHERE tracked > 0),
d AS (SELECT user_id, second, tracked, CASE WHEN bs IS NULL THEN [] ELSE list_filter(list_transform(list_zip(ps, bs), lambda z: sqrt(pow(z[1].x - z[2].x, 2) + pow(z[1].y - z[2].y, 2))), lambda v: v IS NOT NULL) END AS moves FROM l)
SELECT user_id, second, CAST(tracked AS INT) AS tracked, round(coalesce(list_sum(moves) / nullif(len(moves), 0), 0), 9) AS motion FROM d""")
def landmark_motion(spark, sf_dir):
    """Points that come and go: each is hardly seen in every fifth frame, and some frames show none."""
    k = F.create_map(*[x for i, n in enumerate(_SEEN_POINTS) for x in (F.lit(n), F.lit(i))])
    hidden = lambda p: ((F.col("event_id") + F.try_element_at(k, p["name"])) % 5 == 0) | (F.col("event_id") % 13 == 0)
    frames = _frames(spark, sf_dir).withColumn("points", F.transform("points", lambda p: p.withField("visibility", F.when(hidden(p), 0.2).otherwise(0.9))))
    return V.landmark_motion(frames, ["user_id"]).withColumn("motion", F.round("motion", 9))
