"""Ordered rows: smoothing, islands, peaks, latest rows, sessions, as-of and interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators import joins as J
from tempora.operators import sequences as S
from tempora.plans.catalog import micros, query, table

_T = "epoch_us(ts) / 1e6"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time in seconds."""
    return table(spark, sf_dir, "events").withColumn("t", micros() / 1e6)


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM events")
def moving_average(spark, sf_dir):
    return S.centred_mean(table(spark, sf_dir, "events"), ["user_id"], ["ts"], "value", 5).select("event_id", F.round("smooth", 6).alias("smooth"))


@query("""
WITH m AS (SELECT event_id, value, lag(value) OVER w AS pv, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, lag(CAST(json_extract(props, '$.k') AS DOUBLE)) OVER w AS pk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT event_id, round(coalesce(sqrt((value - pv) * (value - pv) + (k - pk) * (k - pk)), 0), 5) AS motion FROM m""")
def lag_motion(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    return S.motion(rows, ["user_id"], ["ts"], "value", "k").select("event_id", F.round("motion", 5).alias("motion"))


@query("""
WITH d AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS step FROM events) SELECT user_id, median(step) AS interval FROM d GROUP BY 1""")
def interval_median(spark, sf_dir):
    return S.interval_median(table(spark, sf_dir, "events").withColumn("us", micros()), ["user_id"], "us")


_SMOOTH = "s AS (SELECT event_id, user_id, epoch_us(ts) AS us, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS v FROM events)"
_ISLANDS = f"""
{_SMOOTH}, f AS (SELECT *, coalesce(v >= 14, false) AS inside FROM s), g AS (SELECT *, CASE WHEN inside AND NOT coalesce(lag(inside) OVER w, false) THEN 1 ELSE 0 END AS st FROM f WINDOW w AS (PARTITION BY user_id ORDER BY us)),
i AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS island FROM g),
p AS (SELECT user_id, CAST(island AS BIGINT) AS island, min(us) AS start, max(us) AS "end", count(*) AS n, avg(v) AS mean, max(v) AS peak FROM i WHERE inside GROUP BY 1, 2)"""


def _smooth(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("us", micros())
    return S.centred_mean(rows, ["user_id"], ["us"], "value", 5, "v").select("event_id", "user_id", "us", F.round("v", 6).alias("v"))


def _periods(spark, sf_dir):
    return S.island_periods(S.islands(_smooth(spark, sf_dir), ["user_id"], ["us"], F.col("v") >= 14), ["user_id"], "us", "v")


@query(f'WITH {_ISLANDS} SELECT user_id, island, start, "end", n, round(mean, 11) AS mean FROM p')
def active_islands(spark, sf_dir):
    return _periods(spark, sf_dir).select("user_id", "island", "start", "end", "n", F.round("mean", 11).alias("mean"))


@query(f"""WITH {_ISLANDS}, k AS (SELECT user_id, CAST(island AS BIGINT) AS island, us, v, row_number() OVER (PARTITION BY user_id, island ORDER BY v DESC, us) AS r FROM i WHERE inside)
SELECT user_id, island, us AS peak_time, v AS peak FROM k WHERE r = 1""")
def island_peaks(spark, sf_dir):
    return _periods(spark, sf_dir).select("user_id", "island", "peak_time", "peak")


@query(f"""WITH {_SMOOTH} SELECT event_id, coalesce(max(us) FILTER (v <= 10) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING), min(us) OVER (PARTITION BY user_id)) AS boundary_start,
coalesce(min(us) FILTER (v <= 10) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), max(us) OVER (PARTITION BY user_id)) AS boundary_end FROM s""")
def peak_boundaries(spark, sf_dir):
    return S.boundaries(_smooth(spark, sf_dir), ["user_id"], "us", "v", 10.0).select("event_id", "boundary_start", "boundary_end")


@query(f"""WITH {_ISLANDS}, q AS (SELECT user_id, start, "end", mean, peak, max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR start - reach > 14400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM q)
SELECT user_id, min(n.start) AS start, max(n."end") AS "end", count(*) AS merged, round(list_reduce(list(n.mean ORDER BY n.start, n."end"), lambda a, b: (a + b) / 2), 11) AS mean, round(max(n.peak), 5) AS peak FROM n GROUP BY user_id, g""")
def merged_periods(spark, sf_dir):
    found = S.merged_periods(_periods(spark, sf_dir).select("user_id", "start", "end", "mean", "peak"), ["user_id"], 4 * 3600 * 1_000_000, "mean", "peak")
    return found.withColumn("mean", F.round("mean", 11)).withColumn("peak", F.round("peak", 5))


@query("""
WITH n AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 21600000000 THEN 0 ELSE 1 END AS st FROM events),
s AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM n)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM s GROUP BY 1, 2""")
def session_gaps(spark, sf_dir):
    rows = S.sessions(table(spark, sf_dir, "events").withColumn("s", micros() / 1e6), ["user_id"], "s", 6 * 3600.0)
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


def _latest_sql(order: str) -> str:
    return f"""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY {order}) AS r FROM events) WHERE r = 1"""


def _latest(spark, sf_dir, *order):
    return S.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], list(order)).select("user_id", "event_type", "event_id", "value")


@query(_latest_sql("date_trunc('day', ts) DESC, ts DESC, event_id DESC"))
def latest_per_key(spark, sf_dir):
    return _latest(spark, sf_dir, F.date_trunc("day", "ts"), F.col("ts"), F.col("event_id"))


@query(_latest_sql("date_trunc('day', ts) DESC, event_id DESC"))
def latest_per_key_tie_by_id(spark, sf_dir):
    return _latest(spark, sf_dir, F.date_trunc("day", "ts"), F.col("event_id"))


@query(_latest_sql("date_trunc('day', ts) DESC, value DESC, event_id DESC"))
def latest_per_key_tie_by_value(spark, sf_dir):
    return _latest(spark, sf_dir, F.date_trunc("day", "ts"), F.col("value"), F.col("event_id"))


@query("""
WITH r AS (SELECT conv_id, CASE WHEN role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS s FROM conversations)
SELECT conv_id, count(*) AS n, CAST(sum(s) AS BIGINT) AS switches, round(sum(s) / CAST(nullif(count(*) - 1, 0) AS DOUBLE), 4) AS switch_rate FROM r GROUP BY 1""")
def role_switch_rate(spark, sf_dir):
    return S.switch_rate(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role")


@query("""SELECT hour, event_id, value FROM (SELECT date_trunc('hour', ts) AS hour, event_id, value, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1""")
def argmax_per_bucket(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    return S.top(rows, ["hour"], [F.desc("value"), "event_id"], 1).select("hour", "event_id", "value")


@query("""SELECT event_type, event_id, value, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 3""")
def top_per_group(spark, sf_dir):
    return S.top(table(spark, sf_dir, "events"), ["event_type"], [F.desc("value"), "event_id"], 3).select("event_type", "event_id", "value", "rank")


#: Events as stretches of time, in hours since 2024 began, so that the default gaps and buffers meet some of them.
_HOURS = "e AS (SELECT event_id, user_id, event_type, (epoch_us(ts) - 1704067200000000) / 3600000000.0 AS s, (epoch_us(ts) - 1704067200000000) / 3600000000.0 + value / 20 AS e FROM events)"


def _hours(spark, sf_dir):
    at = (micros() - F.lit(1704067200000000)) / 3600000000.0
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", at.alias("s"), (at + F.col("value") / 20).alias("e"))


@query(f"""
WITH {_HOURS}, n AS (SELECT *, lead(s) OVER (PARTITION BY user_id ORDER BY s, e) AS nx FROM e)
SELECT event_id, round(greatest(e, CASE WHEN nx IS NULL THEN e + 1.2 WHEN nx - e >= 0 AND nx - e <= 2.5 THEN nx ELSE least(e + 1.2, nx) END), 2) AS extended FROM n""")
def lead_extend(spark, sf_dir):
    return S.until_next(_hours(spark, sf_dir), ["user_id"], "s", "e").select("event_id", "extended")


@query(f"""
WITH {_HOURS}, d AS (SELECT user_id, event_type, CAST(floor(s / 24) AS BIGINT) AS day, s, e FROM e),
k AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id, day) AS n, lead(s) OVER w AS s2, lead(e) OVER w AS e2, lead(event_type) OVER w AS t2 FROM d WINDOW w AS (PARTITION BY user_id, day ORDER BY s, e)),
p AS (SELECT *, n % 2 = 0 AND event_type = t2 AND s2 - e BETWEEN 0 AND 2.5 AS fits FROM k WHERE k % 2 = 1), g AS (SELECT user_id, day FROM p GROUP BY 1, 2 HAVING bool_and(coalesce(fits, false)))
SELECT user_id, day, (k + 1) // 2 AS pair, round(s, 6) AS s, round(greatest(e, e2), 6) AS e, event_type FROM p JOIN g USING (user_id, day)""")
def pair_consecutive(spark, sf_dir):
    rows = _hours(spark, sf_dir).withColumn("day", F.floor(F.col("s") / 24))
    expected = rows.groupBy("user_id", "day").agg(F.floor(F.count("*") / 2).alias("reps"))
    pairs = S.consecutive_pairs(rows.join(expected, ["user_id", "day"]), ["user_id", "day"], "s", "e", "event_type", "reps")
    return pairs.withColumn("s", F.round("s", 6)).withColumn("e", F.round("e", 6))


@query("""
WITH n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS d, greatest(3, floor(count(*) OVER (PARTITION BY user_id) * 0.12 + 0.5)) AS k FROM events)
SELECT user_id, round(median(value) FILTER (u <= k), 6) AS setup, round(median(value) FILTER (d <= k), 6) AS finish FROM n GROUP BY 1""")
def edge_medians(spark, sf_dir):
    return S.edge_medians(table(spark, sf_dir, "events"), ["user_id"], ["ts"], "value").select("user_id", F.round("setup", 6).alias("setup"), F.round("finish", 6).alias("finish"))


@query("""
WITH b AS (SELECT user_id, median(value) AS base FROM events GROUP BY 1) SELECT user_id, min(ts) FILTER (abs(value - base) >= 40) AS onset FROM events JOIN b USING (user_id) GROUP BY 1""")
def first_crossing(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    base = rows.groupBy("user_id").agg(F.median("value").alias("base"))
    return S.onset(rows.join(base, "user_id"), ["user_id"], "ts", "value", "base", 40.0)


@query("""
WITH p AS (SELECT user_id, arg_max(epoch_us(ts), value) AS peak_time, max(value) AS peak FROM events GROUP BY 1)
SELECT user_id, peak_time, peak, min(value) FILTER (epoch_us(ts) < peak_time) AS least_before, min(value) FILTER (epoch_us(ts) > peak_time) AS least_after FROM events JOIN p USING (user_id) GROUP BY 1, 2, 3""")
def phase_extrema(spark, sf_dir):
    return S.split_extrema(table(spark, sf_dir, "events").withColumn("us", micros()), ["user_id"], "us", "value")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS repeated FROM lineitem")
def duplicate_assignment_flag(spark, sf_dir):
    return S.repeated_flag(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "repeated")


@query("""
WITH o AS (SELECT o_orderkey, CAST(o_custkey % 10 AS DOUBLE) AS s, o_custkey % 10 + o_totalprice / 8192 AS e, 1 + o_custkey % 5 AS k FROM orders), x AS (SELECT *, unnest(range(1, k + 1)) AS segment, greatest(e - s, 0.5) / k AS len FROM o)
SELECT o_orderkey, CAST(segment AS INT) AS segment, round(greatest(s, s + (segment - 1) * len - greatest(0.55, least(1.4, len * 0.18))), 2) AS segment_start,
round(least(e, s + segment * len + greatest(0.65, least(1.6, len * 0.22))), 2) AS segment_end FROM x""")
def sequence_segments(spark, sf_dir):
    s = (F.col("o_custkey") % 10).cast("double")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", s.alias("s"), (s + F.col("o_totalprice") / 8192).alias("e"), (1 + F.col("o_custkey") % 5).alias("k"))
    return S.segments(rows, "s", "e", "k").select("o_orderkey", "segment", "segment_start", "segment_end")


@query("""
WITH l AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase'), r AS (SELECT event_id AS rid, user_id, epoch_us(ts) AS rt FROM events WHERE event_type = 'view'),
j AS (SELECT l.event_id, rt, rid, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(t - rt), rt, rid) AS k FROM l LEFT JOIN r USING (user_id))
SELECT event_id, rt AS nearest_time, rid AS nearest_id FROM j WHERE k = 1""")
def asof_nearest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("us", micros())
    left, right = rows.where("event_type = 'purchase'").select("event_id", "user_id", "us"), rows.where("event_type = 'view'").select(F.col("event_id").alias("rid"), "user_id", F.col("us").alias("rt"))
    return J.nearest_in_time(left, right, ["user_id"], "us", "rt", "rid").select("event_id", "nearest_time", "nearest_id")


_SPANS = "s AS (SELECT event_id AS span_id, user_id, epoch_us(ts) / 1000000.0 - 7200 AS start, epoch_us(ts) / 1000000.0 + value * 600 AS \"end\" FROM events WHERE event_type = 'purchase')"


def _spans(spark, sf_dir):
    e = _events(spark, sf_dir).where("event_type = 'purchase'")
    return e.select(F.col("event_id").alias("span_id"), "user_id", (F.col("t") - 7200).alias("start"), (F.col("t") + F.col("value") * 600).alias("end"))


@query(f"""WITH {_SPANS} SELECT span_id, count(*) AS n, min(event_id) AS first_event, round(avg(value), 6) AS mean FROM s JOIN events e ON s.user_id = e.user_id AND epoch_us(ts) / 1000000.0 BETWEEN start AND "end" GROUP BY 1""")
def interval_join(spark, sf_dir):
    points = _events(spark, sf_dir).select("event_id", "user_id", "t", "value")
    joined = J.interval_join(points, _spans(spark, sf_dir), ["user_id"], "t", "start", "end", 7200.0)
    return joined.groupBy("span_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.round(F.avg("value"), 6).alias("mean"))


@query(f"""
WITH {_SPANS}, r AS (SELECT event_id AS rid, user_id, epoch_us(ts) / 1000000.0 AS rs, epoch_us(ts) / 1000000.0 + 3600 AS re FROM events WHERE event_type = 'error')
SELECT span_id, rid, round(greatest(0, least("end", re) - greatest(start, rs)) / greatest(0.01, re - rs), 6) AS ratio FROM s JOIN r USING (user_id)
WHERE start <= re AND rs <= "end" AND round(greatest(0, least("end", re) - greatest(start, rs)) / greatest(0.01, re - rs), 6) > 0.2""")
def overlap_ratio(spark, sf_dir):
    e = _events(spark, sf_dir).where("event_type = 'error'").select(F.col("event_id").alias("rid"), "user_id", F.col("t").alias("r_start"), (F.col("t") + 3600).alias("r_end"))
    return J.overlaps(_spans(spark, sf_dir), e, ["user_id"], 7200.0, 0.2).select("span_id", "rid", "ratio")


@query("""
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
b AS (SELECT user_id, max(value) FILTER (k = floor((n - 1) * 0.2 + 0.5)) AS p20, max(value) FILTER (k = floor((n - 1) * 0.8 + 0.5)) AS p80 FROM r GROUP BY 1)
SELECT event_id, round(value - p20, 6) AS elevation, round(greatest(0, p80 - value), 6) AS compression FROM events JOIN b USING (user_id)""")
def percentile_baseline(spark, sf_dir):
    from tempora.operators.aggregates import nearest_rank

    rows = table(spark, sf_dir, "events")
    base = nearest_rank(rows, ["user_id"], "value", [0.2, 0.8])
    return rows.join(base, "user_id").select("event_id", F.round(F.col("value") - F.col("p20"), 6).alias("elevation"), F.round(F.greatest(F.lit(0.0), F.col("p80") - F.col("value")), 6).alias("compression"))
