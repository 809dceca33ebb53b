"""Detectors bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.operators import detectors as D
from tempora.operators import frames as P
from tempora.plans.catalog import micros, query, table


@query("""
WITH s AS (SELECT user_id, epoch_us(ts) / 1000000.0 AS t, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS v, count(*) OVER (PARTITION BY user_id) AS n FROM events),
r AS (SELECT user_id, v, n, row_number() OVER (PARTITION BY user_id ORDER BY v) - 1 AS k FROM s WHERE n >= 10),
l AS (SELECT user_id, max(v) FILTER (k = floor((n - 1) * 0.25 + 0.5)) AS lo, max(v) FILTER (k = floor((n - 1) * 0.92 + 0.5)) AS hi FROM r GROUP BY 1),
f AS (SELECT s.*, v >= greatest(0.006, lo + (hi - lo) * 0.42) AS inside, min(t) OVER (PARTITION BY user_id) AS t0, max(t) OVER (PARTITION BY user_id) AS t1 FROM s JOIN l USING (user_id)),
g AS (SELECT *, CASE WHEN inside AND NOT coalesce(lag(inside) OVER (PARTITION BY user_id ORDER BY t), false) THEN 1 ELSE 0 END AS st FROM f),
i AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS island FROM g),
p AS (SELECT user_id, round(greatest(any_value(t0), min(t) - 600), 2) AS a, round(least(any_value(t1), max(t) + 800), 2) AS b FROM i WHERE inside GROUP BY user_id, island),
q AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p WHERE b - a >= 900),
m AS (SELECT *, sum(CASE WHEN reach IS NULL OR a - reach > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS grp FROM q)
SELECT user_id, min(a) AS start, max(b) AS "end", count(*) AS merged FROM m GROUP BY user_id, grp""")
def adaptive_active_periods(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("t", micros() / 1e6)
    return D.active_periods(rows, ["user_id"], "t", "value", before=600.0, after=800.0, shortest=900.0, gap=3600.0)


_SEGMENTS = "SELECT o_orderkey, CAST(o_custkey % 7 AS DOUBLE) AS s, CAST(o_custkey % 7 + 5 + o_orderkey % 4 AS DOUBLE) AS e, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 9 AS DOUBLE) END AS cs, CAST(o_orderkey % 9 + 6 AS DOUBLE) AS ce FROM orders"


def _segments(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", (c % 7).cast("double").alias("s"), (c % 7 + 5 + k % 4).cast("double").alias("e"), F.when(k % 11 != 0, (k % 9).cast("double")).alias("cs"), (k % 9 + 6).cast("double").alias("ce")
    )


@query(f"""
WITH x AS (SELECT *, round(s - cs, 2) AS lead_, round(ce - e, 2) AS tail_, greatest(0, least(e, ce) - greatest(s, cs)) / greatest(0.01, ce - cs) AS cover FROM ({_SEGMENTS}))
SELECT o_orderkey, CASE WHEN cs IS NULL THEN 'insufficient' WHEN lead_ > 0.35 OR tail_ > 0.35 OR cover < 0.85 THEN 'needs_adjustment' ELSE 'good' END AS status,
CASE WHEN cs IS NULL THEN '' ELSE concat_ws(',', CASE WHEN lead_ > 0.35 THEN 'missing_start' END, CASE WHEN tail_ > 0.35 THEN 'missing_return' END, CASE WHEN cover < 0.85 THEN 'too_short' END,
CASE WHEN lead_ < -2 THEN 'wide_lead' END, CASE WHEN tail_ < -2 THEN 'wide_tail' END) END AS issues FROM x""")
def segment_evaluation(spark, sf_dir):
    status, issues = D.segment_evaluation(F.col("s"), F.col("e"), F.col("cs"), F.col("ce"))
    return _segments(spark, sf_dir).select("o_orderkey", status.alias("status"), F.array_join(issues, ",").alias("issues"))


@query(f"""
SELECT o_orderkey, CASE WHEN b > a THEN a END AS draft_start, CASE WHEN b > a THEN b END AS draft_end
FROM (SELECT o_orderkey, round(greatest(s, cs - 0.2), 2) AS a, round(least(e, ce + 0.2), 2) AS b FROM ({_SEGMENTS}) WHERE cs IS NOT NULL)""")
def draft_ranges(spark, sf_dir):
    a, b = D.draft_range(F.col("cs"), F.col("ce"), F.col("s"), F.col("e"))
    return _segments(spark, sf_dir).where("cs IS NOT NULL").select("o_orderkey", a.alias("draft_start"), b.alias("draft_end"))


@query("""
WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS expected, count(*) FILTER (event_type = 'view') AS found, count(*) FILTER (event_type = 'error') AS assigned FROM events GROUP BY 1)
SELECT user_id, CASE WHEN expected > 0 AND (found < expected OR assigned < expected) THEN 'blocked' WHEN expected > 0 AND found > expected THEN 'needs_review' ELSE 'ok' END AS status,
concat_ws(',', CASE WHEN expected > 0 AND found < expected THEN 'detected_shortfall' END, CASE WHEN expected > 0 AND assigned < expected THEN 'assigned_shortfall' END, CASE WHEN expected > 0 AND found > expected THEN 'extra_candidates' END) AS issues FROM c""")
def cycle_count_qa(spark, sf_dir):
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(n("click").alias("expected"), n("view").alias("found"), n("error").alias("assigned"))
    status, issues = D.cycle_count_status(F.col("expected"), F.col("found"), F.col("assigned"))
    return counts.select("user_id", status.alias("status"), F.array_join(issues, ",").alias("issues"))


@query("""
WITH b AS (SELECT l_orderkey, l_partkey, CAST(l_suppkey AS INT) AS position, l_discount AS x1, l_discount + l_quantity / 100.0 AS x2, l_tax AS y1, l_tax + l_quantity / 50.0 AS y2, l_linenumber / 7.0 AS seen FROM lineitem),
s AS (SELECT *, round((1 - (x1 + x2) / 2) + (x2 - x1) * (y2 - y1) * 0.25 + seen * 0.05, 6) AS score FROM b)
SELECT l_orderkey, max(score) AS score FROM s GROUP BY 1""")
def primary_subject(spark, sf_dir):
    q = F.col("l_quantity")
    boxes = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").cast("int").alias("position"), F.col("l_discount").alias("x1"), (F.col("l_discount") + q / 100).alias("x2"), F.col("l_tax").alias("y1"), (F.col("l_tax") + q / 50).alias("y2"), (F.col("l_linenumber") / 7).alias("seen"))
    score = F.round(P.subject_score("left", F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col("seen"), F.col("position")), 6)
    return P.primary_subject(boxes.withColumn("score", score), ["l_orderkey"], F.col("score")).select("l_orderkey", "score")
