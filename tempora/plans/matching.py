"""Sequential matching, as recursion over a key's ordered rows in SQL; tests hold the operators against brute force too."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.operators import matching as M
from tempora.plans.catalog import micros, query, table


def _cycles(spark, sf_dir, kind: str, length: int):
    """Events of one kind as cycles of some length, by user and day: what one recording would hold."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    t = micros() / 1e6
    return e.select("user_id", F.to_date("ts").alias("day"), F.col("event_id").alias("id"), t.alias("start"), (t + length + F.col("value") * 60).alias("end"), F.col("value").alias("strength"))


_KEYS = ["user_id", "day"]


def _cycles_sql(kind: str, length: int) -> str:
    return f"SELECT user_id, CAST(ts AS DATE) AS day, event_id AS id, epoch_us(ts) / 1000000.0 AS s, epoch_us(ts) / 1000000.0 + {length} + value * 60 AS e, value AS v FROM events WHERE event_type = '{kind}'"


_SHARE = "greatest(0, least(seg.e, c.e) - greatest(seg.s, c.s)) / greatest(0.01, c.e - c.s)"


@query(f"""
WITH RECURSIVE c AS ({_cycles_sql("view", 600)}), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY s, v, e, id) AS k FROM c),
f AS (SELECT user_id, day, k, 1 AS g, s, e, v, id FROM r WHERE k = 1 UNION ALL
SELECT r.user_id, r.day, r.k, CASE WHEN r.s - f.s < 7200 THEN g ELSE g + 1 END, CASE WHEN r.s - f.s < 7200 AND NOT r.v > f.v THEN f.s ELSE r.s END, CASE WHEN r.s - f.s < 7200 AND NOT r.v > f.v THEN f.e ELSE r.e END,
CASE WHEN r.s - f.s < 7200 AND NOT r.v > f.v THEN f.v ELSE r.v END, CASE WHEN r.s - f.s < 7200 AND NOT r.v > f.v THEN f.id ELSE r.id END FROM f JOIN r ON r.user_id = f.user_id AND r.day = f.day AND r.k = f.k + 1)
SELECT user_id, day, arg_max(id, k) AS id, arg_max(s, k) AS time, arg_max(e, k) AS "end", arg_max(v, k) AS strength FROM f GROUP BY user_id, day, g""")
def peak_merge(spark, sf_dir):
    return M.merge_peaks(_cycles(spark, sf_dir, "view", 600).withColumnRenamed("start", "time"), _KEYS, "time", "strength", 7200.0)


@query(f"""
WITH RECURSIVE c AS ({_cycles_sql("view", 7200)}), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY s, e, id) AS k FROM c),
f AS (SELECT user_id, day, k, [{{'s': s, 'e': e, 'id': id, 'v': v}}] AS kept FROM r WHERE k = 1 UNION ALL
SELECT user_id, day, k, CASE WHEN met IS NULL OR met = 0 THEN list_append(kept, x) WHEN x.v > kept[met].v THEN list_concat(list_append(kept[1:met - 1], x), kept[met + 1:]) ELSE kept END
FROM (SELECT r.user_id, r.day, r.k, kept, {{'s': r.s, 'e': r.e, 'id': r.id, 'v': r.v}} AS x,
list_position(list_transform(kept, lambda o: greatest(0, least(o.e, r.e) - greatest(o.s, r.s)) / greatest(0.01, least(o.e - o.s, r.e - r.s)) >= 0.5), true) AS met FROM f JOIN r ON r.user_id = f.user_id AND r.day = f.day AND r.k = f.k + 1)),
z AS (SELECT user_id, day, arg_max(kept, k) AS kept FROM f GROUP BY 1, 2), u AS (SELECT user_id, day, unnest(kept) AS x FROM z)
SELECT user_id, day, x.id AS id, x.s AS start, x.e AS "end", x.v AS strength, row_number() OVER (PARTITION BY user_id, day ORDER BY x.s, x.e, x.id) AS number FROM u""")
def dedupe_overlaps(spark, sf_dir):
    return M.drop_overlaps(_cycles(spark, sf_dir, "view", 7200), _KEYS, "strength", 0.5)


def _anchored(spark, sf_dir):
    return _cycles(spark, sf_dir, "view", 900).withColumn("anchor", F.when(F.col("id") % 3 != 0, F.col("start") + F.col("strength") * 10))


@query()
def dp_match(spark, sf_dir):
    return M.match_in_order(_cycles(spark, sf_dir, "click", 900), _anchored(spark, sf_dir), _KEYS).withColumn("cost", F.round("cost", 4))


@query(f"""
WITH RECURSIVE seg AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY s, e, id) AS k FROM ({_cycles_sql("click", 900)})),
a AS (SELECT *, CASE WHEN id % 3 <> 0 THEN s + v * 10 ELSE (s + e) / 2 END AS anchor FROM ({_cycles_sql("view", 900)})), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY anchor, id, e, s) AS j FROM a),
o AS (SELECT seg.user_id, seg.day, seg.k, c.j, {_SHARE} >= 0.55 OR c.anchor BETWEEN seg.s - 0.4 AND seg.e + 0.4 AS fits, abs(c.anchor - (seg.s + seg.e) / 2) + 3 * greatest(0, seg.s - c.anchor, c.anchor - seg.e) AS far FROM seg JOIN n c USING (user_id, day)),
l AS (SELECT user_id, day, k, list({{'j': j, 'fits': fits, 'far': far}} ORDER BY j) AS opts FROM o GROUP BY 1, 2, 3),
f AS (SELECT user_id, day, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS cursor, CAST(NULL AS BIGINT) AS j FROM l GROUP BY 1, 2 UNION ALL
SELECT user_id, day, k, coalesce(j, cursor), j FROM (SELECT l.user_id, l.day, l.k, cursor, coalesce(list_filter(opts, lambda x: x.j > cursor AND x.fits)[1].j,
list_sort(list_transform(list_filter(opts, lambda x: x.j > cursor), lambda x: {{'far': x.far, 'j': x.j}}))[1].j) AS j FROM f JOIN l ON l.user_id = f.user_id AND l.day = f.day AND l.k = f.k + 1))
SELECT f.user_id, f.day, seg.id AS segment_id, c.id AS cycle_id, round(abs(c.anchor - (seg.s + seg.e) / 2) + 3 * greatest(0, seg.s - c.anchor, c.anchor - seg.e) + (1 - {_SHARE}) * greatest(0.01, seg.e - seg.s), 4) AS cost
FROM f JOIN seg ON seg.user_id = f.user_id AND seg.day = f.day AND seg.k = f.k JOIN n c ON c.user_id = f.user_id AND c.day = f.day AND c.j = f.j""")
def greedy_match(spark, sf_dir):
    return M.match_greedily(_cycles(spark, sf_dir, "click", 900), _anchored(spark, sf_dir), _KEYS).withColumn("cost", F.round("cost", 4))


@query()
def balanced_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return M.balanced_sample(docs, "lang", "quality", "source", "doc_id", 32, 7)
