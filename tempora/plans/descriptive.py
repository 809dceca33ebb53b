"""Statistics, agreement, distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators import aggregates as A
from tempora.operators import clusters as C
from tempora.plans.catalog import query, table

_PAIRS = "SELECT l_returnflag, CAST(l_linenumber % 4 AS INT) AS a, CAST(l_partkey % 4 AS INT) AS b FROM lineitem"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_linenumber") % 4).cast("int").alias("a"), (F.col("l_partkey") % 4).cast("int").alias("b"))


def _kappa_sql(power: int) -> str:
    return f"""
WITH p AS ({_PAIRS}), o AS (SELECT l_returnflag, count(*) AS n, avg(pow(abs(a - b) / 3.0, {power})) AS obs FROM p GROUP BY 1),
l AS (SELECT l_returnflag, a, count(*) AS c FROM p GROUP BY 1, 2), r AS (SELECT l_returnflag, b, count(*) AS c FROM p GROUP BY 1, 2),
e AS (SELECT l.l_returnflag, sum(CAST(l.c AS DOUBLE) * r.c * pow(abs(a - b) / 3.0, {power})) AS x FROM l JOIN r USING (l_returnflag) GROUP BY 1)
SELECT l_returnflag, n, round(1 - obs / nullif(x / (CAST(n AS DOUBLE) * n), 0), 4) AS kappa FROM o JOIN e USING (l_returnflag)"""


@query(_kappa_sql(1))
def weighted_kappa_linear(spark, sf_dir):
    return A.weighted_kappa(_pairs(spark, sf_dir), ["l_returnflag"], "a", "b", quadratic=False)


@query(_kappa_sql(2))
def weighted_kappa_quadratic(spark, sf_dir):
    return A.weighted_kappa(_pairs(spark, sf_dir), ["l_returnflag"], "a", "b", quadratic=True)


@query(f"""
WITH p AS ({_PAIRS}) SELECT l_returnflag, CAST(a AS INT) AS "left", count(*) FILTER (b = 0) AS right_0, count(*) FILTER (b = 1) AS right_1,
count(*) FILTER (b = 2) AS right_2, count(*) FILTER (b = 3) AS right_3 FROM p GROUP BY 1, 2""")
def confusion_matrix(spark, sf_dir):
    return A.confusion(_pairs(spark, sf_dir), ["l_returnflag"], "a", "b")


@query(f"""
WITH p AS ({_PAIRS}) SELECT l_returnflag, count(*) AS compared, count(*) FILTER (a = b) AS exact, count(*) FILTER (abs(b - a) <= 1) AS within_one,
count(*) FILTER (b > a) AS higher, count(*) FILTER (b < a) AS lower, round(avg(abs(b - a)), 4) AS mean_absolute, round(avg(b - a), 4) AS mean_signed,
round(count(*) FILTER (a = b) / CAST(count(*) AS DOUBLE), 4) AS exact_rate, round(count(*) FILTER (abs(b - a) <= 1) / CAST(count(*) AS DOUBLE), 4) AS within_one_rate
FROM p GROUP BY 1""")
def agreement_metrics(spark, sf_dir):
    return A.agreement(_pairs(spark, sf_dir), ["l_returnflag"], "a", "b")


_LONG = """SELECT l_returnflag, 'l_quantity' AS feature, l_quantity AS value FROM lineitem UNION ALL SELECT l_returnflag, 'l_extendedprice', l_extendedprice FROM lineitem
UNION ALL SELECT l_returnflag, 'l_discount', l_discount FROM lineitem"""


def _long(spark, sf_dir):
    return A.long_form(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_quantity", "l_extendedprice", "l_discount"])


@query(f"""
SELECT l_returnflag, feature, count(value) AS n, count(*) FILTER (value IS NULL) AS missing, round(min(value), 6) AS least, round(quantile_cont(value, 0.25), 6) AS q1,
round(quantile_cont(value, 0.5), 6) AS median, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS largest,
round(stddev_samp(value), 6) AS deviation FROM ({_LONG}) GROUP BY 1, 2""")
def describe_features(spark, sf_dir):
    return A.describe(_long(spark, sf_dir), ["l_returnflag", "feature"])


@query("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(value) FILTER (k = floor((n - 1) * 0.25 + 0.5)) AS p25, max(value) FILTER (k = floor((n - 1) * 0.5 + 0.5)) AS p50, max(value) FILTER (k = floor((n - 1) * 0.92 + 0.5)) AS p92 FROM r GROUP BY 1""")
def nearest_rank_percentile(spark, sf_dir):
    return A.nearest_rank(table(spark, sf_dir, "events"), ["event_type"], "value", [0.25, 0.5, 0.92], few_keys=True)


_MAD = f"""
l AS ({_LONG}), m AS (SELECT l_returnflag, feature, median(value) AS med, stddev_samp(value) AS sd FROM l GROUP BY 1, 2),
d AS (SELECT l_returnflag, feature, any_value(med) AS med, any_value(sd) AS sd, median(abs(value - med)) AS mad FROM l JOIN m USING (l_returnflag, feature) GROUP BY 1, 2),
s AS (SELECT l_returnflag, feature, round(med, 6) AS centre, round(CASE WHEN mad > 0 THEN mad * 1.4826 WHEN sd > 0 THEN sd END, 6) AS scale FROM d)"""


@query(f"WITH {_MAD} SELECT * FROM s")
def mad_standardize(spark, sf_dir):
    return A.standardization(_long(spark, sf_dir), ["l_returnflag", "feature"])


@query(f"""
WITH {_MAD} SELECT l_returnflag, feature, count(*) AS n, count(*) FILTER (z >= 4) AS high, count(*) FILTER (z <= -4) AS low, round(avg(z), 3) AS mean_z
FROM (SELECT l_returnflag, feature, round(greatest(-4, least(4, (value - centre) / scale)), 4) AS z FROM l JOIN s USING (l_returnflag, feature)) GROUP BY 1, 2""")
def robust_z(spark, sf_dir):
    long = _long(spark, sf_dir)
    z = C.robust_z(long, A.standardization(long, ["l_returnflag", "feature"]), ["l_returnflag", "feature"])
    return z.groupBy("l_returnflag", "feature").agg(F.count("*").alias("n"), F.count_if(F.col("z") >= 4).alias("high"), F.count_if(F.col("z") <= -4).alias("low"), F.round(F.avg("z"), 3).alias("mean_z"))


@query("""
WITH s AS (SELECT l_linestatus, count(*) FILTER (l_returnflag = 'A') AS nl, count(*) FILTER (l_returnflag = 'R') AS nh, avg(l_extendedprice) FILTER (l_returnflag = 'A') AS ml,
avg(l_extendedprice) FILTER (l_returnflag = 'R') AS mh, var_samp(l_extendedprice) FILTER (l_returnflag = 'A') AS vl, var_samp(l_extendedprice) FILTER (l_returnflag = 'R') AS vh FROM lineitem GROUP BY 1)
SELECT l_linestatus, nl AS n_low, nh AS n_high, round((mh - ml) / sqrt(((nl - 1) * vl + (nh - 1) * vh) / (nl + nh - 2)) * (1 - 3.0 / (4 * (nl + nh) - 9)), 6) AS g FROM s""")
def hedges_g(spark, sf_dir):
    return A.hedges_g(table(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_returnflag", "A", "R", "l_extendedprice")


@query("SELECT l_returnflag, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def pearson(spark, sf_dir):
    return A.pearson(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")


@query("""
WITH k AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS x,
rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS y FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(corr(x, y), 6) AS rho FROM k GROUP BY 1""")
def spearman(spark, sf_dir):
    return A.spearman(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")


@query("""
WITH m AS (SELECT l_returnflag, l_suppkey, median(l_quantity) AS x, median(l_extendedprice) AS y FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, count(*) AS n, round(corr(x, y), 6) AS r FROM m GROUP BY 1""")
def source_median_correlation(spark, sf_dir):
    return A.source_median_correlation(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_suppkey", "l_quantity", "l_extendedprice")


@query("""
WITH m AS (SELECT unnest(string_split(lower(p_type), ' ')) AS member, p_brand FROM part) SELECT p_brand, member, count(*) AS n FROM m GROUP BY 1, 2""")
def count_issue_codes(spark, sf_dir):
    return A.count_members(table(spark, sf_dir, "part").withColumn("codes", F.split(F.lower("p_type"), " ")), ["p_brand"], "codes")


@query("""
SELECT coalesce(event_type, '(all)') AS event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (value > 20) AS high FROM events GROUP BY GROUPING SETS ((event_type), ())""")
def overall_and_by_type(spark, sf_dir):
    return A.with_total(table(spark, sf_dir, "events"), "event_type", [F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("value") > 20).alias("high")])


@query("""
SELECT p_brand, min(p_retailprice) AS least, median(p_retailprice) AS median, max(p_retailprice) AS largest, round(max(p_retailprice) - min(p_retailprice), 6) AS range,
round(CASE WHEN min(p_retailprice) > 0 THEN max(p_retailprice) / min(p_retailprice) END, 4) AS ratio FROM part GROUP BY 1""")
def range_summary(spark, sf_dir):
    return A.range_summary(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice")


@query("""
WITH o AS (SELECT o_orderkey, count(l_linenumber) AS lines, coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
SELECT count(*) AS orders, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(quantity) AS BIGINT) AS quantity, round(sum(quantity) / CAST(sum(lines) AS DOUBLE), 4) AS per_line FROM o""")
def partial_and_final_rollup(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    each = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left").fillna(0)
    return each.agg(F.count("*").alias("orders"), F.sum("lines").alias("lines"), F.sum("quantity").alias("quantity"), F.round(F.try_divide(F.sum("quantity").cast("double"), F.sum("lines").cast("double")), 4).alias("per_line"))


# ---- distances: part sizes and prices within brands

_PART_LONG = """
l AS (SELECT p_brand, p_partkey, 'size' AS feature, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_brand, p_partkey, 'price', p_retailprice FROM part),
m AS (SELECT p_brand, feature, median(value) AS med, stddev_samp(value) AS sd FROM l GROUP BY 1, 2),
d AS (SELECT p_brand, feature, any_value(med) AS med, any_value(sd) AS sd, median(abs(value - med)) AS mad FROM l JOIN m USING (p_brand, feature) GROUP BY 1, 2),
s AS (SELECT p_brand, feature, round(med, 6) AS centre, round(CASE WHEN mad > 0 THEN mad * 1.4826 WHEN sd > 0 THEN sd END, 6) AS scale FROM d),
z AS (SELECT p_brand, p_partkey, feature, round(greatest(-4, least(4, (value - centre) / scale)), 4) AS z FROM l JOIN s USING (p_brand, feature)),
p AS (SELECT x.p_brand, x.p_partkey AS a, y.p_partkey AS b, sqrt(avg((x.z - y.z) * (x.z - y.z))) AS distance, count(*) AS shared FROM z x JOIN z y ON x.p_brand = y.p_brand AND x.feature = y.feature AND x.p_partkey < y.p_partkey
WHERE x.z IS NOT NULL AND y.z IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 2)"""


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))


def _z(spark, sf_dir):
    long = A.long_form(_parts(spark, sf_dir), ["p_brand", "p_partkey"], ["size", "price"])
    return C.robust_z(long, A.standardization(long, ["p_brand", "feature"]), ["p_brand", "feature"])


def _vectors(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    return C.vectors(parts, A.standardization(A.long_form(parts, ["p_brand"], ["size", "price"]), ["p_brand", "feature"]), ["p_brand"], "p_partkey", ["size", "price"])


@query(f"WITH {_PART_LONG} SELECT p_brand, a, b, round(distance, 6) AS distance, shared FROM p")
def pairwise_distance(spark, sf_dir):
    pairs = C.pair_distances(_vectors(spark, sf_dir), ["p_brand"], "p_partkey", 2)
    return pairs.withColumn("distance", F.floor(F.col("distance") * 1e6 + 0.5) / 1e6)  # as round() by decimals, which takes longer than all else


@query(f"WITH {_PART_LONG} SELECT p_brand, p_partkey, round(sqrt(avg(z * z)), 6) AS score FROM z GROUP BY 1, 2")
def outlier_score(spark, sf_dir):
    return C.outlier_scores(_z(spark, sf_dir), ["p_brand"], "p_partkey")


_SILHOUETTES = f"""
WITH {_PART_LONG}, w AS (SELECT p_brand, a, b, distance FROM p UNION ALL SELECT p_brand, b, a, distance FROM p),
g AS (SELECT p_brand, a, a % 3 AS ga, b % 3 AS gb, avg(distance) AS mean FROM w GROUP BY 1, 2, 3, 4),
o AS (SELECT p_brand, a AS p_partkey, ga AS grp, max(mean) FILTER (ga = gb) AS own, min(mean) FILTER (ga <> gb) AS other FROM g GROUP BY 1, 2, 3)
SELECT p_brand, p_partkey, grp, round(own, 6) AS own, round(other, 6) AS other, CASE WHEN own IS NOT NULL AND other IS NOT NULL THEN CASE WHEN greatest(own, other) > 0 THEN round((other - own) / greatest(own, other), 6) ELSE 0 END END AS silhouette FROM o"""


@query(_SILHOUETTES)
def silhouette(spark, sf_dir):
    rows = _vectors(spark, sf_dir).withColumn("grp", F.col("p_partkey") % 3)
    return C.silhouettes(rows, ["p_brand"], "p_partkey", "grp", 2).withColumn("own", F.round("own", 6)).withColumn("other", F.round("other", 6))


@query(f"""SELECT p_brand, n, m AS mean_silhouette, CASE WHEN m IS NULL THEN 'not_estimable' WHEN m >= 0.5 THEN 'strong_separation_exploratory' WHEN m >= 0.25 THEN 'moderate_separation_exploratory' ELSE 'weak_separation_do_not_name_as_discrete_phenotypes' END AS quality
FROM (SELECT p_brand, count(silhouette) AS n, round(avg(silhouette), 4) AS m FROM ({_SILHOUETTES}) GROUP BY 1)""")
def silhouette_quality(spark, sf_dir):
    return C.mean_silhouette(silhouette(spark, sf_dir), ["p_brand"])



@query(f"""
WITH {_PART_LONG}, e AS (SELECT p_brand, count(distance) FILTER (a % 5 = b % 5) AS within_pairs, count(distance) FILTER (a % 5 <> b % 5) AS between_pairs, round(median(distance) FILTER (a % 5 = b % 5), 4) AS w, round(median(distance) FILTER (a % 5 <> b % 5), 4) AS b FROM p GROUP BY 1),
r AS (SELECT *, CASE WHEN b > 0 THEN round(w / b, 4) END AS ratio FROM e)
SELECT p_brand, within_pairs, between_pairs, w AS "within", b AS "between", ratio, CASE WHEN ratio IS NULL THEN 'not_estimable' WHEN ratio < 0.6 THEN 'strong_source_video_signature' WHEN ratio < 0.85 THEN 'moderate_source_video_signature' ELSE 'weak_source_video_signature' END AS signature FROM r""")
def source_signature(spark, sf_dir):
    return C.source_effect_by_features(_vectors(spark, sf_dir).withColumn("source", F.col("p_partkey") % 5), ["p_brand"], "source", 2)


@query()
def k_medoids(spark, sf_dir):
    return C.k_medoids(_vectors(spark, sf_dir), None, ["p_brand"], "p_partkey", least=2)


@query()
def leave_one_out(spark, sf_dir):
    return C.leave_one_out(_vectors(spark, sf_dir).withColumn("source", F.col("p_partkey") % 5), None, ["p_brand"], "p_partkey", "source", least=2)
