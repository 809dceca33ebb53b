"""Review rounds, evidence, profiles and hints on the test tables: orders and lines stand for items and their reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.functions import hints as H
from tempora.operators import clusters as C
from tempora.operators import rounds as R
from tempora.plans.catalog import query, table
from tempora.plans.descriptive import _PART_LONG, _vectors, _z

# ---- two rounds: each order is reviewed by its clerk's number, once in either round

_ROUND = """SELECT o_orderkey AS id, o_custkey % 5 AS reviewer, CASE WHEN ({k}) % 6 = 0 THEN 'unscorable' ELSE 'scored' END AS status, CASE WHEN ({k}) % 6 <> 0 THEN ({k}) % 4 END AS score,
CASE ({k}) % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' WHEN 3 THEN 'high' END AS confidence, CAST(1000 + ({k}) % 977 AS DOUBLE) AS duration, CASE WHEN ({k}) % 6 = 0 THEN (CASE WHEN ({k}) % 4 = 0 THEN 'view' ELSE 'cut' END) END AS reason FROM orders"""
_A, _B = _ROUND.format(k="o_orderkey + o_custkey"), _ROUND.format(k="o_orderkey + o_custkey + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END")


def _round(spark, sf_dir, second: bool):
    k = F.col("o_orderkey") + F.col("o_custkey") + (F.when(F.col("o_orderkey") % 4 == 0, 1).otherwise(0) if second else 0)
    scored = k % 6 != 0
    confidence = F.when(k % 5 == 0, "low").when(k % 5 == 1, "medium").when(k % 5 < 4, "high")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).alias("reviewer"), F.when(scored, "scored").otherwise("unscorable").alias("status"), F.when(scored, k % 4).alias("score"),
        confidence.alias("confidence"), (1000 + k % 977).cast("double").alias("duration"), F.when(~scored, F.when(k % 4 == 0, "view").otherwise("cut")).alias("reason"),
    )


_CHANGES = f"""a AS ({_A}), b AS ({_B}), r(c, n) AS (VALUES ('low', 1), ('medium', 2), ('high', 3)),
c AS (SELECT a.id, a.reviewer, a.status AS before_status, b.status AS after_status, a.score AS before_score, b.score AS after_score, a.duration AS before_duration, b.duration AS after_duration, a.status <> b.status AS status_changed,
a.status = 'scored' AND b.status = 'scored' AS comparable, CASE WHEN a.status = 'scored' AND b.status = 'scored' THEN a.score <> b.score END AS score_changed, rb.n - ra.n AS confidence_delta, b.duration - a.duration AS duration_delta
FROM a JOIN b ON a.id = b.id LEFT JOIN r ra ON ra.c = a.confidence LEFT JOIN r rb ON rb.c = b.confidence)"""


@query(f"WITH {_CHANGES} SELECT id, reviewer, before_status, after_status, before_score, after_score, status_changed, comparable, score_changed, confidence_delta, duration_delta FROM c")
def reviewer_changes(spark, sf_dir):
    changes = R.reviewer_changes(_round(spark, sf_dir, False), _round(spark, sf_dir, True), ["id", "reviewer"])
    return changes.drop("before_confidence", "after_confidence", "before_duration", "after_duration")


@query(f"""
WITH {_CHANGES} SELECT reviewer, count(*) AS items, count(*) FILTER (status_changed) AS status_changed, count(*) FILTER (comparable) AS comparable, count(*) FILTER (score_changed) AS score_changed, count(*) FILTER (confidence_delta > 0) AS more_confident,
count(*) FILTER (confidence_delta = 0) AS as_confident, count(*) FILTER (confidence_delta < 0) AS less_confident, round(avg(confidence_delta), 4) AS mean_confidence_delta, median(before_duration) AS median_before, median(after_duration) AS median_after,
median(duration_delta) AS median_delta, round(avg(duration_delta), 4) AS mean_delta, round(count(*) FILTER (score_changed) / CAST(nullif(count(*) FILTER (comparable), 0) AS DOUBLE), 4) AS score_change_rate FROM c GROUP BY 1""")
def reviewer_change_summary(spark, sf_dir):
    return R.change_summary(R.reviewer_changes(_round(spark, sf_dir, False), _round(spark, sf_dir, True), ["id", "reviewer"]), ["reviewer"])


@query(f"""
WITH a AS ({_A}), b AS ({_B}), p AS (SELECT a.id, a.status AS ls, b.status AS rs, a.score AS l, b.score AS r, a.reason AS lr, b.reason AS rr FROM a JOIN b ON a.id = b.id),
d AS (SELECT *, CASE WHEN ls <> rs THEN 'scoreability_mismatch' WHEN ls = 'scored' AND l IS DISTINCT FROM r THEN 'score_disagreement' WHEN ls = 'unscorable' AND lr IS DISTINCT FROM rr THEN 'unscorable_reason_disagreement' END AS disagreement FROM p)
SELECT id, ls AS left_status, rs AS right_status, l AS left_score, r AS right_score, disagreement FROM d WHERE disagreement IS NOT NULL""")
def disagreement_queue(spark, sf_dir):
    side = lambda second, mark: _round(spark, sf_dir, second).select("id", *[F.col(c).alias(f"{mark}_{c}") for c in ("status", "score", "reason")])
    return R.disagreements(side(False, "left").join(side(True, "right"), "id")).drop("left_reason", "right_reason")


@query(f"""
WITH a AS ({_A}), b AS ({_B}), c AS (SELECT a.id, a.score AS consensus FROM a JOIN b ON a.id = b.id WHERE a.score = b.score), s AS (SELECT o_orderkey AS id, o_orderpriority AS action, CASE WHEN o_custkey % 7 <> 0 THEN o_custkey % 4 END AS suggested FROM orders),
p AS (SELECT action, abs(consensus - suggested) AS d FROM s JOIN c USING (id) WHERE suggested IS NOT NULL), n AS (SELECT count(*) AS n FROM orders)
SELECT coalesce(action, '(all)') AS action, count(*) AS compared, count(*) FILTER (d = 0) AS exact, count(*) FILTER (d <= 1) AS within_one, round(avg(d), 4) AS mean_absolute, round(count(*) / CAST(any_value(n) AS DOUBLE), 4) AS coverage FROM p, n GROUP BY GROUPING SETS ((action), ())""")
def suggestions_against_consensus(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    b = _round(spark, sf_dir, True).select("id", F.col("score").alias("other"))
    consensus = _round(spark, sf_dir, False).join(b, "id").where("score = other").select("id", F.col("score").alias("consensus"))
    suggested = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("action"), F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey") % 4).alias("suggested"))
    return R.against_consensus(suggested, consensus, "id", "action", orders.count())


@query("""
WITH e AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0), l AS (SELECT o_custkey AS id, o_orderpriority AS reviewer, CASE o_orderkey % 7 WHEN 0 THEN 'deferred' WHEN 5 THEN 'unscorable' ELSE 'scored' END AS status, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey DESC) AS n FROM orders),
f AS (SELECT l.*, e.id IS NOT NULL AS known FROM l LEFT JOIN e ON e.id = l.id WHERE n = 1), k AS (SELECT count(*) AS expected FROM e),
s AS (SELECT reviewer, count(*) FILTER (known) AS reviewed, count(*) FILTER (status = 'scored') AS scored, count(*) FILTER (status = 'unscorable') AS unscorable, count(*) FILTER (status = 'deferred') AS deferred, count(*) FILTER (NOT known) AS unexpected FROM f GROUP BY 1)
SELECT reviewer, expected, reviewed, scored, unscorable, deferred, expected - reviewed AS missing, unexpected, expected > 0 AND scored + unscorable = expected AND deferred = 0 AND expected = reviewed AND unexpected = 0 AS complete FROM s, k""")
def completion_summary(spark, sf_dir):
    from tempora.operators.sequences import latest

    expected = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"))
    k = F.col("o_orderkey") % 7
    reviews = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("reviewer"), "o_orderkey", F.when(k == 0, "deferred").when(k == 5, "unscorable").otherwise("scored").alias("status"))
    return R.completion(expected, latest(reviews, ["id", "reviewer"], ["o_orderkey"]), "id", ["reviewer"])


# ---- gates and contracts


@query("""
SELECT action, feature, CASE WHEN feature = '' THEN 'no_name' WHEN n > 1 THEN 'name_repeats' ELSE 'missing_unit_or_direction' END AS problem FROM (SELECT DISTINCT *, count(*) OVER (PARTITION BY action, feature) AS n FROM
(SELECT p_brand AS action, CASE WHEN p_partkey % 31 = 0 THEN '' ELSE p_type || ' ' || p_size END AS feature, CASE WHEN p_partkey % 13 <> 0 THEN 'cm' END AS unit, CASE WHEN p_partkey % 17 <> 0 THEN 'up' ELSE '' END AS direction FROM part))
WHERE feature = '' OR n > 1 OR unit IS NULL OR direction = '' GROUP BY ALL""")
def feature_contract_violations(spark, sf_dir):
    k = F.col("p_partkey")
    contract = table(spark, sf_dir, "part").select(F.col("p_brand").alias("action"), F.when(k % 31 == 0, "").otherwise(F.concat_ws(" ", "p_type", "p_size")).alias("feature"), F.when(k % 13 != 0, "cm").alias("unit"), F.when(k % 17 != 0, "up").otherwise("").alias("direction"))
    return R.contract_violations(contract)


_GATED = """SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_partkey % 9 <> 0 THEN l_discount * 10 END AS seen, CASE WHEN l_partkey % 8 <> 0 THEN l_tax * 3 END AS missing, ['good', 'limited', 'adjust', NULL][1 + l_suppkey % 4] AS timing, ['ok', 'ok', 'sparse', NULL][1 + l_linenumber % 4] AS feature FROM lineitem"""


def _gated(spark, sf_dir):
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", F.when(F.col("l_partkey") % 9 != 0, F.col("l_discount") * 10).alias("seen"), F.when(F.col("l_partkey") % 8 != 0, F.col("l_tax") * 3).alias("missing"),
        pick(["good", "limited", "adjust", None], F.col("l_suppkey")).alias("timing"), pick(["ok", "ok", "sparse", None], F.col("l_linenumber")).alias("feature"),
    )
    readiness, reasons = R.quality_gate(F.col("seen"), F.col("missing"), F.col("timing"), F.col("feature"))
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", readiness.alias("readiness"), reasons.alias("reasons"))


_GATE = f"""SELECT l_orderkey, l_linenumber, l_returnflag, concat_ws(',', CASE WHEN coalesce(seen, 0) < 0.5 THEN 'low_pose_average_visibility' END, CASE WHEN coalesce(missing, 1) > 0.2 THEN 'high_pose_missing_frames_ratio' END,
CASE WHEN timing IS DISTINCT FROM 'good' THEN 'timing_' || coalesce(timing, 'missing') END, CASE WHEN feature IS DISTINCT FROM 'ok' THEN 'feature_' || coalesce(feature, 'missing') END) AS reasons FROM ({_GATED})"""


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN reasons = '' THEN 'ready' ELSE 'limited' END AS readiness, reasons FROM ({_GATE})")
def quality_gate(spark, sf_dir):
    return _gated(spark, sf_dir).select("l_orderkey", "l_linenumber", "readiness", F.array_join("reasons", ",").alias("reasons"))


@query(f"SELECT coalesce(l_returnflag, '(all)') AS l_returnflag, count(*) AS total, count(*) FILTER (reasons = '') AS ready, count(*) FILTER (reasons <> '') AS limited FROM ({_GATE}) GROUP BY GROUPING SETS ((l_returnflag), ())")
def readiness_by_action(spark, sf_dir):
    return R.readiness_summary(_gated(spark, sf_dir), "l_returnflag")


@query("""
SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_partkey % 10 = 0 THEN 'video_asset_missing' END, CASE WHEN NOT coalesce(s >= 0 AND e > s, false) THEN 'invalid_time_range' END, CASE WHEN coalesce(s >= 0 AND e > s, false) AND e > d + 0.25 THEN 'exceeds_video_duration' END) AS issues
FROM (SELECT *, CASE WHEN l_suppkey % 20 <> 0 THEN l_linenumber - 1.5 END AS s, l_quantity / 2 AS e, CAST(l_suppkey % 25 AS DOUBLE) AS d FROM lineitem)""")
def structural_issues(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 10 != 0, "found").alias("asset"), F.when(F.col("l_suppkey") % 20 != 0, F.col("l_linenumber") - 1.5).cast("double").alias("s"), (F.col("l_quantity") / 2).alias("e"), (F.col("l_suppkey") % 25).cast("double").alias("d"))
    return rows.select("l_orderkey", "l_linenumber", F.array_join(R.structural_issues(F.col("asset"), F.col("s"), F.col("e"), F.col("d")), ",").alias("issues"))


_EVIDENCE = """SELECT o_orderkey AS id, CASE o_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'annotation_only' WHEN 2 THEN 'features_only' ELSE 'full' END AS capability, o_orderkey % 7 <> 0 AS pose, o_orderkey % 11 = 0 AS limited, CASE WHEN o_orderkey % 5 <> 0 THEN 'good' END AS timing, o_custkey % 4 = 0 AS blocked,
CASE WHEN o_orderkey % 3 <> 0 THEN 'ok' END AS feature, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'needs_heel_elevated_attempt' ELSE 'suggested' END AS suggestion, CASE WHEN o_custkey % 9 <> 0 THEN o_custkey % 4 END AS total FROM orders"""


@query(f"""
SELECT id, CASE WHEN capability IS NULL THEN 'unknown' WHEN capability = 'annotation_only' THEN 'annotation_only' WHEN NOT pose THEN 'missing_pose_evidence' WHEN limited THEN 'limited_pose_quality' WHEN capability = 'features_only' AND feature = 'ok' THEN 'features_only'
WHEN capability = 'features_only' THEN 'limited_features' WHEN timing IS NULL THEN 'missing_timing' WHEN blocked THEN 'timing_needs_review' WHEN feature IS NULL THEN 'insufficient_features' WHEN suggestion = 'needs_heel_elevated_attempt' THEN 'staged_scoring_needs_review'
WHEN suggestion IS NULL OR total IS NULL THEN 'insufficient_ai_suggestion' ELSE 'ready' END AS outcome FROM ({_EVIDENCE})""")
def evidence_gate(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    capability = F.when(c % 6 == 1, "annotation_only").when(c % 6 == 2, "features_only").when(c % 6 > 2, "full")
    suggestion = F.when(k % 4 == 1, "needs_heel_elevated_attempt").when(k % 4 > 1, "suggested")
    gate = R.evidence_gate(capability, k % 7 != 0, k % 11 == 0, F.when(k % 5 != 0, "good"), c % 4 == 0, F.when(k % 3 != 0, "ok"), suggestion, F.when(c % 9 != 0, c % 4))
    return table(spark, sf_dir, "orders").select(k.alias("id"), gate.alias("outcome"))


@query("""
WITH s AS (SELECT o_orderkey AS id, o_orderkey % 13 = 0 AS pain, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 4 END AS human, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 4 END AS pose, o_custkey % 2 = 0 AS elevated, CASE WHEN o_custkey % 5 <> 0 THEN o_custkey % 4 END AS fallback FROM orders),
f AS (SELECT *, elevated AND human IS NULL AND fallback IS NOT NULL AND (pose IS NULL OR (fallback >= 2 AND pose < 2)) AS falls FROM s), r AS (SELECT *, CASE WHEN human IS NOT NULL THEN human WHEN falls THEN fallback ELSE pose END AS raw FROM f)
SELECT id, CASE WHEN pain THEN 0 WHEN elevated THEN CASE WHEN raw IS NOT NULL THEN least(raw, 2) END ELSE raw END AS score, CASE WHEN pain THEN 'pain_or_clearing' WHEN human IS NOT NULL THEN 'human_final' WHEN falls THEN 'board_fallback' WHEN pose IS NOT NULL THEN 'pose_suggestion' ELSE 'insufficient_evidence' END AS source,
pain OR raw IS NOT NULL AS scorable FROM r""")
def attempt_scores(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    score, source, scorable = R.attempt_score(k % 13 == 0, F.when(k % 3 == 0, c % 4), F.lit("human_final"), F.when(k % 4 != 0, k % 4), F.lit("pose_suggestion"), c % 2 == 0, F.when(c % 5 != 0, c % 4))
    return table(spark, sf_dir, "orders").select(k.alias("id"), score.alias("score"), source.alias("source"), scorable.alias("scorable"))


# ---- profiles


@query(f"""
WITH {_PART_LONG}, r AS (SELECT p_brand, p_partkey, p_partkey % 3 AS grp, p_type FROM part), c AS (SELECT p_brand, grp, p_type, count(*) AS n FROM r GROUP BY 1, 2, 3), k AS (SELECT p_brand, grp, sum(n) AS n, count(*) AS sources, max(n) / CAST(sum(n) AS DOUBLE) AS share FROM c GROUP BY 1, 2),
f AS (SELECT r.p_brand, grp, feature, round(median(z), 6) AS med FROM r JOIN z USING (p_partkey) WHERE z IS NOT NULL GROUP BY 1, 2, 3), t0 AS (SELECT p_brand, grp, list({{'feature': feature, 'median': med}} ORDER BY abs(med) DESC, feature)[1:3] AS xs FROM f GROUP BY 1, 2), t AS (SELECT p_brand, grp, array_to_string(list_transform(xs, lambda x: x.feature || ':' || CAST(CAST(round(x.median * 100000) AS BIGINT) AS VARCHAR)), ',') AS characteristic FROM t0)
SELECT k.p_brand, k.grp, CAST(n AS BIGINT) AS n, sources, round(share, 4) AS largest_share, sources = 1 OR share >= 0.75 AS concentrated, characteristic FROM k JOIN t ON k.p_brand = t.p_brand AND k.grp = t.grp""")
def group_characterisation(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_partkey") % 3).alias("grp"), "p_type")
    long = _z(spark, sf_dir).select("p_partkey", "feature", "z")
    return R.characterised(rows, long, ["p_brand", "grp"], "p_partkey", "p_type", digits=6).withColumn("characteristic", F.array_join(F.transform("characteristic", lambda x: F.concat_ws(":", x["feature"], F.round(x["median"] * 100000).cast("long").cast("string"))), ","))


@query(f"WITH {_PART_LONG} SELECT p_brand, count(distance) AS n, round(avg(distance), 6) AS mean, round(median(distance), 6) AS median, round(min(distance), 6) AS least, round(max(distance), 6) AS largest FROM p GROUP BY 1")
def distance_summary(spark, sf_dir):
    return C.distance_summary(_vectors(spark, sf_dir), ["p_brand"], 2)


@query(f"""
WITH {_PART_LONG}, x AS (SELECT p_brand, a, b, round(distance, 6) AS distance, a % 5 <> b % 5 AS crossed FROM p), n AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY crossed DESC, distance DESC, a, b) AS n FROM x)
SELECT p_brand, a, b, distance, crossed FROM n WHERE n = 1""")
def contrasting_pairs(spark, sf_dir):
    rows = _vectors(spark, sf_dir).withColumn("source", F.col("p_partkey") % 5)
    return C.contrasting_pair(rows, ["p_brand"], "p_partkey", "source", 2)


# ---- hints


_NOTES = ["['前三个正面', 'total 5 reps, all front', '做了十二次', '共七个动作 都是侧面', 'front then side', '', NULL, 'only 3 segments']", "['squat 4 reps.mp4', 'lunge-side.mov', 'x_正面.mp4', '12-reps', 'a']"]
_COUNTED = {"前三个正面": None, "total 5 reps, all front": 5, "做了十二次": 12, "共七个动作 都是侧面": 7, "front then side": None, "": None, "only 3 segments": 3}


@query(f"""
WITH n AS (SELECT event_id, ({_NOTES[0]})[1 + event_id % 8] AS notes, ({_NOTES[1]})[1 + event_id % 5] AS name, CASE WHEN event_id % 7 = 0 THEN event_id % 30 END AS expected, value AS seconds FROM events),
c AS (SELECT *, coalesce(CASE notes {' '.join(f"WHEN '{k}' THEN {v}" for k, v in _COUNTED.items() if v)} END, CASE name WHEN 'squat 4 reps.mp4' THEN 4 WHEN '12-reps' THEN 12 END) AS said FROM n)
SELECT event_id, said, CAST(least(20, greatest(1, coalesce(CASE WHEN expected > 0 THEN expected END, said, greatest(1, floor(seconds / 3.8))))) AS BIGINT) AS estimate,
CASE WHEN notes = 'front then side' THEN NULL WHEN notes LIKE '%all front%' THEN 'front' WHEN notes LIKE '%都是侧面%' THEN 'side' WHEN name = 'x_正面.mp4' THEN 'front' WHEN name = 'lunge-side.mov' THEN 'side' END AS view FROM c""")
def note_hints(spark, sf_dir):
    k = F.col("event_id")
    notes = [*list(_COUNTED)[:6], None, "only 3 segments"]
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", pick(notes).alias("notes"), pick(["squat 4 reps.mp4", "lunge-side.mov", "x_正面.mp4", "12-reps", "a"]).alias("name"), F.when(k % 7 == 0, k % 30).cast("int").alias("expected"), F.col("value").alias("seconds"))
    c = F.col
    return rows.select("event_id", H.repetitions(c("notes"), c("name")).alias("said"), H.estimated_repetitions(c("seconds"), c("notes"), c("name"), c("expected")).cast("long").alias("estimate"), H.camera_view(c("notes"), c("name")).alias("view"))


@query(r"""
SELECT p_partkey, trim(regexp_replace(replace(replace(lower(t), 'functional movement screen', 'fms'), 'assessment', 'test'), '[^a-z0-9]+', ' ', 'g')) AS folded FROM (SELECT p_partkey, 'Functional Movement Screen: ' || p_name || ' -- Assessment #' || p_size AS t FROM part)""")
def folded_titles(spark, sf_dir):
    title = F.concat(F.lit("Functional Movement Screen: "), "p_name", F.lit(" -- Assessment #"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", H.folded(title).alias("folded"))



#: Notes made of numbers: a and b in Arabic digits, z the Chinese numeral of a. Read by both engines.
_MADE_NOTES = (
    "concat('第', a, '个正面，rep ', b, ' side')", "concat(a, '到', b, '侧面')", "concat('first ', a, ' front, last ', b, ' side')", "concat('rep ', a, '-', b, ' heels elevated; rep ', n, ' fms board')",
    "concat(n, ' reps, all but the first heels raised')", "concat('前', z, '个侧面')", "concat('后', z, '个正面，第', b, '个脚跟抬起')", "'nothing to say'",
)
_NOTE_NUMBERS = "event_id, 1 + event_id % 5 AS a, 1 + event_id % 5 + event_id % 3 AS b, 8 + event_id % 7 AS n"
_CHINESE = "一二三四五"


@query(f"""
WITH e AS (SELECT {_NOTE_NUMBERS}, event_id % 8 AS t FROM events), r AS (SELECT *, unnest(range(1, n + 1)) AS k FROM e)
SELECT event_id, CAST(k AS INT) AS repetition, CASE t WHEN 0 THEN CASE k WHEN a THEN 'front' WHEN b THEN 'side' END WHEN 1 THEN CASE WHEN k BETWEEN a AND b THEN 'side' END WHEN 2 THEN CASE WHEN k <= a THEN 'front' ELSE 'side' END
WHEN 5 THEN CASE WHEN k <= a THEN 'side' END WHEN 6 THEN CASE WHEN k > n - a THEN 'front' END END AS view,
CASE t WHEN 3 THEN k BETWEEN a AND b OR k = n WHEN 4 THEN k > 1 WHEN 6 THEN k = b ELSE false END AS raised FROM r""")
def note_rules(spark, sf_dir):
    from tempora.operators.notes import repetition_rules

    z = F.element_at(F.array(*map(F.lit, _CHINESE)), F.col("a").cast("int"))
    rows = table(spark, sf_dir, "events").selectExpr(*_NOTE_NUMBERS.split(", ")).withColumn("z", z)
    notes = F.lit(None).cast("string")
    for k, made in enumerate(_MADE_NOTES):
        notes = F.when(F.col("event_id") % 8 == k, F.expr(made)).otherwise(notes)
    return repetition_rules(rows.withColumn("notes", notes), ["event_id"], "notes", "n")
