"""Reviews: agreement of raters, adjudication, audits, tiers, gates, scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempora.functions import scalars as X
from tempora.operators import aggregates as A
from tempora.operators import reviews as E
from tempora.operators import scoring as R
from tempora.operators import sequences as S
from tempora.plans.catalog import query, table


@query("""
WITH l AS (SELECT user_id, event_type, CAST(floor(value) AS INT) % 4 AS s, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events),
p AS (SELECT CAST(a.user_id % 4 AS INT) AS action, a.s AS a, b.s AS b FROM l a JOIN l b USING (user_id) WHERE a.event_type = 'click' AND b.event_type = 'view' AND a.r = 1 AND b.r = 1)
SELECT action, count(*) AS compared, count(*) FILTER (a = b) AS exact, count(*) FILTER (abs(b - a) <= 1) AS within_one, count(*) FILTER (b > a) AS higher, count(*) FILTER (b < a) AS lower,
round(avg(abs(b - a)), 4) AS mean_absolute, round(avg(b - a), 4) AS mean_signed, round(count(*) FILTER (a = b) / CAST(count(*) AS DOUBLE), 4) AS exact_rate,
round(count(*) FILTER (abs(b - a) <= 1) / CAST(count(*) AS DOUBLE), 4) AS within_one_rate FROM p GROUP BY 1""")
def agreement_by_action(spark, sf_dir):
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    newest = S.latest(events, ["user_id", "event_type"], ["ts", "event_id"]).withColumn("score", F.floor("value").cast("int") % 4)
    side = lambda kind, name: newest.where(F.col("event_type") == kind).select("user_id", F.col("score").alias(name))
    pairs = side("click", "a").join(side("view", "b"), "user_id").withColumn("action", (F.col("user_id") % 4).cast("int"))
    return A.agreement(pairs, ["action"], "a", "b")


_SCORES = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey % 4 END AS a, CASE WHEN o_orderkey % 5 <> 0 THEN (o_custkey + o_orderkey % 2) % 4 END AS b, o_orderkey % 4 AS ai, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey % 4 END AS old FROM orders"


def _scores(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 7 != 0, c % 4).alias("a"), F.when(k % 5 != 0, (c + k % 2) % 4).alias("b"), (k % 4).alias("ai"), F.when(k % 3 != 0, c % 4).alias("old")
    )


@query(f"""
WITH s AS ({_SCORES}) SELECT o_orderkey, CASE WHEN a IS NULL OR b IS NULL THEN 'pending' WHEN a = b OR ai = a OR ai = b THEN 'valid' ELSE 'invalid' END AS status,
CASE WHEN a IS NULL OR b IS NULL THEN 'none' WHEN a = b THEN 'human_consensus' WHEN ai = a OR ai = b THEN 'ai_human_match' ELSE 'none' END AS source,
CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN a = b THEN a WHEN ai = a THEN a WHEN ai = b THEN b END AS final FROM s""")
def adjudication(spark, sf_dir):
    status, source, final = R.adjudicated(F.col("ai"), F.col("a"), F.col("b"))
    return _scores(spark, sf_dir).select("o_orderkey", status.alias("status"), source.alias("source"), final.alias("final"))


@query(f"""
WITH s AS ({_SCORES}) SELECT o_orderkey, CASE WHEN a IS NULL OR b IS NULL THEN 'no_numeric_consensus_in_both_rounds' WHEN a <> b THEN 'blind_consensus_changed_between_rounds'
WHEN old IS NULL THEN 'stable_blind_historical_label_missing' WHEN a = old THEN 'confirmed_audited_weak_label' ELSE 'stable_blind_disagrees_with_historical' END AS class FROM s""")
def label_audit(spark, sf_dir):
    return _scores(spark, sf_dir).select("o_orderkey", R.audit_class(F.col("a"), F.col("b"), F.col("old")).alias("class"))


@query(f"""
WITH s AS ({_SCORES}), c AS (SELECT o_orderkey, a AS consensus FROM s WHERE a = b)
SELECT o_orderpriority, count(*) AS n, count(consensus) AS with_consensus, count(*) FILTER (consensus = old) AS confirmed, count(*) FILTER (consensus <> old) AS differing
FROM orders JOIN s USING (o_orderkey) LEFT JOIN c USING (o_orderkey) GROUP BY 1""")
def consensus_overlay(spark, sf_dir):
    s = _scores(spark, sf_dir)
    consensus = s.where("a = b").select("o_orderkey", F.col("a").alias("consensus"))
    named = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").join(s, "o_orderkey").join(consensus, "o_orderkey", "left")
    return named.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count("consensus").alias("with_consensus"), F.count_if(F.col("consensus") == F.col("old")).alias("confirmed"), F.count_if(F.col("consensus") != F.col("old")).alias("differing"))


_TIERS = """SELECT doc_id, CASE WHEN toxic = 1 THEN 'excluded' WHEN quality = 1 AND n_chars >= 1000 THEN 'formal' WHEN quality = 1 THEN 'reserve' WHEN quality = 0 THEN 'limited' WHEN n_chars < 200 THEN 'short' ELSE 'other' END AS tier
FROM documents LEFT JOIN labels USING (doc_id)"""


def _tiers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    q, n = F.col("quality"), F.col("n_chars")
    return docs.select("doc_id", R.tier(excluded=F.col("toxic") == 1, formal=(q == 1) & (n >= 1000), reserve=q == 1, limited=q == 0, short=n < 200).alias("tier"))


@query(_TIERS)
def pool_tiers(spark, sf_dir):
    return _tiers(spark, sf_dir)


@query(f"SELECT tier, count(*) AS n FROM ({_TIERS}) GROUP BY 1")
def tier_counts(spark, sf_dir):
    return _tiers(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n"))


@query("""
SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_discount = 0) AS undiscounted, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1""")
def conditional_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_discount") == 0).alias("undiscounted"), F.countDistinct("l_suppkey").alias("suppliers"))


_RATED = """SELECT p_partkey, CASE WHEN p_size >= 35 THEN 'good' WHEN p_size >= 15 THEN 'watch' ELSE 'limited' END AS size_rating,
CASE WHEN p_partkey % 6 = 0 THEN 'not_applicable' WHEN p_retailprice <= 1000 THEN 'good' WHEN p_retailprice <= 1500 THEN 'watch' ELSE 'limited' END AS price_rating FROM part"""


def _rated(spark, sf_dir):
    price = F.when(F.col("p_partkey") % 6 != 0, F.col("p_retailprice"))
    return table(spark, sf_dir, "part").select("p_partkey", X.rating(F.col("p_size"), 35, 15).alias("size_rating"), X.rating(price, 1000.0, 1500.0, rising=False).alias("price_rating"))


@query(_RATED)
def rating_buckets(spark, sf_dir):
    return _rated(spark, sf_dir)


@query(f"""
WITH r AS ({_RATED}), s AS (SELECT *, CASE size_rating WHEN 'limited' THEN 1 WHEN 'watch' THEN 2 ELSE 3 END AS s1, CASE price_rating WHEN 'limited' THEN 1 WHEN 'watch' THEN 2 ELSE 3 END AS s2,
(CAST(size_rating <> 'not_applicable' AS INT) + CAST(price_rating <> 'not_applicable' AS INT)) / 2.0 AS rated FROM r)
SELECT p_partkey, least(s1, s2) AS total, round(rated * 0.45 + 0.8 * 0.35 + 0.5 * 0.2, 4) AS confidence FROM s""")
def min_score_and_confidence(spark, sf_dir):
    total, confidence = R.suggestion([F.col("size_rating"), F.col("price_rating")], F.lit(0.8), F.lit(0.5))
    return _rated(spark, sf_dir).select("p_partkey", total.alias("total"), confidence.alias("confidence"))


#: Attempts: pain, a human score or none, a pose's score or none, elevated heels, a score to fall back on. Read by both engines.
_ATTEMPTS = {
    "pain": "l_discount >= 0.1 AND l_suppkey % 5 = 0", "human": "CASE WHEN l_partkey % 5 = 0 THEN 1 + l_partkey % 3 END", "pose": "CASE WHEN l_partkey % 3 <> 0 THEN 1 + l_suppkey % 3 END", "raised": "l_linenumber > 2 AND l_suppkey % 3 <> 0",
    "fallback": "CASE WHEN l_suppkey % 4 = 0 THEN 1 + l_orderkey % 3 END",
}


@query(f"""
WITH a AS (SELECT l_orderkey, {', '.join(f'{e} AS {c}' for c, e in _ATTEMPTS.items())} FROM lineitem WHERE l_linenumber < 5 AND l_partkey % 4 <> 1),
b AS (SELECT *, raised AND human IS NULL AND fallback IS NOT NULL AND (pose IS NULL OR (fallback >= 2 AND pose < 2)) AS falls FROM a), c AS (SELECT *, CASE WHEN human IS NOT NULL THEN human WHEN falls THEN fallback ELSE pose END AS raw FROM b),
s AS (SELECT l_orderkey, raised, CASE WHEN pain THEN 0 WHEN raised AND raw IS NOT NULL THEN least(raw, 2) ELSE raw END AS score FROM c),
g AS (SELECT l_orderkey, count(*) AS attempts, count(score) AS scorable, CASE WHEN count(*) FILTER (score = 0) > 0 THEN 1 WHEN count(score) = 0 THEN 2 WHEN count(*) FILTER (NOT raised AND score = 3) > 0 THEN 3 WHEN count(*) FILTER (raised AND score >= 2) > 0 THEN 4 WHEN count(*) FILTER (raised AND score IS NOT NULL) > 0 THEN 5 ELSE 6 END AS k FROM s GROUP BY 1)
SELECT l_orderkey, [0, NULL, 3, 2, 1, NULL][k] AS final_score, ['pain_zero', 'insufficient_evidence', 'final_ready', 'final_ready', 'final_ready', 'needs_heel_elevated_attempt'][k] AS status,
['pain_or_clearing_zero', 'no_scorable_attempts', 'floor_attempt_earned_three', 'heel_elevated_attempt_earned_two', 'heel_elevated_attempt_below_two', 'floor_attempt_no_three_needs_board'][k] AS reason, attempts, scorable FROM g""")
def staged_final_score(spark, sf_dir):
    from tempora.operators.rounds import attempt_score

    a = table(spark, sf_dir, "lineitem").where("l_linenumber < 5 AND l_partkey % 4 <> 1").select("l_orderkey", *[F.expr(e).alias(c) for c, e in _ATTEMPTS.items()])
    c = F.col
    score, _, _ = attempt_score(c("pain"), c("human"), F.lit("human_final"), c("pose"), F.lit("pose_suggestion"), c("raised"), c("fallback"))
    return R.staged_score(a.withColumn("score", score), ["l_orderkey"], "score", c("raised"))


@query("""
SELECT doc_id, CASE WHEN n_chars < 100 OR lang = 'es' THEN 'excluded' WHEN quality IS NULL THEN 'pending' ELSE 'eligible' END AS status,
concat_ws(',', CASE WHEN n_chars < 100 THEN 'too_short' END, CASE WHEN quality IS NULL THEN 'unlabelled' END, CASE WHEN lang = 'es' THEN 'wrong_language' END) AS reasons FROM documents LEFT JOIN labels USING (doc_id)""")
def eligibility_reasons(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    status, reasons = R.eligibility([(F.col("n_chars") < 100, "too_short"), (F.col("lang") == "es", "wrong_language")], [(F.col("quality").isNull(), "unlabelled")])
    return docs.select("doc_id", status.alias("status"), F.array_join(reasons, ",").alias("reasons"))


# ---- exports of review events

#: Events: orders of a customer supersede the one before, but for broken links. Read by both engines.
_EVENT = {
    "status": "CASE o_orderkey % 11 WHEN 3 THEN 'unscorable' WHEN 4 THEN 'deferred' WHEN 5 THEN 'done' ELSE 'scored' END", "score": "CASE WHEN o_orderkey % 11 NOT IN (3, 4) OR o_orderkey % 23 = 0 THEN o_orderkey % 5 END",
    "confidence": "CASE o_custkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' END", "unscorable_reason": "CASE WHEN o_orderkey % 11 = 3 AND o_orderkey % 2 = 0 THEN 'view' WHEN o_orderkey % 37 = 0 THEN 'dark' END",
    "zero_reason": "CASE WHEN o_orderkey % 41 = 0 THEN 'guess' END", "comment": "CASE WHEN o_orderkey % 3 = 0 THEN '  ' ELSE 'seen' END", "eligible": "o_orderkey % 11 <> 3 OR o_orderkey % 7 = 0", "cue": "CASE WHEN o_orderkey % 19 = 0 THEN true WHEN o_orderkey % 19 = 1 THEN false END",
    "view": "CASE WHEN o_custkey % 29 <> 0 THEN 'front' END", "side": "CASE WHEN o_custkey % 31 <> 0 THEN 'left' ELSE 'up' END", "started": "CASE WHEN o_orderkey % 43 <> 0 THEN o_orderkey END", "created": "o_orderkey + 5 - CASE WHEN o_orderkey % 47 = 0 THEN 9 ELSE 0 END",
    "duration": "CASE WHEN o_orderkey % 53 <> 0 THEN o_totalprice END",
}
_EVENTS = f"""v AS (SELECT o_orderkey AS event_id, o_custkey AS repetition_id, {', '.join(f'{e} AS {c}' for c, e in _EVENT.items())} FROM orders),
t AS (SELECT o_orderkey AS event_id, o_custkey AS repetition_id, CASE WHEN o_orderkey % 97 = 0 THEN -o_orderkey WHEN o_orderkey % 89 = 0 THEN first_value(o_orderkey) OVER (ORDER BY o_orderkey) WHEN o_orderkey % 83 = 0 THEN lag(o_orderkey, 2) OVER w
WHEN o_custkey % 50 = 0 AND lag(o_orderkey) OVER w IS NULL THEN max(o_orderkey) OVER (PARTITION BY o_custkey) ELSE lag(o_orderkey) OVER w END AS target FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))"""


def _events(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("repetition_id"), *[F.expr(e).alias(c) for c, e in _EVENT.items()])


def _targets(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    least = orders.agg(F.min("o_orderkey")).first()[0]
    k, own = F.col("o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderkey")
    target = F.when(k % 97 == 0, -k).when(k % 89 == 0, F.lit(least)).when(k % 83 == 0, F.lag(k, 2).over(own)).when((F.col("o_custkey") % 50 == 0) & F.lag(k).over(own).isNull(), F.max(k).over(Window.partitionBy("o_custkey"))).otherwise(F.lag(k).over(own))
    return orders.select(k.alias("event_id"), F.col("o_custkey").alias("repetition_id"), target.alias("target"))


_RULES = {
    "status_invalid": "status NOT IN ('scored', 'unscorable', 'deferred')", "score_invalid": "status = 'scored' AND (score IS NULL OR score > 3)", "confidence_invalid": "status IN ('scored', 'unscorable') AND confidence IS NULL", "unscorable_reason_invalid": "unscorable_reason <> 'view'",
    "zero_reason_invalid": "zero_reason <> 'confirmed_pain'", "unscorable_reason_required": "status = 'unscorable' AND unscorable_reason IS DISTINCT FROM 'view'", "unscorable_with_score": "status = 'unscorable' AND score IS NOT NULL", "comment_required": "status = 'unscorable' AND trim(comment) = ''",
    "unscorable_not_excluded": "status = 'unscorable' AND eligible", "started_missing": "started IS NULL", "duration_invalid": "duration IS NULL", "started_after_created": "started > created", "view_invalid": "view IS NULL", "side_invalid": "side = 'up'",
    "cue_inconsistent": "cue AND eligible", "eligibility_inconsistent": "eligible <> (status <> 'unscorable' AND NOT coalesce(cue, false))",
}


@query(f"WITH {_EVENTS} " + " UNION ALL ".join(f"SELECT event_id, '{name}' AS error FROM v WHERE {test}" for name, test in _RULES.items()))
def event_errors(spark, sf_dir):
    return E.event_errors(_events(spark, sf_dir), ["view"])


_CHAINED = f"""{_EVENTS},
s AS (SELECT t.*, CASE WHEN t.target IS NULL THEN 'first' WHEN o.event_id IS NULL THEN 'missing_target' WHEN o.repetition_id <> t.repetition_id THEN 'other_group' ELSE 'linked' END AS status FROM t LEFT JOIN t o ON o.event_id = t.target),
n AS (SELECT event_id, CASE WHEN status = 'linked' THEN target END AS next FROM s), w AS (SELECT event_id, event_id AS spot, next, 0 AS d FROM n UNION ALL SELECT w.event_id, n.event_id, n.next, d + 1 FROM w JOIN n ON n.event_id = w.next WHERE d < 150),
e AS (SELECT event_id, max(d) AS d, arg_max(spot, d) AS root, arg_max(next, d) IS NOT NULL AS cyclic FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d DESC) AS r FROM w) WHERE r = 1 GROUP BY 1), c AS (SELECT target, count(*) AS n FROM s WHERE status = 'linked' GROUP BY 1),
ch AS (SELECT s.event_id, CASE WHEN cyclic THEN 'cycle' ELSE status END AS status, CASE WHEN NOT cyclic THEN root END AS root, CASE WHEN NOT cyclic THEN CAST(d AS BIGINT) END AS steps, status = 'linked' AND c.n > 1 AS forked, h.target IS NULL AS head FROM s JOIN e USING (event_id) LEFT JOIN c ON c.target = s.target LEFT JOIN c h ON h.target = s.event_id)"""


@query(f"WITH RECURSIVE {_CHAINED} SELECT event_id, status, root, steps, coalesce(forked, false) AS forked, head FROM ch")
def superseded_chains(spark, sf_dir):
    return E.chains(_targets(spark, sf_dir), "event_id", "target", "repetition_id")


@query(f"""
WITH RECURSIVE {_CHAINED} SELECT event_id, error FROM (SELECT event_id, CASE status WHEN 'missing_target' THEN 'superseded_missing' WHEN 'other_group' THEN 'superseded_of_another_repetition' WHEN 'cycle' THEN 'superseded_in_a_cycle' END AS error FROM ch) WHERE error IS NOT NULL
UNION ALL SELECT event_id, 'superseded_twice' FROM ch WHERE forked UNION ALL SELECT event_id, 'outside_manifest' FROM t WHERE repetition_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 <> 0)""")
def reference_errors(spark, sf_dir):
    events = _targets(spark, sf_dir)
    expected = table(spark, sf_dir, "customer").where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("repetition_id"))
    return E.reference_errors(events, E.chains(events, "event_id", "target", "repetition_id"), expected)
