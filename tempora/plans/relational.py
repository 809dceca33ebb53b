"""Keys, sets, snapshots, duplicates, constraints, text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.functions import scalars as X
from tempora.operators import constraints as V
from tempora.operators import dedupe as D
from tempora.operators import joins as J
from tempora.plans.catalog import query, table
from tempora.sources.writers import csv_lines, new_events, wide


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def must_match_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey"))
    named = J.must_match(orders, customers, ["c_custkey"])
    return J.must_match(named, table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_nationkey"]).select("o_orderkey", "c_name", "n_name")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def semi_join(spark, sf_dir):
    rich = table(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(rich, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_join(spark, sf_dir):
    rich = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(rich, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query("""
WITH a AS (SELECT c_custkey AS id, c_name AS title, c_mktsegment AS note FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey AS id, upper(c_name) AS title, NULL AS note FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(a.id, b.id) AS id, coalesce(b.title, a.title) AS title, coalesce(a.note, b.note) AS note FROM a FULL JOIN b ON a.id = b.id""")
def full_outer_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("note"))
    found = c.where("id % 2 = 0").select("id", F.upper("title").alias("title"), F.lit(None).cast("string").alias("note"))
    return J.merge_registries(c.where("id % 3 <> 0"), found, "id", ["note"])


@query("""
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 300000), b AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0)
SELECT k, 'missing' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'unexpected' FROM b WHERE k NOT IN (SELECT k FROM a)""")
def key_set_difference(spark, sf_dir):
    rich = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("k"))
    return J.key_differences(rich, table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), "k")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, 'duplicate' AS problem FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_index_violations(spark, sf_dir):
    return J.key_violations(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""
WITH a AS (SELECT * FROM part WHERE p_partkey % 7 <> 0), b AS (SELECT p_partkey, p_name, p_brand, CASE WHEN p_size > 40 THEN 0 ELSE p_size END AS p_size, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS p_type FROM part WHERE p_partkey % 11 <> 0)
SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'added' WHEN b.p_partkey IS NULL THEN 'removed' ELSE 'changed' END AS status,
CASE WHEN a.p_partkey IS NULL OR b.p_partkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.p_size IS DISTINCT FROM b.p_size THEN 'p_size' END, CASE WHEN a.p_type IS DISTINCT FROM b.p_type THEN 'p_type' END) END AS changed
FROM a FULL JOIN b ON a.p_partkey = b.p_partkey
WHERE a.p_partkey IS NULL OR b.p_partkey IS NULL OR a.p_size IS DISTINCT FROM b.p_size OR a.p_type IS DISTINCT FROM b.p_type""")
def row_diff(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    after = part.where("p_partkey % 11 <> 0").withColumn("p_size", F.when(F.col("p_size") > 40, 0).otherwise(F.col("p_size"))).withColumn("p_type", F.when(F.col("p_partkey") % 5 != 0, F.col("p_type")))
    return J.row_differences(part.where("p_partkey % 7 <> 0"), after, "p_partkey", ["p_name", "p_brand", "p_size", "p_type"]).withColumn("changed", F.array_join("changed", ","))


@query("""
SELECT c_custkey, coalesce(CASE WHEN c_custkey % 10 = 0 THEN 'own' END, CASE WHEN c_nationkey % 4 = 0 THEN 'nation' END, 'default') AS view FROM customer""")
def override_layers(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").where("n_nationkey % 4 = 0").select(F.col("n_nationkey").alias("c_nationkey"), F.lit("nation").alias("view"))
    own = c.where("c_custkey % 10 = 0").select("c_custkey", F.lit("own").alias("view"))
    return J.layered(c, [(nations, ["c_nationkey"]), (own, ["c_custkey"])], ["view"], {"view": "default"}).select("c_custkey", "view")


_ALIKE = """SELECT item_id, doc_id, lang, CASE WHEN abs(length(b.text) - n_chars) <= 3 THEN 'title_and_duration' ELSE 'title' END AS kind FROM benchmark b JOIN documents d
ON length(b.text) < length(d.text) AND length(b.text) >= 10 AND contains(d.text, b.text) OR length(d.text) < length(b.text) AND length(d.text) >= 10 AND contains(b.text, d.text) OR b.text = d.text AND b.text <> ''"""


def _alike(spark, sf_dir, by_action: bool = False):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("title"), F.length("text").alias("seconds"), F.element_at(F.array(*map(F.lit, ("en", "de", "fr"))), (F.col("item_id") % 3 + 1).cast("int")).alias("wanted"))
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars", F.when(F.col("lang") == "es", "unknown").otherwise(F.col("lang")).alias("kind_of"))
    return J.similar_titles(items, documents, "title", "text", action=("wanted", "kind_of") if by_action else None)


@query(f"SELECT item_id, doc_id FROM ({_ALIKE})")
def fuzzy_theta_join(spark, sf_dir):
    return _alike(spark, sf_dir).select("item_id", "doc_id")


@query(f"""
WITH p AS (SELECT * FROM ({_ALIKE}) WHERE lang = 'es' OR lang = ['en', 'de', 'fr'][1 + item_id % 3]), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS n FROM p),
m AS (SELECT item_id, bool_or(kind = 'title_and_duration') AS strong, string_agg(doc_id || ':' || kind, ',' ORDER BY n) FILTER (n <= 5) AS matches FROM r GROUP BY 1)
SELECT item_id, CASE WHEN strong IS NULL THEN 'new_candidate' WHEN strong THEN 'likely_duplicate' ELSE 'possible_duplicate' END AS status, coalesce(matches, '') AS matches FROM benchmark LEFT JOIN m USING (item_id)""")
def duplicate_candidates(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id")
    found = J.duplicate_status(_alike(spark, sf_dir, by_action=True), items, ["item_id"], ["doc_id"], "seconds", "n_chars")
    return found.withColumn("matches", F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["doc_id"], m["kind"])), ","))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS kept, count(*) AS copies FROM documents GROUP BY 1")
def content_dedupe(spark, sf_dir):
    return D.by_content(table(spark, sf_dir, "documents"), "text", "doc_id")


@query("""
WITH h AS (SELECT turn, role, conv_id, sha256(text) AS h FROM conversations)
SELECT turn, arg_min(role, conv_id) AS first_source, array_to_string(list_sort(list_distinct(list(role))), ',') AS sources, count(DISTINCT h) AS contents, count(DISTINCT h) > 1 AS conflict FROM h GROUP BY 1""")
def content_conflicts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("turn", "conv_id", "role", F.sha2("text", 256).alias("h"))
    return D.conflicts(rows, "turn", F.col("h"), "conv_id", "role").withColumn("sources", F.array_join("sources", ","))


@query("""
WITH RECURSIVE c AS (SELECT c_custkey, c_mktsegment, 'round_a:' || c_custkey AS s FROM customer),
h AS (SELECT c_custkey, c_mktsegment, s, 0 AS i, CAST(2166136261 AS BIGINT) AS v FROM c UNION ALL
SELECT c_custkey, c_mktsegment, s, i + 1, CAST((CAST(xor(v, ascii(substr(s, i + 1, 1))) AS HUGEINT) * 16777619) % 4294967296 AS BIGINT) FROM h WHERE i < length(s))
SELECT c_custkey, v AS queue_hash, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY v, c_custkey) AS INT) AS position FROM h WHERE i = length(s)""")
def hash_order_queue(spark, sf_dir):
    return D.hashed_order(table(spark, sf_dir, "customer"), ["c_mktsegment"], "round_a", "c_custkey").select("c_custkey", "queue_hash", "position")


@query("""
SELECT 'order_customer' AS rule, CAST(o_custkey AS VARCHAR) AS key, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY 2
UNION ALL SELECT 'line_order', CAST(l_orderkey AS VARCHAR), count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY 2
UNION ALL SELECT 'order_unique', CAST(o_orderkey AS VARCHAR), count(*) FROM orders GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'line_unique', CAST(l_orderkey * 100 + l_linenumber AS VARCHAR), count(*) FROM lineitem GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'discount_range', CAST(l_orderkey AS VARCHAR), count(*) FROM lineitem WHERE l_discount > 0.09 GROUP BY 2
UNION ALL SELECT 'segment_domain', CAST(c_custkey AS VARCHAR), count(*) FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') GROUP BY 2""")
def constraint_violations(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    lines, orders, customers = t("lineitem"), t("orders"), t("customer")
    return V.union([
        V.refers(orders, "o_custkey", customers, "c_custkey", "order_customer"),
        V.refers(lines, "l_orderkey", orders, "o_orderkey", "line_order"),
        V.unique(orders, "o_orderkey", "order_unique"),
        V.unique(lines.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("k")), "k", "line_unique"),
        V.holds(lines, "l_orderkey", F.col("l_discount") <= 0.09, "discount_range"),
        V.holds(customers, "c_custkey", F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "segment_domain"),
    ])


@query("""
WITH e AS (SELECT * FROM (VALUES ('click', 10), ('view', 20), ('refund', 1)) AS v(event_type, expected)), c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
SELECT 'event_count' AS rule, coalesce(e.event_type, c.event_type) AS key, coalesce(n, 0) AS n FROM c FULL JOIN e ON c.event_type = e.event_type WHERE n IS DISTINCT FROM expected""")
def expected_count_drift(spark, sf_dir):
    return V.count_is(table(spark, sf_dir, "events"), "event_type", {"click": 10, "view": 20, "refund": 1}, "event_count").withColumn("key", F.col("key"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) % 10 = 3 AS cue FROM events")
def json_extract(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), (k % 10 == 3).alias("cue"))


@query("""
SELECT p_partkey, concat_ws(',', CAST(p_partkey AS VARCHAR), CASE WHEN regexp_matches(v, '[",\n\r]') THEN '"' || replace(v, '"', '""') || '"' ELSE v END, 'a;b') AS line
FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN p_name || ', "' || p_brand || '"' ELSE p_name END AS v FROM part)""")
def csv_escape(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"'))).when(F.col("p_partkey") % 3 == 2, F.col("p_name"))
    return csv_lines(table(spark, sf_dir, "part").select("p_partkey", name.alias("v"), F.array(F.lit("a"), F.lit("b")).alias("tags")), ["p_partkey", "v", "tags"], ["p_partkey"])


@query("""
SELECT doc_id, regexp_matches(text, '[0-9]{3}') AS has_number, CASE WHEN regexp_matches(lower(text), 'licens') THEN 'license' WHEN regexp_matches(text, '@') THEN 'contact' ELSE 'none' END AS hint,
length(text) - length(replace(text, 'the', '')) AS the_chars FROM documents""")
def regex_hints(spark, sf_dir):
    text = F.col("text")
    hint = F.when(F.lower(text).rlike("licens"), "license").when(text.rlike("@"), "contact").otherwise("none")
    return table(spark, sf_dir, "documents").select("doc_id", text.rlike("[0-9]{3}").alias("has_number"), hint.alias("hint"), (F.length(text) - F.length(F.replace(text, F.lit("the"), F.lit("")))).cast("long").alias("the_chars"))


@query("""
WITH l AS (SELECT l_orderkey, l_returnflag AS f, sum(CAST(l_quantity AS BIGINT)) AS v FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, CAST(max(v) FILTER (f = 'A') AS BIGINT) AS "A", CAST(max(v) FILTER (f = 'N') AS BIGINT) AS "N", CAST(max(v) FILTER (f = 'R') AS BIGINT) AS "R" FROM l GROUP BY 1""")
def wide_features(spark, sf_dir):
    long = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("feature")).agg(F.sum(F.col("l_quantity").cast("long")).alias("value"))
    return wide(long, ["l_orderkey"], ["A", "N", "R"])


@query("""SELECT event_id, event_type FROM events WHERE event_id % 2 = 1""")
def idempotent_append(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.sha2(F.concat_ws("|", "event_id", "event_type"), 256).alias("content_hash"))
    fresh, _ = new_events(events.where("event_id % 2 = 0"), events)
    return fresh.select("event_id", "event_type")


@query("""
SELECT s_suppkey, round(degrees(acos(greatest(-1, least(1, x / nullif(sqrt(x * x + y * y), 0))))), 6) AS angle, round(degrees(abs(atan2(x, y))), 6) AS lean, floor(y + 0.5) AS nearest,
round(least((abs(x) % 180), 180 - (abs(x) % 180)), 6) AS axial FROM (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS x, s_acctbal / 100.0 AS y FROM supplier)""")
def scalar_geometry(spark, sf_dir):
    x, y, zero = F.col("s_nationkey").cast("double"), F.col("s_acctbal") / 100.0, F.lit(0.0)
    angle = X.joint_angle(F.lit(1.0), zero, zero, zero, x, y)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(angle, 6).alias("angle"), F.round(X.lean_angle(x, y), 6).alias("lean"), X.half_up(y).cast("double").alias("nearest"), F.round(X.axial_difference(x, zero), 6).alias("axial"))
