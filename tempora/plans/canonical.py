"""Canonical entries: a customer's orders are repeated exports of one entry, parts are files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.operators import canonical as C
from tempora.operators import export as X
from tempora.operators import predictions as P
from tempora.plans.catalog import query, table

#: Markers of paths by action, the folders of files, and what an export says. Read by both engines.
_MARKERS = {"squat": ("/deep squat/", "/squat/"), "lunge": ("/lunge/",), "raise": ("/aslr/",)}
_FOLDER = "CASE p_partkey % 7 WHEN 0 THEN '/data/Deep Squat/' WHEN 1 THEN '/data/squat/old/' WHEN 2 THEN '/data/Lunge/' WHEN 3 THEN '/data/Sample Videos/' WHEN 4 THEN '/data/Sample Videos/ASLR/' ELSE '/data/' END"
_PATH = f"concat({_FOLDER}, p_partkey, '/Take', p_partkey % 300, '.mp4')"
_EXPORT = {
    "entry_id": "o_custkey", "content_hash": "CASE WHEN o_custkey % 4 = 0 THEN concat('h', o_orderkey % 2) ELSE 'h' END", "source_file": "concat('export-', o_orderkey % 7, '.json')", "position": "o_orderkey",
    "action": "CASE o_custkey % 5 WHEN 0 THEN 'squat' WHEN 1 THEN 'lunge' WHEN 2 THEN 'raise' WHEN 3 THEN 'jump' END", "video_name": "CASE WHEN o_custkey % 11 = 0 THEN '' WHEN o_custkey % 13 <> 0 THEN concat('TAKE', o_custkey % 330, '.MP4') END",
    "parts": "o_orderkey % 4",
}
_EXPORTS = f"x AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _EXPORT.items())} FROM orders)"
_FIRSTS = f"""{_EXPORTS}, o AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY source_file, position) AS n FROM x),
d AS (SELECT entry_id, count(*) AS occurrences, array_to_string(list_sort(list_distinct(list(source_file))), ',') AS source_files, count(DISTINCT content_hash) > 1 AS conflict FROM x GROUP BY 1), e AS (SELECT o.* EXCLUDE (source_file), occurrences, source_files, conflict FROM o JOIN d USING (entry_id) WHERE n = 1)"""


def _entries(spark, sf_dir):
    exports = table(spark, sf_dir, "orders").select(*[F.expr(e).alias(c) for c, e in _EXPORT.items()])
    return C.deduplicated(exports, "entry_id", "content_hash", "source_file", ["source_file", "position"])


@query(f"WITH {_FIRSTS} SELECT entry_id, content_hash, position, occurrences, source_files, conflict FROM e")
def canonical_entries(spark, sf_dir):
    return _entries(spark, sf_dir).select("entry_id", "content_hash", "position", "occurrences", F.array_join("source_files", ",").alias("source_files"), "conflict")


_MARKED = " ".join(f"WHEN action = '{a}' AND ({' OR '.join(f'''contains(lower(path), '{m}')''' for m in marks)}) THEN 100" for a, marks in _MARKERS.items())


@query(f"""
WITH {_FIRSTS}, f AS (SELECT {_PATH} AS path, lower(string_split({_PATH}, '/')[-1]) AS name FROM part),
j AS (SELECT entry_id, action, video_name, path, CASE {_MARKED} ELSE 0 END + CASE WHEN contains(lower(path), '/sample videos/') THEN 20 ELSE 0 END AS score FROM e LEFT JOIN f ON name = lower(video_name)),
b AS (SELECT *, max(score) FILTER (path IS NOT NULL) OVER (PARTITION BY entry_id) AS best FROM j),
s AS (SELECT entry_id, action, any_value(video_name) AS video_name, any_value(best) AS best, count(path) AS n, count(path) FILTER (score = best) AS alike, min(path) FILTER (score = best) AS path FROM b GROUP BY 1, 2)
SELECT entry_id, action, CASE WHEN coalesce(video_name, '') = '' THEN 'not_referenced' WHEN coalesce(best, 0) = 0 THEN 'missing' WHEN alike > 1 THEN 'ambiguous' ELSE 'found' END AS video_status,
CASE WHEN best > 0 THEN path END AS video_path, CASE WHEN coalesce(best, 0) = 0 THEN n ELSE alike END AS video_candidates FROM s""")
def canonical_assets(spark, sf_dir):
    files = C.ranked_files(table(spark, sf_dir, "part").select(F.expr(_PATH).alias("path")), "path", _MARKERS)
    return C.resolved(_entries(spark, sf_dir).select("entry_id", "action", "video_name"), files, "video_name", "action", list(_MARKERS), "video").drop("video_name")


@query(f"""
WITH {_FIRSTS}, s AS (SELECT entry_id, concat('ing_', substr(sha256(CAST(entry_id AS VARCHAR)), 1, 12)) AS ingest_id, unnest(range(0, parts)) AS k FROM e)
SELECT entry_id, ingest_id, concat('rep_', substr(sha256(concat(ingest_id, '|s', k, '|', k, '|', k * 2, '|', k * 2 + 1)), 1, 12)) AS repetition_id, CAST(k + 1 AS INT) AS repetition, concat('s', k) AS segment_id, k * 2 AS start, k * 2 + 1 AS "end" FROM s""")
def canonical_repetitions(spark, sf_dir):
    segment = lambda k: F.struct(F.concat(F.lit("s"), k.cast("string")).alias("segment_id"), (k * 2).alias("start"), (k * 2 + 1).alias("end"))
    ks = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")), lambda k: k < F.col("parts"))
    return C.repetitions(_entries(spark, sf_dir).withColumn("segments", F.transform(ks, segment)), "entry_id", "segments", ["entry_id"])


# ---- export records, and predictions without labels

_KINDS = ("timing", "features", "suggestion")
_LEAVES = {"place": "o_orderkey", "status": "o_orderstatus", "urgent": "o_orderpriority LIKE '1%'", "owner": "CASE WHEN o_orderkey % 2 = 0 THEN concat('c', o_custkey) END"}


@query(rf"""
WITH e AS (SELECT o_custkey, o_orderkey % 3 AS kind, o_orderkey, {', '.join(f'{x} AS {c}' for c, x in _LEAVES.items() if c != 'owner')}, concat_ws(';', o_orderstatus, concat('a\;', o_orderpriority), coalesce({_LEAVES['owner']}, '\0')) AS reasons FROM orders),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, kind ORDER BY o_orderkey DESC) AS n FROM e) WHERE n = 1)
SELECT CAST(c.c_custkey AS VARCHAR) AS c_custkey, c_name AS name, {', '.join(f"CAST({k}.{c} AS VARCHAR) AS {k}__{c}" for k in _KINDS for c in ("place", "status", "urgent", "reasons"))}
FROM customer c {' '.join(f"LEFT JOIN l {name} ON {name}.o_custkey = c.c_custkey AND {name}.kind = {i}" for i, name in enumerate(_KINDS))}""")
def export_records(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    reasons = F.array("o_orderstatus", F.concat(F.lit("a;"), "o_orderpriority"), F.expr(_LEAVES["owner"]))
    rows = orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", *[F.expr(x).alias(c) for c, x in _LEAVES.items() if c != "owner"], reasons.alias("reasons"))
    evidence = {k: (rows.where(F.col("o_orderkey") % 3 == i), ["o_orderkey"]) for i, k in enumerate(_KINDS)}
    records = X.with_evidence(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name")), evidence, "c_custkey")
    return X.flattened(records)


@query("""
SELECT p_partkey AS id, CASE WHEN p_size >= 25 THEN 3 WHEN p_size >= 10 THEN 2 ELSE 1 END AS suggested, quality AS label FROM (SELECT p_partkey, p_size FROM part WHERE p_partkey % 7 <> 0 UNION ALL SELECT p_partkey, 50 FROM part WHERE p_partkey % 7 = 0) LEFT JOIN labels ON doc_id = p_partkey""")
def leak_free_predictions(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    base, other = part.where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size")), part.where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("id"), F.lit(50).alias("size"))
    score = lambda rows: rows.select("id", F.when(F.col("size") >= 25, 3).when(F.col("size") >= 10, 2).otherwise(1).alias("suggested"))
    return P.prediction_package([base, other], score, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label")), "id", "label")
