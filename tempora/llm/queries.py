"""One query for each operator, over its whole table, with the parameters of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm._common import scratch
from tempora.llm.centroids import centroid_clusters
from tempora.llm.decontaminate import contamination, item_digest, span_words
from tempora.llm.html_text import page_texts
from tempora.llm.line_dedup import drop_shared_lines
from tempora.llm.mixing import mixing_rates
from tempora.llm.neighbours import nearest_neighbours
from tempora.llm.packing import packed_pieces
from tempora.llm.prefix_trie import prefix_trie
from tempora.llm.quality import held_out, quality_scores
from tempora.llm.simhash import near_duplicates
from tempora.llm.token_counts import token_counts
from tempora.llm.token_files import read_token_index, write_token_file
from tempora.llm.toxicity import toxicity_scores

#: Weights of the domains that the mix aims at, and the files of the vocabularies.
DOMAIN_TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
COUNT_VOCABULARY, TOKENIZER = "byte_bpe_50k.tiktoken", "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str) -> str:
    """A file of the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain): the language of the documents that the labelled table covers."""
    return labels.select("doc_id").join(docs.select("doc_id", F.col("lang").alias("domain")), "doc_id")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rates = mixing_rates(docs.select("doc_id", "text"), labelled_domains(docs, _table(spark, sf_dir, "labels")), DOMAIN_TARGETS)
    return rates.select("doc_id", "n_tokens", *[F.col(f"p_{k}").alias(f"p_{d}") for k, d in enumerate(sorted(DOMAIN_TARGETS))], "rate")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = drop_shared_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=40, min_docs=5)
    return lines.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2("lines.kept_text", 256).alias("kept_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), vocabulary_path(COUNT_VOCABULARY))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"), width=4, radius=4)
    return found.select(F.col("doc").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out(5, 0)
    scored = toxicity_scores(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"), learn=~out)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id", "_found.n_words", span_words().alias("n_hit"), F.size("_found.item_ids").cast("long").alias("n_items"),
        item_digest().alias("items_sha256"), (F.size("_found.item_ids") > 0).alias("contaminated"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out(4, 2)
    scored = quality_scores(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"), learn=~out)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    write_token_file(_table(spark, sf_dir, "documents"), path, vocabulary_path(TOKENIZER), end_id=2)
    return read_token_index(spark, path).select(F.col("doc").alias("doc_id"), "start", "n_tokens", F.col("crc").alias("ids_crc32"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(_table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations"), group=5, heads=9)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroid_clusters(_table(spark, sf_dir, "embeddings"), k=8, rounds=10, dim=64, scale=1024, seed="3:")
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packed_pieces(_table(spark, sf_dir, "documents"), vocabulary_path(TOKENIZER), length=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_line_dedup": op2_line_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_simhash": op4_simhash,
    "op5_toxicity": op5_toxicity,
    "op6_decontamination": op6_decontamination,
    "op7_quality": op7_quality,
    "op8_token_files": op8_token_files,
    "op9_neighbours": op9_neighbours,
    "op10_html_text": op10_html_text,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_centroids": op12_centroids,
    "op13_packing": op13_packing,
}


def _lower_sql(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_LINES_SQL = f"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, {_lower_sql("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper <> doc_id) AS n_dropped,
sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN s USING (key) GROUP BY 1"""

def _windows_sql(window: int = 10) -> str:
    """Words of a document with those after them; each length of window looks only where a first word of one stands."""
    pattern = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    later = ", ".join(f"lead(h0, {k}) OVER (PARTITION BY doc_id ORDER BY k) AS h{k}" for k in range(1, window))
    tries = " UNION ALL ".join(
        f"SELECT doc_id, k, {n} AS size, concat_ws(' ', {', '.join(f'h{j}' for j in range(n))}) AS w FROM p WHERE h{n - 1} IS NOT NULL AND h0 IN (SELECT head FROM bw WHERE size = {n})" for n in range(1, window + 1)
    )
    return f"""
WITH b AS (SELECT item_id, regexp_extract_all({_lower_sql("text")}, {pattern}) AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least({window}, len(ws)) AS size, array_to_string(ws[k : k + least({window}, len(ws)) - 1], ' ') AS w, ws[k] AS head
FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least({window}, len(ws)) + 2)) AS k FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, coalesce(regexp_extract_all({_lower_sql("text")}, {pattern}), []) AS ws FROM documents),
p AS (SELECT *, {later} FROM (SELECT doc_id, unnest(ws) AS h0, unnest(range(1, len(ws) + 1)) AS k FROM d)),
c AS ({tries}),
f AS (SELECT DISTINCT doc_id, k, size, item_id FROM c JOIN bw USING (size, w)),
h AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS place FROM f) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM f) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)"""


#: CRC-32 of a decimal number: byte by byte, eight shifts each.
_CRC_SQL = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
lambda a, b: list_reduce(list_prepend(xor(a, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda y, z: xor(y >> 1, CAST(3988292384 AS BIGINT) * (y & 1))))"""

#: A prefix's key is the text of its turns' hashes, so that its ancestors' keys are its own beginnings.
_TRIE_SQL = f"""
WITH t AS (SELECT conv_id, sha256(strlen(r) || ':' || r || x) AS d, strlen(x) AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(r) || ':' || r || x)) AS k
FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT *, xor({_CRC_SQL}, CAST(4294967295 AS BIGINT)) % 9 AS h, conv_id - ((conv_id % 5) + 5) % 5 AS base FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY 1)),
e AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS lent FROM c LEFT JOIN c AS b ON b.conv_id = c.base),
m AS (SELECT e.conv_id, k AS depth, d, b FROM e JOIN t ON t.conv_id = e.base WHERE k <= h UNION ALL SELECT e.conv_id, k - h + lent, d, b FROM e JOIN t ON t.conv_id = e.conv_id WHERE k > h),
p AS (SELECT conv_id, depth, b, string_agg(d, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM m UNION ALL SELECT conv_id, 0, 0, '' FROM e),
l AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(b) AS b, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM l GROUP BY 1, 2),
k AS (SELECT path[1 : length(path) - 64] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
s AS (SELECT a AS path, CAST(count(*) FILTER (n_children IS NULL) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * b) AS BIGINT) AS saved_tokens
FROM (SELECT n.*, n_children, unnest(list_transform(range(0, depth + 1), lambda j: n.path[1 : 64 * j])) AS a FROM n LEFT JOIN k ON k.path = n.path) GROUP BY 1)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n JOIN s ON s.path = n.path LEFT JOIN k ON k.path = n.path LEFT JOIN n AS u ON n.depth > 0 AND u.path = n.path[1 : length(n.path) - 64]"""


def _centroids_sql(rounds: int = 10) -> str:
    """Each round by itself; integers of any size, so that nothing is rounded."""
    nearest = "SELECT r, vec_id, v, arg_min(k, d * 8 + k) AS k, min(d) AS d FROM (SELECT *, CAST(list_sum(list_transform(list_zip(v, c), lambda x: CAST(x[1] - x[2] AS HUGEINT) * (x[1] - x[2]))) AS HUGEINT) AS d FROM v, {c}) GROUP BY 1, 2, 3"
    steps = "".join(f"""
a{i} AS MATERIALIZED ({nearest.format(c=f"c{i}")}),
c{i + 1} AS MATERIALIZED (SELECT c{i}.k, coalesce(m, c) AS c FROM c{i} LEFT JOIN (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS m FROM
(SELECT k, place, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, unnest(range(1, 65)) AS place FROM a{i}) GROUP BY 1, 2) GROUP BY 1) USING (k)),""" for i in range(rounds))  # fmt: skip
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS k, v AS c FROM v QUALIFY k < 8),{steps}
a AS MATERIALIZED ({nearest.format(c=f"c{rounds}")})
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a JOIN c{rounds} USING (k)"""


#: What SQL can say; tests/llm hold the other queries against plain versions, round trips and held-out rows.
SQL: dict[str, str] = {"op2_line_dedup": _LINES_SQL, "op6_decontamination": _windows_sql(), "op11_prefix_trie": _TRIE_SQL, "op12_centroids": _centroids_sql()}
