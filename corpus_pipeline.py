"""A training corpus from raw documents: five stages, each a written table that the next one reads.

A stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
documents. Null texts and ids pass the stages as their operators say; an empty table passes as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm._common import saved, scratch, temporary
from tempora.llm.decontaminate import decontaminated
from tempora.llm.mixing import mixed, mixing_rates
from tempora.llm.quality import held_out, quality_scores
from tempora.llm.queries import DOMAIN_TARGETS, TOKENIZER, labelled_domains, vocabulary_path
from tempora.llm.similar import without_similar
from tempora.llm.token_files import read_token_index, write_token_file

#: Score from which a document is kept.
QUALITY = 0.7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour vote rejects go."""
    scored = quality_scores(docs, _table(spark, sf_dir, "labels"), learn=~held_out(4, 2), column="_quality")
    return scored.where(F.col("_quality") >= QUALITY).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id. Links are pairs whose sets of five-word shingles have a similarity of 0.8 or more."""
    return without_similar(docs, width=5, least=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten words of a benchmark item, or a shorter item, go."""
    return decontaminated(docs, _table(spark, sf_dir, "benchmark"), window=10).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of languages that are short of their target weight repeat; rates are one at least, so none is lost."""
    rates = mixing_rates(docs.select("doc_id", "text"), labelled_domains(docs, _table(spark, sf_dir, "labels")), DOMAIN_TARGETS, at_least=1.0)
    return mixed(docs, saved(rates))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all that is left go to a token file; returned is what is read back for each document of it."""
    path = scratch(spark)
    write_token_file(docs, path, vocabulary_path(TOKENIZER), end_id=2)
    return read_token_index(spark, path).select(F.col("doc").alias("doc_id"), "start", "n_tokens", F.col("crc").alias("ids_crc32"))


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID / binary output", token_stage),
]

#: Trained models and token ids have no SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with temporary() as area:
            docs = area.keep(saved(stage(spark, docs, sf_dir)))
    return docs
