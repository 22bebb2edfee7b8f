"""From raw documents to token ids: filter, deduplicate, pseudonymize, mix, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from footfall.llm import bpe, pareto_mix, pseudonyms, quality, simhash
from footfall.llm.common import stash
from footfall.llm.queries import WORD_BPE, vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands fitted to good ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, bands=quality.fit_bands(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return simhash.keep_first(docs)


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers and dates replaced by pseudonyms of the same format."""
    return pseudonyms.hide_personal(docs, pseudonyms.session_key(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return pareto_mix.mix(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids, ids and decoded text (as digests) of every row of the mix."""
    return bpe.digests(bpe.encode_and_decode(docs, vocabulary(WORD_BPE)))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("hide_personal", hide_personal),
    ("mix_sources", mix_sources),
    ("encode_bpe", encode_bpe),
]

# Compression, fingerprints and merges are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each reading what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
