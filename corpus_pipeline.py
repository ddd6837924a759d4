"""A corpus pipeline: language ID, near-duplicate removal, decontamination, mixing, token files.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. Every stage
works on all its predecessor kept, reread from Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, jaccard_join, language_id, mixing, token_files
from tessera.llm.common import materialise, table
from tessera.llm.queries import MIX_LEVELS, MIX_SHARE, MIX_WEIGHTS, tokenizer_path

#: A model stage and a seeded mix have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter and those in doubt go."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 80 % of five-word shingles."""
    return jaccard_join.keep_one(docs, n=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten consecutive words of a benchmark item."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at the target weights, repeated where a source is upsampled."""
    return mixing.mix(docs, MIX_LEVELS, MIX_WEIGHTS, budget_share=MIX_SHARE, max_epochs=2)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, described as read back."""
    return token_files.tokenize(docs, tokenizer_path())


STAGES = [("language ID", identify_language), ("near duplicates", drop_near_duplicates), ("decontamination", decontaminate), ("mixing", mix_sources), ("token files", write_tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
