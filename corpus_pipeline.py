"""From raw documents to token ids: quality, lines, near duplicates, mixture, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hinoki.llm import bpe, line_dedup, mixing, neardup, quality
from hinoki.llm.queries import vocabulary
from hinoki.llm.scratch import Scratch

def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def line_frequency(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source."""
    return line_dedup.drop_boilerplate(docs, length_col="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose source, language and topic shares meet the targets."""
    return mixing.mix(docs, share=mixing.SHARE, most_rounds=mixing.ROUNDS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of the ids and of the decoded text."""
    return bpe.encode_decode(docs, vocabulary("word_bpe_49k.json"), with_ids=True)


STAGES = [("quality rules", quality_rules), ("line dedup", line_frequency), ("near duplicates", near_duplicates), ("mixing", mixture), ("bpe", tokens)]

#: Rolling hashes, sketches and merges aren't SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
