"""Driver queries of the ten operators and of the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, line_dedup, mixing, neardup, order_minhash, quality, sharding, token_count, token_orc, url_filter
from .scratch import Scratch

END_ID = 2
SHARDS = 24
#: Sketches of a fingerprint; with 24, one text in 25 that keeps its first half matches nowhere.
SKETCHES = 64


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_read(spark, sf_dir, "documents"), share=mixing.SHARE, most_rounds=mixing.ROUNDS, keep_probability="p")
    return out.select("doc_id", "source", "lang", F.col("p_topic").alias("topic"), F.round("p", 6).alias("probability"))


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "tokens").path("orc")
    token_orc.write_tokens(_read(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), END_ID)
    return token_orc.token_index(spark, path)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(_read(spark, sf_dir, "documents"), sketches=SKETCHES)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(_read(spark, sf_dir, "documents"), count_col="n_dropped").select("doc_id", "text", "n_dropped")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(_read(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_token_orc, op3_near_duplicates, op4_order_minhash, op5_line_dedup, op6_bpe, op7_shards, op8_quality_rules, op9_url_filter, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the whole result; the other operators have brute-force tests."""
    return {"op1_mix_sources": mixing.mix_sql(share=mixing.SHARE), "op5_line_dedup": line_dedup.drop_boilerplate_sql()}
