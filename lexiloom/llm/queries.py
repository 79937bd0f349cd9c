"""The queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language_id, lm_scoring, near_dedup, piece_codec, quality_model, quality_rules, sharding, suffix_dedup, url_filter
from .common import read
from .queries_sql import SQL


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_report(read(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(*language_id.sample(docs)))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.apply_policy(quality_rules.ledger(read(spark, sf_dir, "documents").select("doc_id", "text")))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits", "policy")


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.train(*quality_model.sample(docs, read(spark, sf_dir, "labels"))))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: Ids up to which the good documents of op7 are broadcast (8 bytes each, counted first); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target: documents that labels marks as good."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    good = read(spark, sf_dir, "labels").where(F.col("quality") == 1).select("doc_id").distinct().withColumn("good", F.lit(True))
    good = F.broadcast(good) if good.count() <= BROADCAST_IDS else good
    return lm_scoring.cross_entropy_difference(docs.join(good, "doc_id", "left"), F.col("good"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.transcode(read(spark, sf_dir, "documents"), piece_model())


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), shingle=4)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_url_filter, op3_language_id, op4_quality_rules, op5_quality_model, op6_decontamination, op7_lm_scoring, op8_sentencepiece, op9_near_dedup, op10_sharding)}
