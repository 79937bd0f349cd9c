"""The corpus pipeline: documents through five stages, each of which calls one operator of lexiloom.llm.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of documents; the last returns each
document with the digests of its ids and of their decoded text. Rows that repeat id and text are treated alike in every
stage, columns of other names go through untouched, and empty tables give empty tables. What is written between two
stages goes to the folder that driver and executors share and is removed once the next stage is written; the rows that
the last stage reads stay until the session's owner clears that folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import decontamination, near_dedup, piece_codec, quality_rules, suffix_dedup
from lexiloom.llm.common import read, remove, shared_folder
from lexiloom.llm.queries import piece_model


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules' policy v1 rejects go; null texts have no words and go."""
    packed = docs.select(F.struct(*docs.columns).alias("__row"), F.col("text").alias("__text"))  # clashing names stay apart
    return quality_rules.apply_policy(quality_rules.ledger(packed, "__text")).where("kept").select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five words a shingle, similarity 0.8. Texts without words stay."""
    return near_dedup.without_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur more than once are cut out of the texts; texts of which nothing is left go.

    Null and short texts stay as they are. A character that a cut leaves in part goes too.
    """
    return suffix_dedup.without_repeats(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter item, go; null texts hold none."""
    return decontamination.without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document; a null text is empty."""
    return piece_codec.transcode(docs, piece_model())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmarks", benchmarks), ("encode", encode)]

#: Suffix dedup and encoding are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet to the shared folder and read again."""
    docs, old = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if old:
            remove(spark, old)
        docs, old = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
