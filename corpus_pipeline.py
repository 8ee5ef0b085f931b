"""The corpus pipeline: five stages, each one of the operators of gridloom.llm.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame; all but the last return the columns of documents.

Of every stage: rows without doc_id or text, empty and very long texts, ties,
repeated rows, empty tables and columns of any name are handled as the
operator that it calls says; extra columns pass through unchanged. Each but
the first begins by letting executors give free heap back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import bpe_codec, curriculum, gam, line_dedup, ngram_join
from gridloom.runtime import give_back, materialize, ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    ship(spark)
    return gam.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later matches of lines go from the texts; a document that has no word left thereby goes too."""
    ship(spark)
    give_back(spark)
    return line_dedup.clean(docs)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are linked by 5-word shingles at a similarity of 0.8, the one with the smallest doc_id stays."""
    ship(spark)
    give_back(spark)
    return ngram_join.keep_one(docs, k=5, percent=80)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, in training order."""
    ship(spark)
    give_back(spark)
    return curriculum.mixed(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, encoded and decoded."""
    ship(spark)
    give_back(spark)
    return bpe_codec.digests(docs)


STAGES = [("quality_classifier", quality_stage), ("line_dedup", line_stage), ("ngram_jaccard_join", near_copy_stage), ("source_mix", mix_stage), ("bpe_codec", bpe_stage)]
#: The trained classifier and the encoder are beyond SQL; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
