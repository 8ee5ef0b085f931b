"""The queries of this subpackage: one for each operator, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import bpe_codec, curriculum, dac, gam, licence_scan, line_dedup, lsm_dedup, ngram_join, ring, token_fertility
from gridloom.llm.common import documents
from gridloom.runtime import ship


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_lines", "n_gone", "text")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(documents(spark, sf_dir))


def op3_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.shard_documents(documents(spark, sf_dir))


def op5_lsm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm_dedup.dedup(documents(spark, sf_dir))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan.scan(documents(spark, sf_dir))


def op10_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.mix(documents(spark, sf_dir))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(documents(spark, sf_dir))


def op4_dac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.token_files(documents(spark, sf_dir))


def op7_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_token_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_fertility.rules(documents(spark, sf_dir))


_SQL: dict[str, str] = {
    "op5_lsm_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}

    def shipped(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        return run

    return {k: shipped(f) for k, f in found.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
