"""The queries of this subpackage: thin bindings of each operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import ann, divergence, mixing, packing, pieces, pii, quality, runs, secrets, simhash, urls, vector_dedup, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.dedup_vectors(_table(spark, sf_dir, "embeddings"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded_digest(_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, sf_dir, "documents"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_vectors(_table(spark, sf_dir, "embeddings"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digest(_table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(_table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


QUERIES = (op1_pii, op2_urls, op3_quality, op4_vector_dedup, op5_pieces, op6_simhash, op7_warc, op8_secrets, op9_mixing, op10_nearest, op11_runs, op12_divergence, op13_packing)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op4_vector_dedup": vector_dedup.ORACLE_SQL, "op7_warc": warc.ORACLE_SQL, "op9_mixing": mixing.ORACLE_SQL, "op12_divergence": divergence.ORACLE_SQL}
