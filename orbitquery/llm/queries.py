"""The opN queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, langid, licenses, packing, pii, simhash, tokencount, topk, warc, wavelet
from .common import Table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_found")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_of(_table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_token_shards(wavelet.write_token_shards(_table(spark, sf_dir, "documents")))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_digest(_table(spark, sf_dir, "documents"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = Table(topk.quantised(_table(spark, sf_dir, "embeddings")), "vectors").df
    return topk.exact_top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages")))
    return records.where("gap is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f USING (d)
"""

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_decontamination": op2_decontamination,
    "op3_language_id": op3_language_id,
    "op4_token_files": op4_token_files,
    "op5_pii": op5_pii,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_warc": op7_warc,
    "op8_packing": op8_packing,
    "op9_token_counts": op9_token_counts,
    "op10_licenses": op10_licenses,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": decontam.ORACLE_SQL,
    "op6_exact_top_k": topk.ORACLE_SQL,
    "op7_warc": WARC_SQL,
    "op10_licenses": licenses.oracle_sql(),
}
