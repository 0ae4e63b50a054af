"""The operators' registered queries: op<N>_<name>, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, common, exact_dedup, hard_negatives, licenses, merkle, minhash, packing, quality, secrets_scan, simhash, toxicity, url_filters, warc


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predict(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predict(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.digest(secrets_scan.scan(common.table(spark, sf_dir, "documents")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(common.table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(common.table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.with_edits(common.table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(common.table(spark, sf_dir, "documents")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(common.table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(common.table(spark, sf_dir, "pages")))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(common.table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(common.table(spark, sf_dir, "embeddings"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judged(common.table(spark, sf_dir, "pages")).drop("purity")


_OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
k AS (SELECT doc_id, norm, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op10_toxicity": op10_toxicity,
        "op2_secrets": op2_secrets,
        "op4_simhash": op4_simhash,
        "op3_packing": op3_packing,
        "op5_bpe": op5_bpe,
        "op6_fingerprints": op6_fingerprints,
        "op7_licenses": op7_licenses,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_warc": op9_warc,
        "op11_merkle": op11_merkle,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_url_filters": op13_url_filters,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_licenses": licenses.oracle(), "op8_exact_dedup": _OP8_SQL, "op9_warc": warc.oracle(), "op11_merkle": merkle.oracle(), "op12_hard_negatives": hard_negatives.ORACLE, "op13_url_filters": url_filters.oracle()}
