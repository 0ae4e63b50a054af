"""A training-data pipeline over ``documents``: toxic texts go, exact copies go, near-duplicates go, secrets are masked,
and what stays is packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``.

* toxicity (operator 10): fits on labelled rows outside its held-out fold; documents with a score of 0.7 or more go.
* exact dedup (8): of texts that are equal after white space is normalised, the smallest doc_id stays.
* near dedup (4): SimHash finds pairs, the texts verify them: five-word shingles, Jaccard likeness of 0.8 or more; of each
  group of linked documents the one with the smallest doc_id stays. The operator's own query keeps its contract's values.
* secret scans (2): reported spans are masked in the texts, n_chars follows; every document stays.
* packing (3): one row per piece, with its sequence and offset.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from termloom.llm import common, exact_dedup, near_copies, packing, secrets_scan, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, common.table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_first(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets_scan.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack),
]

#: A fitted classifier, fingerprints and token ids are beyond SQL; tests run every stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), "pipeline-" + name.lower().replace(" ", "-"))
    return docs
