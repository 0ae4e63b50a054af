"""Vector indexes as Parquet tables: encoding of documents, provenance, checks on opening."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import checkpointed
from .versions import Clash, Versions

DIMENSIONS = 64


def hashed_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Feature hashing of words by their md5 prefix: the same vectors in every engine, a stand-in for a trained encoder.

    Unit length, zeros for a text without words.
    """
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    cells = F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(dimensions)))
    places = F.array(*[F.lit(i).cast("long") for i in range(dimensions)])
    # arrays of one value bind the cells and the counts, so that each is made once
    counted = F.transform(F.array(cells), lambda found: F.transform(places, lambda i: (F.size(found) - F.size(F.array_remove(found, i))).cast("double")))
    unit = F.transform(counted, lambda counts: _unit_length(counts))
    return F.get(unit, F.lit(0))


def _unit_length(counts: Column) -> Column:
    norms = F.array(F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x)))
    scaled = F.transform(norms, lambda norm: F.transform(counts, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)).cast("float")))
    return F.get(scaled, F.lit(0))


def build(documents: DataFrame, path: str, model: str, index_type: str, version: str, encode=hashed_embedding, bucket: int | None = None) -> int:
    """Encode documents (doc_id, term, component, text) and write them with a provenance record; returns their number.

    Rows are clustered by term, so that the components of a term lie in one file and group without a further look elsewhere.
    """
    rows = documents.withColumn("embedding", encode(F.col("text")))
    rows = rows.repartition(bucket, "term") if bucket else rows.repartition("term")
    rows.sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/vectors")
    spark = documents.sparkSession
    n = spark.read.parquet(f"{path}/vectors").count()
    record = {"model": model, "index_type": index_type, "version": version, "dimensions": DIMENSIONS, "count": n}
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/provenance")
    return n


def open_index(spark: SparkSession, path: str, model: str | None = None, version: str | None = None) -> tuple[DataFrame, dict]:
    """The vectors and their provenance; an error where model, version or count differ."""
    record = json.loads(spark.read.text(f"{path}/provenance").first().value)
    for key, wanted in (("model", model), ("version", version)):
        if wanted is not None and record[key] != wanted:
            raise ValueError(f"index has {key} {record[key]}, not {wanted}")
    vectors = spark.read.parquet(f"{path}/vectors")
    if vectors.count() != record["count"]:
        raise ValueError("the index is incomplete")
    return vectors, record


def cached(texts: DataFrame, root: str, model: str, encode=hashed_embedding) -> DataFrame:
    """text, embedding of the distinct texts (text); only those that no earlier run has encoded with this model are encoded.

    The cache is a versioned table by digest of text and model. A writer that another one overtook tries anew with what that one
    wrote; nulls are left out.
    """
    cache = Versions(texts.sparkSession, root)
    keyed = checkpointed(texts.filter(F.col("text").isNotNull()).select("text").distinct().withColumn("key", F.sha2(F.concat(F.lit(model + "|"), "text").cast("binary"), 256)))
    while True:
        base = cache.latest()
        new = keyed.join(cache.read(base).select("key"), "key", "left_anti") if base else keyed
        if new.isEmpty() and base:
            break
        try:
            cache.append(new.select("key", F.lit(model).alias("model"), encode(F.col("text")).alias("embedding")), base)
            break
        except Clash:
            continue
    return keyed.join(cache.read().select("key", "embedding"), "key").select("text", "embedding")


def write_run(rows: DataFrame, root: str, kind: str, dataset: str, model: str, run_id: str) -> None:
    """Results of a run under kind, dataset, model and run, as partitions."""
    tagged = rows.withColumns({"type": F.lit(kind), "dataset": F.lit(dataset), "model": F.lit(model), "run_id": F.lit(run_id)})
    tagged.write.mode("append").partitionBy("type", "dataset", "model", "run_id").parquet(root)


def read_runs(spark: SparkSession, root: str, kind: str | None = None) -> DataFrame:
    """All runs; a filter on a kind prunes partitions."""
    runs = spark.read.parquet(root)
    return runs if kind is None else runs.filter(F.col("type") == kind)
