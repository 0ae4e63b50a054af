"""An index of inverted lists: a coarse quantiser, every vector in the list of its nearest centre, probes and exact scores.

The quantiser (spherical k-means) is fitted on a bounded sample; every vector is put into a list, whatever the number. A list
is a key of the index table; large ones are dealt into parts, so that a list that holds most vectors fills many tasks.
``search`` looks into the ``probes`` nearest lists of each query and scores what is there exactly; ``search_exact`` goes on to
all lists that may hold a better row, by the triangle inequality of angles, and so gives what a full scan gives.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import storage
from . import knn

#: Vectors on which the quantiser is fitted (at most twice as many are read); rounds of fitting; its random choices' seed.
SAMPLE_ROWS, ROUNDS, SEED = 20_000, 12, 7

#: Sample rows that a list has on average, at least; vectors of a part of a list; queries of a block.
LIST_SAMPLE, PART_ROWS, QUERY_BLOCK = 16, 8_192, 2_000

#: Small tables (a row a list or part) are broadcast up to so many rows.
BROADCAST_ROWS = 500_000


def fit(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centres of unit length: spherical k-means; a centre that loses all its rows moves to the row that is served worst."""
    rng = np.random.default_rng(SEED)
    if not len(sample):
        return np.zeros((1, 0))
    x = knn.unit(sample)
    lists = max(1, min(lists, len(x) // LIST_SAMPLE))
    centres = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(ROUNDS):
        sims = x @ centres.T
        nearest, served = sims.argmax(axis=1), sims.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        for i in np.flatnonzero(~np.isin(np.arange(lists), nearest)):
            worst = int(served.argmin())
            sums[i], served[worst] = x[worst], np.inf
        centres = knn.unit(sums)
    return centres


def _angle(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def _cosines(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return x @ centres.T if x.size and centres.size else np.zeros((len(x), len(centres)))


def _assigned(centres):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = knn.matrix(batch.column("embedding"), batch.num_rows)
            sims = _cosines(x, centres.value)
            lists = sims.argmax(axis=1)
            angle = np.where(~x.any(axis=1), np.pi, _angle(sims[np.arange(batch.num_rows), lists]))  # a zero vector has no angle: its list is never passed over
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists.astype(np.int32)), pa.array(angle)], [*batch.schema.names, "list", "angle"])

    return assign


def build(docs: DataFrame, path: str, lists: int | None = None) -> None:
    """Index ``docs`` (id, embedding) under ``path``: vectors by list and part, centres, and each list's size and radius.

    ``lists``: half the square root of the number of vectors by default, as far as the sample allows.
    """
    spark, rows = docs.sparkSession, knn.clean(docs)
    n = rows.count()
    share = min(1.0, SAMPLE_ROWS / max(1, n))
    drawn = rows.filter(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 32)) < int(share * (1 << 32))).limit(2 * SAMPLE_ROWS)
    sample = np.array([r.embedding for r in drawn.select("embedding").collect()], dtype=np.float64)
    centres = fit(np.nan_to_num(sample), lists or max(1, int(np.ceil(np.sqrt(n) / 2))))
    shared = spark.sparkContext.broadcast(centres)
    schema = T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    found = rows.mapInArrow(_assigned(shared), schema).withColumn("seq", F.monotonically_increasing_id())
    found.write.mode("overwrite").parquet(f"{path}/assigned")
    found = spark.read.parquet(f"{path}/assigned")
    stats = found.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).withColumn("parts", F.ceil(F.col("n") / PART_ROWS).cast("int"))
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")  # a row a list
    stats = F.broadcast(spark.read.parquet(f"{path}/lists").select("list", "parts"))
    dealt = found.join(stats, "list").withColumn("part", F.pmod(F.col("seq"), F.col("parts")).cast("int"))
    # whole lists lie together in files, so that a search for few lists skips the others' row groups
    dealt.select("list", "part", "id", "embedding").repartitionByRange("list", "part").sortWithinPartitions("list", "part", "id").write.mode("overwrite").parquet(f"{path}/vectors")
    record = {"lists": len(centres), "dimensions": int(centres.shape[1]), "count": n, "centres": centres.tolist()}
    spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/quantiser")


class Index:
    """An index opened for searches; the quantiser and the lists' sizes and radii are small, bounded by the sample."""

    def __init__(self, spark: SparkSession, path: str):
        record = json.loads(spark.read.text(f"{path}/quantiser").first().value)
        self.spark, self.count = spark, record["count"]
        self.vectors, self.lists = spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/lists")
        centres = np.array(record["centres"], dtype=np.float64).reshape(record["lists"], record["dimensions"])
        radii = np.full(len(centres), -np.inf)  # an empty list holds nothing near
        for r in self.lists.select("list", "radius").collect():
            radii[r["list"]] = r["radius"]
        self._shared = spark.sparkContext.broadcast((centres, radii))

    def probed(self, queries: DataFrame, probes: int) -> DataFrame:
        """Each query with its nearest lists."""
        shared = self._shared

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                centres, radii = shared.value
                sims = _cosines(knn.matrix(batch.column("embedding"), batch.num_rows), centres)
                sims[:, np.isneginf(radii)] = -2.0
                lists = np.argsort(-sims, axis=1, kind="stable")[:, :probes].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(lists), pa.list_(pa.int32()))], [*batch.schema.names, "lists"])

        rows = knn.clean(queries)
        return rows.mapInArrow(choose, T.StructType([*rows.schema.fields, T.StructField("lists", T.ArrayType(T.IntegerType()))]))

    def reachable(self, queries: DataFrame) -> DataFrame:
        """Each query (with lists, those already seen, and kth, its similarity to beat) with the other lists that may beat it."""
        shared = self._shared

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                centres, radii = shared.value
                x = knn.matrix(batch.column("embedding"), batch.num_rows)
                sims = _cosines(x, centres)
                near = np.cos(np.maximum(0.0, _angle(sims) - radii - 1e-9))
                near[~x.any(axis=1)] = 1.0
                open_ = (np.maximum(near, 0.0) + 1e-6 >= np.asarray(batch.column("kth"))[:, None]) & ~np.isneginf(radii)
                seen = batch.column("lists").to_pylist()
                lists = [np.setdiff1d(np.flatnonzero(o), s).astype(np.int32) for o, s in zip(open_, seen)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("embedding"), pa.array(lists, pa.list_(pa.int32()))], ["id", "embedding", "lists"])

        return queries.mapInArrow(choose, T.StructType([*queries.schema.fields[:2], T.StructField("lists", T.ArrayType(T.IntegerType()))]))

    def scored(self, probed: DataFrame, k: int, exclude_self: bool) -> DataFrame:
        """query_id, doc_id, similarity: the k best rows of each part of each list that a query asks for.

        A part of a list meets a block of the queries that ask for the list; blocks are as many as their number needs.
        """
        asked = probed.select("id", "embedding", F.explode("lists").alias("list"))
        per_list = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("q_blocks"))
        sizes = self.lists.select("list", "parts").join(per_list, "list")
        sizes = F.broadcast(storage.checkpointed(sizes))  # a row a list
        docs = self.vectors.join(sizes.select("list", "q_blocks"), "list").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
        asked = asked.join(sizes, "list").withColumn("q", F.pmod(F.xxhash64("id"), F.col("q_blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

        def meet(d: pa.Table, q: pa.Table) -> pa.Table:
            return knn.block_top(d, q, k, exclude_self)

        keys = ["list", "part", "q"]
        return docs.select(*keys, "id", "embedding").groupBy(*keys).cogroup(asked.select(*keys, "id", "embedding").groupBy(*keys)).applyInArrow(meet, knn.FOUND)

    def search(self, queries: DataFrame, k: int, probes: int, exclude_self: bool = True) -> DataFrame:
        """query_id, doc_id, similarity, rank of the k best rows in each query's ``probes`` nearest lists."""
        return knn.ranked(self.scored(self.probed(queries, probes), k, exclude_self), k)

    def search_exact(self, queries: DataFrame, k: int, probes: int, exclude_self: bool = True) -> DataFrame:
        """The same over all rows: after the probes, every list whose nearest possible row isn't farther than the k-th found."""
        probed = storage.checkpointed(self.probed(queries, probes))
        first = storage.checkpointed(knn.ranked(self.scored(probed, k, exclude_self), k))
        kth = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("similarity").alias("kth"))
        rest = probed.join(kth, "id", "left").select("id", "embedding", "lists", F.coalesce("kth", F.lit(0.0)).alias("kth"))
        second = self.scored(storage.checkpointed(self.reachable(rest)), k, exclude_self)
        return knn.ranked(first.drop("rank").unionByName(second), k)
