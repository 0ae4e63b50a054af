"""Exact nearest neighbours by cosine similarity: a grid of document blocks and query blocks, merged top-k.

Both sides are dealt into blocks of bounded size, each document block meets each query block in one task, and a task gives k
rows a query. Nothing passes through the driver, and documents are read once however many queries there are. Within a task
only k numbers a query are held beside one slice of documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Documents and queries of a block, about. Queries go into smaller blocks, FEW_QUERIES each, while all the documents' copies
#: for these are at most COPIES rows: more tasks where copies cost little.
DOC_BLOCK, QUERY_BLOCK, FEW_QUERIES, COPIES = 131_072, 16_384, 1_000, 4_000_000

#: Documents and queries that a task multiplies at a time.
STEP, ASKED = 1_024, 1_000

#: Bits of a document's place in its block within a pair's number.
_PLACE = 32
_LAST = (1 << _PLACE) - 1

FOUND = "query_id long, doc_id long, similarity double"


def unit(x: np.ndarray) -> np.ndarray:
    norms = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    """Unit rows of a column of lists of one width; null components count as zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    return unit(flat.reshape(rows, -1)) if rows else np.zeros((0, 0))


def block_top(docs: pa.Table, queries: pa.Table, k: int, exclude_self: bool) -> pa.Table:
    """query_id, doc_id, similarity of the k nearest of ``docs`` to each query; ties go to the smaller id."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [none]
    if docs.num_rows and queries.num_rows:
        docs, queries = docs.sort_by("id").combine_chunks(), queries.combine_chunks()
        ids, asked = np.asarray(docs.column("id")), np.asarray(queries.column("id"))
        for start in range(0, len(asked), ASKED):
            some = queries.slice(start, ASKED)
            q, own = matrix(some.column("embedding"), some.num_rows), asked[start : start + ASKED]
            held = np.full((len(own), k), -1, dtype=np.int64)
            for at in range(0, len(ids), STEP):
                part = docs.slice(at, STEP)
                # one number a pair, millionths first and then the smaller id: no two are equal, so k are k whatever the ties
                keys = np.rint(np.clip(q @ matrix(part.column("embedding"), part.num_rows).T, 0, 1) * 1e6).astype(np.int64) << _PLACE
                keys |= _LAST - (at + np.arange(part.num_rows))
                if exclude_self:
                    first, last = np.searchsorted(ids[at : at + STEP], own), np.searchsorted(ids[at : at + STEP], own, "right")
                    for i in np.flatnonzero(last > first):
                        keys[i, first[i] : last[i]] = -1
                better = np.flatnonzero(keys.max(axis=1) > held.min(axis=1))
                held[better] = np.partition(np.concatenate([held[better], keys[better]], axis=1), -k, axis=1)[:, -k:]
            query, place = np.nonzero(held >= 0)
            chosen = held[query, place]
            found.append((own[query], ids[_LAST - (chosen & _LAST)], (chosen >> _PLACE) / 1e6))
    return pa.table(dict(zip(("query_id", "doc_id", "similarity"), (np.concatenate(c) for c in zip(*found, strict=True)), strict=True)))


def blocks(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def query_blocks(docs: int, queries: int, query_block: int | None = None) -> int:
    """Blocks of queries: each takes a copy of all documents."""
    if query_block:
        return blocks(queries, query_block)
    return max(blocks(queries, QUERY_BLOCK), min(blocks(queries, FEW_QUERIES), COPIES // max(1, docs)))


def clean(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("embedding").isNotNull()).select(F.col("id").cast("long").alias("id"), "embedding")


def every(n: int) -> Column:
    """All numbers below n, one a row."""
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their rank; tasks cut what they have to k before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def knn(docs: DataFrame, queries: DataFrame, k: int, exclude_self: bool = True, doc_block: int = DOC_BLOCK, query_block: int | None = None) -> DataFrame:
    """query_id, doc_id, similarity, rank of the ``k`` nearest documents of each query.

    ``docs`` and ``queries`` are (id long, embedding array<float>), all of one width; null embeddings are left out.
    Similarities are clamped to 0..1 and rounded to six digits; ties go to the smaller id. A zero vector has similarity 0.
    Documents are dealt by a running number, so that ids that repeat don't fill one block; the numbers of rows come from the
    files' metadata where nothing is filtered.
    """
    rows = docs.count()
    n, m = blocks(rows, doc_block), query_blocks(rows, queries.count(), query_block)
    dealt = clean(docs).withColumn("d", F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")).withColumn("q", every(m))
    asked = clean(queries).withColumn("q", F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")).withColumn("d", every(n))

    def meet(d: pa.Table, q: pa.Table) -> pa.Table:
        return block_top(d, q, k, exclude_self)

    return ranked(dealt.groupBy("d", "q").cogroup(asked.groupBy("d", "q")).applyInArrow(meet, FOUND), k)
