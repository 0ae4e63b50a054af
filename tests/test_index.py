"""Nearest neighbours over a grid of blocks and by inverted lists, against all rows in plain numpy."""

import math

import numpy as np
import pytest

from termloom.operators import inverted, knn
from termloom.plans import retrieval
from termloom.storage import scratch

from .conftest import SF

SCHEMA = "id long, embedding array<float>"


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), None if v is None else [float(c) for c in v]) for i, v in zip(ids, x)], SCHEMA)


def plain(ids, x, queries, k):
    unit = knn.unit(np.array(x, dtype=np.float32).astype(np.float64))
    sims = np.round(np.clip(unit @ unit.T, 0, 1), 6) + 0.0
    out = []
    for q in queries:
        at = [i for i in range(len(ids)) if ids[i] != ids[q]]
        for rank, i in enumerate(sorted(at, key=lambda i: (-sims[q, i], ids[i]))[:k], 1):
            out.append((ids[q], ids[i], sims[q, i], rank))
    return sorted(out)


def rows(df):
    return sorted((r.query_id, r.doc_id, r.similarity, r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 12))
    x = centres[rng.integers(0, 20, 900)] + rng.normal(scale=0.25, size=(900, 12))
    x[100:400] = x[7]  # a vector that a third of all rows share
    x[500] = 0
    return list(range(900)), np.round(x, 3)


def test_grid_of_small_blocks(spark, clustered):
    ids, x = clustered
    docs = frame(spark, [*ids, 5000], [*x, None])
    got = knn.knn(docs, docs.filter("id % 45 = 0"), 6, doc_block=130, query_block=7)
    assert rows(got) == plain(ids, x, range(0, 900, 45), 6)
    assert "toLocalIterator" not in open(knn.__file__).read()


def test_index_recall_and_exactness(spark, clustered):
    ids, x = clustered
    docs = frame(spark, ids, x)
    path = scratch(spark, "index-test")
    inverted.build(docs, path, lists=24)
    index = inverted.Index(spark, path)
    queries = docs.filter("id % 45 = 0")
    want = plain(ids, x, range(0, 900, 45), 10)
    assert rows(index.search_exact(queries, 10, probes=2)) == want
    near = rows(index.search(queries, 10, probes=4))
    found, sims = {r[:2] for r in near}, {r[0]: r[2] for r in want if r[3] == 10}
    assert len(near) == len(want)
    # of equal similarities any row is as good
    assert np.mean([r[2] >= sims[r[0]] for r in near]) >= 0.9 and found
    assert sorted(r.id for r in index.vectors.collect()) == ids


def test_recall_on_vectors_without_clusters(spark):
    exact = {r[:2] for r in rows(retrieval.knn_topk(spark, SF))}
    near = {r[:2] for r in rows(retrieval.index_probes(spark, SF))}
    assert len(near & exact) / len(exact) >= 0.9


def test_empty_index(spark):
    docs = spark.createDataFrame([], SCHEMA)
    path = scratch(spark, "index-empty")
    inverted.build(docs, path)
    index = inverted.Index(spark, path)
    some = frame(spark, [1], [[1.0, 0.0]])
    assert index.search(some, 3, 2).count() == 0 and index.search_exact(some, 3, 1).count() == 0


def test_centres_serve_every_row():
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(5, 4)), 40, axis=0)
    centres = inverted.fit(x, 10)
    assert math.isclose(float((knn.unit(x) @ centres.T).max(axis=1).min()), 1.0, abs_tol=1e-9)


def test_cache_of_vectors(spark):
    """Only new texts are encoded; models don't share vectors; nulls and repeats cost nothing."""
    from pyspark.sql import functions as F

    from termloom.sources import index
    from termloom.sources.versions import Versions

    path = scratch(spark, "vector-cache")
    rows = lambda texts: spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: list(r.embedding) for r in index.cached(rows(["a b", "a b", "c", None, ""]), path, "m").collect()}
    want = {r.text: list(r.e) for r in rows(["a b", "c", ""]).select("text", index.hashed_embedding(F.col("text")).alias("e")).collect()}
    assert got == want
    assert index.cached(rows(["c", "d"]), path, "m").count() == 2
    assert index.cached(rows(["c", "d"]), path, "m").count() == 2
    assert index.cached(rows(["c"]), path, "other").count() == 1
    assert [n for _, _, n in Versions(spark, path).history()] == [3, 1, 1]
