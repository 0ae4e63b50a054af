"""Queries do their whole job, with work that grows with their input."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from termloom.functions import text as T
from termloom.operators import knn, phrase_query
from termloom.plans import extraction
from termloom.sources.index import hashed_embedding


def test_normality_reads_documents_of_every_language(spark, tmp_path):
    rows = [(1, "de", "Befund normal. Rest offen."), (2, "fr", "Tout est normale."), (3, "en", "No cue here."), (4, None, "Unremarkable."), (5, "en", None)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in entry.queries()["txt_normality"](spark, str(tmp_path)).collect()}
    assert got == {(1, 2, 1), (2, 1, 1), (3, 1, 0), (4, 1, 1)}


def made(column, name):
    """How often a function is called in a column's expression."""
    return column._jc.toString().count(name)


def test_a_text_is_cut_into_sentences_once(spark):
    assert made(extraction.subdivide(F.col("text")), "regexp_extract_all") == 1


def test_a_language_vote_reads_a_text_once(spark):
    assert made(T.detect_language(F.col("text")), "regexp_replace") == 1
    rows = [(1, "le der der xx het yy la les zz des"), (2, "der die le la and something"), (3, "zzzz yyyy xxxx wwww vvvv uuuu"), (4, "der die"), (5, None), (6, "The,the THE and; für ünd le le le la")]
    got = dict(spark.createDataFrame(rows, "id long, text string").select("id", T.detect_language("text")).collect())
    assert got == {1: "fr", 2: "de", 3: "en", 4: "en", 5: "en", 6: "en"}


def test_a_block_of_a_search_holds_k_numbers_a_query():
    rng = np.random.default_rng(1)
    table = lambda n: pa.table({"id": np.arange(n), "embedding": pa.array(list(rng.normal(size=(n, 8)).astype(np.float32)))})
    docs, queries = table(30_000), table(500)
    tracemalloc.start()
    found = knn.block_top(docs, queries, 150, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 75_000 and peak < 60e6


def test_terms_of_one_vector_are_searched_once(spark, monkeypatch):
    words = [f"w{i % 12}" for i in range(600)]
    terms = spark.createDataFrame(list(enumerate(words)), "id long, name string").select("id", hashed_embedding(F.col("name")).alias("embedding"))
    texts = spark.createDataFrame([("w3",), ("w5 w7",), ("w1 w1",), ("w1",), ("none",)], "text string")
    asked = []

    def counted(docs, queries, k, **options):
        asked.append((docs.count(), queries.count()))
        return knn.knn(docs, queries, k, **options)

    monkeypatch.setattr(phrase_query, "knn", counted)
    got = sorted(tuple(r) for r in phrase_query.nearest_terms(texts, terms, 7).collect())
    encoded = texts.select("text", F.dense_rank().over(Window.orderBy("text")).cast("long").alias("id"), hashed_embedding(F.col("text")).alias("embedding"))
    plain = knn.knn(terms, encoded.select("id", "embedding"), 7, exclude_self=False).join(encoded.select("text", F.col("id").alias("query_id")), "query_id")
    assert got == sorted(tuple(r) for r in plain.select("text", F.col("doc_id").alias("term"), "similarity", "rank").collect())
    assert asked[0][0] <= 12 and asked[0][1] == 4
