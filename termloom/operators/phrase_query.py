"""From texts to ranked terms: sentences first, whole texts where these find nothing, and candidates by variants of phrases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.index import hashed_embedding
from ..storage import checkpointed
from .knn import knn, ranked

Encode = Callable[[Column], Column]

#: Index of a whole text among its sentences.
WHOLE = -1


def nearest_terms(texts: DataFrame, terms: DataFrame, k: int, encode: Encode = hashed_embedding) -> DataFrame:
    """text, term, similarity, rank: the k nearest ``terms`` (id, embedding) of each distinct text (text).

    Each text is encoded once, and texts of one vector are searched once; both are written to the shared folder, however often
    the result is read. Terms of one vector are searched as one, by the smallest id: of the k first rows of a text each is among the k smallest
    ids of one of its k first vectors, as of any vector before that one its smallest id comes first too. ``terms`` may have many rows of few vectors.
    """
    encoded = checkpointed(texts.select("text").distinct().withColumn("embedding", encode(F.col("text"))).filter("embedding IS NOT NULL"))
    asked = checkpointed(encoded.select("embedding").distinct().select(F.monotonically_increasing_id().alias("id"), "embedding"))
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("id"))
    first = terms.filter("embedding IS NOT NULL").withColumn("place", place).filter(F.col("place") <= k)
    vectors = first.groupBy("embedding").agg(F.sort_array(F.collect_list("id")).alias("ids")).orderBy(F.col("ids")[0], "embedding")
    vectors = checkpointed(vectors.select(F.monotonically_increasing_id().alias("id"), "embedding", "ids"))  # numbers in the order of ids
    found = knn(vectors.select("id", "embedding"), asked, k, exclude_self=False).drop("rank")
    found = found.join(vectors.select(F.col("id").alias("doc_id"), "ids"), "doc_id")
    # a vector counts only if fewer than k terms are more alike than its own
    own = Window.partitionBy("query_id", "similarity")
    through = Window.partitionBy("query_id").orderBy(F.desc("similarity"))
    needed = found.withColumn("before", F.sum(F.size("ids")).over(through) - F.sum(F.size("ids")).over(own)).filter(F.col("before") < k)
    listed = ranked(needed.select("query_id", "similarity", F.explode("ids").alias("doc_id")), k)
    named = encoded.join(asked, "embedding").select("text", "id")
    return checkpointed(named.join(listed, F.col("id") == F.col("query_id")).select("text", F.col("doc_id").alias("term"), "similarity", "rank"))


def process(texts: DataFrame, terms: DataFrame, k: int, least: float, by_sentence: bool = True, encode: Encode = hashed_embedding) -> DataFrame:
    """query_id, sentence, text, term, similarity, rank of ``texts`` (query_id, text) over ``terms`` (id, embedding).

    Each sentence is searched twofold as deep as asked for, and its rows at or over ``least`` are cut to k. Texts whose sentences
    found nothing are searched as a whole, k deep, with -1 for the sentence; this pass reads these texts only. Without
    ``by_sentence`` every text is searched as a whole, twofold as deep. A null text has no sentences and finds nothing.
    """
    texts = texts.select("query_id", F.coalesce("text", F.lit("")).alias("text"))
    whole = texts.select("query_id", F.lit(WHOLE).alias("sentence"), "text")
    if not by_sentence:
        return _cut(whole, nearest_terms(whole, terms, 2 * k, encode), k, least)
    sentences = texts.select("query_id", F.posexplode(T.sentences("text")).alias("sentence", "text"))
    first = checkpointed(_cut(sentences, nearest_terms(sentences, terms, 2 * k, encode), k, least))
    missing = checkpointed(whole.join(first.select("query_id").distinct(), "query_id", "left_anti"))
    return first.unionByName(_cut(missing, nearest_terms(missing, terms, k, encode), k, least))


def _cut(parts: DataFrame, found: DataFrame, k: int, least: float) -> DataFrame:
    return parts.join(found.filter((F.col("similarity") >= least) & (F.col("rank") <= k)), "text").select("query_id", "sentence", "text", "term", "similarity", "rank")


def select(rows: DataFrame, floor: float, least: int, most: int, key: str = "item_id") -> DataFrame:
    """Distinct terms of an item in rank order: those that overlap or reach the floor, filled up to ``least``, ``most`` at most.

    Filling up takes weak terms only while fewer than ``least`` are taken, that is among the first ``least``.
    """
    first = F.row_number().over(Window.partitionBy(key, "term").orderBy("rank"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("rank"))
    rows = rows.withColumn("first", first).filter("first = 1").withColumn("place", place)
    good = rows.filter(F.col("overlap") | (F.col("score") >= floor) | (F.col("place") <= least))
    return good.withColumn("place", place).filter(F.col("place") <= most).drop("first", "place")


def by_variants(
    items: DataFrame, variants: Callable[[Column], Column], retrieve: Callable[[DataFrame], DataFrame], floor: float, least: int, most: int
) -> DataFrame:
    """item_id, term, score, variant, rank of ``items`` (item_id, phrase, category).

    Items with one cleaned phrase and category are one request. Its variants are retrieved, each distinct one once: ``retrieve`` gives
    (text, term, label, similarity, rank). Of a variant's terms ``select`` keeps those whose label shares a word with it or that reach the floor; a
    term's best score over a request's variants counts, and the request's list goes back to every item that asked.
    """
    items = items.withColumn("key", T.clean_phrase("phrase"))
    requests = items.groupBy("key", "category").agg(F.min("phrase").alias("phrase"))
    asked = checkpointed(requests.select("key", "category", F.posexplode(variants(F.col("phrase"))).alias("n", "text")).filter("text <> ''"))
    found = retrieve(asked.select("text").distinct())
    overlap = F.size(F.array_intersect(T.token_set("text"), T.token_set("label"))) > 0
    kept = select(found.select(F.col("text").alias("item_id"), "rank", "term", F.col("similarity").alias("score"), overlap.alias("overlap")), floor, least, most)
    kept = asked.join(kept.withColumnRenamed("item_id", "text"), "text")
    best = kept.groupBy("key", "category", "term").agg(F.max("score").alias("score"), F.max_by("text", F.struct("score", -F.col("n"))).alias("variant"))
    order = Window.partitionBy("key", "category").orderBy(F.desc("score"), "term")
    shared = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return items.join(shared, ["key", "category"]).select("item_id", "term", "score", "variant", "rank")
