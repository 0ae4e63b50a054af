"""Texts to terms: depth and threshold by sentence, the second pass over whole texts, variants fanned back out."""

from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators import phrase_query
from termloom.sources.index import hashed_embedding

NAMES = {1: "small ring", 2: "red widget", 3: "blue bolt", 4: "hot gear", 5: "red ring", 6: None}


def terms(spark):
    rows = spark.createDataFrame([(i, n) for i, n in NAMES.items()], "id long, name string")
    return rows.select("id", hashed_embedding(F.col("name")).alias("embedding"))


def found(spark, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "query_id long, text string")
    got = phrase_query.process(df, terms(spark), 2, 0.45, **options)
    return {(r.query_id, r.sentence, r["rank"]): (r.term, r.similarity) for r in got.collect()}


def test_sentences_first_then_whole_texts(spark):
    texts = {1: "A small ring. The red widget! Nothing of it here at all.", 2: "red. qqq hot www eee rrr ttt. gear.", 3: None, 4: "", 5: "hot aa bb cc. gear dd ee ff."}
    got = found(spark, texts)
    assert got[1, 0, 1][0] == 1 and got[1, 1, 1][0] == 2 and (1, phrase_query.WHOLE, 1) not in got
    assert {k[0] for k in got} <= {1, 2, 5} and (2, 0, 1) in got
    whole = found(spark, texts, by_sentence=False)
    assert {k[1] for k in whole} == {phrase_query.WHOLE}
    # no sentence of text 5 reaches the threshold, the whole text does so if it does on its own
    assert not any(k[0] == 5 and k[1] >= 0 for k in got)
    assert {k: v for k, v in got.items() if k[0] == 5} == {k: v for k, v in whole.items() if k[0] == 5}


def test_ranks_are_cut_to_k(spark):
    got = found(spark, {1: "red ring red ring"})
    assert {k[2] for k in got} <= {1, 2} and got[1, 0, 1] == (5, 1.0)


def test_variants_are_asked_once_and_given_to_all(spark):
    items = spark.createDataFrame([(1, "Red Ring 5 mm", "a"), (2, "red ring 5 mm", "a"), (3, "red ring 5 mm", "b"), (4, "red ring", "a"), (5, "", "a"), (6, "zzz", "a")], "item_id long, phrase string, category string")
    asked = []

    def retrieve(phrases):
        asked.extend(r.text for r in phrases.collect())
        rows = [("red ring", 5, "red ring", 1.0, 1), ("red ring", 2, "red widget", 0.5, 2), ("red ring 5 mm", 5, "red ring", 0.7, 1), ("Red Ring 5 mm", 5, "red ring", 0.7, 1), ("Red Ring", 5, "red ring", 1.0, 1), ("zzz", 3, "blue bolt", 0.1, 1), ("zzz", 4, "hot gear", 0.1, 2)]
        return phrases.sparkSession.createDataFrame(rows, "text string, term long, label string, similarity double, rank int").join(phrases, "text", "left_semi")

    got = {}
    for r in phrase_query.by_variants(items, T.query_variants, retrieve, 0.6, 1, 5).collect():
        got.setdefault(r.item_id, []).append((r["rank"], r.term, r.score, r.variant))
    assert len(asked) == len(set(asked))
    assert sorted(got[1]) == sorted(got[2]) and got[1][0][1:3] == (5, 1.0)
    assert {r[1] for r in got[3]} == {2, 5} and {r[1] for r in got[4]} == {2, 5}
    assert got[6] == [(1, 3, 0.1, "zzz")] and 5 not in got
