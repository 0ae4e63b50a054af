"""Term retrieval: single-vector and multi-vector queries with score-aggregation strategies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..functions.formula import compile_formula
from ..operators import inverted
from ..operators.knn import knn
from ..storage import scratch, table

TOP = 10
#: Raw depth of multi-vector retrieval: five components a term, three times over.
RAW = 15 * TOP
WEIGHTS = {"label": 0.5, "synonyms": 0.3, "definition": 0.2}
STRATEGIES = ("label_only", "label_synonyms_min", "label_synonyms_max", "all_weighted", "all_max", "all_min", "custom_formula")
FORMULA = "0.6 * label + 0.3 * max(synonyms) + 0.1 * avg(label, definition)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def query_set(docs: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by 20."""
    return docs.filter(F.col("id") % 20 == 0)


def neighbours(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    docs = vectors(spark, sf_dir)
    return knn(docs, query_set(docs), k)


def knn_sql(k: int) -> str:
    """CTEs v and r(query_id, doc_id, similarity, rank) of the same search."""
    return f"""
v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, label FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.id AS query_id, d.id AS doc_id, round(greatest(0.0, least(1.0, list_cosine_similarity(q.e, d.e))), 6) AS similarity
  FROM v q JOIN v d ON q.id % 20 = 0 AND q.id <> d.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM s QUALIFY rank <= {k})"""


@register("knn_topk", f"WITH {knn_sql(TOP)} SELECT query_id, doc_id, similarity, rank FROM r")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark, sf_dir, TOP)


def filter_results(found: DataFrame, least: float | None = None, most: int | None = None) -> DataFrame:
    """Rows at or over a similarity, the first ``most`` of each query, ranked anew from 1."""
    rows = found if least is None else found.filter(F.col("similarity") >= least)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "doc_id")
    rows = rows.withColumn("rank", F.row_number().over(order))
    return rows if most is None else rows.filter(F.col("rank") <= most)


@register(
    "knn_filter_threshold",
    f"WITH {knn_sql(3 * TOP)} SELECT query_id, doc_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM r WHERE similarity >= 0.3 QUALIFY rank <= {TOP}",
)
def knn_filter_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-vector retrieval: threefold depth, threshold 0.3, first ten."""
    return filter_results(neighbours(spark, sf_dir, 3 * TOP), 0.3, TOP)


@register(
    "format_results",
    f"""WITH {knn_sql(3 * TOP)}, f AS (SELECT * FROM r WHERE similarity >= 0.3 AND rank <= {TOP}),
b AS (SELECT *, CASE WHEN similarity >= 0.7 THEN 'high' WHEN similarity >= 0.4 THEN 'moderate' ELSE 'low' END AS band, round(1 - similarity, 6) AS distance FROM f)
SELECT query_id, doc_id, similarity, distance, rank, band, NOT bool_or(band = 'high') OVER (PARTITION BY query_id) AS no_high_match FROM b""",
)
def format_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked results with distance, confidence band and a flag for result sets without a high match."""
    rows = filter_results(neighbours(spark, sf_dir, 3 * TOP), 0.3, TOP)
    rows = rows.withColumns({"distance": F.round(1 - F.col("similarity"), 6), "band": confidence_band(F.col("similarity"))})
    return rows.withColumn("no_high_match", ~F.bool_or(F.col("band") == "high").over(Window.partitionBy("query_id")))


def six_digits(x: Column) -> Column:
    """Half-up to six digits by plain double arithmetic, which every engine does alike."""
    return F.floor(x * 1e6 + 0.5) / F.lit(1e6)


def confidence_band(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "moderate").otherwise("low")


def similarity_of_distance(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance))


def with_components(found: DataFrame) -> DataFrame:
    """Five vectors a term: the label, three synonyms, the definition."""
    part = F.col("doc_id") % 5
    return found.withColumns({
        "term": F.floor(F.col("doc_id") / 5).cast("long"),
        "component": F.when(part == 0, "label").when(part == 4, "definition").otherwise("synonym"),
    })


def group_by_term(found: DataFrame) -> DataFrame:
    """Per query and term: label score (the last one in rank order), synonym scores in rank order, definition score, best component.

    On equal scores the earlier row wins the best component. One shuffle: partial sums go by (query, term).
    """
    at = lambda name: F.when(F.col("component") == name, F.struct("rank", "similarity"))
    return found.groupBy("query_id", "term").agg(
        F.max(at("label"))["similarity"].alias("label_score"),
        F.transform(F.sort_array(F.collect_list(at("synonym"))), lambda s: s["similarity"]).alias("synonym_scores"),
        F.max(at("definition"))["similarity"].alias("definition_score"),
        F.max_by(F.struct("component", "doc_id", "similarity"), F.struct("similarity", -F.col("rank"))).alias("best"),
    )


def strategy_score(strategy: str, weights: dict[str, float] | None = None, formula: str = FORMULA) -> Column:
    """The score of a term's components; nothing present scores 0.0."""
    label, synonyms, definition = F.col("label_score"), F.col("synonym_scores"), F.col("definition_score")
    top, low = F.array_max(synonyms), F.array_min(synonyms)
    w = weights or WEIGHTS
    match strategy:
        case "label_only":
            score = label
        case "label_synonyms_min":
            score = F.least(label, low)
        case "label_synonyms_max":
            score = F.greatest(label, top)
        case "all_weighted":
            parts = [(label, w["label"]), (top, w["synonyms"]), (definition, w["definition"])]
            total = sum((F.when(s.isNotNull(), F.lit(x)).otherwise(0.0) for s, x in parts), F.lit(0.0))
            score = F.try_divide(sum((F.coalesce(s, F.lit(0.0)) * x for s, x in parts), F.lit(0.0)), total)
        case "all_max":
            score = F.greatest(label, top, definition)
        case "all_min":
            score = F.least(label, low, definition)
        case "custom_formula":
            score = compile_formula(formula, label, synonyms, definition)
        case _:
            raise ValueError(f"unknown strategy {strategy}")
    return six_digits(F.coalesce(score, F.lit(0.0)))


def aggregate_terms(found: DataFrame, strategy: str, least: float = 0.0, most: int = TOP, **options) -> DataFrame:
    """Terms ranked by aggregated score; only components within the raw depth count."""
    terms = group_by_term(with_components(found)).withColumn("score", strategy_score(strategy, **options)).filter(F.col("score") >= least)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "term")
    return terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


_TERMS_SQL = f"""WITH {knn_sql(RAW)},
c AS (SELECT *, doc_id // 5 AS term, CASE doc_id % 5 WHEN 0 THEN 'label' WHEN 4 THEN 'definition' ELSE 'synonym' END AS component FROM r),
t AS (SELECT query_id, term, max(similarity) FILTER (component = 'label') AS l, max(similarity) FILTER (component = 'synonym') AS sx,
  min(similarity) FILTER (component = 'synonym') AS sn, max(similarity) FILTER (component = 'definition') AS d FROM c GROUP BY ALL)"""
_SCORES = {
    "label_only": "l",
    "label_synonyms_min": "least(l, sn)",
    "label_synonyms_max": "greatest(l, sx)",
    "all_weighted": "(coalesce(l, 0.0) * 0.5 + coalesce(sx, 0.0) * 0.3 + coalesce(d, 0.0) * 0.2) / (CASE WHEN l IS NULL THEN 0.0::DOUBLE ELSE 0.5 END + CASE WHEN sx IS NULL THEN 0.0 ELSE 0.3 END + CASE WHEN d IS NULL THEN 0.0 ELSE 0.2 END)",
    "all_max": "greatest(l, sx, d)",
    "all_min": "least(l, sn, d)",
    "custom_formula": "0.6::DOUBLE * coalesce(l, 0.0) + 0.3 * coalesce(sx, 0.0) + 0.1 * ((coalesce(l, 0.0) + coalesce(d, 0.0)) / 2)",
}


def _register_strategies() -> None:
    for strategy in STRATEGIES:
        sql = f"""{_TERMS_SQL}, x AS (SELECT query_id, term, floor(coalesce({_SCORES[strategy]}, 0.0) * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE AS score FROM t)
SELECT query_id, term, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, term) AS rank FROM x QUALIFY rank <= {TOP}"""

        def run(spark: SparkSession, sf_dir: str, strategy: str = strategy) -> DataFrame:
            return aggregate_terms(neighbours(spark, sf_dir, RAW), strategy).select("query_id", "term", "score", "rank")

        register(f"mv_{strategy}", sql)(run)


_register_strategies()


@register(
    "mv_best_component",
    f"""{_TERMS_SQL} SELECT query_id, term, component AS matched_component, doc_id AS matched_id, similarity AS best_similarity FROM c
QUALIFY row_number() OVER (PARTITION BY query_id, term ORDER BY similarity DESC, rank) = 1""",
)
def mv_best_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = group_by_term(with_components(neighbours(spark, sf_dir, RAW)))
    return terms.select(
        "query_id", "term", F.col("best.component").alias("matched_component"), F.col("best.doc_id").alias("matched_id"), F.col("best.similarity").alias("best_similarity")
    )


@register(
    "mv_batch_padded",
    f"""{_TERMS_SQL}, x AS (SELECT query_id, term, round(coalesce(greatest(l, sx), 0.0), 6) AS score FROM t),
k AS (SELECT query_id, count(*) AS n FROM x WHERE score >= 0.5 GROUP BY 1)
SELECT v.id AS query_id, CASE WHEN k.n IS NULL THEN 0 WHEN k.n > {TOP} THEN {TOP} ELSE k.n END AS n_results FROM v LEFT JOIN k ON v.id = k.query_id WHERE v.id % 20 = 0""",
)
def mv_batch_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch retrieval keeps queries without results."""
    found = aggregate_terms(neighbours(spark, sf_dir, RAW), "label_synonyms_max", least=0.5)
    queries = query_set(vectors(spark, sf_dir)).select(F.col("id").alias("query_id"))
    counts = found.groupBy("query_id").agg(F.count("*").alias("n"))
    return queries.join(counts, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n_results"))


#: Share of the lists that index_probes looks into: the tables' vectors have no clusters, so near rows lie in many lists.
PROBED_SHARE = 0.75


def built_index(spark: SparkSession, sf_dir: str) -> inverted.Index:
    path = scratch(spark, "inverted")
    inverted.build(vectors(spark, sf_dir), path)
    return inverted.Index(spark, path)


@register("index_probes")
def index_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate search by inverted lists; tests measure its recall at ten against the exact search."""
    index = built_index(spark, sf_dir)
    probes = math.ceil(PROBED_SHARE * index.lists.count())
    return index.search(query_set(vectors(spark, sf_dir)), TOP, probes)


@register("index_exact", f"WITH {knn_sql(TOP)} SELECT query_id, doc_id, similarity, rank FROM r")
def index_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same index, searched until no unseen list can hold a better row."""
    index = built_index(spark, sf_dir)
    return index.search_exact(query_set(vectors(spark, sf_dir)), TOP, math.ceil(index.lists.count() / 4))


@register("index_lists", "WITH v AS (SELECT count(*) AS n FROM embeddings WHERE embedding IS NOT NULL) SELECT n AS vectors, true AS whole, true AS within FROM v")
def index_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector is in one list and one part of it, and no part holds more than its share."""
    index = built_index(spark, sf_dir)
    parts = index.vectors.groupBy("list", "part").agg(F.count("*").alias("n"))
    sums = parts.groupBy("list").agg(F.sum("n").alias("found"), F.max("n").alias("most"))
    checked = sums.join(F.broadcast(index.lists), "list", "full")
    return checked.agg(
        F.sum("found").alias("vectors"), F.coalesce(F.bool_and(F.col("found") == F.col("n")), F.lit(True)).alias("whole"),
        F.coalesce(F.bool_and(F.col("most") <= 2 * inverted.PART_ROWS), F.lit(True)).alias("within"),
    )
