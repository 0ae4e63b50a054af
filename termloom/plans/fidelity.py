"""Does the embedding space follow the labels' structure? Neighbour overlap, branch purity, rank correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import graph
from ..operators.knn import knn
from ..operators.prefix import running
from ..storage import checkpointed, table
from .ontology import _REC, ROOT, about_terms, closed
from .retrieval import knn_sql, neighbours, query_set, vectors

K = 10


@register(
    "fid_branch_purity",
    f"""WITH {knn_sql(K)}, h AS (SELECT q.label AS branch, CASE WHEN d.label = q.label THEN 1.0::DOUBLE ELSE 0.0 END AS same FROM r JOIN v q ON q.id = r.query_id JOIN v d ON d.id = r.doc_id)
SELECT coalesce(branch::VARCHAR, 'ALL') AS branch, count(*) AS n, round(avg(same), 6) AS purity FROM h GROUP BY ROLLUP (branch)""",
)
def fid_branch_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the ten nearest neighbours in a vector's own branch (its label), overall and by branch."""
    labels = vectors(spark, sf_dir).select("id", "label")
    found = neighbours(spark, sf_dir, K)
    rows = found.join(labels.select(F.col("id").alias("query_id"), F.col("label").alias("branch")), "query_id").join(labels.select(F.col("id").alias("doc_id"), "label"), "doc_id")
    same = F.when(F.col("label") == F.col("branch"), 1.0).otherwise(0.0)
    rows = rows.rollup("branch").agg(F.count("*").alias("n"), F.round(F.avg(same), 6).alias("purity"))
    return rows.select(F.coalesce(F.col("branch").cast("string"), F.lit("ALL")).alias("branch"), "n", "purity")


@register(
    "fid_knn_overlap",
    f"""WITH {knn_sql(K)}, o AS (SELECT q.id AS query_id, d.id AS doc_id, row_number() OVER (PARTITION BY q.id ORDER BY CASE WHEN d.label = q.label THEN 0 ELSE 1 END, abs(d.id - q.id), d.id) AS rank
FROM v q JOIN v d ON q.id % 20 = 0 AND q.id <> d.id QUALIFY rank <= {K})
SELECT r.query_id, count(o.doc_id) / {K}.0::DOUBLE AS overlap FROM r LEFT JOIN o ON o.query_id = r.query_id AND o.doc_id = r.doc_id GROUP BY r.query_id""",
)
def fid_knn_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared part of two neighbourhoods: by embedding, and by structure (same label first, then nearest id).

    The structural neighbourhood is searched among the label's own vectors, joined on the label, in windows of ids; the few
    labels with under ten others are filled up from all vectors by nearest id.
    """
    docs = vectors(spark, sf_dir).select("id", "label")
    queries = query_set(docs).select(F.col("id").alias("query_id"), F.col("label").alias("q_label"))
    ranked = running(docs, [F.col("id")], {"n": F.lit(1)}, ("label",))
    places = ranked.filter(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), F.col("label").alias("q_label"), F.col("n").alias("q_n"))
    near = places.withColumn("n", F.explode(F.sequence(F.col("q_n") - K, F.col("q_n") + K))).join(ranked.withColumnRenamed("label", "q_label"), ["q_label", "n"])
    own = near.filter(F.col("id") != F.col("query_id")).select("query_id", F.col("id").alias("doc_id"), F.lit(0).alias("other"))
    by_id = queries.withColumn("id", F.explode(F.sequence(F.col("query_id") - 4 * K, F.col("query_id") + 4 * K))).join(docs, "id")
    rest = by_id.filter((F.col("id") != F.col("query_id")) & (F.col("label") != F.col("q_label"))).select("query_id", F.col("id").alias("doc_id"), F.lit(1).alias("other"))
    order = Window.partitionBy("query_id").orderBy("other", F.abs(F.col("doc_id") - F.col("query_id")), "doc_id")
    struct = own.unionByName(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= K).select("query_id", "doc_id", F.lit(1).alias("hit"))
    found = neighbours(spark, sf_dir, K).join(struct, ["query_id", "doc_id"], "left")
    return found.groupBy("query_id").agg((F.count("hit") / float(K)).alias("overlap"))


def average_rank(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Ranks with ties averaged. Values are counted first; the running sum over the distinct ones goes by ranges."""
    n = running(rows.groupBy(column).agg(F.count("*").alias("c")), [F.col(column)], {"below": F.col("c")})
    ranks = n.select(F.col(column), (F.col("below") + (F.col("c") + 1) / 2).alias(name))
    return rows.join(ranks, column)


def spearman(rows: DataFrame, x: str, y: str) -> Column:
    return average_rank(average_rank(rows, x, "rx"), y, "ry").agg(F.round(F.corr("rx", "ry"), 6).alias("rho"), F.count("*").alias("n"))


@register(
    "fid_spearman",
    f"""WITH {knn_sql(50)}, h AS (SELECT 1 - similarity AS x, abs(d.label - q.label) AS y FROM r JOIN v q ON q.id = r.query_id JOIN v d ON d.id = r.doc_id),
g AS (SELECT rank() OVER (ORDER BY round(x, 6)) + (count(*) OVER (PARTITION BY round(x, 6)) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM h)
SELECT round(corr(rx, ry), 6) AS rho, count(*) AS n FROM g""",
)
def fid_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of cosine distance and label distance over the fifty nearest of each query."""
    labels = vectors(spark, sf_dir).select("id", "label")
    found = neighbours(spark, sf_dir, 50)
    rows = found.join(labels.select(F.col("id").alias("query_id"), F.col("label").alias("a")), "query_id").join(labels.select(F.col("id").alias("doc_id"), F.col("label").alias("b")), "doc_id")
    return spearman(rows.select(F.round(1 - F.col("similarity"), 6).alias("x"), F.abs(F.col("a") - F.col("b")).alias("y")), "x", "y")


@register(
    "fid_depth_corr",
    """WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, label FROM embeddings WHERE embedding IS NOT NULL),
c AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(e[i]) AS m FROM v, range(1, 65) t(i) GROUP BY i)),
h AS (SELECT round(1 - list_cosine_similarity(e, c), 5) AS x, label AS y FROM v, c),
g AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM h)
SELECT round(corr(rx, ry), 4) AS rho, count(*) AS n FROM g""",
)
def fid_depth_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of a vector's depth (its label) and its distance to the centroid, one value a dimension."""
    docs = vectors(spark, sf_dir).filter(F.col("embedding").isNotNull())
    means = docs.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = [r.m for r in means.orderBy("i").collect()]  # as many numbers as a vector has
    c = F.array(*[F.lit(float(m)) for m in centre])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, x: s + x)
    e = F.col("embedding")
    distance = 1 - F.coalesce(F.try_divide(dot(e, c), F.sqrt(dot(e, e)) * F.sqrt(dot(c, c))), F.lit(0.0))
    return spearman(docs.select(F.round(distance, 5).alias("x"), F.col("label").alias("y")), "x", "y").select(F.round("rho", 4).alias("rho"), "n")


# --- neighbourhoods and distances of the graph: vectors of parts, by id ---


def term_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, term, embedding of vectors whose id is a part's."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).distinct()
    return vectors(spark, sf_dir).filter(F.col("embedding").isNotNull()).join(parts, "id").select("id", F.concat(F.lit("P:"), F.col("id").cast("string")).alias("term"), "embedding")


def resnik_top_k(queries: DataFrame, candidates: DataFrame, closed: DataFrame, ic: DataFrame, k: int) -> DataFrame:
    """term, other, resnik, rank: of each query (term) the ``k`` candidates (term) with the largest Resnik similarity, then the smallest id.

    A term that isn't among an ancestor's first k + 1 candidates by id is beaten by k others that share this ancestor, so each
    ancestor offers those only: no group of all terms below an ancestor is paired or gathered. Limits by rank are
    taken in each task before the shuffle.
    """
    below = closed.join(candidates.select("term"), "term").select("ancestor", F.col("term").alias("other"))
    first = below.withColumn("n", F.row_number().over(Window.partitionBy("ancestor").orderBy("other"))).filter(F.col("n") <= k + 1).drop("n")
    above = closed.join(queries.select("term"), "term").join(ic.select(F.col("term").alias("ancestor"), "ic"), "ancestor").select("ancestor", "term", "ic")
    offers = above.join(first, "ancestor").filter("other <> term").groupBy("term", "other").agg(F.max("ic").alias("resnik"))
    order = Window.partitionBy("term").orderBy(F.desc("resnik"), "other")
    return offers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


_TERM_VECTORS = """tv AS (SELECT vec_id AS id, 'P:' || vec_id AS term, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND vec_id IN (SELECT p_partkey FROM part)),
rs AS (SELECT q.id AS qid, d.id AS did, q.term AS a, d.term AS b, round(greatest(0.0, least(1.0, list_cosine_similarity(q.e, d.e))), 6) AS sim,
  (SELECT max(ic.ic) FROM cl x JOIN cl y ON y.ancestor = x.ancestor JOIN ic ON ic.term = x.ancestor WHERE x.term = q.term AND y.term = d.term) AS resnik FROM tv q JOIN tv d ON q.id % 20 = 0 AND q.id <> d.id)"""


@register(
    "fid_resnik_overlap",
    f"""{_REC}, {_TERM_VECTORS}, en AS (SELECT a, b FROM rs QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, did) <= {K}), gn AS (SELECT a, b FROM rs QUALIFY row_number() OVER (PARTITION BY a ORDER BY resnik DESC, b) <= {K})
SELECT en.a AS term, count(gn.b) / {K}.0::DOUBLE AS overlap FROM en LEFT JOIN gn USING (a, b) GROUP BY en.a""",
)
def fid_resnik_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared part of each query term's neighbourhoods by embedding and by Resnik similarity."""
    docs, up = checkpointed(term_vectors(spark, sf_dir)), closed(spark, sf_dir)
    queries = query_set(docs)
    found = knn(docs, queries, K).join(docs.select(F.col("id").alias("query_id"), "term"), "query_id").join(docs.select(F.col("id").alias("doc_id"), F.col("term").alias("other")), "doc_id")
    near = resnik_top_k(queries, docs, up, graph.information_content(up, ROOT), K).select("term", "other", F.lit(1).alias("hit"))
    return found.join(near, ["term", "other"], "left").groupBy("term").agg((F.count("hit") / float(K)).alias("overlap"))


def distance_correlation(docs: DataFrame, pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """rho_path, rho_resnik, n_pairs: rank correlations of cosine distance with path length and with minus Resnik similarity.

    ``docs`` is (id, term, embedding), ``pairs`` (a, b) of ids, as ``sample_pairs`` gives them, ``terms`` the graph's features.
    """
    side = lambda k: docs.select(F.col("id").alias(k), F.col("term").alias(f"t{k}"), F.col("embedding").alias(f"e{k}"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    cosine = F.coalesce(F.try_divide(dot("ea", "eb"), F.sqrt(dot("ea", "ea")) * F.sqrt(dot("eb", "eb"))), F.lit(0.0))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select(F.col("ta").alias("a"), F.col("tb").alias("b"), F.round(1 - cosine, 5).alias("distance"))
    rows = checkpointed(graph.pair_features(rows.select("a", "b").distinct(), terms).select("a", "b", "path", (-F.col("resnik")).alias("unlike")).join(rows, ["a", "b"]).filter("path IS NOT NULL"))
    path = spearman(rows.select("distance", "path"), "distance", "path").select(F.round("rho", 4).alias("rho_path"))
    resnik = spearman(rows.select("distance", "unlike"), "distance", "unlike").select(F.round("rho", 4).alias("rho_resnik"), F.col("n").alias("n_pairs"))
    return path.crossJoin(resnik)  # a row each


#: A vector's partners in the correlation query: those up to so many ids after it.
STEPS = 25


@register(
    "fid_graph_correlation",
    f"""{_REC}, tv AS (SELECT vec_id AS id, 'P:' || vec_id AS term, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND vec_id IN (SELECT p_partkey FROM part)),
pr AS (SELECT x.term AS a, y.term AS b, round(1 - list_cosine_similarity(x.e, y.e), 5) AS d FROM tv x JOIN tv y ON y.id > x.id AND y.id <= x.id + {STEPS}),
cm AS (SELECT pr.a, pr.b, any_value(pr.d) AS d, max(ic.ic) AS resnik, max(dp.depth) FILTER (dp.depth >= 0) AS lca FROM pr JOIN cl x ON x.term = pr.a JOIN cl y ON y.term = pr.b AND y.ancestor = x.ancestor JOIN ic ON ic.term = x.ancestor JOIN dp ON dp.term = x.ancestor GROUP BY pr.a, pr.b),
h AS (SELECT d AS x, greatest(p.depth + q.depth - 2 * lca, 0) AS y, -resnik AS z FROM cm JOIN dp p ON p.term = a JOIN dp q ON q.term = b),
g AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry, rank() OVER (ORDER BY z) + (count(*) OVER (PARTITION BY z) - 1) / 2.0::DOUBLE AS rz FROM h)
SELECT round(corr(rx, ry), 4) AS rho_path, round(corr(rx, rz), 4) AS rho_resnik, count(*) AS n_pairs FROM g""",
)
def fid_graph_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over each vector and the ones up to STEPS ids after it: does distance in space go with distance in the graph?"""
    docs = checkpointed(term_vectors(spark, sf_dir))
    after = docs.select(F.col("id").alias("a"), F.explode(F.sequence(F.col("id") + 1, F.col("id") + STEPS)).alias("b"))
    return distance_correlation(docs, after.join(docs.select(F.col("id").alias("b")), "b").select("a", "b"), about_terms(spark, sf_dir))


#: Rows of a bucket, about, within which pairs are drawn.
PAIR_BUCKET = 64


def sample_pairs(ids: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` distinct unordered pairs (a, b) of distinct ids (id), all pairs if there are no more.

    In each draw rows fall into small buckets by hash and pair with the next row of their bucket in an order by hash: no rank
    over all rows, no product of rows. Draws are doubled until they give enough. Where half or more of all pairs are asked
    for, the answer is of the size of the product, and all pairs are listed and cut by hash.
    """
    total = ids.count()
    n = min(n, total * (total - 1) // 2)
    if 4 * n >= total * (total - 1):
        drawn = ids.select(F.col("id").alias("a")).join(ids.select(F.col("id").alias("b")), F.col("a") < F.col("b"))
    else:
        draws = -(-2 * n // total)
        while (drawn := _drawn(ids, total, draws, seed)).count() < n:
            draws *= 2
    return drawn.orderBy(F.xxhash64(F.lit(seed), "a", "b"), "a", "b").limit(n)


def _drawn(ids: DataFrame, total: int, draws: int, seed: int) -> DataFrame:
    rows = ids.withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "d", "id"), F.lit(max(1, total // PAIR_BUCKET)))
    follow = F.lead("id").over(Window.partitionBy("d", "bucket").orderBy(F.xxhash64(F.lit(seed + 1), "d", "id"), "id"))
    pairs = rows.withColumn("bucket", bucket).withColumn("other", follow).filter(F.col("other").isNotNull() & (F.col("other") != F.col("id")))
    return pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def self_neighbours(docs: DataFrame, k: int) -> DataFrame:
    """Neighbours of every vector among all others, query block by query block."""
    return knn(docs, docs, k)
