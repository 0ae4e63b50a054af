"""Ranking metrics per query and averaged, confidence bands of their means, and comparisons of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import bootstrap
from ..operators.prefix import running
from ..storage import table
from .retrieval import TOP, knn_sql, neighbours, query_set, vectors

K_VALUES = (1, 3, 5, 10)

#: A gold label's members, without the query itself; ranked results with their hits.
_HITS = f"""WITH {knn_sql(TOP)},
n AS (SELECT label, count(*) - 1 AS n_gold FROM v GROUP BY label),
h AS (SELECT r.query_id, r.rank, r.similarity, CASE WHEN d.label = q.label THEN 1 ELSE 0 END AS hit, n.n_gold
  FROM r JOIN v q ON q.id = r.query_id JOIN v d ON d.id = r.doc_id JOIN n ON n.label = q.label)"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, similarity, hit, n_gold: documents of the query's own label are relevant."""
    docs = vectors(spark, sf_dir)
    sizes = docs.groupBy("label").agg((F.count("*") - 1).alias("n_gold"))
    gold = query_set(docs).select(F.col("id").alias("query_id"), F.col("label").alias("gold")).join(sizes, F.col("label") == F.col("gold")).drop("label")
    found = neighbours(spark, sf_dir, TOP).join(docs.select(F.col("id").alias("doc_id"), "label"), "doc_id")
    return found.join(gold, "query_id").select("query_id", "rank", "similarity", F.when(F.col("label") == F.col("gold"), 1).otherwise(0).alias("hit"), "n_gold")


def round6(x: Column) -> Column:
    return F.round(x, 6)


def reciprocal_rank(found: DataFrame) -> DataFrame:
    first = F.min(F.when(F.col("hit") == 1, F.col("rank")))
    return found.groupBy("query_id").agg(round6(F.coalesce(1.0 / first, F.lit(0.0))).alias("mrr"))


def at_k(found: DataFrame, ks: tuple[int, ...] = K_VALUES) -> DataFrame:
    """Hit rate, precision (over k, even if fewer came), recall, average precision and NDCG of each query and k, in one pass.

    Running sums go over a query's few ranks; ks are exploded after the window, not joined.
    """
    order = Window.partitionBy("query_id").orderBy("rank")
    rows = found.withColumn("seen", F.sum("hit").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter(F.col("rank") <= F.col("k"))
    rows = rows.groupBy("query_id", "k").agg(
        F.sum("hit").alias("n_hits"),
        F.sum(F.when(F.col("hit") == 1, F.col("seen") / F.col("rank")).otherwise(0.0)).alias("precisions"),
        F.sum(F.col("hit") / F.log2(F.col("rank") + 1.0)).alias("dcg"),
        F.first("n_gold").alias("n_gold"),
    )
    best = F.least("n_gold", F.col("k").cast("long"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(best, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + F.lit(1.0)))
    none = F.col("n_gold") <= 0
    return rows.select(
        "query_id", "k",
        F.when(F.col("n_hits") > 0, 1.0).otherwise(0.0).alias("hit_rate"),
        round6(F.col("n_hits") / F.col("k")).alias("precision"),
        F.when(none, 0.0).otherwise(round6(F.try_divide(F.col("n_hits"), F.col("n_gold")))).alias("recall"),
        F.when(none, 0.0).otherwise(round6(F.try_divide(F.col("precisions"), best))).alias("ap"),
        F.when(none, 0.0).otherwise(round6(F.col("dcg") / ideal)).alias("ndcg"),
    )


_AT_K = (
    _HITS
    + """, w AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank) AS seen FROM h),
g AS (SELECT query_id, k, any_value(n_gold) AS n_gold, sum(hit) AS n_hits, sum(CASE WHEN hit = 1 THEN seen / rank ELSE 0 END) AS precisions, sum(hit / log2(rank + 1)) AS dcg
  FROM w, (VALUES (1), (3), (5), (10)) ks(k) WHERE rank <= k GROUP BY query_id, k),
m AS (SELECT query_id, k, CASE WHEN n_hits > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS hit_rate, round(n_hits / k, 6) AS precision,
  CASE WHEN n_gold <= 0 THEN 0.0 ELSE round(n_hits / n_gold, 6) END AS recall, CASE WHEN n_gold <= 0 THEN 0.0 ELSE round(precisions / least(n_gold, k), 6) END AS ap,
  CASE WHEN n_gold <= 0 THEN 0.0 ELSE round(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= least(n_gold, k)), 6) END AS ndcg FROM g)"""
)


@register("ir_mrr", _HITS + " SELECT query_id, round(coalesce(1.0::DOUBLE / min(rank) FILTER (hit = 1), 0.0), 6) AS mrr FROM h GROUP BY query_id")
def ir_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reciprocal_rank(hits(spark, sf_dir))


def _metric(name: str, column: str) -> None:
    @register(name, f"{_AT_K} SELECT query_id, k, {column} FROM m")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return at_k(hits(spark, sf_dir)).select("query_id", "k", column)


for _n, _c in (("ir_hit_rate", "hit_rate"), ("ir_ndcg", "ndcg"), ("ir_recall", "recall"), ("ir_precision", "precision"), ("ir_map", "ap")):
    _metric(_n, _c)


@register(
    "ir_summary_by_k",
    _AT_K + " SELECT k, count(*) AS n_cases, round(avg(hit_rate), 5) AS hit_rate, round(avg(precision), 5) AS precision, round(avg(recall), 5) AS recall, round(avg(ap), 5) AS map, round(avg(ndcg), 5) AS ndcg FROM m GROUP BY k",
)
def ir_summary_by_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = lambda c, name=None: F.round(F.avg(c), 5).alias(name or c)
    return at_k(hits(spark, sf_dir)).groupBy("k").agg(F.count("*").alias("n_cases"), mean("hit_rate"), mean("precision"), mean("recall"), mean("ap", "map"), mean("ndcg"))


@register(
    "ir_compare_models",
    _AT_K
    + """, l AS (SELECT m.*, 'model-' || (q.label % 3) AS model FROM m JOIN v q ON q.id = m.query_id)
SELECT model, k, count(*) AS n_cases, round(avg(ndcg), 5) AS ndcg, round(avg(recall), 5) AS recall, round(stddev_pop(ndcg), 5) AS ndcg_std FROM l GROUP BY model, k""",
)
def ir_compare_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per model and k; a query's model is taken from its label, so that every model has cases."""
    labels = vectors(spark, sf_dir).select(F.col("id").alias("query_id"), F.concat(F.lit("model-"), (F.col("label") % 3).cast("string")).alias("model"))
    rows = at_k(hits(spark, sf_dir)).join(labels, "query_id")
    return rows.groupBy("model", "k").agg(
        F.count("*").alias("n_cases"), F.round(F.avg("ndcg"), 5).alias("ndcg"), F.round(F.avg("recall"), 5).alias("recall"), F.round(F.stddev_pop("ndcg"), 5).alias("ndcg_std")
    )


def bootstrap_means(values: DataFrame, column: str, draws: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """mean, low, high of a seeded Poisson bootstrap over ``values`` (key, the column); null values count as zero."""
    means = bootstrap.sums(values, [column], draws, seed).select(F.try_divide(column, "w").alias("m"))
    edge = (1 - level) / 2
    bounds = means.agg(round6(F.percentile("m", F.lit(edge))).alias("low"), round6(F.percentile("m", F.lit(1 - edge))).alias("high"))
    return values.agg(round6(F.avg(column)).alias("mean")).crossJoin(bounds)  # a row on either side


_MRR = "bv AS (SELECT query_id AS key, round(coalesce(1.0::DOUBLE / min(rank) FILTER (hit = 1), 0.0), 6) AS mrr FROM h GROUP BY query_id)"


@register(
    "boot_mean",
    f"""{_HITS}, {_MRR}, b AS (SELECT draw, sum(w * mrr) / nullif(sum(w), 0) AS m FROM {bootstrap.weights_sql("bv", 1000, 42)} GROUP BY draw)
SELECT round((SELECT avg(mrr) FROM bv), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM b""",
)
def boot_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap interval of the mean reciprocal rank."""
    return bootstrap_means(reciprocal_rank(hits(spark, sf_dir)).withColumnRenamed("query_id", "key"), "mrr")


def paired_bootstrap(values: DataFrame, a: str, b: str, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """diff, p_value, significant of the two-sided test on centred differences of ``values`` (key, a, b)."""
    diff = values.select("key", (F.col(a) - F.col(b)).alias("d"))
    observed = diff.agg(F.avg("d").alias("diff"))
    # the centred sum is the sum less the weights' sum times the mean, so that no value needs the mean beforehand
    means = bootstrap.sums(diff, ["d"], draws, seed).crossJoin(observed).select("diff", F.try_divide(F.col("d") - F.col("w") * F.col("diff"), "w").alias("m"))
    far = F.round(F.abs("m"), 9) >= F.round(F.abs("diff"), 9)
    tested = means.agg(round6(F.first("diff")).alias("diff"), round6(F.avg(F.when(far, 1.0).otherwise(0.0))).alias("p_value"))
    return tested.select("diff", "p_value", (F.col("p_value") < 0.05).alias("significant"))


@register(
    "boot_paired",
    f"""{_AT_K}, bv AS (SELECT query_id AS key, coalesce(max(ndcg) FILTER (k = 10), 0) - coalesce(max(ndcg) FILTER (k = 5), 0) AS d FROM m GROUP BY query_id), o AS (SELECT avg(d) AS diff FROM bv),
b AS (SELECT draw, sum(w * (d - diff)) / nullif(sum(w), 0) AS m FROM {bootstrap.weights_sql("bv", 1000, 42)}, o GROUP BY draw),
p AS (SELECT round(any_value(diff), 6) AS diff, round(avg(CASE WHEN round(abs(m), 9) >= round(abs(diff), 9) THEN 1.0::DOUBLE ELSE 0 END), 6) AS p_value FROM b, o) SELECT diff, p_value, p_value < 0.05 AS significant FROM p""",
)
def boot_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDCG at 10 against NDCG at 5 of the same queries."""
    wide = at_k(hits(spark, sf_dir)).groupBy(F.col("query_id").alias("key")).pivot("k", [5, 10]).agg(F.first("ndcg"))
    return paired_bootstrap(wide.na.fill(0.0), "10", "5", draws=1000)


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary labels with a score: a text's length on a scale from 0 to 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.round(F.col("n_chars") / (F.col("n_chars") + 1500.0), 4).alias("score"))
    return table(spark, sf_dir, "labels").filter(F.col("quality").isNotNull()).select("doc_id", F.col("quality").alias("label")).join(docs, "doc_id")


def precision_recall_curve(scored: DataFrame) -> DataFrame:
    """threshold, tp, n, precision, recall, f1 over the distinct scores.

    Counts are summed per score first; the running sums over the distinct scores, from the greatest down, go by ranges.
    """
    by_score = scored.groupBy("score").agg(F.sum("label").alias("p"), F.count("*").alias("c"))
    summed = running(by_score, [F.desc("score")], {"above_p": F.col("p"), "above_c": F.col("c")})
    rows = summed.select(F.col("score").alias("threshold"), (F.col("above_p") + F.col("p")).alias("tp"), (F.col("above_c") + F.col("c")).alias("n"))
    rows = rows.crossJoin(F.broadcast(scored.agg(F.sum("label").alias("total"))))
    rows = rows.withColumns({"precision": F.col("tp") / F.col("n"), "recall": F.coalesce(F.try_divide("tp", "total"), F.lit(0.0))})
    p, r = F.col("precision"), F.col("recall")
    return rows.withColumn("f1", 2 * p * r / (p + r + 1e-10))


_CURVE = """WITH d AS (SELECT label, round(n_chars / (n_chars + 1500.0::DOUBLE), 4) AS score FROM (SELECT l.quality AS label, n_chars FROM labels l JOIN documents USING (doc_id) WHERE quality IS NOT NULL)),
s AS (SELECT score AS threshold, sum(label) AS p, count(*) AS c FROM d GROUP BY 1),
w AS (SELECT threshold, sum(p) OVER (ORDER BY threshold DESC) AS tp, sum(c) OVER (ORDER BY threshold DESC) AS n, sum(p) OVER () AS total FROM s),
c AS (SELECT *, tp / n AS precision, tp / total AS recall FROM w), f AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-10) AS f1 FROM c)"""


@register("threshold_best_f1", _CURVE + " SELECT threshold, round(f1, 6) AS f1 FROM f ORDER BY round(f1, 9) DESC, threshold DESC LIMIT 1")
def threshold_best_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = precision_recall_curve(scored_labels(spark, sf_dir))
    return curve.orderBy(F.desc(F.round("f1", 9)), F.desc("threshold")).limit(1).select("threshold", F.round("f1", 6).alias("f1"))


@register(
    "threshold_precision_at_recall",
    _CURVE + " SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM f WHERE recall >= 0.8 ORDER BY round(precision, 9) DESC, threshold DESC LIMIT 1",
)
def threshold_precision_at_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = precision_recall_curve(scored_labels(spark, sf_dir)).filter(F.col("recall") >= 0.8)
    return curve.orderBy(F.desc(F.round("precision", 9)), F.desc("threshold")).limit(1).select("threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


_CI = """WITH m AS (SELECT o_orderpriority AS model, avg(o_totalprice) AS mean, 1.96 * stddev_samp(o_totalprice) / sqrt(count(*)) AS half FROM orders GROUP BY 1)"""


@register(
    "ci_overlap",
    _CI + " SELECT a.model AS model_a, b.model AS model_b, a.mean - a.half <= b.mean + b.half AND b.mean - b.half <= a.mean + a.half AS overlap FROM m a JOIN m b ON a.model < b.model",
)
def ci_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of models, and whether their intervals overlap (then the difference isn't significant)."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(F.avg("o_totalprice").alias("mean"), (1.96 * F.stddev_samp("o_totalprice") / F.sqrt(F.count("*"))).alias("half"))
    a, b = o.select(*[F.col(c).alias(c + "_a") for c in o.columns]), o.select(*[F.col(c).alias(c + "_b") for c in o.columns])
    pairs = a.join(b, F.col("model_a") < F.col("model_b"))
    return pairs.select("model_a", "model_b", ((F.col("mean_a") - F.col("half_a") <= F.col("mean_b") + F.col("half_b")) & (F.col("mean_b") - F.col("half_b") <= F.col("mean_a") + F.col("half_a"))).alias("overlap"))


_GATE = """WITH base AS (SELECT l_returnflag || l_linestatus AS metric, avg(l_discount) AS value FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-01-01' GROUP BY 1),
cand AS (SELECT l_returnflag || l_linestatus AS metric, avg(l_discount) AS value FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY 1)"""


@register(
    "regression_gate",
    _GATE + " SELECT coalesce(base.metric, cand.metric) AS metric, base.value IS NULL OR cand.value IS NULL OR isnan(cand.value) OR cand.value < base.value - 0.0001 AS regressed FROM base FULL JOIN cand ON base.metric = cand.metric",
)
def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gated metric that dropped beyond the tolerance, is missing or isn't a number fails."""
    items = table(spark, sf_dir, "lineitem").withColumn("metric", F.concat("l_returnflag", "l_linestatus"))
    half = lambda early, name: items.filter((F.col("l_shipdate") < "1995-01-01") == early).groupBy("metric").agg(F.avg("l_discount").alias(name))
    both = half(True, "base").join(half(False, "cand"), "metric", "full_outer")
    bad = F.col("base").isNull() | F.col("cand").isNull() | F.isnan("cand") | (F.col("cand") < F.col("base") - 0.0001)
    return both.select("metric", F.coalesce(bad, F.lit(True)).alias("regressed"))
