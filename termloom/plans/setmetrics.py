"""Predictions against gold sets: outcomes, precision, recall and F1 by averaging, assertions, aggregation over chunks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import graph
from ..storage import table

ASSERTIONS = ("PRESENT", "ABSENT", "UNCERTAIN")

#: Annotations of the test tables: an order is a document, a part is a term, the return flag is the assertion.
_SETS = """WITH a AS (SELECT l_orderkey AS doc_id, 'P:' || l_partkey AS term, CASE l_returnflag WHEN 'A' THEN 'PRESENT' WHEN 'N' THEN 'ABSENT' ELSE 'UNCERTAIN' END AS assertion, l_quantity, l_discount FROM lineitem),
u AS (SELECT doc_id, term, assertion, bool_or(l_quantity <= 30) AS p, bool_or(l_discount >= 0.03) AS g FROM a WHERE l_quantity <= 30 OR l_discount >= 0.03 GROUP BY ALL),
o AS (SELECT doc_id, term, assertion, CASE WHEN NOT p THEN 'fn' WHEN NOT g THEN 'fp' ELSE 'tp' END AS outcome FROM u),
d AS (SELECT doc_id, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn FROM o GROUP BY doc_id),
m AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fn) END AS r FROM d),
x AS (SELECT *, CASE WHEN p + r = 0 THEN 0.0::DOUBLE ELSE 2 * p * r / (p + r) END AS f FROM m)"""


def annotations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Predicted and gold (doc_id, term, assertion)."""
    flag = F.col("l_returnflag")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("P:"), F.col("l_partkey").cast("string")).alias("term"),
        F.when(flag == "A", "PRESENT").when(flag == "N", "ABSENT").otherwise("UNCERTAIN").alias("assertion"), "l_quantity", "l_discount",
    )
    keep = ("doc_id", "term", "assertion")
    return rows.filter("l_quantity <= 30").select(*keep), rows.filter("l_discount >= 0.03").select(*keep)


def outcomes(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """doc_id, term, assertion, outcome (tp, fp, fn). Both sides go through one aggregation: one shuffle instead of a join's two."""
    both = pred.withColumn("side", F.lit(1)).unionByName(gold.withColumn("side", F.lit(2)))
    sides = both.groupBy("doc_id", "term", "assertion").agg(F.bit_or("side").alias("sides"))
    return sides.select("doc_id", "term", "assertion", F.when(F.col("sides") == 3, "tp").when(F.col("sides") == 1, "fp").otherwise("fn").alias("outcome"))


def normalize_for_scoring(rows: DataFrame, mode: str = "strict") -> DataFrame:
    """``strict`` leaves annotations as they are, ``present-only`` keeps asserted ones."""
    if mode not in ("strict", "present-only"):
        raise ValueError(f"unknown scoring mode {mode}")
    return rows if mode == "strict" else rows.filter(F.col("assertion") == "PRESENT")


def counts(found: DataFrame, *by: str) -> DataFrame:
    n = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return found.groupBy(*by).agg(n("tp"), n("fp"), n("fn"))


def prf(rows: DataFrame) -> DataFrame:
    """p, r, f of tp, fp, fn; zero where nothing is to divide by."""
    zero = F.lit(0.0)
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), zero)
    tp = F.col("tp")
    rows = rows.withColumns({"p": ratio(tp, tp + F.col("fp")), "r": ratio(tp, tp + F.col("fn"))})
    return rows.withColumn("f", ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))


def r5(x: Column, name: str) -> Column:
    return F.round(x, 5).alias(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prf(counts(outcomes(*annotations(spark, sf_dir)), "doc_id"))


@register("outcome_tp_fp_fn", _SETS + " SELECT doc_id, term, assertion, outcome FROM o")
def outcome_tp_fp_fn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(*annotations(spark, sf_dir))


@register("doc_metrics", _SETS + " SELECT doc_id, tp, fp, fn, round(p, 5) AS p, round(r, 5) AS r, round(f, 5) AS f FROM x")
def doc_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "tp", "fp", "fn", *[r5(F.col(c), c) for c in "prf"])


_MICRO = ", s AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM d), y AS (SELECT tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM s)"


@register("prf_micro", _SETS + _MICRO + " SELECT round(p, 5) AS precision, round(r, 5) AS recall, round(2 * p * r / (p + r), 5) AS f1 FROM y")
def prf_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prf(counts(outcomes(*annotations(spark, sf_dir)))).select(r5(F.col("p"), "precision"), r5(F.col("r"), "recall"), r5(F.col("f"), "f1"))


@register("prf_macro", _SETS + " SELECT round(avg(p), 5) AS precision, round(avg(r), 5) AS recall, round(avg(f), 5) AS f1 FROM x")
def prf_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).agg(r5(F.avg("p"), "precision"), r5(F.avg("r"), "recall"), r5(F.avg("f"), "f1"))


@register(
    "prf_weighted",
    _SETS + ", w AS (SELECT *, greatest(tp + fn, 1) AS w FROM x) SELECT round(sum(p * w) / sum(w), 5) AS precision, round(sum(r * w) / sum(w), 5) AS recall, round(sum(f * w) / sum(w), 5) AS f1 FROM w",
)
def prf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents weigh as their gold sets, one at least."""
    rows = documents(spark, sf_dir).withColumn("w", F.greatest(F.col("tp") + F.col("fn"), F.lit(1)))
    mean = lambda c, name: r5(F.try_divide(F.sum(F.col(c) * F.col("w")), F.sum("w")), name)
    return rows.agg(mean("p", "precision"), mean("r", "recall"), mean("f", "f1"))


@register(
    "prf_by_assertion",
    _SETS
    + """, s AS (SELECT coalesce(assertion, 'ALL') AS assertion, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn FROM o GROUP BY ROLLUP (assertion))
SELECT assertion, tp, fp, fn, round(tp / (tp + fp), 5) AS precision, round(tp / (tp + fn), 5) AS recall FROM s""",
)
def prf_by_assertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    rows = outcomes(*annotations(spark, sf_dir)).rollup("assertion").agg(n("tp"), n("fp"), n("fn"))
    return prf(rows).select(F.coalesce("assertion", F.lit("ALL")).alias("assertion"), "tp", "fp", "fn", r5(F.col("p"), "precision"), r5(F.col("r"), "recall"))


@register(
    "assertion_confusion",
    """WITH a AS (SELECT l_orderkey AS d, l_linenumber AS n, CASE l_returnflag WHEN 'A' THEN 'PRESENT' WHEN 'N' THEN 'ABSENT' ELSE 'UNCERTAIN' END AS gold, CASE WHEN l_linestatus = 'O' THEN 'ABSENT' WHEN l_quantity <= 25 THEN 'PRESENT' ELSE 'UNCERTAIN' END AS pred FROM lineitem)
SELECT gold, count(*) FILTER (pred = 'PRESENT') AS "PRESENT", count(*) FILTER (pred = 'ABSENT') AS "ABSENT", count(*) FILTER (pred = 'UNCERTAIN') AS "UNCERTAIN", round(100.0 * avg(CASE WHEN gold = pred THEN 1.0::DOUBLE ELSE 0.0 END), 5) AS accuracy FROM a GROUP BY gold""",
)
def assertion_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    rows = table(spark, sf_dir, "lineitem").select(
        F.when(flag == "A", "PRESENT").when(flag == "N", "ABSENT").otherwise("UNCERTAIN").alias("gold"),
        F.when(F.col("l_linestatus") == "O", "ABSENT").when(F.col("l_quantity") <= 25, "PRESENT").otherwise("UNCERTAIN").alias("pred"),
    )
    cells = [F.count_if(F.col("pred") == a).alias(a) for a in ASSERTIONS]
    return rows.groupBy("gold").agg(*cells, F.round(100 * F.avg(F.when(F.col("gold") == F.col("pred"), 1.0).otherwise(0.0)), 5).alias("accuracy"))


@register("joint_f1", _SETS + " SELECT doc_id, round(CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 5) AS joint_f1 FROM d")
def joint_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = counts(outcomes(*annotations(spark, sf_dir)), "doc_id")
    return rows.select("doc_id", r5(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), "joint_f1"))


# --- aggregation of chunk predictions to documents: an order is a document, its suppliers are chunks, part types are terms ---

_CHUNKS = """WITH c AS (SELECT l_orderkey AS doc_id, l_suppkey % 3 AS chunk, p_brand AS term, max(l_discount * 10) AS score FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL), n AS (SELECT doc_id, count(DISTINCT chunk) AS chunks FROM c GROUP BY 1)"""


def chunk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_discount")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return lines.join(parts, "l_partkey").groupBy(F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 3).alias("chunk"), F.col("p_brand").alias("term")).agg(F.max(F.col("l_discount") * 10).alias("score"))


def aggregate_chunks(scores: DataFrame, strategy: str, threshold: float | None = None) -> DataFrame:
    """doc_id, term of a document's chunks (doc_id, chunk, term, score) by strategy: union, intersection, weighted or threshold."""
    match strategy:
        case "union":
            return scores.select("doc_id", "term").distinct()
        case "intersection":
            n = scores.groupBy("doc_id").agg(F.countDistinct("chunk").alias("chunks"))
            per = scores.groupBy("doc_id", "term").agg(F.countDistinct("chunk").alias("n"))
            return per.join(n, "doc_id").filter(F.col("n") == F.col("chunks")).select("doc_id", "term")
        case "weighted":
            return scores.groupBy("doc_id", "term").agg(F.avg("score").alias("s")).filter(F.round("s", 9) >= (0.5 if threshold is None else threshold)).select("doc_id", "term")
        case "threshold":
            return scores.groupBy("doc_id", "term").agg(F.max("score").alias("s")).filter(F.round("s", 9) >= (0.7 if threshold is None else threshold)).select("doc_id", "term")
    raise ValueError(f"unknown strategy {strategy}")


def _aggregation(strategy: str, sql: str) -> None:
    @register(f"agg_{strategy}", f"{_CHUNKS} {sql}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return aggregate_chunks(chunk_scores(spark, sf_dir), strategy)


_aggregation("union", "SELECT DISTINCT doc_id, term FROM c")
_aggregation("intersection", "SELECT doc_id, term FROM c JOIN n USING (doc_id) GROUP BY doc_id, term, chunks HAVING count(DISTINCT chunk) = chunks")
_aggregation("weighted", "SELECT doc_id, term FROM c GROUP BY ALL HAVING round(avg(score), 9) >= 0.5")
_aggregation("threshold", "SELECT doc_id, term FROM c GROUP BY ALL HAVING round(max(score), 9) >= 0.7")


# --- maximum-weight matching per document ---


def assign(weights) -> list[tuple[int, int]]:
    """Row and column pairs of a matching of maximum total weight; pairs of no weight are left out.

    Shortest augmenting paths with potentials on the costs ``top - weight``, rows no more than columns; each step looks at
    all columns at once.
    """
    w = np.asarray(weights, dtype=np.float64)
    if not w.size:
        return []
    if flip := len(w) > w.shape[1]:
        w = w.T
    n, m = w.shape
    cost = w.max() - w
    row_potential, column_potential = np.zeros(n), np.zeros(m)
    owner, owned = np.full(m, -1), np.full(n, -1)  # of columns, and the columns that rows own
    for start in range(n):
        least, way, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, dtype=bool)
        row, reached, came = start, 0.0, -1
        while True:
            path = np.where(done, np.inf, reached + cost[row] - row_potential[row] - column_potential)
            nearer = path < least
            least, way = np.where(nearer, path, least), np.where(nearer, came, way)
            came = int(np.where(done, np.inf, least).argmin())
            reached = least[came]
            done[came] = True
            if owner[came] < 0:
                break
            row = owner[came]
        seen = np.flatnonzero(done & (owner >= 0))
        row_potential[start] += reached
        row_potential[owner[seen]] += reached - least[seen]
        column_potential[seen] -= reached - least[seen]
        at = came
        while at >= 0:
            before = way[at]
            row = owner[before] if before >= 0 else start
            owner[at], owned[row] = row, at
            at = before
    pairs = [(int(r), int(c)) for r, c in enumerate(owned) if c >= 0 and w[r, c] > 0]
    return [(b, a) for a, b in pairs] if flip else pairs


def best_total(pairs: list[tuple]) -> float:
    """Greatest total credit of a matching of (a, b, credit); parts that share no term are solved on their own."""
    best: dict[tuple, float] = {}
    root: dict[tuple, tuple] = {}

    def find(x: tuple) -> tuple:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b, credit in pairs:
        if credit > 0:
            best[a, b] = max(best.get((a, b), 0.0), credit)
            root[find((0, a))] = find((1, b))
    parts: dict[tuple, list] = {}
    for (a, b), credit in best.items():
        parts.setdefault(find((0, a)), []).append((a, b, credit))
    total = 0.0
    for part in parts.values():
        rows, columns = ({x: i for i, x in enumerate(sorted({p[k] for p in part}))} for k in (0, 1))
        weights = np.zeros((len(rows), len(columns)))
        for a, b, credit in part:
            weights[rows[a], columns[b]] = credit
        total += float(sum(weights[pair] for pair in assign(weights)))
    return total


def soft_matches(credits: DataFrame) -> DataFrame:
    """doc_id, assertion, soft_tp from (doc_id, assertion, a, b, credit).

    Only pairs that earn credit are gathered, by document and assertion; a group is as large as one document's unmatched
    annotations and is solved part by part over Arrow batches.
    """

    @F.pandas_udf("double")
    def best(pairs: pd.Series) -> pd.Series:
        return pairs.map(lambda row: round(best_total([(p["a"], p["b"], p["credit"]) for p in row]), 6))

    gathered = credits.filter("credit > 0").groupBy("doc_id", "assertion").agg(F.collect_list(F.struct("a", "b", "credit")).alias("pairs"))
    return gathered.select("doc_id", "assertion", best("pairs").alias("soft_tp"))


def _soft_sql() -> str:
    """Matchings one false positive after the other: of each set of gold terms used so far (a bit each) the best total."""
    from .ontology import _CREDIT, _FEATURES, _GRAPH, _KIND

    return f"""WITH RECURSIVE {_GRAPH}, {_SETS.removeprefix("WITH ")},
fpn AS (SELECT doc_id, assertion, term, row_number() OVER (PARTITION BY doc_id, assertion ORDER BY term) AS i FROM o WHERE outcome = 'fp'),
fnn AS (SELECT doc_id, assertion, term, row_number() OVER (PARTITION BY doc_id, assertion ORDER BY term) - 1 AS j FROM o WHERE outcome = 'fn'),
p AS (SELECT DISTINCT x.term AS a, y.term AS b FROM fpn x JOIN fnn y ON x.doc_id = y.doc_id AND x.assertion = y.assertion), {_FEATURES}{_KIND}, cr AS (SELECT a, b, {_CREDIT} AS credit FROM k),
w AS (SELECT x.doc_id, x.assertion, x.i, y.j, credit FROM fpn x JOIN fnn y ON x.doc_id = y.doc_id AND x.assertion = y.assertion JOIN cr ON cr.a = x.term AND cr.b = y.term WHERE credit > 0),
grp AS (SELECT DISTINCT doc_id, assertion FROM w), ways AS (SELECT * FROM w UNION ALL SELECT doc_id, assertion, i, -1, 0.0::DOUBLE FROM fpn SEMI JOIN grp USING (doc_id, assertion)),
st(doc_id, assertion, i, mask, total) AS (SELECT doc_id, assertion, 0::BIGINT, 0::BIGINT, 0.0::DOUBLE FROM grp UNION ALL
  SELECT s.doc_id, s.assertion, s.i + 1, CASE WHEN j < 0 THEN mask ELSE mask | (1::BIGINT << j::INTEGER) END AS used, max(total + credit) FROM st s
  JOIN ways ON ways.doc_id = s.doc_id AND ways.assertion = s.assertion AND ways.i = s.i + 1 AND (j < 0 OR (mask >> greatest(j, 0)::INTEGER) & 1 = 0) GROUP BY s.doc_id, s.assertion, s.i, used),
soft AS (SELECT doc_id, assertion, round(max(total), 6) AS soft FROM st GROUP BY ALL), ex AS (SELECT doc_id, assertion, count(*) AS exact FROM o WHERE outcome = 'tp' GROUP BY ALL)
SELECT doc_id, assertion, coalesce(exact, 0) AS exact, round(coalesce(exact, 0) + coalesce(soft, 0.0), 6) AS soft_tp FROM ex FULL JOIN soft USING (doc_id, assertion)"""


@register("assign_soft_rows_only", _soft_sql())
def assign_soft_rows_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ontology-aware soft true positives: exact matches first, the rest by maximum-weight matching within an assertion."""
    from .ontology import about_terms

    found = outcomes(*annotations(spark, sf_dir))
    exact = found.filter("outcome = 'tp'").groupBy("doc_id", "assertion").agg(F.count("*").alias("exact"))
    side = lambda o, name: found.filter(F.col("outcome") == o).select("doc_id", "assertion", F.col("term").alias(name))
    pairs = side("fp", "a").join(side("fn", "b"), ["doc_id", "assertion"])
    terms = about_terms(spark, sf_dir)
    credits = graph.pair_features(pairs.select("a", "b").distinct(), terms).select("a", "b", graph.pair_credit().alias("credit"))
    soft = soft_matches(pairs.join(credits, ["a", "b"]).select("doc_id", "assertion", "a", "b", "credit"))
    both = exact.join(soft, ["doc_id", "assertion"], "full_outer")
    return both.select("doc_id", "assertion", F.coalesce("exact", F.lit(0)).alias("exact"), F.round(F.coalesce("exact", F.lit(0)) + F.coalesce("soft_tp", F.lit(0.0)), 6).alias("soft_tp"))


def semantic_prf(pred: DataFrame, gold: DataFrame, sims: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, exact, semantic, n_pred, n_gold: exact matches by term, then each other prediction with its best gold term.

    A prediction counts if any gold term that no exact match used is similar enough; a gold term may serve several.
    ``sims`` is (a, b, hybrid) of predicted and gold terms.
    """
    p, g = pred.select("doc_id", "term").distinct(), gold.select("doc_id", "term").distinct()
    exact = p.join(g, ["doc_id", "term"])
    left = p.join(exact, ["doc_id", "term"], "left_anti").withColumnRenamed("term", "a")
    open_ = g.join(exact, ["doc_id", "term"], "left_anti").withColumnRenamed("term", "b")
    near = left.join(open_, "doc_id").join(sims.filter(F.col("hybrid") >= threshold).select("a", "b"), ["a", "b"])
    semantic = near.groupBy("doc_id").agg(F.countDistinct("a").alias("semantic"))
    n = lambda rows, name: rows.groupBy("doc_id").agg(F.count("*").alias(name))
    out = n(p, "n_pred").join(n(g, "n_gold"), "doc_id", "full_outer").join(n(exact, "exact"), "doc_id", "left").join(semantic, "doc_id", "left")
    return out.na.fill(0, ["n_pred", "n_gold", "exact", "semantic"])


_NEAR_KEYS = "abs(pa - pb) <= 40 AND 1 - abs(pa - pb) / 100.0::DOUBLE >= 0.7"


@register(
    "semantic_prf",
    f"""{_SETS}, p AS (SELECT DISTINCT doc_id, term FROM u WHERE p), g AS (SELECT DISTINCT doc_id, term FROM u WHERE g), e AS (SELECT * FROM p INTERSECT SELECT * FROM g),
l AS (SELECT doc_id, CAST(substr(term, 3) AS BIGINT) AS pa FROM (SELECT * FROM p EXCEPT SELECT * FROM e)), r AS (SELECT doc_id, CAST(substr(term, 3) AS BIGINT) AS pb FROM (SELECT * FROM g EXCEPT SELECT * FROM e)),
s AS (SELECT doc_id, count(DISTINCT pa) AS semantic FROM l JOIN r USING (doc_id) WHERE {_NEAR_KEYS} GROUP BY doc_id),
i AS (SELECT DISTINCT doc_id FROM u) SELECT i.doc_id, (SELECT count(*) FROM e WHERE e.doc_id = i.doc_id) AS exact, coalesce(s.semantic, 0) AS semantic, (SELECT count(*) FROM p WHERE p.doc_id = i.doc_id) AS n_pred,
(SELECT count(*) FROM g WHERE g.doc_id = i.doc_id) AS n_gold FROM i LEFT JOIN s USING (doc_id)""",
)
def semantic_prf_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with near keys are similar terms; the similarities are listed by a join on key ranges of 40, not as a product."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    near = parts.withColumn("o", F.explode(F.sequence(F.col("k") - 40, F.col("k") + 40))).join(parts.select(F.col("k").alias("o")), "o")
    name = lambda c: F.concat(F.lit("P:"), F.col(c).cast("string"))
    sims = near.select(name("k").alias("a"), name("o").alias("b"), (1 - F.abs(F.col("k") - F.col("o")) / 100.0).alias("hybrid"))
    return semantic_prf(*annotations(spark, sf_dir), sims)
