"""Joins of chunks, matches and documents: context, assertions of matches, outcome details, alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..functions.text import spans_overlap
from ..operators import bootstrap
from ..storage import table
from .extraction import _MATCHES, chunk_matches, process_chunk_matches
from .ontology import _TERMS as _TERM_TABLE
from .ontology import terms
from .setmetrics import _SETS, annotations, counts, outcomes, prf


@register(
    "grounded_context",
    "SELECT conv_id, turn, lag(text) OVER w AS previous, text AS primary_text, lead(text) OVER w AS following FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
)
def grounded_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk with the texts before and after it."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("text").over(order).alias("previous"), F.col("text").alias("primary_text"), F.lead("text").over(order).alias("following"))


def match_status(chunk_status: Column, start: Column, end: Column, scopes: Column) -> Column:
    """Of a match in a negated chunk: negated where it overlaps a negated scope, else affirmed; without places the chunk's status."""
    inside = F.exists(scopes, lambda s: spans_overlap(start, end, s["start"], s["end"]))
    return F.when(chunk_status != "negated", chunk_status).when(start.isNull() | scopes.isNull() | (F.size(scopes) == 0), chunk_status).when(inside, "negated").otherwise("affirmed")


@register(
    "match_assertion",
    """WITH a AS (SELECT l_orderkey AS d, l_linenumber AS n, l_partkey % 100 AS s, l_partkey % 100 + 10 AS e, l_returnflag, l_suppkey FROM lineitem)
SELECT d AS doc_id, n AS line, s AS start, CASE l_returnflag WHEN 'A' THEN 'affirmed' WHEN 'R' THEN 'normal' ELSE CASE WHEN greatest(s, l_suppkey % 60) < least(e, l_suppkey % 60 + 30) THEN 'negated' ELSE 'affirmed' END END AS status FROM a""",
)
def match_assertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, start = F.col("l_returnflag"), F.col("l_partkey") % 100
    status = F.when(flag == "A", "affirmed").when(flag == "R", "normal").otherwise("negated")
    scopes = F.array(F.struct((F.col("l_suppkey") % 60).alias("start"), (F.col("l_suppkey") % 60 + 30).alias("end")))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), start.alias("start"), match_status(status, start, start + 10, scopes).alias("status"))


@register(
    "adapt_chunks",
    f"""{_MATCHES}, k AS (SELECT * FROM m WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY doc_id, chunk_idx ORDER BY pos) <= 10),
c AS (SELECT id AS chunk_idx, id // 100 AS doc_id FROM v WHERE id % 20 = 0)
SELECT c.doc_id, c.chunk_idx + 1 AS chunk_id, count(k.term) AS n_matches, coalesce(string_agg(k.term::VARCHAR, ',' ORDER BY k.pos), '') AS terms FROM c LEFT JOIN k USING (doc_id, chunk_idx) GROUP BY ALL""",
)
def adapt_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks, those without matches too, numbered from 1, with their matches in order."""
    chunks = table(spark, sf_dir, "embeddings").filter("embedding IS NOT NULL AND vec_id % 20 = 0").select(F.col("vec_id").alias("chunk_idx"), F.floor(F.col("vec_id") / 100).cast("long").alias("doc_id"))
    kept = process_chunk_matches(chunk_matches(spark, sf_dir)).groupBy("doc_id", "chunk_idx").agg(F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("m"))
    names = F.array_join(F.transform(F.coalesce("m", F.array().cast("array<struct<pos:int,term:bigint>>")), lambda m: m["term"].cast("string")), ",")
    return chunks.join(kept, ["doc_id", "chunk_idx"], "left").select("doc_id", (F.col("chunk_idx") + 1).alias("chunk_id"), F.when(F.col("m").isNull(), 0).otherwise(F.size("m")).cast("long").alias("n_matches"), names.alias("terms"))


@register(
    "align_vectors",
    """WITH t AS (SELECT l.doc_id AS id FROM labels l), d AS (SELECT doc_id AS id FROM documents WHERE n_chars > 500)
SELECT count(*) FILTER (t.id IS NOT NULL AND d.id IS NOT NULL) AS aligned, count(*) FILTER (d.id IS NULL) AS only_labels, count(*) FILTER (t.id IS NULL) AS only_documents FROM t FULL JOIN d ON t.id = d.id""",
)
def align_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two id sets align: common ids and the symmetric difference, in one aggregation."""
    a = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit(1).alias("side"))
    b = table(spark, sf_dir, "documents").filter("n_chars > 500").select(F.col("doc_id").alias("id"), F.lit(2).alias("side"))
    sides = a.unionByName(b).groupBy("id").agg(F.bit_or("side").alias("s"))
    return sides.agg(F.count_if(F.col("s") == 3).alias("aligned"), F.count_if(F.col("s") == 1).alias("only_labels"), F.count_if(F.col("s") == 2).alias("only_documents"))


@register(
    "detail_analysis",
    _SETS + """, e AS (SELECT doc_id, term, assertion, string_agg(l_quantity::INTEGER::VARCHAR, ',' ORDER BY l_quantity) AS evidence FROM a GROUP BY ALL)
SELECT o.doc_id, o.term, o.assertion, o.outcome, e.evidence FROM o JOIN e USING (doc_id, term, assertion) WHERE outcome <> 'tp'""",
)
def detail_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors with the evidence of their term."""
    found = outcomes(*annotations(spark, sf_dir)).filter("outcome <> 'tp'")
    flag = F.col("l_returnflag")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("P:"), F.col("l_partkey").cast("string")).alias("term"), F.when(flag == "A", "PRESENT").when(flag == "N", "ABSENT").otherwise("UNCERTAIN").alias("assertion"), "l_quantity"
    )
    evidence = rows.groupBy("doc_id", "term", "assertion").agg(F.array_join(F.transform(F.sort_array(F.collect_list("l_quantity")), lambda q: q.cast("int").cast("string")), ",").alias("evidence"))
    return found.join(evidence, ["doc_id", "term", "assertion"])


@register(
    "assertion_distribution",
    """WITH a AS (SELECT l_orderkey AS d, CASE l_returnflag WHEN 'A' THEN 'PRESENT' WHEN 'N' THEN 'ABSENT' ELSE 'UNCERTAIN' END AS assertion FROM lineitem)
SELECT assertion, count(*) AS n, count(DISTINCT d) AS n_documents, count(*) FILTER (assertion <> 'UNCERTAIN') AS scored FROM a GROUP BY assertion""",
)
def assertion_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("d"), F.when(flag == "A", "PRESENT").when(flag == "N", "ABSENT").otherwise("UNCERTAIN").alias("assertion"))
    return rows.groupBy("assertion").agg(F.count("*").alias("n"), F.countDistinct("d").alias("n_documents"), F.count_if(F.col("assertion") != "UNCERTAIN").alias("scored"))


@register(
    "component_stats",
    f"WITH {_TERM_TABLE} SELECT count(*) AS labels, sum(len(list_filter(synonyms, lambda x: x <> ''))) AS synonyms, count(*) FILTER (definition <> '') AS definitions FROM t",
)
def component_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = F.size(F.filter("synonyms", lambda s: s != ""))
    return terms(spark, sf_dir).agg(F.count("*").alias("labels"), F.sum(filled).alias("synonyms"), F.count_if(F.col("definition") != "").alias("definitions"))


_CORPUS_DRAWS = 200


@register(
    "boot_corpus",
    f"""{_SETS}, v AS (SELECT doc_id AS key, tp, fp, fn FROM d), b AS (SELECT draw, sum(w * tp) AS tp, sum(w * fp) AS fp, sum(w * fn) AS fn FROM {bootstrap.weights_sql("v", _CORPUS_DRAWS, 42)} GROUP BY draw),
s AS (SELECT draw, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM (SELECT draw, tp::DOUBLE AS tp, fp, fn FROM b UNION ALL SELECT 0, sum(tp)::DOUBLE, sum(fp), sum(fn) FROM d)),
l AS (SELECT draw, unnest([{{'metric': 'precision', 'x': p}}, {{'metric': 'recall', 'x': r}}, {{'metric': 'f1', 'x': 2 * p * r / nullif(p + r, 0)}}], recursive := true) FROM s)
SELECT metric, round(max(x) FILTER (draw = 0), 6) AS value, round(quantile_cont(x, 0.025) FILTER (draw > 0), 6) AS low, round(quantile_cont(x, 0.975) FILTER (draw > 0), 6) AS high FROM l GROUP BY metric""",
)
def boot_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded bootstrap over documents of micro precision, recall and F1: each document's counts with a Poisson weight in each draw."""
    found = counts(outcomes(*annotations(spark, sf_dir)), "doc_id").withColumnRenamed("doc_id", "key")
    measured = prf(bootstrap.sums(found, ["tp", "fp", "fn"], _CORPUS_DRAWS))
    point = prf(found.agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn")]))
    long = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).alias("value")) for n, c in (("precision", "p"), ("recall", "r"), ("f1", "f"))])).alias("x")).select("x.*")
    edge = lambda q, name: F.round(F.percentile("value", F.lit(q)), 6).alias(name)
    bounds = long(measured).groupBy("metric").agg(edge(0.025, "low"), edge(0.975, "high"))
    return long(point).select("metric", F.round("value", 6).alias("value")).join(bounds, "metric")
