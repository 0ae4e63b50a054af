"""Document extraction: chunk matches to evidence to ranked terms, chunk quality and adaptive re-chunking.

In the test tables a query vector stands for a chunk (its document is id div 100) and its neighbours for the chunk's matches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import text as T
from ..storage import checkpointed
from .retrieval import knn_sql, neighbours

#: Similarity a chunk's match needs, matches a chunk keeps, mean confidence a term needs.
CHUNK_THRESHOLD, PER_CHUNK, LEAST_CONFIDENCE = 0.3, 10, 0.0


def chunk_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, chunk_idx, term, score, pos, status."""
    found = neighbours(spark, sf_dir, 30)
    status = F.when(F.col("query_id") % 3 == 0, "negated").when(F.col("query_id") % 3 == 1, "affirmed").otherwise("normal")
    return found.select(
        F.floor(F.col("query_id") / 100).cast("long").alias("doc_id"), F.col("query_id").alias("chunk_idx"), F.floor(F.col("doc_id") / 5).cast("long").alias("term"),
        F.col("similarity").alias("score"), F.col("rank").alias("pos"), status.alias("status"),
    )


_MATCHES = f"""WITH {knn_sql(30)}, m AS (SELECT query_id // 100 AS doc_id, query_id AS chunk_idx, doc_id // 5 AS term, similarity AS score, rank AS pos,
CASE query_id % 3 WHEN 0 THEN 'negated' WHEN 1 THEN 'affirmed' ELSE 'normal' END AS status FROM r)"""


def process_chunk_matches(found: DataFrame, threshold: float = CHUNK_THRESHOLD, most: int = PER_CHUNK, top_only: bool = False) -> DataFrame:
    """The first matches of each chunk at or over the threshold; only the best one if asked."""
    order = Window.partitionBy("doc_id", "chunk_idx").orderBy("pos")
    rows = found.filter((F.col("score") >= threshold) & F.col("term").isNotNull()).withColumn("n", F.row_number().over(order))
    return rows.filter(F.col("n") <= (1 if top_only else most)).drop("n")


@register(
    "ev_chunk_filter",
    f"{_MATCHES} SELECT doc_id, chunk_idx, term, score FROM m WHERE score >= {CHUNK_THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id, chunk_idx ORDER BY pos) <= {PER_CHUNK}",
)
def ev_chunk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return process_chunk_matches(chunk_matches(spark, sf_dir)).select("doc_id", "chunk_idx", "term", "score")


def aggregate_evidence(rows: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """Ranked terms of a document: mean and best score, evidence count, chunks, first best chunk, commonest status (first seen on ties).

    Two aggregations on (document, term) with partial sums; the statuses are counted on the way.
    """
    by_status = rows.groupBy("doc_id", "term", "status").agg(
        F.count("*").alias("c"), F.sum("score").alias("s"), F.max("score").alias("m"), F.min(F.struct("chunk_idx", "pos")).alias("seen"),
        F.collect_set("chunk_idx").alias("chunks"), F.max(F.struct("score", (-F.col("chunk_idx")).alias("c"))).alias("top"),
    )
    terms = by_status.groupBy("doc_id", "term").agg(
        F.sum("c").alias("n_evidence"), (F.round(F.sum("s"), 6) / F.sum("c")).alias("confidence"), F.max("m").alias("score"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("chunks")))).alias("chunks"), (-F.max("top")["c"]).alias("top_chunk"),
        F.max_by("status", F.struct("c", (-F.col("seen.chunk_idx")).alias("a"), (-F.col("seen.pos")).alias("b"))).alias("status"),
    )
    order = Window.partitionBy("doc_id").orderBy(F.desc("confidence"), F.desc("n_evidence"), "term")
    return terms.filter(F.col("confidence") >= least).withColumn("rank", F.row_number().over(order))


@register(
    "ev_aggregate_rank",
    f"""{_MATCHES}, k AS (SELECT * FROM m WHERE score >= {CHUNK_THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id, chunk_idx ORDER BY pos) <= {PER_CHUNK}),
st AS (SELECT doc_id, term, status, count(*) AS c, min((chunk_idx, pos)) AS seen FROM k GROUP BY ALL), b AS (SELECT doc_id, term, status FROM st QUALIFY row_number() OVER (PARTITION BY doc_id, term ORDER BY c DESC, seen) = 1),
t AS (SELECT doc_id, term, count(*) AS n_evidence, round(sum(score), 6) / count(*) AS confidence, max(score) AS score, string_agg(DISTINCT chunk_idx::VARCHAR, ',' ORDER BY chunk_idx::VARCHAR) AS chunks,
arg_max(chunk_idx, (score, -chunk_idx)) AS top_chunk FROM k GROUP BY ALL)
SELECT doc_id, term, n_evidence, confidence, score, chunks, top_chunk, status FROM t JOIN b USING (doc_id, term)""",
)
def ev_aggregate_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aggregate_evidence(process_chunk_matches(chunk_matches(spark, sf_dir)))
    chunks = F.array_join(F.sort_array(F.transform("chunks", lambda c: c.cast("string"))), ",")
    return rows.select("doc_id", "term", "n_evidence", "confidence", "score", chunks.alias("chunks"), "top_chunk", "status")


# --- quality of chunks, improvement gate, adaptive re-chunking ---


@dataclass(frozen=True)
class Adaptive:
    poor: float = 0.55
    margin: float = 0.03
    gain: float = 0.05
    rounds: int = 2
    least_chars: int = 30
    sentences: int = 3
    overlap: int = 1


def chunk_quality(found: DataFrame, config: Adaptive = Adaptive()) -> DataFrame:
    """top1, top2 and whether a chunk is poor: a weak best match with no clear lead over the second."""
    rows = found.groupBy("doc_id", "chunk_idx").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    rows = rows.select("doc_id", "chunk_idx", F.get("s", F.lit(0)).alias("top1"), F.get("s", F.lit(1)).alias("top2"))
    weak = F.col("top1").isNull() | ((F.col("top1") < config.poor) & (F.col("top2").isNull() | (F.round(F.col("top1") - F.col("top2"), 9) < config.margin)))
    return rows.withColumn("poor", weak)


@register(
    "chunk_quality",
    f"""{_MATCHES}, q AS (SELECT doc_id, chunk_idx, max(score) FILTER (pos = 1) AS top1, max(score) FILTER (pos = 2) AS top2 FROM m GROUP BY ALL)
SELECT doc_id, chunk_idx, top1, top2, top1 < 0.55 AND (top2 IS NULL OR round(top1 - top2, 9) < 0.03) AS poor FROM q""",
)
def q_chunk_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_quality(chunk_matches(spark, sf_dir))


def improvement_gate(parents: DataFrame, children: DataFrame, gain: float = Adaptive.gain) -> DataFrame:
    """parent, best_child, accept: children replace a parent if the best of them gains enough."""
    best = children.groupBy("parent").agg(F.max("score").alias("best_child"))
    return parents.join(best, "parent", "left").withColumn("accept", F.coalesce(F.round(F.col("best_child") - F.col("score"), 9) >= gain, F.lit(False)))


@register(
    "improvement_gate",
    f"""{_MATCHES}, p AS (SELECT doc_id AS parent, max(score) FILTER (pos = 1 AND chunk_idx % 100 = 0) AS score, max(score) FILTER (chunk_idx % 100 <> 0) AS best_child FROM m GROUP BY doc_id)
SELECT parent, score, best_child, coalesce(round(best_child - score, 9) >= 0.05, false) AS accept FROM p WHERE score IS NOT NULL""",
)
def q_improvement_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunk_matches(spark, sf_dir)
    first = F.col("chunk_idx") % 100 == 0
    parents = rows.filter(first & (F.col("pos") == 1)).groupBy(F.col("doc_id").alias("parent")).agg(F.max("score").alias("score"))
    return improvement_gate(parents, rows.filter(~first).select(F.col("doc_id").alias("parent"), "score"))


def subdivide(chunk: Column, config: Adaptive = Adaptive()) -> Column:
    """Sentence windows of a chunk: distinct, long enough, not the chunk itself."""
    step = max(1, config.sentences - config.overlap)

    def windows(x: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(x["s"]) - 1, F.lit(0)), F.lit(step))
        found = F.array_distinct(F.transform(starts, lambda s: F.array_join(F.slice(x["s"], s + 1, config.sentences), " ")))
        return F.filter(found, lambda w: (F.length(w) >= config.least_chars) & (w != x["whole"]))

    # an array of one value binds the sentences and the cleaned chunk, so that each is made once and not once a window
    bound = F.array(F.struct(T.sentences(chunk).alias("s"), T.clean_spaces(chunk).alias("whole")))
    return F.get(F.transform(bound, windows), F.lit(0))


def adaptive_rechunk(chunks: DataFrame, retrieve: Callable[[DataFrame], DataFrame], config: Adaptive = Adaptive()) -> DataFrame:
    """Chunks (doc_id, chunk_id, text) after at most ``rounds`` of: assess, split the poor ones, retrieve, keep what gained.

    ``retrieve`` gives (doc_id, chunk_id, score) of chunks. Rounds are few and bounded; each ends in a checkpoint.
    """
    rename = lambda rows: rows.withColumnRenamed("chunk_id", "chunk_idx")
    current, open_ = chunks.select("doc_id", "chunk_id", "text"), chunks.select("doc_id", "chunk_id", "text")
    for _ in range(config.rounds):
        quality = chunk_quality(rename(retrieve(open_)), config).withColumnRenamed("chunk_idx", "chunk_id")
        assessed = open_.join(quality, ["doc_id", "chunk_id"], "left").withColumn("poor", F.coalesce("poor", F.lit(True)))
        poor = assessed.filter("poor").withColumnRenamed("text", "whole")
        children = poor.select("doc_id", F.col("chunk_id").alias("parent"), F.col("whole"), F.posexplode(subdivide(F.col("whole"), config)).alias("n", "text"))
        children = checkpointed(children.select("doc_id", "parent", F.concat_ws(".", "parent", F.col("n").cast("string")).alias("chunk_id"), "text"))
        if children.isEmpty():
            break
        key = F.concat_ws("|", F.col("doc_id").cast("string"), "parent")
        scored = retrieve(children.select("doc_id", "chunk_id", "text")).join(children.select("doc_id", "chunk_id", "parent"), ["doc_id", "chunk_id"])
        gate = improvement_gate(poor.select(F.concat_ws("|", F.col("doc_id").cast("string"), "chunk_id").alias("parent"), F.coalesce("top1", F.lit(0.0)).alias("score")), scored.select(key.alias("parent"), "score"), config.gain)
        won = gate.filter("accept").select(F.col("parent").alias("key"))
        kept = current.withColumn("key", F.concat_ws("|", F.col("doc_id").cast("string"), "chunk_id")).join(won, "key", "left_anti").drop("key")
        open_ = checkpointed(children.withColumn("key", key).join(won, "key", "left_semi").select("doc_id", "chunk_id", "text"))
        current = checkpointed(kept.unionByName(open_))
    return current


@register(
    "chunk_subdivide",
    r"""WITH n AS (SELECT doc_id, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[ \t\n\r]*\n[ \t\n\r]*', ' ', 'g'), '[ \t\n\r]{2,}', ' ', 'g')) AS whole FROM documents),
l AS (SELECT doc_id, whole, array_to_string(list_transform(list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '\A[ \t\n\r]+|[ \t\n\r]+\z', '', 'g')), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[.?!]\z') THEN x ELSE x || '.' END), ' ') AS t FROM n),
p AS (SELECT doc_id, whole, list_filter(list_transform(regexp_extract_all(t, '[^.?!]+[.?!]'), lambda x: regexp_replace(x, '\A[ \t\n\r]+|[ \t\n\r]+\z', '', 'g')), lambda x: x <> '') AS s FROM l),
w AS (SELECT doc_id, whole, list_distinct(list_transform(range(0, greatest(len(s), 1), 2), lambda i: array_to_string(s[i + 1 : i + 3], ' '))) AS w FROM p)
SELECT doc_id, len(list_filter(w, lambda x: length(x) >= 30 AND x <> whole)) AS n_windows FROM w""",
)
def chunk_subdivide(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .texts import docs

    return docs(spark, sf_dir).select("doc_id", F.size(subdivide(F.col("text"))).cast("long").alias("n_windows"))
