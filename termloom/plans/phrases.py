"""Texts to ranked terms in one plan: queries by sentence, candidates by variants, chunks that are split until they gain.

In the test tables parts are the terms, encoded by hashed words, and turns of conversations the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import text as T
from ..operators import phrase_query
from ..sources.index import DIMENSIONS, hashed_embedding
from ..storage import checkpointed, table
from .extraction import Adaptive, adaptive_rechunk

TOP, LEAST = 5, 0.35
FLOOR, FEWEST, MOST = 0.6, 2, 6
CONFIG = Adaptive(poor=0.55, margin=0.03, gain=0.02, rounds=2, least_chars=30, sentences=3, overlap=1)


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), hashed_embedding(F.col("p_name")).alias("embedding"))
    return checkpointed(rows)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")


def embedded_sql(name: str, source: str) -> str:
    """CTE ``name`` (text, e) of the texts of ``source``: hashed words, of unit length, as four-byte floats."""
    return f"""{name}_c AS (SELECT DISTINCT text, list_transform(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: ('0x' || substr(md5(w), 1, 8))::UBIGINT % {DIMENSIONS}) AS cells FROM {source}),
{name}_n AS (SELECT text, list_transform(range(0, {DIMENSIONS}), lambda i: len(list_filter(cells, lambda c: c = i))::DOUBLE) AS n FROM {name}_c),
{name} AS MATERIALIZED (SELECT text, list_transform(n, lambda x: CASE WHEN list_sum(n) > 0 THEN CAST(CAST(x / sqrt(list_inner_product(n, n)) AS FLOAT) AS DOUBLE) ELSE 0.0 END) AS e FROM {name}_n)"""


def ranked_sql(name: str, vectors: str, k: int) -> str:
    """CTE ``name`` (text, term, label, similarity, rank) of the k nearest parts of each text of ``vectors``."""
    return f"""{name}_s AS (SELECT v.text, p_partkey AS term, p_name AS label, CASE WHEN list_sum(v.e) = 0 OR list_sum(t.e) = 0 THEN 0.0 ELSE round(greatest(0.0, least(1.0, list_cosine_similarity(v.e, t.e))), 6) END AS similarity
  FROM {vectors} v, part JOIN terms t ON t.text = p_name),
{name} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY text ORDER BY similarity DESC, term) AS rank FROM {name}_s QUALIFY rank <= {k})"""


_STRIP = r"regexp_replace(x, '\A[ \t\n\r]+|[ \t\n\r]+\z', '', 'g')"


def sentences_sql(text: str) -> str:
    lines = f"list_filter(list_transform(string_split(replace(replace({text}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: {_STRIP}), lambda x: x <> '')"
    ended = rf"array_to_string(list_transform({lines}, lambda x: CASE WHEN regexp_matches(x, '[.?!]\z') THEN x ELSE x || '.' END), ' ')"
    return f"list_filter(list_transform(regexp_extract_all({ended}, '[^.?!]+[.?!]'), lambda x: {_STRIP}), lambda x: x <> '')"


_TERMS = embedded_sql("terms", "(SELECT p_name AS text FROM part)")


@register(
    "process_query",
    f"""WITH {_TERMS}, b AS (SELECT conv_id * 1000 + turn AS item_id, coalesce(text, '') AS text, {sentences_sql("coalesce(text, '')")} AS parts FROM conversations),
q AS (SELECT item_id AS query_id, i AS sentence, parts[i + 1] AS text FROM (SELECT *, unnest(range(0, len(parts))) AS i FROM b)), {embedded_sql("qv", "q")}, {ranked_sql("qr", "qv", 2 * TOP)},
f AS (SELECT query_id, sentence, text, term, similarity, rank FROM q JOIN qr USING (text) WHERE similarity >= {LEAST} AND rank <= {TOP}),
w AS (SELECT item_id AS query_id, -1 AS sentence, text FROM b WHERE item_id NOT IN (SELECT query_id FROM f)), {embedded_sql("wv", "w")}, {ranked_sql("wr", "wv", TOP)},
u AS (SELECT * FROM f UNION ALL SELECT query_id, sentence, text, term, similarity, rank FROM w JOIN wr USING (text) WHERE similarity >= {LEAST})
SELECT query_id, CAST(sentence AS INTEGER) AS sentence, term, p_name AS label, similarity, rank FROM u JOIN part ON p_partkey = term""",
)
def process_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by sentence, whole where no sentence finds a part, with the parts' names."""
    found = phrase_query.process(texts(spark, sf_dir), terms(spark, sf_dir), TOP, LEAST)
    labels = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("term"), F.col("p_name").alias("label"))
    return found.join(labels, "term").select("query_id", "sentence", "term", "label", "similarity", "rank")


@register(
    "map_variant_candidates",
    rf"""WITH {_TERMS}, i AS (SELECT conv_id * 1000 + turn AS item_id, array_to_string(string_split(coalesce(text, ''), ' ')[1:2], ' ') || CASE WHEN turn % 3 = 0 THEN ' ' || turn || ' mm' ELSE '' END AS phrase, role AS category FROM conversations),
k AS (SELECT *, trim(regexp_replace(lower(regexp_replace(regexp_replace(phrase, '[(][^)]*[)]', ' ', 'g'), '[_-]', ' ', 'g')), '[ \t\n\r]+', ' ', 'g')) AS key FROM i),
g AS (SELECT key, category, trim(regexp_replace(regexp_replace(min(phrase), '[ \t\n\r]*\n[ \t\n\r]*', ' ', 'g'), '[ \t\n\r]{{2,}}', ' ', 'g')) AS phrase FROM k GROUP BY ALL),
v AS (SELECT key, category, 0 AS n, phrase AS text FROM g UNION ALL SELECT key, category, 1, trim(regexp_replace(phrase, '[ ]*[0-9]+([.,][0-9]+)?[ ]*(mg|kg|g|cm|mm|m|ml|l|%)?\z', '')) FROM g),
a AS (SELECT key, category, min(n) AS n, text FROM v WHERE text <> '' GROUP BY ALL), {embedded_sql("av", "a")}, {ranked_sql("ar", "av", 20)},
s AS (SELECT text, term, similarity, rank, len(list_intersect([CASE WHEN length(x) > 3 AND ends_with(x, 's') THEN left(x, -1) ELSE x END FOR x IN regexp_extract_all(lower(text), '[a-z0-9_]+')], [CASE WHEN length(x) > 3 AND ends_with(x, 's') THEN left(x, -1) ELSE x END FOR x IN regexp_extract_all(lower(label), '[a-z0-9_]+')])) > 0 AS overlap FROM ar),
o AS (SELECT * FROM s WHERE overlap OR similarity >= {FLOOR} OR rank <= {FEWEST} QUALIFY row_number() OVER (PARTITION BY text ORDER BY rank) <= {MOST}),
m AS (SELECT key, category, term, max(similarity) AS score, arg_max(text, (similarity, -n)) AS variant FROM a JOIN o USING (text) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY key, category ORDER BY score DESC, term) AS rank FROM m QUALIFY rank <= {MOST})
SELECT item_id, term, score, variant, rank FROM k JOIN r USING (key, category)""",
)
def map_variant_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two words of turns, some with a measure, as phrases: retrieved with and without it, once for all items that ask for the same."""
    parts, measure = table(spark, sf_dir, "part"), F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" "), F.col("turn").cast("string"), F.lit(" mm"))).otherwise("")
    phrase = F.concat(F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), " "), 1, 2), " "), measure)
    items = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), phrase.alias("phrase"), F.col("role").alias("category"))
    labels = parts.select(F.col("p_partkey").alias("term"), F.col("p_name").alias("label"))
    known = terms(spark, sf_dir)

    def retrieve(phrases: DataFrame) -> DataFrame:
        return phrase_query.nearest_terms(phrases, known, 20).join(labels, "term")

    return phrase_query.by_variants(items, T.query_variants, retrieve, FLOOR, FEWEST, MOST)


def _round_sql(n: int) -> str:
    """One round over o{n-1} (open chunks) and c{n-1} (all): o{n} are the children that were taken in, c{n} all chunks after it."""
    o, c = f"o{n - 1}", f"c{n - 1}"
    step = CONFIG.sentences - CONFIG.overlap
    return rf"""{embedded_sql(f"ov{n}", o)}, {ranked_sql(f"or{n}", f"ov{n}", 2)},
q{n} AS (SELECT text, max(similarity) FILTER (rank = 1) AS top1, max(similarity) FILTER (rank = 2) AS top2 FROM or{n} GROUP BY text),
p{n} AS (SELECT doc_id, chunk_id, text, top1 FROM {o} LEFT JOIN q{n} USING (text) WHERE top1 IS NULL OR (top1 < {CONFIG.poor} AND (top2 IS NULL OR round(top1 - top2, 9) < {CONFIG.margin}))),
x{n} AS (SELECT doc_id, chunk_id AS parent, text AS whole, {sentences_sql("text")} AS s FROM p{n}),
y{n} AS (SELECT doc_id, parent, trim(regexp_replace(regexp_replace(whole, '[ \t\n\r]*\n[ \t\n\r]*', ' ', 'g'), '[ \t\n\r]{{2,}}', ' ', 'g')) AS whole,
  list_transform(range(0, greatest(len(s), 1), {step}), lambda i: array_to_string(s[i + 1 : i + {CONFIG.sentences}], ' ')) AS w FROM x{n}),
z{n} AS (SELECT doc_id, parent, list_filter(list_filter(w, lambda t, i: list_position(w, t) = i), lambda t: length(t) >= {CONFIG.least_chars} AND t <> whole) AS w FROM y{n}),
k{n} AS (SELECT doc_id, parent, parent || '.' || i AS chunk_id, w[i + 1] AS text FROM (SELECT *, unnest(range(0, len(w))) AS i FROM z{n})), {embedded_sql(f"kv{n}", f"k{n}")}, {ranked_sql(f"kr{n}", f"kv{n}", 2)},
g{n} AS (SELECT k.doc_id, k.parent FROM k{n} k JOIN kr{n} USING (text) JOIN p{n} p ON p.doc_id = k.doc_id AND p.chunk_id = k.parent GROUP BY ALL HAVING round(max(similarity) - any_value(coalesce(top1, 0.0)), 9) >= {CONFIG.gain}),
o{n} AS (SELECT doc_id, chunk_id, text FROM k{n} SEMI JOIN g{n} USING (doc_id, parent)),
c{n} AS (SELECT * FROM {c} ANTI JOIN (SELECT doc_id, parent AS chunk_id FROM g{n}) USING (doc_id, chunk_id) UNION ALL SELECT * FROM o{n})"""


@register(
    "adaptive_rechunk",
    f"WITH {_TERMS}, o0 AS (SELECT conv_id * 1000 + turn AS doc_id, '0' AS chunk_id, coalesce(text, '') AS text FROM conversations), c0 AS (SELECT * FROM o0), {_round_sql(1)}, {_round_sql(2)} SELECT doc_id, chunk_id, text FROM c2",
)
def q_adaptive_rechunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as chunks: the poor ones are split, retrieved anew, and stay split where that gains, twice over."""
    known = terms(spark, sf_dir)

    def retrieve(chunks: DataFrame) -> DataFrame:
        return chunks.join(phrase_query.nearest_terms(chunks, known, 2), "text").select("doc_id", "chunk_id", F.col("similarity").alias("score"))

    chunks = texts(spark, sf_dir).select(F.col("query_id").alias("doc_id"), F.lit("0").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"))
    return adaptive_rechunk(chunks, retrieve, CONFIG)
