"""Mapping phrases to candidate terms: routing, local matches, selection, deduplication of mentions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import text as T
from ..operators import phases, phrase_query
from ..storage import table
from .retrieval import knn_sql, neighbours

LOCAL_MATCH = 80.0


def local_match(phrase: Column, label: Column, threshold: float = LOCAL_MATCH) -> Column:
    """Priority of a candidate: 1 equal token sets, 2 equal texts, 3 contained as whole words, 4 similar tokens; null otherwise."""
    a, b = T.clean_phrase(phrase), T.clean_phrase(label)
    contained = (F.length(a) > 0) & F.concat(F.lit(" "), b, F.lit(" ")).contains(F.concat(F.lit(" "), a, F.lit(" ")))
    equal = F.sort_array(T.token_set(phrase)) == F.sort_array(T.token_set(label))
    return F.when(equal, 1).when(a == b, 2).when(contained, 3).when(T.token_sort_similarity(a, b) >= threshold, 4)


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, phrase, candidates by shared brand: a part's name without its first word against its brand's parts' names."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    return p.select(F.col("p_partkey").alias("item_id"), F.substring_index("p_name", " ", -1).alias("phrase"), "p_brand", "p_size")


@register(
    "map_local_match",
    r"""WITH p AS (SELECT p_partkey AS item_id, p_partkey % 6 AS kind, lower(p_name) || ' ' || lower(p_type) AS b, lower(p_type) || ' ' || lower(p_name) AS turned, lower(p_name) AS part FROM part),
w AS (SELECT *, CASE kind WHEN 0 THEN turned WHEN 1 THEN b WHEN 2 THEN part WHEN 3 THEN b || ' x' WHEN 4 THEN reverse(b) ELSE 'zz ' || reverse(part) END AS a FROM p),
t AS (SELECT item_id, a, b, list_sort(list_distinct(regexp_extract_all(a, '[a-z0-9_]+'))) AS ta, list_sort(list_distinct(regexp_extract_all(b, '[a-z0-9_]+'))) AS tb FROM w),
s AS (SELECT *, [CASE WHEN length(x) > 3 AND ends_with(x, 's') THEN left(x, -1) ELSE x END FOR x IN ta] AS sa, [CASE WHEN length(x) > 3 AND ends_with(x, 's') THEN left(x, -1) ELSE x END FOR x IN tb] AS sb,
array_to_string(list_sort(string_split(a, ' ')), ' ') AS oa, array_to_string(list_sort(string_split(b, ' ')), ' ') AS ob FROM t),
r AS (SELECT item_id, CASE WHEN list_sort(list_distinct(sa)) = list_sort(list_distinct(sb)) THEN 1 WHEN a = b THEN 2 WHEN contains(' ' || b || ' ', ' ' || a || ' ') THEN 3
WHEN 100.0::DOUBLE * (1 - levenshtein(oa, ob) / greatest(length(oa), length(ob))::DOUBLE) >= 80 THEN 4 END AS priority FROM s) SELECT item_id, priority FROM r WHERE priority IS NOT NULL""",
)
def map_local_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label's words turned around, the label itself, a part of it, nearly it, and two that are nothing like it."""
    kind, part, of = F.col("p_partkey") % 6, F.lower("p_name"), F.lower("p_type")
    label = F.concat_ws(" ", part, of)
    phrase = F.when(kind == 0, F.concat_ws(" ", of, part)).when(kind == 1, label).when(kind == 2, part).when(kind == 3, F.concat(label, F.lit(" x")))
    phrase = phrase.when(kind == 4, F.reverse(label)).otherwise(F.concat(F.lit("zz "), F.reverse(part)))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), phrase.alias("phrase"), label.alias("label"))
    return rows.select("item_id", local_match(F.col("phrase"), F.col("label")).alias("priority")).filter("priority IS NOT NULL")


@register(
    "map_select_candidates",
    f"""WITH {knn_sql(50)}, c AS (SELECT query_id AS item_id, rank, doc_id // 5 AS term, similarity AS score, doc_id % 7 = 0 AS overlap FROM r),
d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY item_id, term ORDER BY rank) = 1), p AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS place FROM d),
g AS (SELECT * FROM p WHERE overlap OR score >= 0.35 OR place <= 5 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY rank) <= 10) SELECT item_id, rank, term, score FROM g""",
)
def map_select_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of query vectors with floor 0.35, five to ten an item."""
    found = neighbours(spark, sf_dir, 50)
    rows = found.select(F.col("query_id").alias("item_id"), "rank", F.floor(F.col("doc_id") / 5).alias("term"), F.col("similarity").alias("score"), (F.col("doc_id") % 7 == 0).alias("overlap"))
    return phrase_query.select(rows, 0.35, 5, 10).drop("overlap")


def route(score: Column, runner_up: Column, length: Column) -> Column:
    """Resolved locally, to be mapped, or skipped."""
    return F.when(length < 3, "skipped").when((score >= 0.7) & (F.coalesce(runner_up, F.lit(0.0)) < score), "resolved").otherwise("unresolved")


@register(
    "map_routing",
    """SELECT CASE WHEN length(p_type) < 3 THEN 'skipped' WHEN p_size / 50.0::DOUBLE >= 0.7 AND (p_size % 7) / 7.0::DOUBLE < p_size / 50.0::DOUBLE THEN 'resolved' ELSE 'unresolved' END AS route, count(*) AS n FROM part GROUP BY 1""",
)
def map_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.groupBy(route(F.col("p_size") / 50.0, (F.col("p_size") % 7) / 7.0, F.length("p_type")).alias("route")).agg(F.count("*").alias("n"))


def deduplicate_terms(rows: DataFrame) -> DataFrame:
    """The first mention of each (case, term, assertion), with all mentions' evidence in order."""
    return rows.groupBy("case_id", "term", "assertion").agg(
        F.min("pos").alias("first_pos"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "evidence"))), lambda e: e["evidence"]).alias("evidence")
    )


@register(
    "dedup_terms",
    """SELECT l_orderkey AS case_id, l_suppkey % 4 AS term, l_returnflag AS assertion, min(l_linenumber) AS first_pos, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS evidence FROM lineitem GROUP BY 1, 2, 3""",
)
def dedup_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), (F.col("l_suppkey") % 4).alias("term"), F.col("l_returnflag").alias("assertion"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("evidence")
    )
    return deduplicate_terms(rows).withColumn("evidence", F.array_join(F.transform("evidence", lambda e: e.cast("string")), ","))


def merge_adjacent(rows: DataFrame, joins: Column) -> DataFrame:
    """Gaps and islands: rows that ``joins`` the one before them (by case and position) become one with it."""
    order = Window.partitionBy("case_id").orderBy("pos")
    rows = rows.withColumn("opens", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("opens").over(order))
    return rows.groupBy("case_id", "island").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"))


@register(
    "merge_chunk_rows",
    """WITH w AS (SELECT conv_id AS case_id, turn AS pos, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations WHERE text IS NOT NULL),
o AS (SELECT *, CASE WHEN prev IS NOT NULL AND (length(prev) < 80 OR regexp_matches(text, '^[0-9a-z]')) THEN 0 ELSE 1 END AS opens FROM w), i AS (SELECT *, sum(opens) OVER (PARTITION BY case_id ORDER BY pos) AS island FROM o)
SELECT case_id, min(pos) AS first_pos, count(*) AS n, string_agg(text, ' ' ORDER BY pos) AS text FROM i GROUP BY case_id, island""",
)
def merge_chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row joins the one before it when that one is a fragment or when it starts with a digit or a small letter."""
    rows = table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("pos"), "text")
    before = F.lag("text").over(Window.partitionBy("case_id").orderBy("pos"))
    return merge_adjacent(rows, before.isNotNull() & ((F.length(before) < 80) | F.col("text").rlike("^[0-9a-z]"))).drop("island")


def token_budget_groups(rows: DataFrame, budget: int) -> DataFrame:
    """Greedy groups of a case's chunks in order, none over the budget unless one chunk alone is."""
    state = F.struct(F.lit(0).alias("used"), F.lit(0).alias("grp"), F.array().cast("array<struct<pos:bigint,grp:int>>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        new = (acc["used"] > 0) & (acc["used"] + c["size"] > budget)
        grp = acc["grp"] + F.when(new, 1).otherwise(0)
        return F.struct(F.when(new, c["size"]).otherwise(acc["used"] + c["size"]).alias("used"), grp.alias("grp"), F.concat(acc["out"], F.array(F.struct(c["pos"].alias("pos"), grp.alias("grp")))).alias("out"))

    gathered = rows.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), F.col("size").cast("int").alias("size")))).alias("c"))
    return gathered.select("case_id", F.inline(F.aggregate("c", state, step)["out"]))


@register(
    "group_by_budget",
    """WITH RECURSIVE c AS (SELECT conv_id AS case_id, turn AS pos, length(coalesce(text, '')) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(coalesce(text, ''))) AS n FROM conversations),
f(case_id, pos, n, used, grp) AS (SELECT case_id, pos, n, size, 0 FROM c WHERE n = 1 UNION ALL
SELECT c.case_id, c.pos, c.n, CASE WHEN f.used > 0 AND f.used + c.size > 600 THEN c.size ELSE f.used + c.size END, f.grp + CASE WHEN f.used > 0 AND f.used + c.size > 600 THEN 1 ELSE 0 END
FROM f JOIN c ON c.case_id = f.case_id AND c.n = f.n + 1) SELECT case_id, pos, grp FROM f""",
)
def group_by_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations in groups of 600 characters; tests hold the fold against plain Python."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("pos"), F.length(F.coalesce("text", F.lit(""))).alias("size"))
    return token_budget_groups(rows, 600)


# --- both phases over a corpus: recorded answers stand for a served model ---


def _recorded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """An extractor that reads phrases parted by semicolons; a prompt of more than two is one that its answer's JSON breaks off."""
    for frame in batches:
        rows = []
        for doc_id, grp, prompt in frame[["doc_id", "grp", "prompt"]].itertuples(index=False):
            phrases = [p for p in prompt.split(";") if p]
            if len(phrases) > 2:
                rows.append((doc_id, grp, None, None, None, None, "unterminated JSON"))
            rows += [(doc_id, grp, p, "abnormal", "negated" if doc_id % 3 == 0 else "affirmed", prompt, None) for p in phrases if len(phrases) <= 2]
        yield pd.DataFrame(rows, columns=["doc_id", "grp", "phrase", "category", "assertion", "evidence", "error"])


def _halves(open_: DataFrame, mode: str) -> DataFrame:
    """Groups of two phrases, then of one: what a smaller mode sends again."""
    size = 2 if mode == "grouped_large" else 1
    phrases = F.split("prompt", ";")
    starts = F.sequence(F.lit(0), F.size(phrases) - 1, F.lit(size))
    cut = open_.select("doc_id", F.posexplode(F.transform(starts, lambda s: F.array_join(F.slice(phrases, s + 1, size), ";"))).alias("n", "prompt"))
    return cut.select("doc_id", (F.col("n") + 100).cast("int").alias("grp"), "prompt")


_LABEL_WORDS = "list_sort(list_distinct(list_transform(regexp_extract_all(lower({0}), '[a-z0-9_]+'), lambda x: CASE WHEN length(x) > 3 AND ends_with(x, 's') THEN left(x, -1) ELSE x END)))"
_SAME = f"{_LABEL_WORDS.format('phrase')} = {_LABEL_WORDS.format('label')}"


@register(
    "map_two_phases",
    f"""WITH t AS (SELECT min(p_partkey) AS term, p_name AS label FROM part GROUP BY p_name),
m AS (SELECT DISTINCT l_orderkey AS doc_id, CASE WHEN l_partkey % 4 = 0 THEN string_split(p_name, ' ')[2] || ' ' || string_split(p_name, ' ')[1] WHEN l_partkey % 4 = 1 THEN string_split(p_name, ' ')[2] || ' zz' ELSE p_name END AS phrase FROM lineitem JOIN part ON p_partkey = l_partkey),
i AS (SELECT doc_id, phrase, CASE WHEN doc_id % 3 = 0 THEN 'negated' ELSE 'affirmed' END AS assertion FROM m),
c AS (SELECT i.phrase, t.term, t.label, {_SAME} AS same, len(list_intersect({_LABEL_WORDS.format('phrase')}, {_LABEL_WORDS.format('label')})) / 2.0::DOUBLE AS score FROM (SELECT DISTINCT phrase FROM i) i JOIN t ON len(list_intersect({_LABEL_WORDS.format('phrase')}, {_LABEL_WORDS.format('label')})) > 0),
p AS (SELECT *, CASE WHEN same THEN 1 WHEN phrase = label THEN 2 WHEN contains(' ' || label || ' ', ' ' || phrase || ' ') THEN 3
  WHEN 100.0::DOUBLE * (1 - levenshtein(array_to_string(list_sort(string_split(phrase, ' ')), ' '), array_to_string(list_sort(string_split(label, ' ')), ' ')) / greatest(length(phrase), length(label))::DOUBLE) >= {LOCAL_MATCH} THEN 4 END AS local FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY local NULLS LAST, score DESC, term) AS n FROM p)
SELECT doc_id, term, assertion, phrase, CASE WHEN local IS NOT NULL THEN 'local' WHEN score >= 0.7 THEN 'score' ELSE 'mapped' END AS method FROM i JOIN r USING (phrase) WHERE n = 1""",
)
def map_two_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents and their parts' names, some turned around or half unknown, as phrases: long prompts fail and go again in
    smaller groups; candidates share a word; what neither matches locally nor is sure goes to a mapper that takes the first."""
    part = table(spark, sf_dir, "part")
    words, k = F.split("p_name", " "), F.col("l_partkey") % 4
    phrase = F.when(k == 0, F.concat_ws(" ", words[1], words[0])).when(k == 1, F.concat(words[1], F.lit(" zz"))).otherwise(F.col("p_name"))
    lines = table(spark, sf_dir, "lineitem").join(part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    groups = lines.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.sort_array(F.collect_set(phrase)), ";").alias("prompt")).withColumn("grp", F.lit(0))
    terms = part.groupBy(F.col("p_name").alias("label")).agg(F.min("p_partkey").alias("term"))

    def retrieve(asked: DataFrame) -> DataFrame:
        """Terms that share a word, by one join on words; the score is the share of a label's two words."""
        of = lambda rows, c: rows.select("*", F.explode(T.token_set(c)).alias("word"))
        return of(asked, "phrase").join(of(terms, "label"), "word").groupBy("phrase", "term", "label").agg((F.count("*") / F.lit(2.0)).alias("score"))

    found = phases.run(groups, _recorded, retrieve, phases.first_offer, regroup=_halves)
    return found.select("doc_id", "term", "assertion", "phrase", "method")


@register(
    "mention_experiencer",
    """WITH c AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Family/History' WHEN 1 THEN ' Other ' WHEN 2 THEN 'General' ELSE role END AS category FROM conversations),
n AS (SELECT *, regexp_replace(lower(trim(category)), '[ /_-]+', '_', 'g') AS c FROM c)
SELECT conv_id, turn, CASE WHEN c = 'family_history' THEN 'family_history' WHEN c IN ('other', 'unrelated', 'general') THEN 'other' ELSE 'proband' END AS experiencer FROM n""",
)
def mention_experiencer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whom a mention is about, by its category; turns' roles and three spellings of categories stand for them."""
    kind = F.col("turn") % 4
    category = F.when(kind == 0, "Family/History").when(kind == 1, " Other ").when(kind == 2, "General").otherwise(F.col("role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", phases.experiencer(category).alias("experiencer"))
