"""Assertion queries on the sentences of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import assertions as A
from ..functions import text as T
from ..operators.attribution import places_of
from ..storage import table
from .texts import _D, _ENDED, _STRIP


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    # sentences are spaced inside the generator: filters above see a plain column and don't repeat the work
    return rows.select("doc_id", "lang", F.posexplode(F.transform(T.sentences("text"), A.spaced)).alias("chunk_idx", "spaced"))


_SENTENCES = f"""{_D}{_ENDED}, p AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(t, '[^.?!]+[.?!]'), lambda x: {_STRIP}), lambda x: x <> '') AS parts FROM l),
c AS (SELECT p.doc_id, d.lang, CAST(i AS INTEGER) AS chunk_idx, ' ' || regexp_replace(lower(parts[i + 1]), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ' AS s FROM (SELECT doc_id, parts, unnest(range(0, len(parts))) AS i FROM p) p JOIN d USING (doc_id))"""


def _case(make) -> str:
    return "CASE lang " + " ".join(f"WHEN '{x}' THEN {make(x)}" for x in A.FORWARD) + f" ELSE {make('en')} END"


def _pseudo(lang: str) -> str:
    s = "s"
    for p in A.PSEUDO.get(lang, ()):
        s = f"replace({s}, ' {p} ', ' ' || chr(1) || ' ')"
    return s


def _scopes_sql(lang: str) -> str:
    """Scopes of the cues of a language, blank ones as null."""
    parts = []
    for cue in sorted(A.FORWARD[lang], key=lambda c: (-len(c), c)):
        rest = f"substr(q, strpos(q, ' {cue} ') + {len(cue) + 2})"
        for t in A.TERMINATE.get(lang, ()):
            rest = f"split_part(' ' || {rest}, ' {t} ', 1)"
        words = f"array_to_string(list_filter(string_split(trim({rest}), ' '), lambda w: w <> '')[1:{A.SCOPE_WORDS}], ' ')"
        parts.append(f"CASE WHEN strpos(q, ' {cue} ') > 0 THEN nullif({words}, '') END")
    return "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"


_SCOPED = f"""{_SENTENCES}, q AS MATERIALIZED (SELECT doc_id, lang, chunk_idx, s, {_case(_pseudo)} AS q FROM c),
r AS MATERIALIZED (SELECT doc_id, lang, chunk_idx, {_case(_scopes_sql)} AS scopes, {_case(lambda x: "(" + " OR ".join(f"strpos(s, ' {c} ') > 0" for c in A.NORMAL[x]) + ")")} AS normal FROM q)"""


@register("txt_negation_keyword", f"{_SCOPED} SELECT doc_id, chunk_idx, array_to_string(scopes, '|') AS scopes FROM r WHERE len(scopes) > 0")
def txt_negation_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with negated scopes; each document by its language's cues."""
    scopes = A.by_language(F.col("lang"), lambda x: A.negated_scopes(F.col("spaced"), x))
    rows = sentences(spark, sf_dir).select("doc_id", "chunk_idx", scopes.alias("s"))
    return rows.filter(F.size("s") > 0).select("doc_id", "chunk_idx", F.array_join("s", "|").alias("scopes"))


@register("txt_normality", f"{_SENTENCES} SELECT doc_id, count(*) AS n_sentences, count(*) FILTER ({_case(lambda x: '(' + ' OR '.join(f"strpos(s, ' {c} ') > 0" for c in A.NORMAL[x]) + ')')}) AS n_normal FROM c GROUP BY doc_id")
def txt_normality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sentences, and how many of them have a cue of normality of its language."""
    normal = A.by_language(F.col("lang"), lambda x: A.is_normal(F.col("spaced"), x))
    return sentences(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.count_if(normal).alias("n_normal"))


@register(
    "assertion_status_counts",
    f"{_SCOPED} SELECT lang, CASE WHEN len(scopes) > 0 THEN 'negated' WHEN normal THEN 'normal' ELSE 'affirmed' END AS status, count(*) AS n FROM r GROUP BY ALL",
)
def assertion_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = A.by_language(F.col("lang"), lambda x: A.status(F.col("spaced"), x))
    return sentences(spark, sf_dir).groupBy("lang", status.alias("status")).agg(F.count("*").alias("n"))


@register(
    "canonical_assertion",
    """SELECT l_returnflag, l_linestatus, CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'affirmed' WHEN 'NF' THEN 'negated' WHEN 'NO' THEN 'normal' ELSE 'uncertain' END AS status,
l_returnflag = 'N' AS excluded, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def canonical_assertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings per flag: present, ABSENT, Unremarkable, possible."""
    key = F.concat("l_returnflag", "l_linestatus")
    raw = F.when(key == "AF", " Present").when(key == "NF", "ABSENT").when(key == "NO", "Unremarkable").otherwise("possible")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return rows.select("l_returnflag", "l_linestatus", A.canonical(raw).alias("status"), A.excluded(raw).alias("excluded"), "n")


# --- attribution: which words of a chunk a term stands on ---


@register(
    "txt_attribution",
    r"""WITH b AS (SELECT item_id, regexp_replace(lower(trim(array_to_string(string_split(text, ' ')[1:3], ' '))), '[^a-z ]', '', 'g') AS label FROM benchmark), u AS (SELECT label, min(item_id) AS item_id FROM b WHERE length(label) >= 8 GROUP BY label),
d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents) SELECT doc_id, item_id, strpos(t, label) - 1 AS start, strpos(t, label) - 1 + length(label) AS "end" FROM d JOIN u ON strpos(t, label) > 0""",
)
def txt_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First place of each label in each document, any case; documents aren't shuffled.

    The labels are terms (the openings of the benchmark's passages); blocks of them travel to the texts.
    """
    label = F.regexp_replace(F.lower(F.trim(F.array_join(F.slice(F.split("text", " "), 1, 3), " "))), "[^a-z ]", "")
    terms = table(spark, sf_dir, "benchmark").select("item_id", label.alias("label")).filter(F.length("label") >= 8).groupBy("label").agg(F.min("item_id").alias("item_id"))
    return places_of(table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text")), terms)
