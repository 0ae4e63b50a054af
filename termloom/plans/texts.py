"""Text queries over whole documents: cleaning, chunking, windows, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import text as T
from ..storage import table

LEAD_WORDS = ("and", "or", "the", "of", "with", "und", "der", "die", "et", "le", "la", "y", "el")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))


def chunks(found: DataFrame, parts: Column) -> DataFrame:
    return found.select("doc_id", F.posexplode(parts).alias("chunk_idx", "chunk"))


_D = r"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents), n AS (SELECT doc_id, lang, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM d)"""
_STRIP = r"regexp_replace(x, '\A[ \t\n\r]+|[ \t\n\r]+\z', '', 'g')"


def _exploded(source: str, parts: str, cte: str = "") -> str:
    """DuckDB: strip parts, drop blank ones, number the rest from 0."""
    return f"""{_D}{cte}, p AS (SELECT doc_id, list_filter(list_transform({parts}, lambda x: {_STRIP}), lambda x: x <> '') AS parts FROM {source})
SELECT doc_id, CAST(i AS INTEGER) AS chunk_idx, parts[i + 1] AS chunk FROM (SELECT doc_id, parts, unnest(range(0, len(parts))) AS i FROM p)"""


_CLEAN = r"trim(regexp_replace(regexp_replace(text, '[ \t\n\r]*\n[ \t\n\r]*', ' ', 'g'), '[ \t\n\r]{2,}', ' ', 'g'))"


@register("txt_clean", f"{_D} SELECT doc_id, {_CLEAN} AS cleaned FROM d")
def txt_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.clean_spaces("text").alias("cleaned"))


@register("txt_paragraphs", _exploded("n", r"regexp_split_to_array(t, '\n[ \t]*\n+')"))
def txt_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(docs(spark, sf_dir), T.paragraphs("text"))


_ENDED = r""", l AS (SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '\A[ \t\n\r]+|[ \t\n\r]+\z', '', 'g')), lambda x: x <> ''),
  lambda x: CASE WHEN regexp_matches(x, '[.?!]\z') THEN x ELSE x || '.' END), ' ') AS t FROM n)"""


@register("txt_sentences", _exploded("l", r"regexp_extract_all(t, '[^.?!]+[.?!]')", _ENDED))
def txt_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(docs(spark, sf_dir), T.sentences("text"))


_PUNCT = (
    r", g AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\b("
    + "|".join(T.ABBREVIATIONS)
    + r")\.', '\1' || chr(1), 'g'), '([0-9])[.]([0-9])', '\1' || chr(1) || '\2', 'g'), '[.,:;?!][ \t\n\r]+', chr(2), 'g'), '[.,:;?!]+[ \t\n\r]*\z', '') AS t FROM d)"
)


@register("txt_punctuation", _exploded("g", "string_split(t, chr(2))", _PUNCT).replace("parts[i + 1] AS chunk", "replace(parts[i + 1], chr(1), '.') AS chunk"))
def txt_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(docs(spark, sf_dir), T.punctuation_chunks("text"))


def _conjunction_cte() -> str:
    """A mark follows every run of blanks; the mark before a conjunction becomes a cut. Neighbouring cuts share no sign."""
    case = []
    for lang, words in T.CONJUNCTIONS.items():
        listed = "|".join(sorted(words, key=lambda w: (-len(w), w)))
        case.append(rf"WHEN '{lang}' THEN regexp_replace(t, '\x02((?:{listed})[ \t\n\r])', chr(1) || '\1', 'gi')")
    cases = " ".join(case)
    return rf", k AS (SELECT doc_id, lang, regexp_replace(text, '([ \t\n\r]+)', '\1' || chr(2), 'g') AS t FROM d), g AS (SELECT doc_id, replace(CASE lang {cases} ELSE t END, chr(2), '') AS t FROM k)"


@register("txt_conjunction", _exploded("g", "string_split(t, chr(1))", _conjunction_cte()))
def txt_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by its own language's conjunctions."""
    rows = docs(spark, sf_dir)
    parts = F.coalesce(*[F.when(F.col("lang") == lang, T.conjunction_chunks("text", lang)) for lang in T.CONJUNCTIONS], T.non_blank(F.array("text")))
    return chunks(rows, parts)


@register(
    "txt_token_windows",
    _D
    + r""", w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '') AS w FROM d),
s AS (SELECT doc_id, w, CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 7 THEN [0] ELSE range(0, len(w) - 7 + 1, 3) END AS starts FROM w)
SELECT doc_id, CAST(list_position(starts, i) - 1 AS INTEGER) AS chunk_idx, array_to_string(w[i + 1 : i + 7], ' ') AS chunk FROM (SELECT doc_id, w, starts, unnest(starts) AS i FROM s)""",
)
def txt_token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # words are a column of their own, so that windows slice them and don't split the text again
    return chunks(docs(spark, sf_dir).select("doc_id", T.words("text").alias("words")), T.token_windows(F.col("words"), 7, 3))


_LISTED = "|".join(sorted(LEAD_WORDS, key=lambda w: (-len(w), w)))


def _edge_sql(x: str) -> str:
    for _ in range(3):
        x = rf"regexp_replace({x}, '\A[ \t\n\r.,:;!?()-]+|[ \t\n\r.,:;!?()-]+\z', '', 'g')"
        x = rf"regexp_replace({x}, '\A(?:{_LISTED})[ \t\n\r]+|[ \t\n\r]+(?:{_LISTED})\z', '', 'gi')"
    return f"trim({x})"


@register("txt_edge_clean", f"{_D} SELECT doc_id, {_edge_sql('text')} AS cleaned FROM d")
def txt_edge_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.edge_clean("text", LEAD_WORDS).alias("cleaned"))


@register(
    "txt_token_set",
    _D + r""", w AS (SELECT doc_id, unnest(regexp_extract_all(lower(regexp_replace(text, '[^\x00-\x7f]', ' ', 'g')), '[a-z0-9_]+')) AS w FROM d)
SELECT doc_id, count(DISTINCT CASE WHEN length(w) > 3 AND w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END) AS n_tokens FROM w GROUP BY doc_id""",
)
def txt_token_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    ascii_ = F.regexp_replace("text", r"[^\x00-\x7f]", " ")
    return docs(spark, sf_dir).select("doc_id", F.size(T.token_set(ascii_)).cast("long").alias("n_tokens")).filter("n_tokens > 0")


@register(
    "txt_normalize_id",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'HP:' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') WHEN p_partkey % 3 = 1 THEN 'HP:' || p_partkey ELSE 'MP:' || p_partkey END AS normalized,
CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE 'HP:' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') END AS canonical FROM part""",
)
def txt_normalize_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, kind = F.col("p_partkey").cast("string"), F.col("p_partkey") % 3
    raw = F.when(kind == 0, F.concat(F.lit("http://example.org/obo/HP_"), F.lpad(key, 7, "0"))).when(kind == 1, F.concat(F.lit("HP:"), key)).otherwise(F.concat(F.lit("MP:"), key))
    return table(spark, sf_dir, "part").select("p_partkey", T.normalize_term_id(raw).alias("normalized"), T.canonical_term_id(T.normalize_term_id(raw)).alias("canonical"))


@register(
    "txt_spans",
    f"""{_D}{_ENDED}, p AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_extract_all(t, '[^.?!]+[.?!]'), lambda x: {_STRIP}), lambda x: x <> '')) AS chunk FROM l),
f AS (SELECT p.doc_id, strpos(text, chunk) - 1 AS at_, length(chunk) AS n FROM p JOIN d USING (doc_id))
SELECT doc_id, count(*) AS n_found, sum(at_) AS sum_start, sum(at_ + n) AS sum_end FROM f WHERE at_ >= 0 GROUP BY doc_id""",
)
def txt_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence's first place in its text, in code points; those that cleaning changed have none. Per-row arrays, no join."""
    spans = F.filter(F.transform(T.sentences("text"), lambda s: F.struct(F.position(s, F.col("text")).alias("at"), F.length(s).alias("n"))), lambda p: p["at"] > 0)
    rows = docs(spark, sf_dir).select("doc_id", F.explode(spans).alias("s"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_found"), F.sum(F.col("s.at") - 1).alias("sum_start"), F.sum(F.col("s.at") - 1 + F.col("s.n")).alias("sum_end"))


def voronoi(spans: DataFrame) -> DataFrame:
    """Left and right boundary of each span of a document: midway to its neighbours, the text's ends at the edges."""
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    left = F.lag("end").over(order)
    right = F.lead("start").over(order)
    return spans.withColumns({
        "left": F.coalesce(F.floor((left + F.col("start")) / 2), F.lit(0)).cast("long"), "right": F.coalesce(F.floor((F.col("end") + right) / 2), F.col("n_chars")).cast("long"),
    })


@register(
    "txt_voronoi",
    """WITH s AS (SELECT l_orderkey AS doc_id, l_linenumber * 100 + l_partkey % 50 AS s, l_linenumber * 100 + l_partkey % 50 + 20 AS e FROM lineitem)
SELECT doc_id, s AS start, e AS "end", coalesce((lag(e) OVER w + s) // 2, 0) AS "left", coalesce((e + lead(s) OVER w) // 2, 1000) AS "right" FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY s, e)""",
)
def txt_voronoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_linenumber") * 100 + F.col("l_partkey") % 50
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), start.alias("start"), (start + 20).alias("end"), F.lit(1000).alias("n_chars"))
    return voronoi(rows).drop("n_chars")


_VOTES = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(v) for v in words)}))) AS {lang}" for lang, words in T.COMMON.items())
_BEST = f"greatest({', '.join(T.COMMON)})"


@register(
    "txt_language",
    _D
    + r", w AS (SELECT doc_id, lang, text, list_filter(string_split(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM d)"
    + f""", v AS (SELECT doc_id, lang, text, {_VOTES} FROM w)
SELECT doc_id, lang, CASE WHEN length(trim(text)) < 20 OR {_BEST} = 0 THEN 'en' {' '.join(f"WHEN {lang} = {_BEST} THEN '{lang}'" for lang in T.COMMON)} END AS detected FROM v""",
)
def txt_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language by common words; documents are known to be in four languages."""
    return docs(spark, sf_dir).select("doc_id", "lang", T.detect_language("text").alias("detected"))


@register(
    "group_small_chunks",
    """WITH w AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn AS first_turn, CASE WHEN nxt IS NULL THEN text ELSE text || chr(10) || nxt END AS grp FROM w WHERE nxt IS NOT NULL OR n = 1""",
)
def group_small_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding groups of two turns that overlap by one."""
    by = Window.partitionBy("conv_id")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lead("text").over(by.orderBy("turn")).alias("nxt"), F.count("*").over(by).alias("n"))
    rows = rows.filter(F.col("nxt").isNotNull() | (F.col("n") == 1))
    return rows.select("conv_id", F.col("turn").alias("first_turn"), F.concat_ws("\n", "text", "nxt").alias("grp"))
