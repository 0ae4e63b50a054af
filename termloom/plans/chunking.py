"""The staged chunking pipeline: semantic splits, merging of negations, cleaning, chunk variants around annotations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import text as T
from ..sources.index import hashed_embedding
from ..storage import table

#: Words that alone make no chunk, and words that begin a negation (fixed values).
LOW_VALUE = ("and", "or", "the", "a", "an", "of", "in", "und", "der", "die", "das", "et", "le", "la", "y", "el", "de")
NEGATIONS = ("no", "not", "without", "kein", "keine", "nicht", "ohne", "pas", "sans", "sin", "geen", "niet")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once for use in many places of an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def semantic_split(chunk: Column, size: int = 5, threshold: float = 0.2, least: int = 2, embed=hashed_embedding) -> Column:
    """Cut a chunk where the windows of ``size`` words before and after a place are less alike than ``threshold``.

    Places lie ``size`` words apart. A piece of under ``least`` words joins the piece before it.
    """

    def split(words: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(words) / size).cast("int") - 1, F.lit(0))), lambda i: F.slice(words, i * size + 1, size))
        vectors = F.transform(blocks, lambda b: F.struct(F.array_join(b, " ").alias("t"), F.size(b).alias("n"), embed(F.array_join(b, " "), 16).alias("v")))
        start = F.array().cast("array<struct<t:string,n:int,v:array<float>>>")

        def step(acc: Column, b: Column) -> Column:
            last = F.try_element_at(acc, F.lit(-1))
            cosine = F.aggregate(F.zip_with(last["v"], b["v"], lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
            joins = last.isNotNull() & ((cosine >= threshold) | (b["n"] < least))
            merged = F.struct(F.concat(last["t"], F.lit(" "), b["t"]).alias("t"), (last["n"] + b["n"]).alias("n"), b["v"].alias("v"))
            return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(merged))).otherwise(F.concat(acc, F.array(b)))

        return F.transform(F.aggregate(vectors, start, step), lambda p: p["t"])

    return _let(T.words(chunk), lambda w: F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(split(w)))


def merge_negations(parts: Column, most: int = 5) -> Column:
    """A part that ends in a negation takes the part after it, if that has at most ``most`` words."""
    listed = "|".join(NEGATIONS)
    negated = lambda part: F.coalesce(part.rlike(rf"(?i)(?:\A|[ \t\n\r])(?:{listed})\z"), F.lit(False))

    def step(acc: Column, part: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joins = negated(last) & (F.size(T.words(part)) <= most)
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last, F.lit(" "), part)))).otherwise(F.concat(acc, F.array(part)))

    # the fold copies what it has for every part; parts of which none ends in a negation stay as they are
    return _let(parts, lambda p: F.when(F.exists(p, negated), F.aggregate(p, F.array().cast("array<string>"), step)).otherwise(p))


def clean_chunks(parts: Column, least: int = 2) -> Column:
    """Cleaned edges; chunks that are too short, or of one or two low-value words only, go."""
    cleaned = F.transform(parts, lambda p: T.edge_clean(p, LOW_VALUE, 2))
    low = lambda p: (F.size(T.words(p)) <= 2) & F.forall(T.words(F.lower(p)), lambda w: w.isin(*LOW_VALUE))
    return F.filter(cleaned, lambda p: (F.length(p) >= least) & ~low(p))


@dataclass(frozen=True)
class Stage:
    """A step of a chunking pipeline; unknown kinds are an error when the pipeline is built."""

    kind: str
    lang: str = "en"
    size: int = 5
    threshold: float = 0.2
    least: int = 2


DEFAULT = (Stage("paragraph"), Stage("sentence"), Stage("punctuation"), Stage("conjunction"), Stage("negation"), Stage("cleaner"))


def override(stages: tuple[Stage, ...], **changes) -> tuple[Stage, ...]:
    """The stages with the semantic ones' parameters changed."""
    return tuple(replace(s, **changes) if s.kind == "semantic" else s for s in stages)


def build(stages: tuple[Stage, ...] = DEFAULT) -> Callable[[Column], Column]:
    """One expression for all stages: text in, array of chunks out; no stage shuffles."""
    split = {
        "noop": lambda s: T.noop_chunks, "paragraph": lambda s: T.paragraphs, "sentence": lambda s: T.sentences, "punctuation": lambda s: T.punctuation_chunks,
        "conjunction": lambda s: lambda c: T.conjunction_chunks(c, s.lang), "semantic": lambda s: lambda c: semantic_split(c, s.size, s.threshold, s.least),
    }
    whole = {"negation": lambda s: merge_negations, "cleaner": lambda s: lambda parts: clean_chunks(parts, s.least)}
    for s in stages:
        if s.kind not in split and s.kind not in whole:
            raise ValueError(f"unknown stage {s.kind}")

    def run(text: Column) -> Column:
        parts = F.array(text)
        for s in stages:
            parts = F.flatten(F.transform(parts, split[s.kind](s))) if s.kind in split else whole[s.kind](s)(parts)
        return parts

    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


_B = r"[ \t\n\r]"
_STRIP = rf"regexp_replace(x, '\A{_B}+|{_B}+\z', '', 'g')"


def _parts_sql(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda x: {_STRIP}), lambda x: x <> '')"


def _pipeline_sql() -> str:
    """The default stages in DuckDB; a negation joins what follows by islands, as the end of what was joined is its last part's."""
    words = "|".join(sorted(T.CONJUNCTIONS["en"], key=lambda w: (-len(w), w)))
    low = "|".join(sorted(LOW_VALUE, key=lambda w: (-len(w), w)))
    ends = "replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    lines = f"list_filter(list_transform(string_split(y, chr(10)), lambda x: {_STRIP}), lambda x: x <> '')"
    ended = rf"array_to_string(list_transform({lines}, lambda x: CASE WHEN regexp_matches(x, '[.?!]\z') THEN x ELSE x || '.' END), ' ')"
    guarded = rf"regexp_replace(regexp_replace(y, '\b({'|'.join(T.ABBREVIATIONS)})\.', '\1' || chr(1), 'g'), '([0-9])[.]([0-9])', '\1' || chr(1) || '\2', 'g')"
    pieces = rf"string_split(regexp_replace(regexp_replace({guarded}, '[.,:;?!]{_B}+', chr(2), 'g'), '[.,:;?!]+{_B}*\z', ''), chr(2))"
    cut = rf"string_split(replace(regexp_replace(regexp_replace(y, '({_B}+)', '\1' || chr(2), 'g'), '\x02((?:{words}){_B})', chr(1) || '\1', 'gi'), chr(2), ''), chr(1))"
    each = lambda parts, split: f"flatten(list_transform({parts}, lambda y: {split}))"
    clean = "c"
    for _ in range(2):
        clean = rf"regexp_replace({clean}, '\A[ \t\n\r.,:;!?()-]+|[ \t\n\r.,:;!?()-]+\z', '', 'g')"
        clean = rf"regexp_replace({clean}, '(?i)\A(?:{low}){_B}+|{_B}+(?:{low})\z', '', 'g')"
    listed = ", ".join(f"'{w}'" for w in LOW_VALUE)
    split = rf"list_filter(string_split_regex(c, '{_B}+'), lambda w: w <> '')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
p1 AS (SELECT r, doc_id, {_parts_sql(rf"regexp_split_to_array({ends}, '\n[ \t]*\n+')")} AS a FROM d),
p2 AS (SELECT r, doc_id, {each('a', _parts_sql(f"regexp_extract_all({ended}, '[^.?!]+[.?!]')"))} AS a FROM p1),
p3 AS (SELECT r, doc_id, {each('a', f"list_transform({_parts_sql(pieces)}, lambda x: replace(x, chr(1), '.'))")} AS a FROM p2),
p4 AS (SELECT r, doc_id, {each('a', _parts_sql(cut))} AS a FROM p3),
u AS (SELECT r, doc_id, i, a[i] AS c, CASE WHEN i > 1 THEN a[i - 1] END AS before FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM p4)),
o AS (SELECT *, CASE WHEN regexp_matches(before, '(?i)(?:\\A|{_B})(?:{'|'.join(NEGATIONS)})\\z') AND len({split}) <= 5 THEN 0 ELSE 1 END AS opens FROM u),
g AS (SELECT *, sum(opens) OVER (PARTITION BY r ORDER BY i) AS island FROM o),
m AS (SELECT r, doc_id, island, string_agg(c, ' ' ORDER BY i) AS c FROM g GROUP BY ALL),
e AS (SELECT r, doc_id, island, trim({clean}) AS c FROM m),
k AS (SELECT *, {split} AS w FROM e),
f AS (SELECT * FROM k WHERE length(c) >= 2 AND NOT (len(w) <= 2 AND len(list_filter(w, lambda x: lower(x) NOT IN ({listed}))) = 0))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY r ORDER BY island) - 1 AS INTEGER) AS chunk_idx, c AS chunk FROM f"""


@register("txt_pipeline", _pipeline_sql())
def txt_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All default stages."""
    return documents(spark, sf_dir).select("doc_id", F.posexplode(build()(F.col("text"))).alias("chunk_idx", "chunk"))


@register(
    "txt_semantic_split",
    rf"""WITH d AS (SELECT row_number() OVER () AS r, conv_id, turn, list_filter(string_split_regex(coalesce(text, ''), '{_B}+'), lambda w: w <> '') AS w FROM conversations),
b AS (SELECT r, conv_id, turn, i, array_to_string(w[i * 5 + 1 : i * 5 + 5], ' ') AS t, len(w[i * 5 + 1 : i * 5 + 5]) AS n FROM (SELECT *, unnest(range(0, CAST(ceil(len(w) / 5.0) AS BIGINT))) AS i FROM d)),
c AS (SELECT *, list_transform(list_filter(regexp_split_to_array(lower(t), '[^a-z0-9]+'), lambda x: x <> ''), lambda x: ('0x' || substr(md5(x), 1, 8))::UBIGINT % 16) AS cells FROM b),
h AS (SELECT * EXCLUDE (cells), list_transform(range(0, 16), lambda k: len(list_filter(cells, lambda x: x = k))::DOUBLE) AS h FROM c),
v AS (SELECT * EXCLUDE (h), list_transform(h, lambda x: CASE WHEN list_sum(h) > 0 THEN CAST(CAST(x / sqrt(list_inner_product(h, h)) AS FLOAT) AS DOUBLE) ELSE 0.0 END) AS v FROM h),
l AS (SELECT *, lag(v) OVER (PARTITION BY r ORDER BY i) AS before FROM v),
o AS (SELECT *, CASE WHEN before IS NOT NULL AND (list_inner_product(before, v) >= 0.2 OR n < 2) THEN 0 ELSE 1 END AS opens FROM l),
g AS (SELECT *, sum(opens) OVER (PARTITION BY r ORDER BY i) AS island FROM o)
SELECT conv_id, turn, CAST(island - 1 AS INTEGER) AS chunk_idx, string_agg(t, ' ' ORDER BY i) AS chunk FROM g GROUP BY r, conv_id, turn, island""",
)
def txt_semantic_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns cut where neighbouring windows share few words; rejoined pieces give the turn's words."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("conv_id", "turn", F.posexplode(semantic_split(F.col("text"))).alias("chunk_idx", "chunk"))


@register(
    "txt_negation_merge",
    """WITH p AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 = 0 THEN text || ' without' WHEN turn % 2 = 1 THEN 'any fever' ELSE text END AS part FROM conversations WHERE text IS NOT NULL),
w AS (SELECT *, lag(part) OVER o AS before, len(regexp_extract_all(part, '[^ \t\n\r]+')) AS n FROM p WINDOW o AS (PARTITION BY conv_id ORDER BY turn, part)),
j AS (SELECT *, CASE WHEN coalesce(before LIKE '% without', false) AND n <= 5 THEN 0 ELSE 1 END AS opens FROM w), g AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY turn, part) AS island FROM j)
SELECT conv_id, island::BIGINT AS part, string_agg(part, ' ' ORDER BY turn, part) AS merged FROM g GROUP BY conv_id, island""",
)
def txt_negation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as parts, every third ending in a negation: such a part takes the next one if that is short."""
    part = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.concat("text", F.lit(" without"))).when(F.col("turn") % 2 == 1, "any fever").otherwise(F.col("text"))
    rows = table(spark, sf_dir, "conversations").filter("text IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", part.alias("part")))).alias("p"))
    merged = rows.select("conv_id", F.posexplode(merge_negations(F.transform("p", lambda p: p["part"]))).alias("at", "merged"))
    return merged.select("conv_id", (F.col("at") + 1).cast("long").alias("part"), "merged")


# --- chunks around annotations: spans of an order's lines in a text of a thousand characters ---


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_linenumber") * 100 + F.col("l_partkey") % 50
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), start.alias("start"), (start + 20 + F.col("l_suppkey") % 90).alias("end"))
    return rows.distinct()


_SPANS = "s AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber * 100 + l_partkey % 50 AS s, l_linenumber * 100 + l_partkey % 50 + 20 + l_suppkey % 90 AS e FROM lineitem)"


@register(
    "chunk_variants",
    f"""WITH {_SPANS}, b AS (SELECT *, coalesce((lag(e) OVER w + s) // 2, 0) AS lo, coalesce((e + lead(s) OVER w) // 2, 1000) AS hi FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY s, e))
SELECT doc_id, s AS start, e AS "end", ratio::DOUBLE AS ratio, CAST(s - floor(greatest(s - lo, 0) * ratio) AS BIGINT) AS chunk_start, CAST(e + floor(greatest(hi - e, 0) * ratio) AS BIGINT) AS chunk_end FROM b, (VALUES (0.0), (0.5), (1.0)) r(ratio)""",
)
def chunk_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each span grown towards its boundaries by none, half and all of the way."""
    from .texts import voronoi

    rows = voronoi(spans(spark, sf_dir).withColumn("n_chars", F.lit(1000)))
    rows = rows.withColumn("ratio", F.explode(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0))))
    grow = lambda room: F.floor(F.greatest(room, F.lit(0)) * F.col("ratio"))
    return rows.select("doc_id", "start", "end", "ratio", (F.col("start") - grow(F.col("start") - F.col("left"))).alias("chunk_start"), (F.col("end") + grow(F.col("right") - F.col("end"))).alias("chunk_end"))


@register(
    "validate_annotations",
    f"WITH {_SPANS} SELECT doc_id, s AS start, e AS \"end\", 'overlap' AS violation FROM (SELECT *, lag(e) OVER (PARTITION BY doc_id ORDER BY s, e) AS prev FROM s) WHERE prev > s",
)
def validate_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that are negative, empty, or begin before the one before them ends."""
    before = F.lag("end").over(Window.partitionBy("doc_id").orderBy("start", "end"))
    rows = spans(spark, sf_dir).withColumn("before", before)
    kind = F.when(F.col("start") < 0, "negative").when(F.col("end") <= F.col("start"), "empty").when(F.col("before") > F.col("start"), "overlap")
    return rows.withColumn("violation", kind).filter("violation IS NOT NULL").select("doc_id", "start", "end", "violation")


def to_word_boundaries(text: Column, start: Column, end: Column) -> Column:
    """(start, end) grown to whole words of letters and digits, with an end mark that follows."""
    head = F.length(F.regexp_extract(F.substring(text, F.lit(1), start), r"[\p{L}\p{N}]*\z", 0))
    inside = F.when(F.substring(text, start + 1, F.lit(1)).rlike(r"[\p{L}\p{N}]"), head).otherwise(0)
    tail = F.length(F.regexp_extract(F.substring(text, end + 1, F.length(text)), r"\A[\p{L}\p{N}]*[.!?]?", 0))
    grows = F.when(F.substring(text, end, F.lit(1)).rlike(r"[\p{L}\p{N}]"), tail).otherwise(0)
    return F.struct((start - inside).alias("start"), (end + grows).alias("end"))
