"""Steps around the extraction and mapping calls: groups with overlap, merged mentions, qualifier exclusions, answers in text."""

from __future__ import annotations

import difflib
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import text as T
from ..storage import table

# --- extraction groups: greedy under a token budget, neighbours overlapping ---

_GROUPS = "array<struct<grp:int,first:int,last:int,tokens:bigint,oversized:boolean>>"


def overlapping_groups(sizes: list[int], budget: int, overlap: int) -> list[dict]:
    """Runs of places, each as long as the budget allows, the next one starting ``overlap`` places before the last one's end."""
    out, first = [], 0
    while first < len(sizes):
        last, used = first, sizes[first]
        while last + 1 < len(sizes) and used + sizes[last + 1] <= budget:
            last += 1
            used += sizes[last]
        out.append({"grp": len(out) + 1, "first": first + 1, "last": last + 1, "tokens": used, "oversized": used > budget})
        if last == len(sizes) - 1:
            break
        first = max(last + 1 - overlap, first + 1)
    return out


def extraction_groups(chunks: DataFrame, budget: int, overlap: int = 1) -> DataFrame:
    """case_id, grp, first, last (places from 1), tokens, oversized of chunks (case_id, pos, size).

    A chunk that is over the budget on its own makes a group that is marked as oversized, so that one document can't stop
    a corpus. A case's sizes are gathered: numbers, as many as a document has chunks.
    """

    @F.pandas_udf(_GROUPS)
    def grouped(sizes: pd.Series) -> pd.Series:
        return sizes.map(lambda s: overlapping_groups([int(x) for x in s], budget, overlap))

    gathered = chunks.groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.col("size").cast("long").alias("size")))), lambda c: c["size"]).alias("sizes"))
    return gathered.select("case_id", F.inline(grouped("sizes")))


_BUDGET = 120


@register(
    "extraction_groups",
    f"""WITH RECURSIVE c AS (SELECT conv_id AS case_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, 4 + len(string_split(coalesce(text, ''), ' ')) AS size FROM conversations),
s AS MATERIALIZED (SELECT *, sum(size) OVER (PARTITION BY case_id ORDER BY pos) AS cum, count(*) OVER (PARTITION BY case_id) AS n FROM c),
w AS MATERIALIZED (SELECT a.case_id, a.pos AS first, greatest(max(b.pos) FILTER (b.cum - a.cum + a.size <= {_BUDGET}), any_value(a.pos)) AS last, a.n FROM s a JOIN s b ON b.case_id = a.case_id AND b.pos >= a.pos GROUP BY ALL),
g AS (SELECT case_id, 1 AS grp, first, last, n FROM w WHERE first = 1 UNION ALL SELECT w.case_id, g.grp + 1, w.first, w.last, w.n FROM g JOIN w ON w.case_id = g.case_id AND w.first = greatest(g.last, g.first + 1) AND g.last < g.n)
SELECT g.case_id, grp, first, last, CAST(b.cum - a.cum + a.size AS BIGINT) AS tokens, b.cum - a.cum + a.size > {_BUDGET} AS oversized FROM g JOIN s a ON a.case_id = g.case_id AND a.pos = g.first JOIN s b ON b.case_id = g.case_id AND b.pos = g.last""",
)
def extraction_groups_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations, a header of four tokens each, in groups that share one turn with the next."""
    size = F.size(F.split(F.coalesce("text", F.lit("")), " ")) + 4
    return extraction_groups(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("pos"), size.alias("size")), _BUDGET)


# --- mentions of one finding ---

_MENTIONS = "array<struct<pos:bigint,chunks:array<int>,evidence:string,start:int,stop:int>>"


def _merges(a: dict, b: dict) -> bool:
    """Whether two mentions with equal keys are one: chunks in common, spans that overlap where both are known, evidence that holds the other's."""
    if not set(a["chunks"]) & set(b["chunks"]):
        return False
    if None not in (a["start"], a["stop"], b["start"], b["stop"]) and not (a["start"] < b["stop"] and b["start"] < a["stop"]):
        return False
    return bool(a["clean"] and b["clean"]) and (a["clean"] in b["clean"] or b["clean"] in a["clean"])


def _clean(text: str | None) -> str:
    return " ".join(re.sub(r"[^\w\s]", " ", (text or "").lower()).split())


def fold_mentions(rows: list[dict]) -> list[dict]:
    """Mentions in order; each joins the first one before it that it merges with, else it stands."""
    out: list[dict] = []
    for row in rows:
        row = {**row, "chunks": sorted({int(c) for c in row["chunks"]}), "clean": _clean(row["evidence"])}
        for old in out:
            if _merges(old, row):
                old["chunks"] = sorted({*old["chunks"], *row["chunks"]})
                if len((row["evidence"] or "").strip()) > len((old["evidence"] or "").strip()):
                    old["evidence"], old["clean"] = row["evidence"], row["clean"]
                for side, pick in (("start", min), ("stop", max)):
                    known = [x for x in (old[side], row[side]) if x is not None]
                    old[side] = pick(known) if known else None
                break
        else:
            out.append(row)
    return [{k: r[k] for k in ("pos", "chunks", "evidence", "start", "stop")} for r in out]


def merge_mentions(found: DataFrame) -> DataFrame:
    """Mentions (doc_id, pos, phrase, category, experiencer, assertion, chunks, evidence, start, stop), those of one finding merged.

    Mentions that are equal in all eight of phrase, category, experiencer, assertion, chunks, evidence and bounds are one
    to begin with. The rest merges within equal phrase, category, experiencer and assertion only, by containment; a
    group is one document's mentions of one phrase.
    """

    @F.pandas_udf(_MENTIONS)
    def fold(groups: pd.Series) -> pd.Series:
        def one(rows) -> list[dict]:
            none = lambda x: None if x is None or x != x else int(x)
            return fold_mentions([{"pos": int(r["pos"]), "chunks": list(r["chunks"]), "evidence": r["evidence"], "start": none(r["start"]), "stop": none(r["stop"])} for r in rows])

        return groups.map(one)

    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    key = [low("phrase").alias("phrase"), T.normalize_category("category").alias("category"), low("experiencer").alias("experiencer"), low("assertion").alias("assertion")]
    item = F.struct("pos", F.array_sort("chunks").alias("chunks"), "evidence", "start", "stop")
    distinct = found.groupBy("doc_id", *key, F.array_sort("chunks").alias("chunks"), "evidence", "start", "stop").agg(F.min("pos").alias("pos"))
    gathered = distinct.groupBy("doc_id", "phrase", "category", "experiencer", "assertion").agg(F.sort_array(F.collect_list(item)).alias("m"))
    return gathered.select("doc_id", "phrase", "category", "experiencer", "assertion", F.inline(fold("m")))


@register(
    "merge_mentions",
    """WITH m AS (SELECT l_orderkey AS doc_id, l_linenumber::BIGINT AS pos, CASE WHEN l_suppkey % 2 = 0 THEN 'fever' ELSE 'cough' END AS phrase, lower(l_returnflag) AS assertion, l_linenumber // 3 AS chunk, CASE WHEN l_partkey % 2 = 0 THEN 'had it' ELSE 'had it twice' END AS evidence FROM lineitem)
SELECT doc_id, phrase, assertion, chunk::VARCHAR AS chunks, min(pos) AS pos, arg_max(evidence, length(evidence)) AS evidence FROM m GROUP BY doc_id, phrase, assertion, chunk""",
)
def merge_mentions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as mentions: one chunk each, evidence that holds the other's, so that chunk and axes decide."""
    phrase = F.when(F.col("l_suppkey") % 2 == 0, " Fever").otherwise("cough")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("pos"), phrase.alias("phrase"), F.lit("Abnormal").alias("category"), F.lit("proband").alias("experiencer"),
        F.col("l_returnflag").alias("assertion"), F.array(F.floor(F.col("l_linenumber") / 3).cast("int")).alias("chunks"), F.when(F.col("l_partkey") % 2 == 0, "had it").otherwise("had it twice").alias("evidence"),
        F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("stop"),
    )
    return merge_mentions(rows).select("doc_id", "phrase", "assertion", F.array_join(F.transform("chunks", lambda c: c.cast("string")), ",").alias("chunks"), "pos", "evidence")


def qualifier_exclusions(findings: DataFrame, candidates: DataFrame, floor: float) -> DataFrame:
    """Excluded findings that negated qualifiers give: ("X without Y") Y's best candidate, if it scores at least ``floor``.

    ``findings`` is (doc_id, term, qualifier, chunks), ``candidates`` (phrase, term, label, score). The new finding keeps its
    source's chunks, so that it can be placed; below the floor, or without candidates, there is none.
    """
    order = Window.partitionBy("phrase").orderBy(F.desc("score"), "term")
    best = candidates.withColumn("n", F.row_number().over(order)).filter((F.col("n") == 1) & (F.col("score") >= floor))
    best = best.select(F.col("phrase").alias("qualifier"), F.col("term").alias("excluded"), "label", "score")
    rows = findings.withColumn("qualifier", F.trim("qualifier")).filter("qualifier <> ''")
    out = rows.join(best, "qualifier").select("doc_id", F.col("term").alias("source"), F.col("excluded").alias("term"), "label", "score", "qualifier", "chunks")
    return out.withColumns({"assertion": F.lit("negated"), "method": F.lit("negated_qualifier_derived")})


@register(
    "qualifier_exclusions",
    """WITH c AS (SELECT p_brand AS phrase, p_partkey AS term, p_name AS label, p_size / 50.0::DOUBLE AS score, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS n FROM part WHERE p_partkey % 9 <> 0 AND p_size < 50)
SELECT l_orderkey AS doc_id, l_partkey AS source, c.term, c.label, c.score, count(*) AS n_findings, 'negated' AS assertion FROM lineitem JOIN part p ON p.p_partkey = l_partkey AND l_linenumber <= 2 AND p_size % 4 <> 0 JOIN c ON c.phrase = p.p_brand AND c.n = 1 AND c.score >= 0.97 GROUP BY ALL""",
)
def qualifier_exclusions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's brand as the qualifier of its order's finding; blank for every fourth size."""
    p = table(spark, sf_dir, "part")
    lines = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2").join(p, F.col("l_partkey") == F.col("p_partkey"))
    findings = lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("term"), F.when(F.col("p_size") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_brand")).alias("qualifier"), F.array("l_linenumber").alias("chunks"))
    candidates = p.filter("p_partkey % 9 <> 0 AND p_size < 50").select(F.col("p_brand").alias("phrase"), F.col("p_partkey").alias("term"), F.col("p_name").alias("label"), (F.col("p_size") / 50.0).alias("score"))
    found = qualifier_exclusions(findings, candidates, 0.97)
    return found.groupBy("doc_id", "source", "term", "label", "score", "assertion").agg(F.count("*").alias("n_findings"))


# --- answers of served models ---

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.DOTALL | re.IGNORECASE)


def json_in(text: str | None) -> str | None:
    """The first JSON object of a text, fenced ones first, in canonical form; none if nothing decodes to an object."""
    decoder = json.JSONDecoder()

    def decoded(part: str, whole: bool):
        try:
            value, end = decoder.raw_decode(part)
        except (ValueError, RecursionError):
            return None
        return value if isinstance(value, dict) and (not whole or not part[end:].strip()) else None

    for m in _FENCE.finditer(text or ""):
        if (found := decoded(m[1].strip(), True)) is not None:
            return json.dumps(found, sort_keys=True)
    at = -1
    while (at := (text or "").find("{", at + 1)) >= 0:
        if (found := decoded(text[at:], False)) is not None:
            return json.dumps(found, sort_keys=True)
    return None


def json_in_text(text: Column) -> Column:
    @F.pandas_udf("string")
    def extract(texts: pd.Series) -> pd.Series:
        return texts.map(json_in)

    return extract(text)


@register(
    "answer_json",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE '{"k": ' || o_orderkey || ', "s": "a{b"}' END AS answer FROM orders""",
)
def answer_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects in fences, in prose, behind broken ones; none in every fifth answer."""
    k = F.col("o_orderkey")
    body = F.concat(F.lit('{"s": "a{b", "k": '), k.cast("string"), F.lit("}"))
    text = F.when(k % 5 == 0, F.concat(F.lit('see {"k": 0} or\n```json\n'), body, F.lit("\n```"))).when(k % 5 == 1, F.concat(F.lit("The answer {is} "), body, F.lit(" I think")))
    text = text.when(k % 5 == 2, body).when(k % 5 == 3, F.concat(F.lit("```\n[1, 2]\n``` {bad: "), body)).otherwise(F.lit("none { here } [1]"))
    return table(spark, sf_dir, "orders").select(k, json_in_text(text).alias("answer"))


# --- arguments of tools ---

#: Other names of arguments (fixed values of the interface).
ALIASES = {
    "query": "text", "phrase": "text", "snippet": "text", "clinical_text": "text", "input": "text", "input_text": "text", "q": "text", "lang": "language", "locale": "language",
    "limit": "num_results", "max": "num_results", "max_results": "num_results", "top": "num_results", "k": "num_results", "per_chunk": "num_results_per_chunk",
    "results_per_chunk": "num_results_per_chunk", "mode": "response_mode", "verbosity": "response_mode", "detail": "response_mode", "threshold": "similarity_threshold",
    "min_similarity": "similarity_threshold", "term1": "term1_id", "hpo1": "term1_id", "id1": "term1_id", "term2": "term2_id", "hpo2": "term2_id", "id2": "term2_id", "sections": "details", "include": "details",
}


def did_you_mean(unknown: str, valid: list[str]) -> str | None:
    """The valid name that an unknown one stands for: by alias, else the closest spelling of at least 0.6."""
    if ALIASES.get(unknown) in valid:
        return ALIASES[unknown]
    return next(iter(difflib.get_close_matches(unknown, valid, n=1, cutoff=0.6)), None)


def canonical_arguments(arguments: Column, valid: Column) -> Column:
    """A map of arguments with aliases renamed where the tool has the canonical name; one given under both names keeps the canonical value."""
    table_ = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    target = lambda k: F.when(F.array_contains(valid, F.try_element_at(table_, k)), F.try_element_at(table_, k))
    kept = F.map_filter(arguments, lambda k, v: target(k).isNull())
    moved = F.filter(F.map_entries(arguments), lambda e: target(e["key"]).isNotNull() & ~F.map_contains_key(arguments, target(e["key"])))
    names = F.array_distinct(F.transform(moved, lambda e: target(e["key"])))
    first = lambda n: F.get(F.filter(moved, lambda e: target(e["key"]) == n), F.lit(0))["value"]
    return F.map_concat(kept, F.map_from_arrays(names, F.transform(names, first)))


_VALID = ("text", "language", "num_results", "response_mode", "similarity_threshold")
_ASKED = (("query", "text"), ("langage", "language"), ("top", "num_results"), ("responsemode", "response_mode"), ("similarity_treshold", "similarity_threshold"), ("zzz", None), ("text", "text"))


@register(
    "argument_help",
    f"""WITH a(n, asked, suggestion) AS (VALUES {", ".join(f"({n}, '{a}', {'NULL' if s is None else repr(s)})" for n, (a, s) in enumerate(_ASKED))})
SELECT asked, suggestion, count(*) AS n FROM events JOIN a ON a.n = event_id % {len(_ASKED)} GROUP BY ALL""",
)
def argument_help(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions for the argument names of calls: aliases, misspellings, and one that nothing is like."""

    @F.pandas_udf("string")
    def suggest(names: pd.Series) -> pd.Series:
        return names.map({n: did_you_mean(n, list(_VALID)) for n in names.unique()})

    asked = F.get(F.array(*[F.lit(a) for a, _ in _ASKED]), (F.col("event_id") % len(_ASKED)).cast("int"))
    rows = table(spark, sf_dir, "events").groupBy(asked.alias("asked")).agg(F.count("*").alias("n"))
    return rows.select("asked", suggest("asked").alias("suggestion"), "n")


@register(
    "argument_aliases",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'text=own' WHEN event_id % 3 = 1 THEN 'text=a' ELSE '' END AS text, event_id % 2 = 0 AS has_sections FROM events""",
)
def argument_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with an alias, with an alias beside the canonical name, or neither; an alias of another tool's argument stays."""
    k = F.col("event_id")
    pair = lambda name, value: F.map_from_arrays(F.array(F.lit(name)), F.array(F.lit(value)))
    none = F.create_map().cast("map<string,string>")
    given = F.map_concat(F.when(k % 3 != 2, pair("query", "a")).otherwise(none), F.when(k % 3 == 0, pair("text", "own")).otherwise(none), F.when(k % 2 == 0, pair("sections", "s")).otherwise(none))
    out = canonical_arguments(given, F.array(*map(F.lit, _VALID)))
    rows = table(spark, sf_dir, "events").select(k, out.alias("m"))
    text = F.coalesce(F.concat(F.lit("text="), F.try_element_at("m", F.lit("text"))), F.lit(""))
    return rows.select("event_id", text.alias("text"), F.map_contains_key("m", "sections").alias("has_sections"))


# --- accounts and reports ---


def energy_cost(energy_kwh: Column, carbon_kg: Column, price_per_kwh: Column) -> Column:
    """energy_kwh and carbon_kg of six digits, electricity_cost of eight; null where a part isn't known."""
    return F.struct(F.round(energy_kwh, 6).alias("energy_kwh"), F.round(carbon_kg, 6).alias("carbon_kg"), F.round(energy_kwh * price_per_kwh, 8).alias("electricity_cost"))


@register(
    "energy_cost",
    """SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, round(e, 6) AS energy_kwh, round(c, 6) AS carbon_kg, round(e * 0.31::DOUBLE, 8) AS electricity_cost
FROM (SELECT l_shipdate, sum(l_quantity) / 1000 AS e, CASE WHEN count(*) % 3 = 0 THEN NULL ELSE sum(l_quantity) / 2500 END AS c FROM lineitem GROUP BY 1)""",
)
def energy_cost_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy of a day's runs, its carbon where it was measured, and its price."""
    days = table(spark, sf_dir, "lineitem").groupBy("l_shipdate").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    cost = energy_cost(F.col("q") / 1000, F.when(F.col("n") % 3 != 0, F.col("q") / 2500), F.lit(0.31))
    return days.select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), cost.alias("c")).select("day", "c.*")


def quality_line(at: Column, poor: Column, reason: Column, first: Column, second: Column) -> Column:
    """A chunk's line of the quality report; scores that are missing are a dash."""
    score = lambda x: F.coalesce(F.format_string("%.3f", x), F.lit("  -  "))
    flag = F.rpad(F.when(poor, "True").otherwise("False"), 6, " ")
    return F.concat_ws("  ", F.lpad(at.cast("string"), 9, " "), flag, F.rpad(reason, 11, " "), F.when(first.isNull(), "  -  ").otherwise(score(first)), F.when(second.isNull(), "  -  ").otherwise(score(second)), F.when(first.isNull() | second.isNull(), "  -  ").otherwise(score(first - second)))


@register(
    "quality_report",
    """SELECT o_orderkey AS case_id, string_agg(lpad(l_linenumber::VARCHAR, 9, ' ') || '  ' || CASE WHEN f < 0.5 THEN 'True  ' ELSE 'False ' END || '  ' || rpad(CASE WHEN f < 0.5 THEN 'low_top' WHEN s IS NULL THEN 'single' ELSE 'ok' END, 11, ' ')
|| '  ' || printf('%.3f', f) || '  ' || coalesce(printf('%.3f', s), '  -  ') || '  ' || coalesce(printf('%.3f', f - s), '  -  '), chr(10) ORDER BY l_linenumber, f DESC) AS report
FROM (SELECT l_orderkey AS o_orderkey, l_linenumber, l_quantity / 60.0::DOUBLE AS f, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity / 130.0::DOUBLE END AS s FROM lineitem) GROUP BY 1""",
)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case's chunks as a text table; a case has a handful of chunks."""
    first, second = F.col("l_quantity") / 60.0, F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity") / 130.0)
    poor = first < 0.5
    reason = F.when(poor, "low_top").when(second.isNull(), "single").otherwise("ok")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), "l_linenumber", quality_line(F.col("l_linenumber"), poor, reason, first, second).alias("line"), (-first).alias("o"))
    lines = F.sort_array(F.collect_list(F.struct("l_linenumber", "o", "line")))
    return rows.groupBy("case_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("report"))


@register(
    "column_lists",
    "SELECT l_orderkey AS query_id, string_agg('P:' || l_partkey, ',' ORDER BY s DESC, l_linenumber, 'P:' || l_partkey) AS ids, string_agg(printf('%.2f', 1 - s), ',' ORDER BY s DESC, l_linenumber, 'P:' || l_partkey) AS distances FROM (SELECT *, l_quantity / 60.0::DOUBLE AS s FROM lineitem) GROUP BY 1",
)
def column_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query's ranked results as lists of ids and distances, the form in which vector stores answer."""
    s = F.col("l_quantity") / 60.0
    item = F.struct((-s).alias("o"), "l_linenumber", F.concat(F.lit("P:"), F.col("l_partkey").cast("string")).alias("id"), F.format_string("%.2f", 1 - s).alias("d"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(F.sort_array(F.collect_list(item)).alias("r"))
    join = lambda k: F.array_join(F.transform("r", lambda x: x[k]), ",")
    return rows.select("query_id", join("id").alias("ids"), join("d").alias("distances"))


@register(
    "plot_data",
    """SELECT o_orderpriority AS model, metric, round(value, 4) AS value FROM (SELECT o_orderpriority, avg(o_totalprice) AS mean, median(o_totalprice) AS median, count(*)::DOUBLE AS n FROM orders GROUP BY 1) UNPIVOT (value FOR metric IN (mean, median, n))""",
)
def plot_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of models in long form: one row for each bar or point of a figure."""
    price = F.col("o_totalprice")
    wide = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(F.avg(price).alias("mean"), F.percentile(price, F.lit(0.5)).alias("median"), F.count("*").cast("double").alias("n"))
    return wide.unpivot("model", ["mean", "median", "n"], "metric", "value").withColumn("value", F.round("value", 4))


def model_policy(name: Column, allowed: tuple[str, ...], default: str) -> Column:
    """The model to retrieve with, and whether the one asked for is allowed; none asked for is the default."""
    asked = F.nullif(F.trim(F.coalesce(name, F.lit(""))), F.lit(""))
    return F.struct(F.when(asked.isNull() | ~asked.isin(*allowed), default).otherwise(asked).alias("model"), (asked.isNull() | asked.isin(*allowed)).alias("accepted"))


@register(
    "model_policy",
    "SELECT CASE WHEN p_mfgr IN ('Brand#1', 'Brand#2') THEN p_mfgr ELSE 'Brand#1' END AS model, p_mfgr IN ('', 'Brand#1', 'Brand#2') AS accepted, count(*) AS n FROM (SELECT CASE WHEN p_size % 5 = 0 THEN '' ELSE 'Brand#' || (p_size % 4) END AS p_mfgr FROM part) GROUP BY ALL",
)
def model_policy_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("p_size") % 5 == 0, " ").otherwise(F.concat(F.lit("Brand#"), (F.col("p_size") % 4).cast("string")))
    rows = table(spark, sf_dir, "part").select(model_policy(asked, ("Brand#1", "Brand#2"), "Brand#1").alias("p"))
    return rows.groupBy("p.model", "p.accepted").agg(F.count("*").alias("n"))
