"""Annotated notes and run reports: offsets of chunks, segments, findings, trace graphs, reference checks, summaries."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import text as T
from ..storage import checkpointed, table


_STRIP = r"regexp_replace(x, '\A[ \t\n\r]+|[ \t\n\r]+\z', '', 'g')"
_LINES = f"list_filter(list_transform(string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: {_STRIP}), lambda x: x <> '')"
_ENDED = rf"array_to_string(list_transform({_LINES}, lambda x: CASE WHEN regexp_matches(x, '[.?!]\z') THEN x ELSE x || '.' END), ' ')"
_PARTS = f"list_filter(list_transform(regexp_extract_all({_ENDED}, '[^.?!]+[.?!]'), lambda x: {_STRIP}), lambda x: x <> '')"


def offsets_in(text: str, chunks: list[str]) -> list[int]:
    """A search begins at its place and doesn't walk there, so a text of many chunks is read about once."""
    out, at = [], 0
    for chunk in chunks:
        place = text.find(chunk, at)
        if place < 0:
            place = text.find(chunk)
        if place >= 0:
            at = place + 1
        out.append(place)
    return out


def running_offsets(text: Column, chunks: Column) -> Column:
    """Place of each chunk, searched from just behind the start of the one before, else from the beginning, else -1."""

    @F.pandas_udf("array<int>")
    def found(texts: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([offsets_in(t, p) for t, p in zip(texts, parts, strict=True)], dtype="object")

    return found(text, chunks)


@register(
    "note_offsets",
    rf"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, {_PARTS} AS parts FROM documents),
c AS (SELECT row_number() OVER () AS r, doc_id, text, parts, len(parts) AS n FROM d WHERE len(parts) > 0),
f(r, i, start, behind) AS (SELECT r, 1, strpos(text, parts[1]) - 1, greatest(strpos(text, parts[1]), 0) FROM c UNION ALL
SELECT f.r, f.i + 1, g.start, CASE WHEN g.start >= 0 THEN g.start + 1 ELSE f.behind END FROM f JOIN c ON c.r = f.r AND f.i < c.n,
LATERAL (SELECT CASE WHEN strpos(substr(c.text, f.behind + 1), c.parts[f.i + 1]) > 0 THEN f.behind + strpos(substr(c.text, f.behind + 1), c.parts[f.i + 1]) - 1 ELSE strpos(c.text, c.parts[f.i + 1]) - 1 END AS start) g)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_idx, CAST(start AS INTEGER) AS start FROM f JOIN c USING (r)""",
)
def note_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of every sentence in its document."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("chunks", T.sentences("text"))
    return rows.select("doc_id", F.posexplode(running_offsets(F.col("text"), F.col("chunks"))).alias("chunk_idx", "start"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_linenumber") * 20 + F.col("l_partkey") % 9
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), start.alias("start"), (start + 5 + F.col("l_suppkey") % 16).alias("end"), F.col("l_linenumber").alias("pos"), (F.col("l_partkey") % 5).alias("term"), (F.col("l_returnflag") == "R").alias("manual")
    )


_SPANS = "s AS (SELECT l_orderkey AS doc_id, l_linenumber * 20 + l_partkey % 9 AS s, l_linenumber * 20 + l_partkey % 9 + 5 + l_suppkey % 16 AS e, l_linenumber AS pos, l_partkey % 5 AS term, l_returnflag = 'R' AS manual FROM lineitem)"


def merged(rows: DataFrame) -> DataFrame:
    """Overlapping or touching spans of a document as one, with the terms they carry; one gathered array a document."""
    before = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("start") <= reach, 0).otherwise(1)
    rows = rows.withColumn("opens", opens).withColumn("island", F.sum("opens").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_set("term")).alias("terms")).drop("island")


@register(
    "note_segments",
    f"""WITH {_SPANS}, f AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM s),
g AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM f),
m AS (SELECT doc_id, min(s) AS s, max(e) AS e, string_agg(DISTINCT term::VARCHAR, ',' ORDER BY term::VARCHAR) AS terms FROM g GROUP BY doc_id, island),
p AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS a, s AS b FROM m)
SELECT doc_id, s AS start, e AS "end", true AS highlighted, terms FROM m UNION ALL SELECT doc_id, a, b, false, '' FROM p WHERE a < b""",
)
def note_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highlighted ranges and the plain ones before them."""
    m = merged(spans(spark, sf_dir))
    lit = m.select("doc_id", "start", "end", F.lit(True).alias("highlighted"), F.array_join(F.transform("terms", lambda t: t.cast("string")), ",").alias("terms"))
    before = F.coalesce(F.lag("end").over(Window.partitionBy("doc_id").orderBy("start")), F.lit(0))
    gaps = m.select("doc_id", before.alias("a"), "start").filter("a < start").select("doc_id", F.col("a").alias("start"), F.col("start").alias("end"), F.lit(False).alias("highlighted"), F.lit("").alias("terms"))
    return lit.unionByName(gaps)


@register(
    "note_findings",
    f"WITH {_SPANS} SELECT doc_id, term, min(s) FILTER (pos = first_pos) AS start, bool_or(manual) AS manual, count(*) AS n FROM (SELECT *, min(pos) OVER (PARTITION BY doc_id, term) AS first_pos FROM s) GROUP BY doc_id, term",
)
def note_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a term: the first annotation's values; manual if any is."""
    return spans(spark, sf_dir).groupBy("doc_id", "term").agg(F.min(F.struct("pos", "start"))["start"].alias("start"), F.bool_or("manual").alias("manual"), F.count("*").alias("n"))


@register(
    "trace_graph",
    "WITH t AS (SELECT event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events) SELECT source, target, count(*) AS n FROM t WHERE target IS NOT NULL GROUP BY ALL",
)
def trace_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edges between successive steps of users, with their numbers."""
    follow = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), follow.alias("target")).filter("target IS NOT NULL").groupBy("source", "target").agg(F.count("*").alias("n"))


def dangling(references: DataFrame, targets: DataFrame, key: list[str]) -> DataFrame:
    """References without a target: an empty result is a valid response."""
    return references.select(*key).distinct().join(targets.select(*key).distinct(), key, "left_anti")


@register("reference_check", "SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 1000)")
def reference_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dangling(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").filter("n_chars > 1000"), ["doc_id"])


def run_status(failed: Column, total: Column) -> Column:
    return F.when(failed == 0, "complete").when(failed == total, "failed").otherwise("partial")


@register(
    "run_status",
    "SELECT o_custkey AS run, CASE WHEN count(*) FILTER (o_orderstatus = 'F') = 0 THEN 'complete' WHEN count(*) FILTER (o_orderstatus = 'F') = count(*) THEN 'failed' ELSE 'partial' END AS status FROM orders GROUP BY 1",
)
def q_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count("*").alias("n"))
    return runs.select("run", run_status(F.col("f"), F.col("n")).alias("status"))


@register(
    "report_markdown",
    "SELECT '| priority | orders |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || p || ' | ' || n || ' |', chr(10) ORDER BY p) AS report FROM (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1)",
)
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small table as Markdown: the groups are few, their lines are joined in one row."""
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("p", "n"))), lambda r: F.concat(F.lit("| "), r["p"], F.lit(" | "), r["n"].cast("string"), F.lit(" |")))
    return n.agg(F.concat(F.lit("| priority | orders |\n|---|---|\n"), F.array_join(lines, "\n")).alias("report"))


def latest_replacement(links: DataFrame, live: DataFrame) -> DataFrame:
    """(id, replaced_by) chains to (id, target): the first live term a chain reaches; cycles and dead ends have none.

    Pointers double every turn, so chains of n links take log n joins, and as many turns are made as the number of links asks for.
    """
    now = links.select("id", F.col("replaced_by").alias("target")).filter("target IS NOT NULL")
    alive = live.select(F.col("id").alias("target"), F.lit(True).alias("alive"))
    now = checkpointed(now)
    for _ in range(max(1, now.count().bit_length())):
        known = now.join(alive, "target", "left")
        step = now.select(F.col("id").alias("target"), F.col("target").alias("next"))
        now = checkpointed(known.join(step, "target", "left").select("id", F.when(F.col("alive"), F.col("target")).otherwise(F.coalesce("next", "target")).alias("target")))
    return now.join(alive, "target").select("id", "target")


def subject_ip(trusted: tuple[str, ...]):
    """A pandas UDF (client, forwarded) to the subject's address: the last forwarded hop that isn't a trusted proxy's.

    The header counts only if the client itself is trusted; addresses that don't parse give null.
    """
    networks = [ipaddress.ip_network(t) for t in trusted]

    def parse(x: str | None):
        try:
            return ipaddress.ip_address((x or "").strip())
        except ValueError:
            return None

    @F.pandas_udf("string")
    def resolve(client: pd.Series, forwarded: pd.Series) -> pd.Series:
        out = []
        for c, f in zip(client, forwarded, strict=True):
            at = parse(c)
            if at is not None and f and any(at in n for n in networks):
                for hop in reversed(f.split(",")):
                    at = parse(hop)
                    if at is None or not any(at in n for n in networks):
                        break
            out.append(None if at is None else str(at))
        return pd.Series(out, dtype="object")

    return resolve


_TRUSTED = ("10.0.0.0/8", "192.168.1.0/24")


@register(
    "subject_addresses",
    """WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '10.0.0.' || event_id % 200 WHEN 1 THEN '192.168.1.' || user_id % 200 WHEN 2 THEN '192.168.2.' || user_id % 200 ELSE 'none' END AS client,
  '8.8.' || user_id % 250 || '.' || event_id % 250 || CASE event_id % 3 WHEN 0 THEN ', 10.1.2.3' WHEN 1 THEN ', 10.1.2.3, 192.168.1.9' ELSE '' END AS forwarded FROM events)
SELECT event_id, CASE WHEN client = 'none' THEN NULL WHEN starts_with(client, '192.168.2.') THEN client ELSE split_part(forwarded, ',', 1) END AS subject FROM e""",
)
def subject_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The address that a request counts for: the last forwarded hop before trusted proxies, if the client is one of these."""
    k, u = F.col("event_id"), F.col("user_id")
    text = lambda c: c.cast("string")
    client = F.when(k % 4 == 0, F.concat(F.lit("10.0.0."), text(k % 200))).when(k % 4 == 1, F.concat(F.lit("192.168.1."), text(u % 200))).when(k % 4 == 2, F.concat(F.lit("192.168.2."), text(u % 200))).otherwise("none")
    hops = F.concat(F.lit("8.8."), text(u % 250), F.lit("."), text(k % 250), F.when(k % 3 == 0, ", 10.1.2.3").when(k % 3 == 1, ", 10.1.2.3, 192.168.1.9").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", subject_ip(_TRUSTED)(client, hops).alias("subject"))


@register(
    "term_replacements",
    """WITH RECURSIVE l AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN p_partkey - 1 WHEN 2 THEN p_partkey // 2 WHEN 3 THEN p_partkey + 1 ELSE p_partkey - 1 END AS target FROM part),
live AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 5 = 0),
w(id, target, steps) AS (SELECT id, target, 1 FROM l WHERE target IS NOT NULL UNION ALL SELECT w.id, l.target, steps + 1 FROM w JOIN l ON l.id = w.target WHERE w.target NOT IN (SELECT id FROM live) AND l.target IS NOT NULL AND steps < 64)
SELECT w.id, w.target FROM w JOIN live ON live.id = w.target""",
)
def term_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live term that a chain of replacements reaches; threes and fours point at each other and reach none."""
    k = F.col("p_partkey")
    target = F.when(k % 5 == 0, None).when(k % 5 == 1, k - 1).when(k % 5 == 2, F.floor(k / 2).cast("long")).when(k % 5 == 3, k + 1).otherwise(k - 1)
    links = table(spark, sf_dir, "part").select(k.alias("id"), target.alias("replaced_by"))
    return latest_replacement(links, links.filter("id % 5 = 0").select("id"))
