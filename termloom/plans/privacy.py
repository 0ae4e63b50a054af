"""Personal data in documents: findings by rule, validators, merged spans, redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import pii
from ..storage import table

_BY_ID = {r.id: r for r in pii.RULES}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.coalesce("html", F.lit("")).alias("text"))


def _rule_query(name: str, rule: pii.Rule, source=documents, rows: str = "doc_id, coalesce(text, '') AS text FROM documents", sql: bool = True) -> None:
    pattern = rule.pattern.replace("'", "''")
    found = f"WITH t AS (SELECT {rows}), m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}')) AS matched FROM t) SELECT doc_id, matched, count(*) AS n FROM m GROUP BY ALL"

    @register(name, found if sql else None)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = source(spark, sf_dir).withColumn("s", F.explode(pii.matches(F.col("text"), rule.guard + rule.pattern)))
        return rows.groupBy("doc_id", F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("matched")).agg(F.count("*").alias("n"))


for _id in ("email", "ipv4", "date"):
    _rule_query(f"pii_{_id}", _BY_ID[_id])
_rule_query("pii_url", _BY_ID["url"], pages, "page_id AS doc_id, coalesce(html, '') AS text FROM pages")
_rule_query("pii_phone", pii.DIGIT_RUN)
_rule_query("pii_phone_regions", _BY_ID["phone"], sql=False)


@register(
    "pii_validators",
    """WITH c AS (SELECT c_custkey, lpad(CAST((c_custkey * 7919) % 100000000 AS VARCHAR), 8, '0') || substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST((c_custkey * 7919) % 100000000 % (22 + c_custkey % 2) AS INTEGER) + 1, 1) AS dni,
lpad(CAST((c_custkey * 104729) % 1000000000 AS VARCHAR), 9, '0') AS bsn, chr(CAST(65 + c_custkey % 30 AS INTEGER)) || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS kvnr,
(1 + c_custkey % 3) || '85' || lpad(CAST(c_custkey % 15 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS nir FROM customer)
SELECT c_custkey, substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST(left(dni, 8) AS INTEGER) % 23 + 1, 1) = substr(dni, 9, 1) AS dni,
(list_sum(list_transform(range(1, 9), lambda i: CAST(substr(bsn, i, 1) AS INTEGER) * (10 - i))) - CAST(substr(bsn, 9, 1) AS INTEGER)) % 11 = 0 AND bsn <> '000000000' AS bsn,
regexp_full_match(kvnr, '[A-Z][0-9]{9}') AS kvnr, left(nir, 1) IN ('1', '2') AND CAST(substr(nir, 4, 2) AS INTEGER) BETWEEN 1 AND 12 AS nir FROM c""",
)
def pii_validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers made from customer keys, about half of them right."""
    k = F.col("c_custkey")
    n = (k * 7919) % 100_000_000
    dni = F.concat(F.lpad(n.cast("string"), 8, "0"), F.substring(F.lit("TRWAGMYFPDXBNJZSQVHLCKE"), (n % (22 + k % 2)).cast("int") + 1, F.lit(1)))
    bsn = F.lpad(((k * 104729) % 1_000_000_000).cast("string"), 9, "0")
    kvnr = F.concat(F.char(65 + k % 30), F.lpad(k.cast("string"), 9, "0"))
    nir = F.concat((1 + k % 3).cast("string"), F.lit("85"), F.lpad((k % 15).cast("string"), 2, "0"), F.lpad(k.cast("string"), 8, "0"))
    rows = table(spark, sf_dir, "customer").select(k, dni.alias("d"), bsn.alias("b"), kvnr.alias("v"), nir.alias("i"))
    return rows.select(k, pii.valid_dni(F.col("d")).alias("dni"), pii.valid_bsn(F.col("b")).alias("bsn"), pii.valid_kvnr(F.col("v")).alias("kvnr"), pii.valid_nir(F.col("i")).alias("nir"))


@register("pii_scan_summary")
def pii_scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged findings by rule and confidence; tests hold the scan against plain Python."""
    rows = documents(spark, sf_dir).select("doc_id", F.explode(pii.merge(pii.scan(F.col("text")))).alias("f"))
    return rows.groupBy("f.rule", "f.confidence").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@register(
    "pii_merge_overlaps",
    """WITH s AS (SELECT l_orderkey AS doc_id, l_linenumber * 10 + l_partkey % 9 AS s, l_linenumber * 10 + l_partkey % 9 + 3 + l_suppkey % 9 AS e FROM lineitem),
f AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM s),
g AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT doc_id, min(s) AS start, max(e) AS "end", count(*) AS n FROM g GROUP BY doc_id, island""",
)
def pii_merge_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a document that overlap become one (touching ones don't)."""
    start = (F.col("l_linenumber") * 10 + F.col("l_partkey") % 9).cast("int")
    spans = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.struct(start.alias("start"), (start + 3 + F.col("l_suppkey") % 9).cast("int").alias("end")).alias("s"))
    gathered = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list("s")).alias("spans"))
    empty = F.array().cast("array<struct<start:int,end:int,n:bigint>>")

    def step(acc, s):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), (last["n"] + 1).alias("n"))
        fresh = F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(1).cast("long").alias("n"))
        overlap = F.coalesce(s["start"] < last["end"], F.lit(False))
        return F.when(overlap, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(fresh)))

    return gathered.select("doc_id", F.inline(F.aggregate("spans", empty, step)))


@register("pii_redact", r"SELECT doc_id, regexp_replace(coalesce(text, ''), '" + _BY_ID["email"].pattern + r"', '[EMAIL]', 'g') AS redacted FROM documents")
def pii_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High-confidence contact data by tokens; with the one rule for addresses the splice equals a replacement."""
    found = pii.scan(F.col("text"), F.col("lang"), (_BY_ID["email"],))
    return documents(spark, sf_dir).withColumn("f", found).select("doc_id", pii.redact(F.col("text"), F.col("f")).alias("redacted"))


#: Characters on either side in which context is looked for.
CONTEXT_CHARS = 32


def untitled_names(text):
    """(name, score) of untitled names: 2, a particle adds 1, a word of context nearby 2."""
    particle = rf"(?i)\s(?:{'|'.join(pii.PARTICLES)})\s"
    context = rf"(?iu){'|'.join(pii.NAME_CONTEXT)}"

    def scored(m):
        start = F.greatest(m["start"] - CONTEXT_CHARS, F.lit(0))
        name, near = F.substring(text, m["start"] + 1, m["end"] - m["start"]), F.substring(text, start + 1, m["end"] + CONTEXT_CHARS - start)
        return F.struct(name.alias("name"), (F.lit(2) + F.when(name.rlike(particle), 1).otherwise(0) + F.when(near.rlike(context), 2).otherwise(0)).alias("score"))

    return F.transform(pii.matches(text, _BY_ID["untitled-name"].pattern), scored)


@register("pii_names")
def pii_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of names by score; a finding for review, never redacted unasked."""
    rows = documents(spark, sf_dir).select("doc_id", F.explode(untitled_names(F.col("text"))).alias("n"))
    return rows.groupBy("doc_id", "n.name", "n.score").agg(F.count("*").alias("n"))
