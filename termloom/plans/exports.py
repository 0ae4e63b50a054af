"""Response shaping and export records: JSON packets, budgets, pruned columns, run stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..functions.assertions import canonical
from ..storage import table

#: Response budgets in characters by mode, and each mode's columns (fixed values).
BUDGETS = {"minimal": 4_000, "compact": 12_000, "standard": 24_000, "full": 48_000}
MODES = {"minimal": ("id", "rank"), "compact": ("id", "rank", "label", "score"), "standard": ("id", "rank", "label", "score", "status"), "full": ("id", "rank", "label", "score", "status", "evidence")}
SYNONYMS_SHOWN = 10


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked terms of cases: an order's parts by price."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag", "l_linestatus")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    status = F.when(F.col("l_returnflag") == "A", "affirmed").when(F.col("l_returnflag") == "N", "negated").otherwise("uncertain")
    order = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    return lines.join(parts, "l_partkey").select(
        F.col("l_orderkey").alias("case_id"), F.concat(F.lit("P:"), F.col("l_partkey").cast("string")).alias("id"), F.row_number().over(order).alias("rank"),
        F.col("p_name").alias("label"), F.round("l_extendedprice", 2).alias("score"), status.alias("status"), F.col("l_linestatus").alias("evidence"),
    )


_TERMS = """WITH t AS (SELECT l_orderkey AS case_id, 'P:' || l_partkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank, p_name AS label,
round(l_extendedprice, 2) AS score, CASE l_returnflag WHEN 'A' THEN 'affirmed' WHEN 'N' THEN 'negated' ELSE 'uncertain' END AS status, l_linestatus AS evidence FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def shape(rows: DataFrame, mode: str) -> DataFrame:
    """Only the mode's columns; the case's own key stays."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    return rows.select("case_id", *MODES[mode])


@register("response_mode", _TERMS + " SELECT case_id, id, rank, label, score FROM t")
def response_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape(terms(spark, sf_dir), "compact")


def within_budget(rows: DataFrame, size: Column, budget: int) -> DataFrame:
    """The longest prefix, by rank, whose sizes stay within a budget."""
    order = Window.partitionBy("case_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(order)).filter(F.col("used") <= budget)


@register(
    "response_budget",
    _TERMS + ", u AS (SELECT case_id, id, rank, sum(length(id) + length(label) + length(status) + 20) OVER (PARTITION BY case_id ORDER BY rank) AS used FROM t) SELECT case_id, id, rank, used FROM u WHERE used <= 150",
)
def response_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length("id") + F.length("label") + F.length("status") + 20
    return within_budget(terms(spark, sf_dir), size, 150).select("case_id", "id", "rank", "used")


def export_record(rows: DataFrame) -> DataFrame:
    """Canonical export rows: id and label required, statuses folded, an excluded flag, 1-based chunk ids."""
    checked = F.when(F.col("id").isNull() | F.col("label").isNull(), F.raise_error(F.lit("an export record needs id and label"))).otherwise(F.col("id"))
    status = canonical(F.col("status"))
    return rows.select("case_id", checked.alias("id"), "label", status.alias("assertion"), (status == "negated").alias("excluded"), F.col("rank").cast("int").alias("chunk_id"), "score")


@register("export_records", _TERMS + " SELECT case_id, id, label, status AS assertion, status = 'negated' AS excluded, rank::INTEGER AS chunk_id, score FROM t")
def export_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export_record(terms(spark, sf_dir))


def packet(records: DataFrame, created_by: str = "termloom") -> DataFrame:
    """One JSON packet a case: features with type, excluded flag and evidence, and meta data."""
    feature = F.struct(F.struct("id", "label").alias("type"), "excluded", F.struct(F.col("chunk_id").alias("chunk"), F.col("score")).alias("evidence"))
    rows = records.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("chunk_id", feature.alias("f")))).alias("x"))
    features = F.transform("x", lambda x: x["f"])
    return rows.select("case_id", F.to_json(F.struct(F.concat(F.lit("packet-"), F.col("case_id").cast("string")).alias("id"), features.alias("phenotypicFeatures"), F.struct(F.lit(created_by).alias("createdBy")).alias("metaData"))).alias("packet"))


def sidecar(records: DataFrame) -> DataFrame:
    """The packet's annotation record: its id and every record's evidence."""
    rows = records.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("chunk_id", "id", "assertion"))).alias("records"))
    return rows.select("case_id", F.to_json(F.struct(F.concat(F.lit("packet-"), F.col("case_id").cast("string")).alias("packet_id"), "records")).alias("sidecar"))


@register(
    "export_packets",
    _TERMS + """ SELECT case_id, '{"id":"packet-' || case_id || '","phenotypicFeatures":[' || string_agg('{"type":{"id":"' || id || '","label":"' || label || '"},"excluded":' || CASE WHEN status = 'negated' THEN 'true' ELSE 'false' END || ',"evidence":{"chunk":' || rank || '}}', ',' ORDER BY rank) || '],"metaData":{"createdBy":"termloom"}}' AS packet FROM t GROUP BY case_id""",
)
def export_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without scores, whose printed form differs between engines."""
    return packet(export_record(terms(spark, sf_dir)).withColumn("score", F.lit(None).cast("string")))


@register("cap_synonyms", """SELECT l_orderkey AS case_id, array_to_string(list(l_partkey::VARCHAR ORDER BY l_linenumber, l_partkey)[1:3], ',') AS shown, greatest(count(*) - 3, 0) AS truncated FROM lineitem GROUP BY 1""")
def cap_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three names and how many more there are."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("s"))
    shown = F.array_join(F.transform(F.slice("s", 1, 3), lambda x: x["l_partkey"].cast("string")), ",")
    return rows.select("case_id", shown.alias("shown"), F.greatest(F.size("s") - 3, F.lit(0)).alias("truncated"))


@register(
    "dedup_latest",
    "SELECT o_custkey AS model, o_orderkey AS run_id, o_orderdate AS ts, o_totalprice AS value FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
)
def dedup_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest run of each model, by one aggregation instead of a sorted window."""
    o = table(spark, sf_dir, "orders")
    best = o.groupBy(F.col("o_custkey").alias("model")).agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("b"))
    return best.select("model", F.col("b.o_orderkey").alias("run_id"), F.col("b.o_orderdate").alias("ts"), F.col("b.o_totalprice").alias("value"))


@register(
    "metadata_upsert",
    "SELECT event_type AS key, user_id % 10 AS part, arg_max(event_id, (ts, event_id)) AS value FROM events GROUP BY ALL",
)
def metadata_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key-value pairs: the last write of each key."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("key"), (F.col("user_id") % 10).alias("part")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("value"))
