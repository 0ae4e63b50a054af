"""Annotated corpora: case lists, documents with gold annotations, JSON lines, text and annotation pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CASES = "description string, text string, expected_hpo_ids array<string>"
ANNOTATED = (
    "doc_id string, language string, source string, full_text string, annotations array<struct<hpo_id:string,label:string,"
    "assertion_status:string,evidence_spans:array<struct<start_char:int,end_char:int,text_snippet:string>>>>"
)
CORPUS = "documents array<struct<id:string,text:string,gold_hpo_terms:array<struct<id:string,assertion:string>>>>"
#: Annotation statuses to scored assertions (fixed values).
STATUS = {"affirmed": "PRESENT", "normal": "PRESENT", "negated": "ABSENT", "uncertain": "UNCERTAIN"}


def cases(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """case_id, text, gold (array of id and assertion): every expected id counts as present, blank ones don't count.

    A file is one JSON list, or with ``lines`` a case a line, which Spark reads in parallel.
    """
    rows = spark.read.option("multiLine", not lines).schema(CASES).json(path).withColumn("case_id", F.monotonically_increasing_id())
    ids = F.filter(F.coalesce("expected_hpo_ids", F.array().cast("array<string>")), lambda i: F.trim(i) != "")
    return rows.select("case_id", "text", F.transform(ids, lambda i: F.struct(F.trim(i).alias("id"), F.lit("PRESENT").alias("assertion"))).alias("gold"))


def corpus(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """doc_id, text, gold of JSON objects with documents, one a file or, with ``lines``, one a line; a missing assertion is PRESENT."""
    rows = spark.read.option("multiLine", not lines).schema(CORPUS).json(path).select(F.explode("documents").alias("d"))
    gold = F.transform(F.coalesce("d.gold_hpo_terms", F.array().cast("array<struct<id:string,assertion:string>>")), lambda g: F.struct(g["id"].alias("id"), F.coalesce(g["assertion"], F.lit("PRESENT")).alias("assertion")))
    return rows.select(F.col("d.id").alias("doc_id"), F.col("d.text").alias("text"), gold.alias("gold"))


def assertion_of(status: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    return F.try_element_at(known, F.lower(status))


def annotated(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """doc_id, dataset, language, text, gold of a folder ``<dataset>/annotations/*.json``; unknown statuses are dropped.

    A file holds one document or, with ``lines``, one a line.
    """
    rows = spark.read.option("multiLine", not lines).schema(ANNOTATED).json(path).withColumn("file", F.col("_metadata.file_path"))
    gold = F.transform("annotations", lambda a: F.struct(a["hpo_id"].alias("id"), assertion_of(a["assertion_status"]).alias("assertion")))
    return rows.select(
        "doc_id", F.regexp_extract("file", r"([^/]+)/annotations/[^/]+\z", 1).alias("dataset"), "language", F.col("full_text").alias("text"),
        F.filter(gold, lambda g: g["assertion"].isNotNull()).alias("gold"),
    )


def json_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents of a JSON Lines file, and its malformed lines; blank lines don't count."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", ANNOTATED + ", corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}).alias("d"))
    good = parsed.filter(F.col("d.corrupt").isNull() & F.col("d").isNotNull())
    return good.select("d.*").drop("corrupt"), parsed.filter(F.col("d.corrupt").isNotNull()).select("value")


def annotation_lines(lines: DataFrame) -> DataFrame:
    """start, end, snippet, id of annotation lines in either form: ``[s::e] id | text`` or tab-separated ``s e text id``."""
    raw = r"\A\[(\d+)::(\d+)\]\s+([A-Z]+[_:]\d+)\s*\|\s*(.*)\z"
    tab = r"\A(\d+)\t(\d+)\t([^\t]*)\t([A-Z]+[_:]\d+)"
    v = F.col("value")
    pick = lambda i, j: F.when(v.rlike(raw), F.regexp_extract(v, raw, i)).when(v.rlike(tab), F.regexp_extract(v, tab, j))
    rows = lines.filter(v.rlike(raw) | v.rlike(tab))
    return rows.withColumns({"start": pick(1, 1).cast("int"), "end": pick(2, 2).cast("int"), "snippet": pick(4, 3), "id": F.replace(pick(3, 4), F.lit("_"), F.lit(":"))}).drop("value")


def text_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, text, annotations of ``<stem>.txt`` beside ``<stem>.ann``; unpaired files are left out, and annotations whose
    span isn't their snippet in the text (but for blanks around it)."""
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.(?:txt|ann)\z", 1)
    texts = spark.read.option("wholetext", True).option("pathGlobFilter", "*.txt").text(folder).select(stem.alias("doc_id"), F.col("value").alias("text"))
    lines = spark.read.option("pathGlobFilter", "*.ann").text(folder).select(stem.alias("doc_id"), "value")
    found = annotation_lines(lines).join(texts, "doc_id")
    cut = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    ok = (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.length("text")) & (F.trim(cut) == F.trim("snippet"))
    kept = found.filter(ok).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "id", "snippet"))).alias("annotations"))
    paired = lines.select("doc_id").distinct()
    return texts.join(paired, "doc_id", "left_semi").join(kept, "doc_id", "left")


def project(gold: DataFrame, rules: DataFrame) -> DataFrame:
    """Dataset-specific assertions: (dataset, assertion) to a projected one, null drops the row; no rule leaves it as it is."""
    known = rules.withColumn("ruled", F.lit(True))
    rows = gold.join(known, ["dataset", "assertion"], "left")
    rows = rows.withColumn("assertion", F.when(F.col("ruled"), F.col("projected")).otherwise(F.col("assertion")))
    return rows.filter("assertion IS NOT NULL").drop("projected", "ruled")


def lexicon(default: DataFrame, custom: DataFrame) -> DataFrame:
    """(lang, entry) in lower case; a language with custom entries has no default ones."""
    lower = lambda rows: rows.select("lang", F.lower("entry").alias("entry"))
    return lower(default).join(custom.select("lang").distinct(), "lang", "left_anti").unionByName(lower(custom)).distinct()
