"""Ontology source: OBO-graph JSON to a term table and is-a edges, and the store of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph
from .versions import Versions

#: The fields that are read; everything else in the file is skipped by the reader.
SCHEMA = (
    "graphs array<struct<nodes:array<struct<id:string,lbl:string,meta:struct<deprecated:boolean,definition:struct<val:string>,"
    "synonyms:array<struct<val:string>>,comments:array<string>,basicPropertyValues:array<struct<pred:string,val:string>>>>>,"
    "edges:array<struct<sub:string,subj:string,pred:string,obj:string>>>>"
)
#: Predicates that say is-a (fixed values of the exchange format).
IS_A = ("is_a", "http://www.w3.org/2000/01/rdf-schema#subClassOf", "rdfs:subClassOf")
REPLACED_BY = "IAO_0100001"


def verify_sha256(spark: SparkSession, path: str, expected: str) -> str:
    """The file's digest; an error if it isn't the pinned one."""
    found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("d")).first()
    if found is None or found.d != expected.lower():
        raise ValueError(f"{path} has digest {found.d if found else None}, not {expected}")
    return found.d


def tree_digest(spark: SparkSession, path: str) -> str:
    """A digest of a folder's files that doesn't depend on their order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.substring_index("path", path.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    each = files.select(F.concat_ws(":", name, F.sha2("content", 256)).alias("d"))
    return each.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("d")), "\n"), 256).alias("d")).first().d


def read(spark: SparkSession, path: str, prefix: str = "HP", include_obsolete: bool = False, sha256: str | None = None, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """terms (id, label, definition, synonyms, comments, obsolete, replaced_by) and edges (child, parent).

    Ids are short (``PREFIX:n``), nodes of other vocabularies and, unless asked for, obsolete ones are left out; an edge
    counts if it says is-a and both its ends are terms. A missing label is the id, a missing definition is empty.
    With ``lines`` every line of the files is a graph document of its own, so that large ontologies are read in parallel.
    """
    if sha256:
        verify_sha256(spark, path, sha256)
    whole = spark.read.option("multiLine", not lines).schema(SCHEMA).json(path)
    graphs = whole.select(F.explode("graphs").alias("g"))
    short = lambda c: F.when(c.contains(f"{prefix}_"), F.concat(F.lit(f"{prefix}:"), F.substring_index(c, f"{prefix}_", -1))).otherwise(c)
    n = graphs.select(F.explode("g.nodes").alias("n"))
    label = F.coalesce(F.col("n.lbl"), F.lit(""))
    none = F.array().cast("array<string>")
    texts = lambda c: F.coalesce(F.filter(c, lambda s: s.isNotNull() & (s != "")), none)
    terms = n.select(
        short(F.col("n.id")).alias("id"), F.coalesce(F.nullif(label, F.lit("")), short(F.col("n.id"))).alias("label"),
        F.coalesce("n.meta.definition.val", F.lit("")).alias("definition"), texts(F.col("n.meta.synonyms.val")).alias("synonyms"), texts(F.col("n.meta.comments")).alias("comments"),
        (F.coalesce("n.meta.deprecated", F.lit(False)) | F.lower(label).startswith("obsolete ")).alias("obsolete"),
        F.get(F.transform(F.filter("n.meta.basicPropertyValues", lambda p: p["pred"].contains(REPLACED_BY) & (p["val"] != "")), lambda p: short(p["val"])), F.lit(0)).alias("replaced_by"),
    ).filter(F.col("id").startswith(f"{prefix}:")).dropDuplicates(["id"])
    if not include_obsolete:
        terms = terms.filter(~F.col("obsolete"))
    e = graphs.select(F.explode("g.edges").alias("e")).filter(F.col("e.pred").isin(*IS_A))
    edges = e.select(short(F.coalesce("e.sub", "e.subj")).alias("child"), short(F.col("e.obj")).alias("parent")).filter("child IS NOT NULL AND parent IS NOT NULL").distinct()
    known = terms.select("id")
    edges = edges.join(known, F.col("child") == F.col("id"), "left_semi").join(known, F.col("parent") == F.col("id"), "left_semi")
    return terms, edges


def parsing_summary(terms: DataFrame) -> DataFrame:
    return terms.agg(
        F.count("*").alias("terms"), F.count_if(F.col("definition") == "").alias("without_definition"), F.count_if(F.size("synonyms") == 0).alias("without_synonyms"), F.count_if("obsolete").alias("obsolete")
    )


def prepare(spark: SparkSession, path: str, store: str, root: str, prefix: str = "HP", sha256: str | None = None, lines: bool = False) -> None:
    """Ingest: terms, edges, closure and depths into a store of Parquet tables; a term the root doesn't reach has depth -1."""
    terms, edges = read(spark, path, prefix, sha256=sha256, lines=lines)
    terms.write.mode("overwrite").parquet(f"{store}/terms")
    edges.write.mode("overwrite").parquet(f"{store}/edges")
    kept = spark.read.parquet(f"{store}/terms")
    closed = graph.closure(kept.select(F.col("id").alias("term")), spark.read.parquet(f"{store}/edges"))
    closed.write.mode("overwrite").parquet(f"{store}/closure")
    graph.depths(spark.read.parquet(f"{store}/closure"), root).write.mode("overwrite").parquet(f"{store}/depths")
    meta = {"sha256": sha256 or "", "prefix": prefix, "root": root, "terms": str(kept.count())}
    spark.createDataFrame(sorted(meta.items()), "key string, value string").write.mode("overwrite").parquet(f"{store}/metadata")


def term_versions(spark: SparkSession, store: str) -> Versions:
    """The store's terms as versions; the folder that ``prepare`` wrote is the first one."""
    return Versions(spark, f"{store}/terms-versions", adopted=f"{store}/terms")


def append_terms(new: DataFrame, store: str) -> int:
    """Add terms to a store in one step; an id that is there already is an error, and so is a writer that came in between."""
    terms = term_versions(new.sparkSession, store)
    base = terms.latest()
    old = terms.read(base)
    if clash := new.join(old.select("id"), "id", "left_semi").limit(1).collect():
        raise ValueError(f"term {clash[0].id} is in the store already")
    return terms.append(new.select(*old.columns), base)


def terms_by_ids(terms: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Details of the ids (id) that are known, and those that aren't."""
    return terms.join(ids.distinct(), "id", "left_semi"), ids.distinct().join(terms.select("id"), "id", "left_anti")


def enrich(results: DataFrame, terms: DataFrame) -> DataFrame:
    """Results (id, …) with definition and synonyms; empty ones are null."""
    details = terms.select("id", F.nullif("definition", F.lit("")).alias("definition"), F.when(F.size("synonyms") > 0, F.col("synonyms")).alias("synonyms"))
    return results.join(details, "id", "left")


def without_unrelated(rows: DataFrame, closed: DataFrame, root: str) -> DataFrame:
    """Drop known terms (column ``id``) that don't lie below a root; unknown terms and the root itself stay."""
    flags = closed.groupBy(F.col("term").alias("id")).agg(F.bool_or(F.col("ancestor") == root).alias("below"))
    return rows.join(flags, "id", "left").filter(F.coalesce("below", F.lit(True))).drop("below")


def upsert_metadata(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, value, updated_at): the latest value of each key."""
    order = Window.partitionBy("key").orderBy(F.desc("updated_at"))
    return old.unionByName(new).withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")
