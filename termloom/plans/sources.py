"""Queries that write the exchange formats from the tables, read them back through the sources and report what came through.

Files lie in the shared folder, a document a line, so that writing and reading are parallel at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import register
from ..sources import corpora, index, ledger, obo
from ..sources.versions import Clash, Versions
from ..storage import scratch, table

_URI = "http://purl.obolibrary.org/obo/"


def _k() -> Column:
    return F.col("p_partkey")


#: Parts as terms: a heap-shaped tree (the parent of k is k / 5), obsolete, foreign, unnamed and undefined ones among them.
_TERM_SQL = """t AS (SELECT p_partkey AS k, 'HP:' || lpad(p_partkey::VARCHAR, 7, '0') AS id, CASE WHEN p_partkey % 11 = 5 THEN '' WHEN p_partkey % 13 = 7 THEN 'obsolete ' || p_name ELSE p_name END AS lbl,
p_partkey % 17 = 9 AS deprecated, p_partkey % 19 = 11 AS foreign_, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'made by ' || p_brand END AS definition,
CASE WHEN p_partkey % 4 = 0 THEN [] WHEN p_partkey % 4 = 1 THEN [p_type] ELSE [p_type, p_brand] END AS synonyms FROM part),
a AS (SELECT k, id, CASE WHEN lbl = '' THEN id ELSE lbl END AS label, definition, synonyms, deprecated OR starts_with(lbl, 'obsolete ') AS obsolete FROM t WHERE NOT foreign_),
e AS (SELECT c.id AS child, p.id AS parent FROM a c JOIN a p ON p.k = c.k // 5 WHERE NOT c.obsolete AND NOT p.obsolete AND c.k % 23 <> 3 AND c.k > 0)"""


def ontology(spark: SparkSession, sf_dir: str) -> str:
    """Writes the graph documents, a part a line; returns their path."""
    number = lambda k: F.lpad(k.cast("string"), 7, "0")
    uri = lambda k: F.concat(F.lit(_URI), F.when(k % 19 == 11, "MP_").otherwise("HP_"), number(k))
    label = F.when(_k() % 11 == 5, F.lit(None)).when(_k() % 13 == 7, F.concat(F.lit("obsolete "), "p_name")).otherwise(F.col("p_name"))
    values = F.when(_k() % 4 == 0, F.array(F.lit(""))).when(_k() % 4 == 1, F.array("p_type")).otherwise(F.array("p_type", F.lit(None), "p_brand"))
    meta = F.struct(
        F.when(_k() % 17 == 9, F.lit(True)).alias("deprecated"), F.when(_k() % 3 != 0, F.struct(F.concat(F.lit("made by "), "p_brand").alias("val"))).alias("definition"),
        F.transform(values, lambda v: F.struct(v.alias("val"))).alias("synonyms"),
        F.when(_k() % 17 == 9, F.array(F.struct(F.lit(_URI + "IAO_0100001").alias("pred"), uri(_k() + 1).alias("val")))).alias("basicPropertyValues"),
    )
    parent = F.floor(_k() / 5)
    is_a = F.when((_k() % 23 == 3) | (_k() == 0), "part_of").when(_k() % 2 == 0, "is_a").otherwise("http://www.w3.org/2000/01/rdf-schema#subClassOf")
    edge = F.struct(F.when(_k() % 2 == 0, uri(_k())).alias("sub"), F.when(_k() % 2 == 1, uri(_k())).alias("subj"), is_a.alias("pred"), uri(parent).alias("obj"))
    node = F.struct(uri(_k()).alias("id"), label.alias("lbl"), meta.alias("meta"))
    graphs = F.struct(F.array(F.struct(F.array(node).alias("nodes"), F.array(edge).alias("edges"))).alias("graphs"))
    path = scratch(spark, "ontology")
    table(spark, sf_dir, "part").select(F.to_json(graphs).alias("value")).write.text(path)
    return path


@register("obo_terms", f"WITH {_TERM_SQL} SELECT id, label, definition, array_to_string(synonyms, '|') AS synonyms FROM a WHERE NOT obsolete")
def obo_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that an ontology file has: short ids, labels, definitions, synonyms; obsolete and foreign ones left out."""
    terms, _ = obo.read(spark, ontology(spark, sf_dir), lines=True)
    return terms.select("id", "label", "definition", F.array_join("synonyms", "|").alias("synonyms"))


@register("obo_edges", f"WITH {_TERM_SQL} SELECT child, parent FROM e")
def obo_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is-a edges between terms, whichever field names the child and whichever predicate says it."""
    return obo.read(spark, ontology(spark, sf_dir), lines=True)[1]


@register(
    "obo_summary",
    f"WITH {_TERM_SQL} SELECT count(*) AS terms, count(*) FILTER (definition = '') AS without_definition, count(*) FILTER (len(synonyms) = 0) AS without_synonyms, count(*) FILTER (obsolete) AS obsolete FROM a",
)
def obo_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obo.parsing_summary(obo.read(spark, ontology(spark, sf_dir), include_obsolete=True, lines=True)[0])


@register("obo_replacements", f"WITH {_TERM_SQL} SELECT 'HP:' || lpad(k::VARCHAR, 7, '0') AS id, 'HP:' || lpad((k + 1)::VARCHAR, 7, '0') AS replaced_by FROM t WHERE deprecated AND NOT foreign_ AND (k + 1) % 19 <> 11")
def obo_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Obsolete terms and what replaces them within the vocabulary."""
    terms, _ = obo.read(spark, ontology(spark, sf_dir), include_obsolete=True, lines=True)
    return terms.filter(F.col("obsolete") & F.col("replaced_by").startswith("HP:")).select("id", "replaced_by")


_ROOT = "HP:0000002"
_CLOSED_SQL = f"""{_TERM_SQL}, up(term, ancestor, n) AS (SELECT id, id, 0 FROM a WHERE NOT obsolete UNION ALL SELECT u.term, e.parent, u.n + 1 FROM up u JOIN e ON e.child = u.ancestor)"""


def store(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark, "store")
    obo.prepare(spark, ontology(spark, sf_dir), path, _ROOT, lines=True)
    return path


@register("store_depths", f"WITH RECURSIVE {_CLOSED_SQL} SELECT term, coalesce(min(CASE WHEN ancestor = '{_ROOT}' THEN n END), -1) AS depth FROM up GROUP BY term")
def store_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths below a root as the prepared store holds them; -1 where the root isn't reached."""
    return spark.read.parquet(store(spark, sf_dir) + "/depths")


@register("store_metadata", f"WITH {_TERM_SQL} SELECT * FROM (VALUES ('prefix', 'HP'), ('root', '{_ROOT}'), ('sha256', '')) v(key, value) UNION ALL SELECT 'terms', count(*)::VARCHAR FROM a WHERE NOT obsolete")
def store_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(store(spark, sf_dir) + "/metadata")


@register(
    "store_lookup",
    f"""WITH {_TERM_SQL}, w AS (SELECT DISTINCT 'HP:' || lpad((l_partkey * 3)::VARCHAR, 7, '0') AS id FROM lineitem WHERE l_linenumber = 1)
SELECT id, a.label, a.id IS NOT NULL AS known FROM w LEFT JOIN (SELECT * FROM a WHERE NOT obsolete) a USING (id)""",
)
def store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details of asked-for ids; those that the store lacks are reported as unknown."""
    terms, _ = obo.read(spark, ontology(spark, sf_dir), lines=True)
    wanted = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.concat(F.lit("HP:"), F.lpad((F.col("l_partkey") * 3).cast("string"), 7, "0")).alias("id"))
    known, unknown = obo.terms_by_ids(terms, wanted)
    return known.select("id", "label", F.lit(True).alias("known")).unionByName(unknown.select("id", F.lit(None).cast("string").alias("label"), F.lit(False).alias("known")))


@register(
    "store_enrich",
    f"""WITH {_TERM_SQL} SELECT p_partkey AS item_id, nullif(a.definition, '') AS definition, CASE WHEN len(a.synonyms) > 0 THEN array_to_string(a.synonyms, '|') END AS synonyms
FROM part LEFT JOIN (SELECT * FROM a WHERE NOT obsolete) a ON a.k = p_size * 7""",
)
def store_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with their terms' definitions and synonyms; empty ones are null."""
    terms, _ = obo.read(spark, ontology(spark, sf_dir), lines=True)
    results = table(spark, sf_dir, "part").select(_k().alias("item_id"), F.concat(F.lit("HP:"), F.lpad((F.col("p_size") * 7).cast("string"), 7, "0")).alias("id"))
    return obo.enrich(results, terms).select("item_id", "definition", F.array_join("synonyms", "|").alias("synonyms"))


@register(
    "store_unrelated",
    f"""WITH RECURSIVE {_CLOSED_SQL}, w AS (SELECT p_partkey AS item_id, 'HP:' || lpad(p_partkey::VARCHAR, 7, '0') AS id FROM part)
SELECT item_id, id FROM w WHERE id NOT IN (SELECT term FROM up) OR id IN (SELECT term FROM up WHERE ancestor = '{_ROOT}')""",
)
def store_unrelated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known terms outside a branch are dropped, unknown ones stay."""
    rows = table(spark, sf_dir, "part").select(_k().alias("item_id"), F.concat(F.lit("HP:"), F.lpad(_k().cast("string"), 7, "0")).alias("id"))
    return obo.without_unrelated(rows, spark.read.parquet(store(spark, sf_dir) + "/closure"), _ROOT)


@register("store_append", f"WITH {_TERM_SQL} SELECT id, label FROM a WHERE NOT obsolete UNION ALL SELECT 'HP:9' || lpad(s_suppkey::VARCHAR, 6, '0'), s_name FROM supplier")
def store_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as new terms, appended to the store; an id that is there already would be an error."""
    path = store(spark, sf_dir)
    none = F.array().cast("array<string>")
    new = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("HP:9"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("id"), F.col("s_name").alias("label"), F.lit("").alias("definition"),
        none.alias("synonyms"), none.alias("comments"), F.lit(False).alias("obsolete"), F.lit(None).cast("string").alias("replaced_by"),
    )
    obo.append_terms(new, path)
    return obo.term_versions(spark, path).read().select("id", "label")


@register(
    "store_versions",
    """WITH n AS (SELECT (SELECT count(*) FROM labels) AS l, (SELECT count(*) FROM conversations) AS c, (SELECT count(*) FROM documents) AS d)
SELECT 1 AS version, 'replace' AS kind, l AS written, l AS visible FROM n UNION ALL SELECT 2, 'append', c, l + c FROM n UNION ALL SELECT 3, 'replace', d, d FROM n""",
)
def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's versions, each read by itself after the last was made; a writer that read an old version is refused."""
    names = lambda t, c: table(spark, sf_dir, t).select(F.col(c).cast("string").alias("name"))
    store = Versions(spark, scratch(spark, "versions"))
    store.replace(names("labels", "doc_id"))
    store.append(names("conversations", "role"))
    store.replace(names("documents", "source"))
    try:
        store.append(names("region", "r_name"), base=1)
    except Clash:
        pass
    counted = [store.read(v).agg(F.count("*").alias("visible")).withColumns({"version": F.lit(v), "kind": F.lit(kind), "written": F.lit(n).cast("long")}) for v, kind, n in store.history()]
    out = counted[0]
    for more in counted[1:]:
        out = out.unionByName(more)
    return out


@register(
    "embedding_cache",
    """WITH t AS (SELECT DISTINCT substr(coalesce(text, ''), 1, 12) AS text, coalesce(lang = 'en', false) AS en FROM documents), n AS (SELECT count(DISTINCT text) FILTER (en) AS en, count(DISTINCT text) AS n FROM t)
SELECT 1 AS version, en AS encoded, n AS served FROM n UNION ALL SELECT 2, n - en, n FROM n""",
)
def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings of documents, encoded in three runs: English ones, all, and all again, which encodes nothing more."""
    path = scratch(spark, "cache")
    openings = table(spark, sf_dir, "documents").select(F.substring(F.coalesce("text", F.lit("")), 1, 12).alias("text"), "lang")
    index.cached(openings.filter("lang = 'en'"), path, "hashed")
    index.cached(openings, path, "hashed")
    served = index.cached(openings, path, "hashed").agg(F.count("*").alias("served"))
    history = spark.createDataFrame([(v, n) for v, _, n in Versions(spark, path).history()], "version int, encoded long")
    return history.crossJoin(F.broadcast(served))


class _Refused(Exception):
    pass


@register(
    "run_resume",
    """WITH d AS (SELECT coalesce(doc_id, 0) % 12 AS batch, text FROM documents)
SELECT batch, count(*) AS documents, sum(coalesce(length(text), 0)) AS chars, CASE WHEN batch % 5 = 2 THEN 2 ELSE 1 END AS attempts, CASE WHEN batch % 5 = 2 THEN 1 ELSE 0 END AS failures, true AS finished FROM d GROUP BY batch""",
)
def run_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over all documents that fails in some batches, is stopped half-way, and goes on from its ledger."""
    path = scratch(spark, "run")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(12)).cast("int").alias("batch"))

    def work(rows: DataFrame, attempt: int) -> DataFrame:
        if attempt == 1 and not rows.where(F.col("batch") % 5 == 2).isEmpty():
            raise _Refused("503 unavailable")
        return rows.select("doc_id", "batch", F.length(F.coalesce("text", F.lit(""))).alias("chars"))

    ledger.Run(spark, path, {"model": "m", "mode": "small"}, docs, "batch", 12).go_on(work, wave=3, most_waves=2, failures=(_Refused,))
    run = ledger.Run(spark, path, {"model": "m", "mode": "small"}, docs, "batch", 12)
    while run.go_on(work, wave=3, failures=(_Refused,)):
        pass
    tried = run.attempts().groupBy("batch").agg(F.max("attempt").alias("attempts"), F.count_if(~F.col("finished")).cast("int").alias("failures"), F.bool_or("finished").alias("finished"))
    found = run.results().groupBy("batch").agg(F.count("*").alias("documents"), F.sum("chars").alias("chars"))
    return found.join(tried, "batch").select(F.col("batch").cast("long"), "documents", "chars", "attempts", "failures", "finished")


@register("source_digest", "SELECT sha256(string_agg(r_name, chr(10) ORDER BY r_name) || chr(10)) AS digest FROM region")
def source_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's digest, checked against the pinned one on reading (regions are five rows, so one file is right)."""
    path = scratch(spark, "regions")
    rows = table(spark, sf_dir, "region").select(F.col("r_name").alias("value"))
    rows.coalesce(1).sortWithinPartitions("value").write.text(path)
    pinned = rows.agg(F.sha2(F.concat(F.array_join(F.sort_array(F.collect_list("value")), "\n"), F.lit("\n")), 256).alias("d")).first().d
    return spark.createDataFrame([(obo.verify_sha256(spark, path + "/*.txt", pinned),)], "digest string")


# --- annotated corpora ---

_STATUSES = ("affirmed", "Negated", "normal", "uncertain", "made up")


@register(
    "corpus_cases",
    """SELECT o_orderkey AS key, g.id FROM orders, (VALUES (0), (1), (2)) v(i), LATERAL (SELECT CASE WHEN i = 0 THEN 'HP:' || o_custkey WHEN i = 1 AND o_orderkey % 3 = 0 THEN 'HP:' || (o_custkey + 1) END AS id) g
WHERE o_orderkey % 5 <> 0 AND g.id IS NOT NULL""",
)
def corpus_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval cases as JSON: gold ids trimmed, blank ones dropped, cases without ids kept but without rows here."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ids = F.array(F.concat(F.lit(" HP:"), c.cast("string")), F.when(k % 3 == 0, F.concat(F.lit("HP:"), (c + 1).cast("string"))).otherwise("  "))
    rows = table(spark, sf_dir, "orders").select(F.to_json(F.struct(k.cast("string").alias("text"), F.when(k % 5 != 0, ids).alias("expected_hpo_ids"))).alias("value"))
    path = scratch(spark, "cases")
    rows.write.text(path)
    return corpora.cases(spark, path, lines=True).select(F.col("text").cast("long").alias("key"), F.explode("gold.id").alias("id"))


@register(
    "corpus_gold",
    "SELECT 'o' || l_orderkey AS doc_id, 'HP:' || l_partkey AS id, CASE WHEN l_returnflag = 'N' THEN 'PRESENT' ELSE l_returnflag END AS assertion, count(*) AS n FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL",
)
def corpus_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with gold terms as JSON; a missing assertion is PRESENT."""
    term = F.struct(F.concat(F.lit("HP:"), F.col("l_partkey").cast("string")).alias("id"), F.nullif("l_returnflag", F.lit("N")).alias("assertion"))
    docs = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2").groupBy("l_orderkey").agg(F.collect_list(term).alias("gold_hpo_terms"))  # one or two terms an order
    doc = F.struct(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("id"), F.lit("t").alias("text"), "gold_hpo_terms")
    path = scratch(spark, "corpus")
    docs.select(F.to_json(F.struct(F.array(doc).alias("documents"))).alias("value")).write.text(path)
    rows = corpora.corpus(spark, path, lines=True).select("doc_id", F.explode("gold").alias("g"))
    return rows.groupBy("doc_id", "g.id", "g.assertion").agg(F.count("*").alias("n"))


_STATUS_SQL = f"(['{"', '".join(_STATUSES)}'])[1 + o_orderkey % {len(_STATUSES)}]"


@register(
    "corpus_annotated",
    f"""SELECT 'set' || o_custkey % 3 AS dataset, CASE {_STATUS_SQL} WHEN 'Negated' THEN 'ABSENT' WHEN 'uncertain' THEN 'UNCERTAIN' ELSE 'PRESENT' END AS assertion, count(*) AS n
FROM orders WHERE {_STATUS_SQL} <> 'made up' GROUP BY ALL""",
)
def corpus_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated documents in a folder of each data set; statuses become assertions, unknown ones are dropped."""
    k = F.col("o_orderkey")
    status = F.get(F.array(*map(F.lit, _STATUSES)), (k % len(_STATUSES)).cast("int"))
    note = F.struct(F.concat(F.lit("HP:"), k.cast("string")).alias("hpo_id"), status.alias("assertion_status"))
    doc = F.to_json(F.struct(k.cast("string").alias("doc_id"), F.lit("en").alias("language"), F.lit("text").alias("full_text"), F.array(note).alias("annotations")))
    path = scratch(spark, "annotated")
    for n in range(3):
        table(spark, sf_dir, "orders").filter(F.col("o_custkey") % 3 == n).select(doc.alias("value")).write.text(f"{path}/set{n}/annotations")
    rows = corpora.annotated(spark, f"{path}/*/annotations", lines=True).select("dataset", F.explode("gold.assertion").alias("assertion"))
    return rows.groupBy("dataset", "assertion").agg(F.count("*").alias("n"))


@register("corpus_json_lines", "SELECT o_orderkey % 7 = 0 AS malformed, count(*) AS n, sum(CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey END)::BIGINT AS keys FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY 1")
def corpus_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON Lines with broken and blank lines: documents that parse, and lines that don't."""
    k = F.col("o_orderkey")
    line = F.when(k % 11 == 0, F.lit("  ")).when(k % 7 == 0, F.concat(F.lit('{"doc_id": "'), k.cast("string"))).otherwise(F.to_json(F.struct(k.cast("string").alias("doc_id"), F.lit("x").alias("full_text"))))
    path = scratch(spark, "lines")
    table(spark, sf_dir, "orders").select(line.alias("value")).write.text(path)
    good, bad = corpora.json_lines(spark, path)
    both = good.select(F.lit(False).alias("malformed"), F.col("doc_id").cast("long").alias("k")).unionByName(bad.select(F.lit(True).alias("malformed"), F.lit(0).cast("long").alias("k")))
    return both.groupBy("malformed").agg(F.count("*").alias("n"), F.sum("k").alias("keys"))


@register(
    "corpus_annotation_lines",
    """SELECT l_orderkey * 10 + l_linenumber AS key, CAST(l_quantity AS INTEGER) AS start, CAST(l_quantity AS INTEGER) + 4 AS "end", 'HP:' || lpad(l_partkey::VARCHAR, 7, '0') AS id FROM lineitem WHERE l_linenumber % 3 <> 0""",
)
def corpus_annotation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation lines in either form, others among them."""
    start, number = F.col("l_quantity").cast("int").cast("string"), F.lpad(F.col("l_partkey").cast("string"), 7, "0")
    end, key = (F.col("l_quantity").cast("int") + 4).cast("string"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string")
    raw = F.concat(F.lit("["), start, F.lit("::"), end, F.lit("]  HP_"), number, F.lit(" | "), key)
    line = F.when(F.col("l_linenumber") % 3 == 1, raw).when(F.col("l_linenumber") % 3 == 2, F.concat_ws("\t", start, end, key, F.concat(F.lit("HP:"), number))).otherwise(F.concat(F.lit("# "), key))
    rows = corpora.annotation_lines(table(spark, sf_dir, "lineitem").select(line.alias("value")))
    return rows.select(F.col("snippet").cast("long").alias("key"), "start", "end", "id")


_PROJECT = (("A", "F", "ABSENT"), ("B", "O", None), ("A", "P", "PRESENT"))


@register(
    "corpus_project",
    f"""WITH g AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN 'A' ELSE 'B' END AS dataset, o_orderstatus AS assertion FROM orders),
r(dataset, assertion, projected) AS (VALUES {", ".join(f"('{d}', '{a}', {'NULL' if p is None else repr(p)})" for d, a, p in _PROJECT)})
SELECT g.dataset, CASE WHEN r.dataset IS NULL THEN g.assertion ELSE r.projected END AS assertion, count(*) AS n FROM g LEFT JOIN r ON r.dataset = g.dataset AND r.assertion = g.assertion
WHERE r.dataset IS NULL OR r.projected IS NOT NULL GROUP BY ALL""",
)
def corpus_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions by a data set's own rules: renamed, dropped, or left as they are."""
    gold = table(spark, sf_dir, "orders").select(F.when(F.col("o_custkey") % 2 == 0, "A").otherwise("B").alias("dataset"), F.col("o_orderstatus").alias("assertion"))
    rules = spark.createDataFrame(list(_PROJECT), "dataset string, assertion string, projected string")
    return corpora.project(gold, F.broadcast(rules)).groupBy("dataset", "assertion").agg(F.count("*").alias("n"))


@register(
    "corpus_lexicon",
    """SELECT DISTINCT lang, entry FROM (SELECT r_name AS lang, lower(n_name) AS entry FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey % 2 = 0
UNION ALL SELECT r_name, lower('own ' || n_name) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey % 2 = 1)""",
)
def corpus_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word lists by language; a language with entries of its own has no default ones."""
    rows = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    default = rows.select(F.col("r_name").alias("lang"), F.col("n_name").alias("entry"))
    custom = rows.filter("n_regionkey % 2 = 1").select(F.col("r_name").alias("lang"), F.concat(F.lit("own "), "n_name").alias("entry"))
    return corpora.lexicon(default, custom)


@register(
    "corpus_text_pairs",
    """SELECT n_name AS doc_id, 0 AS start, length(n_name) AS "end", 'HP:' || lpad(n_nationkey::VARCHAR, 7, '0') AS id FROM nation WHERE n_nationkey % 3 <> 2 AND n_nationkey % 5 <> 4""",
)
def corpus_text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts beside annotation files (nations, a file each): unpaired ones, and spans that aren't their snippet, are left out."""
    path, rows = scratch(spark, "pairs"), table(spark, sf_dir, "nation").collect()  # a fixed table of 25 rows
    files = []
    for r in rows:
        files.append((f"{r.n_name}.txt", f"{r.n_name} is a nation"))
        if r.n_nationkey % 5 != 4:
            snippet = r.n_name if r.n_nationkey % 3 != 2 else "other"
            files.append((f"{r.n_name}.ann", f"[0::{len(r.n_name)}] HP_{r.n_nationkey:07d} | {snippet}"))
    jvm = spark.sparkContext._jvm
    for name, text in files:
        place = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
        out.write(bytearray(text.encode()))
        out.close()
    found = corpora.text_pairs(spark, path)
    return found.select("doc_id", F.explode("annotations").alias("a")).select("doc_id", "a.start", "a.end", "a.id")


# --- indexes and runs ---


@register(
    "index_roundtrip",
    "SELECT 'HP:' || p_size AS term, count(*) AS n, count(*) FILTER (length(regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g')) > 0) AS unit FROM part GROUP BY 1",
)
def index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index built from part names, opened with its provenance checked: vectors by term, and how many have unit length."""
    path = scratch(spark, "index")
    docs = table(spark, sf_dir, "part").select(_k().cast("string").alias("doc_id"), F.concat(F.lit("HP:"), F.col("p_size").cast("string")).alias("term"), F.lit("label").alias("component"), F.col("p_name").alias("text"))
    index.build(docs, path, "hashed", "multi", "1")
    vectors, _ = index.open_index(spark, path, model="hashed", version="1")
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return vectors.groupBy("term").agg(F.count("*").alias("n"), F.count_if(F.abs(length - 1) < 1e-6).alias("unit"))


@register("run_store", "SELECT CASE WHEN o_orderstatus = 'F' THEN 'retrieval' ELSE 'extraction' END AS type, 'd' AS dataset, 'm' AS model, o_orderstatus AS run_id, count(*) AS n FROM orders GROUP BY ALL")
def run_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of runs in a partitioned store, found again by kind and run."""
    path, orders = scratch(spark, "runs"), table(spark, sf_dir, "orders")
    for status in ("F", "O", "P"):
        index.write_run(orders.filter(F.col("o_orderstatus") == status).select("o_orderkey"), path, "retrieval" if status == "F" else "extraction", "d", "m", status)
    runs = index.read_runs(spark, path, "retrieval").unionByName(index.read_runs(spark, path, "extraction"))
    return runs.groupBy("type", "dataset", "model", "run_id").agg(F.count("*").alias("n"))
