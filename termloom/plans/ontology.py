"""Graph queries. Regions, nations, customers and suppliers are a tree; parts hang below both their brand and their type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import graph
from ..storage import checkpointed, table, table_state

ROOT = "T:0"

_GRAPH = """e(child, parent) AS (SELECT 'R:' || r_regionkey, 'T:0' FROM region UNION SELECT 'N:' || n_nationkey, 'R:' || n_regionkey FROM nation
  UNION SELECT 'C:' || c_custkey, 'N:' || c_nationkey FROM customer UNION SELECT 'S:' || s_suppkey, 'N:' || s_nationkey FROM supplier
  UNION SELECT 'B:' || p_brand, 'T:0' FROM part UNION SELECT 'Y:' || p_type, 'T:0' FROM part
  UNION SELECT 'P:' || p_partkey, 'B:' || p_brand FROM part UNION SELECT 'P:' || p_partkey, 'Y:' || p_type FROM part),
node(term) AS (SELECT child FROM e UNION SELECT parent FROM e),
up(term, ancestor, up) AS (SELECT term, term, 0 FROM node UNION SELECT up.term, e.parent, up.up + 1 FROM up JOIN e ON up.ancestor = e.child),
cl AS (SELECT term, ancestor, min(up) AS up FROM up GROUP BY term, ancestor),
dp AS (SELECT term, coalesce(min(up) FILTER (ancestor = 'T:0'), -1) AS depth FROM cl GROUP BY term),
ds AS (SELECT ancestor AS term, count(*) AS n_descendants FROM cl GROUP BY ancestor),
ic AS (SELECT term, round(abs(ln(n_descendants / (SELECT n_descendants FROM ds WHERE term = 'T:0'))), 6) AS ic FROM ds)"""
_REC = "WITH RECURSIVE " + _GRAPH


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def link(name: str, child: tuple[str, str], parent: tuple[str, str] | None) -> DataFrame:
        key = lambda p: F.concat(F.lit(p[0] + ":"), F.col(p[1]).cast("string"))
        return table(spark, sf_dir, name).select(key(child).alias("child"), (key(parent) if parent else F.lit(ROOT)).alias("parent"))

    parts = [
        link("region", ("R", "r_regionkey"), None), link("nation", ("N", "n_nationkey"), ("R", "n_regionkey")),
        link("customer", ("C", "c_custkey"), ("N", "c_nationkey")), link("supplier", ("S", "s_suppkey"), ("N", "s_nationkey")),
        link("part", ("B", "p_brand"), None), link("part", ("Y", "p_type"), None),
        link("part", ("P", "p_partkey"), ("B", "p_brand")), link("part", ("P", "p_partkey"), ("Y", "p_type")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


#: Closures and term features by application and state of the tables; their rows are checkpointed, what is kept here are plans.
_KEPT: dict[tuple, DataFrame] = {}
_TABLES = ("region", "nation", "customer", "supplier", "part")


def _kept(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """What was made of these very files in this session; tables that were written anew since are read anew."""
    key = (spark.sparkContext.applicationId, sf_dir, name, table_state(spark, sf_dir, _TABLES))
    if key not in _KEPT:
        for old in [k for k in _KEPT if k[0] != key[0] or k[1:3] == key[1:3]]:  # of sessions that have ended, and of older files
            del _KEPT[old]
        _KEPT[key] = make()
    return _KEPT[key]


def _closure(e: DataFrame) -> DataFrame:
    nodes = e.select(F.col("child").alias("term")).union(e.select("parent")).distinct()
    return graph.closure(nodes, e)


def closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph's closure, built once a session for the files as they are."""
    return _kept(spark, sf_dir, "closure", lambda: _closure(edges(spark, sf_dir)))


def about_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term features, built once a session for the files as they are."""
    return _kept(spark, sf_dir, "features", lambda: checkpointed(graph.term_features(closed(spark, sf_dir), ROOT)))


@register("dag_closure", _REC + " SELECT term, ancestor, up FROM cl")
def dag_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closed(spark, sf_dir)


@register("dag_depth", _REC + " SELECT term, depth FROM dp")
def dag_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.depths(closed(spark, sf_dir), ROOT)


@register("dag_descendants", _REC + " SELECT term, n_descendants FROM ds")
def dag_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.descendants(closed(spark, sf_dir))


@register("dag_ic", _REC + " SELECT term, ic FROM ic")
def dag_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.information_content(closed(spark, sf_dir), ROOT)


@register("dag_parents_reduced", _REC + " SELECT child, parent FROM e")
def dag_parents_reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph with shortcuts to grandparents and to the root: its reduction has none of them."""
    e = edges(spark, sf_dir)
    above = e.select(F.col("child").alias("parent"), F.col("parent").alias("over")).join(e, "parent").select("child", F.col("over").alias("parent"))
    root = e.filter(F.col("parent") != ROOT).select("child", F.lit(ROOT).alias("parent"))
    return graph.reduced_parents(_closure(e.union(above).union(root).distinct()))


@register(
    "dag_branch",
    _REC + """, b AS (SELECT cl.term, min(cl.ancestor) AS branch, string_agg(cl.ancestor, ',' ORDER BY cl.ancestor) AS branches FROM cl JOIN dp ON dp.term = cl.ancestor AND dp.depth = 1 GROUP BY 1)
SELECT node.term, b.branch, coalesce(b.branches, '') AS branches FROM node LEFT JOIN b USING (term)""",
)
def dag_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.branches(closed(spark, sf_dir), ROOT).withColumn("branches", F.array_join("branches", ","))


def term_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): customers with the suppliers of their orders, and parts on successive lines of an order."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    key = lambda p, c: F.concat(F.lit(p + ":"), F.col(c).cast("string"))
    trade = lines.select("l_orderkey", "l_suppkey").join(orders, "l_orderkey").select(key("C", "o_custkey").alias("a"), key("S", "l_suppkey").alias("b"))
    follow = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    parts = lines.select("l_partkey", follow.alias("next")).filter("next IS NOT NULL").select(key("P", "l_partkey").alias("a"), key("P", "next").alias("b"))
    return trade.union(parts).distinct()


_PAIRS = _REC + """, p AS (SELECT DISTINCT 'C:' || o_custkey AS a, 'S:' || l_suppkey AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  UNION SELECT 'P:' || l_partkey, 'P:' || nxt FROM (SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS nxt FROM lineitem) WHERE nxt IS NOT NULL),
"""
_FEATURES = """cm AS (SELECT p.a, p.b, x.ancestor, x.up + y.up AS ups, d.depth, ic.ic FROM p JOIN cl x ON x.term = p.a JOIN cl y ON y.term = p.b AND y.ancestor = x.ancestor JOIN dp d ON d.term = x.ancestor JOIN ic ON ic.term = x.ancestor),
lc AS (SELECT a, b, arg_min(ancestor, (-depth, ancestor)) FILTER (depth >= 0) AS lca, max(depth) FILTER (depth >= 0) AS lca_depth, min(ups) AS distance, max(ic) AS resnik FROM cm GROUP BY a, b),
s0 AS (SELECT lc.*, da.depth AS da, db.depth AS db, greatest(da.depth + db.depth - 2 * lca_depth, 0) AS path, (SELECT greatest(max(depth), 1) FROM dp) AS md FROM lc JOIN dp da ON da.term = a JOIN dp db ON db.term = b),
f AS (SELECT *, round(CASE WHEN a = b OR path = 0 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.7::DOUBLE * lca_depth / md + 0.3::DOUBLE * (1 - path / (da + db)))) END, 6) AS hybrid,
  round(CASE WHEN a = b THEN 1.0::DOUBLE ELSE lca_depth / md END, 6) AS simple FROM s0)"""
_KIND = """, k AS (SELECT f.*, CASE WHEN a = b THEN 'exact' WHEN EXISTS (SELECT 1 FROM cl WHERE cl.term = f.a AND cl.ancestor = f.b) THEN 'descendant'
  WHEN EXISTS (SELECT 1 FROM cl WHERE cl.term = f.b AND cl.ancestor = f.a) THEN 'ancestor'
  WHEN EXISTS (SELECT 1 FROM e x JOIN e y ON x.parent = y.parent WHERE x.child = f.a AND y.child = f.b) THEN 'sibling'
  WHEN EXISTS (SELECT 1 FROM e x JOIN e x2 ON x2.child = x.parent JOIN e y2 ON y2.parent = x2.parent JOIN e y ON y.parent = y2.child WHERE x.child = f.a AND y.child = f.b) THEN 'cousin'
  WHEN hybrid >= 0.3 THEN 'semantic' ELSE 'unrelated' END AS kind FROM f)"""


def features(spark: SparkSession, sf_dir: str, pairs: DataFrame | None = None) -> DataFrame:
    return graph.pair_features(term_pairs(spark, sf_dir) if pairs is None else pairs, about_terms(spark, sf_dir))


def _pairwise(name: str, *columns: str) -> None:
    @register(name, f"{_PAIRS}{_FEATURES} SELECT a, b, {', '.join(columns)} FROM f")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return features(spark, sf_dir).select("a", "b", *columns)


_pairwise("dag_lca", "lca", "lca_depth")
_pairwise("dag_sim_hybrid", "hybrid")
_pairwise("dag_sim_simple", "simple")
_pairwise("dag_resnik", "resnik")
_pairwise("dag_path", "path", "distance")


@register("dag_match_kind", f"{_PAIRS}{_FEATURES}{_KIND} SELECT kind, count(*) AS n FROM k GROUP BY kind")
def dag_match_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).groupBy(graph.match_kind().alias("kind")).agg(F.count("*").alias("n"))


_CREDIT = """round(CASE kind WHEN 'exact' THEN 1.0::DOUBLE WHEN 'descendant' THEN greatest(0.75::DOUBLE, 0.95::DOUBLE - 0.05::DOUBLE * (distance - 1))
WHEN 'ancestor' THEN greatest(0.5::DOUBLE, 0.85::DOUBLE - 0.08::DOUBLE * (distance - 1)) WHEN 'sibling' THEN greatest(hybrid, 0.65::DOUBLE) WHEN 'cousin' THEN greatest(hybrid, 0.45::DOUBLE)
WHEN 'semantic' THEN hybrid ELSE 0.0::DOUBLE END, 6)"""


@register(
    "dag_pair_credit",
    f"""{_PAIRS}{_FEATURES}{_KIND} SELECT a, b, kind, {_CREDIT} AS credit FROM k""",
)
def dag_pair_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("a", "b", graph.match_kind().alias("kind"), graph.pair_credit().alias("credit"))


@register(
    "dag_partial_credit",
    f"""{_PAIRS}{_FEATURES}{_KIND} SELECT a, b, round(CASE kind WHEN 'exact' THEN 1.0::DOUBLE WHEN 'ancestor' THEN greatest(0.5::DOUBLE, 1 - 0.1::DOUBLE * distance)
WHEN 'descendant' THEN greatest(0.7::DOUBLE, 1 - 0.05::DOUBLE * distance) WHEN 'sibling' THEN 0.7::DOUBLE WHEN 'cousin' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END, 6) AS partial FROM k""",
)
def dag_partial_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("a", "b", graph.partial_credit().alias("partial"))


def order_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, role, term: of an order, parts on odd lines are expected and those on even lines are retrieved."""
    lines = table(spark, sf_dir, "lineitem")
    role = F.when(F.col("l_linenumber") % 2 == 1, "expected").otherwise("retrieved")
    return lines.select(F.col("l_orderkey").alias("case_id"), role.alias("role"), F.concat(F.lit("P:"), F.col("l_partkey").cast("string")).alias("term")).distinct()


@register(
    "dag_max_ont_sim",
    f"""WITH RECURSIVE {_GRAPH}, t AS (SELECT DISTINCT l_orderkey AS case_id, l_linenumber % 2 AS odd, 'P:' || l_partkey AS term FROM lineitem),
q AS (SELECT x.case_id, x.term AS a, y.term AS b FROM t x JOIN t y ON x.case_id = y.case_id AND x.odd = 1 AND y.odd = 0), p AS (SELECT DISTINCT a, b FROM q),
{_FEATURES}, g AS (SELECT case_id, a, max(hybrid) AS m FROM q JOIN f USING (a, b) GROUP BY case_id, a)
SELECT case_id, max(m) AS max_sim, round(avg(m), 5) AS average_max FROM g GROUP BY case_id""",
)
def dag_max_ont_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each case: the best similarity of any expected and retrieved term, and the mean of each expected term's best."""
    rows = order_terms(spark, sf_dir)
    side = lambda role, name: rows.filter(F.col("role") == role).select("case_id", F.col("term").alias(name))
    pairs = side("expected", "a").join(side("retrieved", "b"), "case_id")
    sims = features(spark, sf_dir, pairs.select("a", "b").distinct()).select("a", "b", "hybrid")
    best = pairs.join(sims, ["a", "b"]).groupBy("case_id", "a").agg(F.max("hybrid").alias("m"))
    return best.groupBy("case_id").agg(F.max("m").alias("max_sim"), F.round(F.avg("m"), 5).alias("average_max"))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term table of the parts: id, label, definition, synonyms, comments."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.concat(F.lit("P:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("label"),
        F.when(F.col("p_size") > 25, F.concat(F.lit("of size "), F.col("p_size").cast("string"))).otherwise("").alias("definition"),
        F.array("p_brand", F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("")).alias("synonyms"), F.array().cast("array<string>").alias("comments"),
    )


_TERMS = """t AS (SELECT 'P:' || p_partkey AS id, p_name AS label, CASE WHEN p_size > 25 THEN 'of size ' || p_size ELSE '' END AS definition, [p_brand, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END] AS synonyms FROM part)"""


def term_documents(found: DataFrame) -> DataFrame:
    """One text a term: label, synonyms, definition, notes, each on its line."""
    some = F.filter("synonyms", lambda s: s != "")
    return found.select(
        "id",
        F.concat_ws(
            "\n", F.concat(F.lit("Term: "), F.col("label")), F.when(F.size(some) > 0, F.concat(F.lit("Synonyms: "), F.array_join(some, "; "))),
            F.when(F.col("definition") != "", F.concat(F.lit("Definition: "), F.col("definition"))), F.when(F.size("comments") > 0, F.concat(F.lit("Notes: "), F.array_join("comments", "; "))),
        ).alias("document"), (F.col("definition") != "").alias("has_definition"), F.size("synonyms").cast("long").alias("synonym_count"),
    )


@register(
    "term_documents",
    f"""WITH {_TERMS}, s AS (SELECT *, list_filter(synonyms, lambda x: x <> '') AS filled FROM t)
SELECT id, concat_ws(chr(10), 'Term: ' || label, CASE WHEN len(filled) > 0 THEN 'Synonyms: ' || array_to_string(filled, '; ') END, CASE WHEN definition <> '' THEN 'Definition: ' || definition END) AS document,
definition <> '' AS has_definition, len(synonyms) AS synonym_count FROM s""",
)
def q_term_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_documents(terms(spark, sf_dir))


def component_documents(found: DataFrame) -> DataFrame:
    """A row for each label, non-empty synonym (its index kept) and definition; id ``term__component__index``."""
    one = lambda name, column: found.filter(F.col(column) != "").select("id", F.lit(name).alias("component"), F.lit(0).alias("index"), F.col(column).alias("text"))
    many = found.select("id", F.posexplode("synonyms").alias("index", "text")).filter("text <> ''").select("id", F.lit("synonym").alias("component"), "index", "text")
    rows = one("label", "label").unionByName(many).unionByName(one("definition", "definition"))
    return rows.select(F.concat_ws("__", "id", "component", F.col("index").cast("string")).alias("doc_id"), F.col("id").alias("term"), "component", "index", "text")


@register(
    "component_documents",
    f"""WITH {_TERMS}, r AS (SELECT id, 'label' AS component, 0 AS index, label AS text FROM t UNION ALL SELECT id, 'definition', 0, definition FROM t
UNION ALL SELECT id, 'synonym', i, synonyms[i + 1] FROM t, range(0, 2) x(i)) SELECT id || '__' || component || '__' || index AS doc_id, id AS term, component, index, text FROM r WHERE text <> ''""",
)
def q_component_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_documents(terms(spark, sf_dir))
