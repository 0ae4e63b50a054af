"""Merkle manifest of a dataset: a digest for each row, a tree for each language, a root over the languages' roots.

Spark ranks the leaves of each language (a range sort and offsets of its partitions, so a language with most rows is no hot
key) and deals them into aligned buckets of 2^BUCKET_BITS neighbours. In each bucket a DuckDB block engine on the executor
runs the level queries on the bucket's Arrow rows: an ordered ``string_agg`` and ``sha256`` a level, up to the bucket's root,
with every leaf's siblings on the way. The buckets' roots are the leaves of the next round, at 1/1024 of the rows, until each
language has one; Spark joins the outer parts of the proofs to the inner ones. The roots of the languages go the same way.

Texts are digested where they are read and never move. Odd rows: every null field counts as null ("-"); rows of a null id
come last within their language and aren't tampered with; rows of a null language form a tree of their own, the first one;
repeated rows are leaves each; texts of any length are digested whole; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

#: A bucket has 2^10 leaves at most: a few hundred kB in a task, whatever the input.
BUCKET_BITS = 10

#: Outer proofs, of some 1.5 kB each, are broadcast up to so many; beyond, the join shuffles on (tree, bucket).
BROADCAST_NODES = 20_000

#: Fields of a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    """A field's form in a leaf: byte count, colon, value; "-" for null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(docs: DataFrame, **changed: Column) -> Column:
    """A row's digest; ``changed`` replaces fields."""
    return F.sha2(F.concat(*[field(changed.get(name, docs[name])) for name in FIELDS]).cast("binary"), 256)


def counted_up(docs: DataFrame) -> Column:
    """The contract's tampering: n_chars + 1 where 7 divides the id's crc32; null elsewhere. Beyond the range of long as well."""
    more = docs["n_chars"].cast("decimal(20,0)") + F.lit(1).cast("decimal(20,0)")
    return F.when(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 0, leaf(docs, n_chars=more))


def leaves(docs: DataFrame, forged: Column | None = None) -> DataFrame:
    """doc_id, tree (a language; "" for null, so that it comes first), hash and forged (a leaf to be verified instead)."""
    other = F.lit(None).cast("string") if forged is None else forged
    tree = F.coalesce(F.concat(F.lit("="), docs["lang"].cast("string")), F.lit(""))
    return docs.select("doc_id", tree.alias("tree"), leaf(docs).alias("hash"), other.alias("forged"))


def ranked(nodes: DataFrame, *order: Column) -> DataFrame:
    """Adds idx, a node's place in its tree by ``order``, and total, the tree's number of nodes.

    A range sort over all trees, and then for each partition and tree the offset that the partitions before it give. The
    offsets are one row a partition and one a tree more; the last key of the sort spreads rows that are equal in all others.
    """
    keys = [F.col("tree"), *order, F.col("seq")]
    placed = nodes.withColumn("seq", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = common.staged(placed.drop("seq").withColumn("place", F.monotonically_increasing_id()), "merkle-leaves")
    part, at = F.shiftrightunsigned("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.select("*", part.alias("part"), at.alias("at")).drop("place")

    own = Window.partitionBy("tree")
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    offsets = offsets.select("tree", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(own).alias("total"))
    offsets = common.staged(offsets, "merkle-offsets")
    if offsets.count() <= common.BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    return placed.join(offsets, ["tree", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("part", "at", "shift")


@cache
def _engine() -> duckdb.DuckDBPyConnection:
    """One DuckDB a Python worker, in memory, with one thread as Spark runs the tasks."""
    return duckdb.connect(config={"threads": 1, "memory_limit": "256MB"})


#: The levels of a bucket. A tree of one bucket ends at its root; one of several buckets has every bucket climb all levels,
#: the last with lone nodes hashed alone, as the whole tree has them.
_LEVELS = """
WITH RECURSIVE up(level, pos, hash, n) AS (
  SELECT 0, idx & {mask}, hash, count(*) OVER () FROM bucket
  UNION ALL
  SELECT level + 1, pos >> 1, sha256(string_agg(hash, '' ORDER BY pos)), (any_value(n) + 1) >> 1
  FROM up WHERE level < {bits} AND (n > 1 OR {more}) GROUP BY level, pos >> 1),
top AS (SELECT max(level) AS depth, max_by(hash, level) AS top FROM up)
SELECT b.*, coalesce(s.siblings, []) AS siblings, top.top
FROM bucket b CROSS JOIN top LEFT JOIN (
  SELECT b.idx, list(coalesce(u.hash, '') ORDER BY l.level) AS siblings
  FROM bucket b CROSS JOIN (SELECT unnest(range(depth)) AS level FROM top) l
  LEFT JOIN up u ON u.level = l.level AND u.pos = xor((b.idx & {mask}) >> l.level, 1)
  GROUP BY b.idx) s USING (idx)
"""


def _bucket_levels(schema: pa.Schema, bits: int):
    def levels(bucket: pa.Table) -> pa.Table:
        more = bucket.column("total")[0].as_py() > 1 << bits
        engine = _engine()
        engine.register("bucket", bucket)
        try:
            out = engine.sql(_LEVELS.format(mask=(1 << bits) - 1, bits=bits, more=more)).to_arrow_table()
        finally:
            engine.unregister("bucket")
        return out.select(schema.names).cast(schema)

    return levels


def climbed(nodes: DataFrame, bits: int = BUCKET_BITS) -> DataFrame:
    """Adds to (tree, idx, total, hash, ...) each node's path to its tree's root, an array of (sibling or "", whether the node
    is the right one), and that root as top."""
    schema = T.StructType([*nodes.schema.fields, T.StructField("siblings", T.ArrayType(T.StringType())), T.StructField("top", T.StringType())])
    bucket = F.shiftright("idx", bits)
    step = nodes.groupBy("tree", bucket.alias("bucket")).applyInArrow(_bucket_levels(to_arrow_schema(schema), bits), schema)
    right = lambda s, i: F.struct(s.alias("sibling"), (F.call_function("shiftright", F.col("idx"), i).bitwiseAND(F.lit(1)) == 1).alias("right"))
    step = common.staged(step.withColumn("siblings", F.transform("siblings", right)).withColumnRenamed("siblings", "path"), "merkle-buckets")
    if (step.agg(F.max("total")).first()[0] or 0) <= 1 << bits:
        return step
    mask = (1 << bits) - 1
    roots = step.where((F.col("total") > 1 << bits) & (F.col("idx").bitwiseAND(F.lit(mask)) == 0))
    roots = roots.select("tree", bucket.alias("idx"), F.shiftright(F.col("total") + F.lit(mask), bits).alias("total"), F.col("top").alias("hash"))
    outer = climbed(roots, bits).select("tree", F.col("idx").alias("bucket"), F.col("path").alias("outer"), F.col("top").alias("root"))
    if outer.count() <= BROADCAST_NODES:
        outer = F.broadcast(outer)
    joined = step.withColumn("bucket", bucket).join(outer, ["tree", "bucket"], "left")
    path = F.when(F.col("root").isNull(), F.col("path")).otherwise(F.concat("path", "outer"))
    return joined.withColumn("path", path).withColumn("top", F.coalesce("root", "top")).drop("bucket", "outer", "root")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    pair = lambda h, p: F.when(p["right"], F.concat(p["sibling"], h)).otherwise(F.concat(h, p["sibling"]))
    return F.aggregate(path, start, lambda h, p: F.sha2(pair(h, p).cast("binary"), 256))


def manifest(docs: DataFrame, forged: Column | None = None, bits: int = BUCKET_BITS) -> DataFrame:
    """One row per document: doc_id, tree, idx, hash, forged, subroot, root and the whole path to the root."""
    order = F.col("doc_id").asc_nulls_last(), F.col("hash")
    placed = climbed(ranked(leaves(docs, forged), *order), bits)
    subroots = common.staged(placed.where("idx = 0").select(F.col("tree").alias("own"), F.col("top").alias("hash")), "merkle-subroots")
    upper = climbed(ranked(subroots.withColumn("tree", F.lit("")), F.col("own")), bits)
    upper = upper.select(F.col("own").alias("tree"), F.col("path").alias("outer"), F.col("top").alias("root"))
    if upper.count() <= BROADCAST_NODES:
        upper = F.broadcast(upper)
    return placed.join(upper, "tree").select("doc_id", "tree", "idx", "hash", "forged", F.col("top").alias("subroot"), "root", F.concat("path", "outer").alias("path"))


def verified(docs: DataFrame, bits: int = BUCKET_BITS) -> DataFrame:
    """The contract's digest of a manifest whose leaves are tampered with by ``counted_up``."""
    rows = manifest(docs, counted_up(docs), bits)
    proof = F.sha2(F.array_join(F.transform("path", lambda p: p["sibling"]), "").cast("binary"), 256)
    rows = rows.withColumn("folded_root", folded(F.coalesce("forged", "hash"), F.col("path")))
    return rows.select(
        "doc_id", F.col("hash").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def oracle() -> str:
    """DuckDB SQL for ``verified``: the whole tree by levels, and every row's fold along it. crc32 goes bit by bit."""
    parts = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in FIELDS)
    forged = parts.replace("n_chars::VARCHAR", "(n_chars::HUGEINT + 1)::VARCHAR")
    return f"""
WITH RECURSIVE d AS (
  SELECT *, '=' || lang AS own, sha256({parts}) AS leaf, sha256({forged}) AS other,
    xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::UBIGINT)),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, w: xor(v >> 1, 3988292384::UBIGINT * (v & 1))))) AS crc
  FROM documents),
base AS (SELECT doc_id, coalesce(own, '') AS tree, leaf, CASE WHEN crc % 7 = 0 THEN other ELSE leaf END AS start,
    row_number() OVER (PARTITION BY own ORDER BY doc_id NULLS LAST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY own) AS n FROM d),
up(tree, level, pos, hash, n) AS (
  SELECT tree, 0, idx, leaf, n FROM base
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(hash, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM up WHERE n > 1 GROUP BY tree, level, pos // 2),
subroots AS (SELECT tree, hash, level AS depth, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
over(level, pos, hash, n) AS (
  SELECT 0, idx, hash, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(hash, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM over WHERE n > 1 GROUP BY level, pos // 2),
nodes AS (
  SELECT up.tree, up.level, up.pos, up.hash, up.n FROM up WHERE up.n > 1
  UNION ALL SELECT s.tree, s.depth + o.level, o.pos, o.hash, o.n FROM subroots s, over o),
walk(doc_id, tree, leaf, level, pos, n, hash, sibs) AS (
  SELECT doc_id, tree, leaf, 0, CASE WHEN n > 1 THEN idx ELSE (SELECT s.idx FROM subroots s WHERE s.tree = base.tree) END,
    CASE WHEN n > 1 THEN n ELSE (SELECT count(*) FROM subroots) END, start, '' FROM base
  UNION ALL
  SELECT w.doc_id, w.tree, w.leaf, w.level + 1,
    CASE WHEN w.level + 1 = s.depth THEN s.idx ELSE w.pos // 2 END,
    CASE WHEN w.level + 1 = s.depth THEN s.n ELSE (w.n + 1) // 2 END,
    sha256(CASE WHEN w.pos % 2 = 1 THEN coalesce(o.hash, '') || w.hash ELSE w.hash || coalesce(o.hash, '') END), w.sibs || coalesce(o.hash, '')
  FROM walk w JOIN subroots s ON s.tree = w.tree
  LEFT JOIN nodes o ON o.tree = w.tree AND o.level = w.level AND o.pos = xor(w.pos, 1)
  WHERE w.level < s.depth OR w.n > 1)
SELECT w.doc_id, w.leaf, s.hash AS subroot, r.hash AS root, sha256(w.sibs) AS proof_sha256, w.hash AS folded_root, w.hash = r.hash AS verified
FROM walk w JOIN subroots s ON s.tree = w.tree CROSS JOIN (SELECT hash FROM over WHERE n = 1) r
WHERE w.level >= s.depth AND w.n = 1
"""
