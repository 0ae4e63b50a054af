"""Connected components of a link table, distributed: alternating large-star and small-star turns.

Each turn is two aggregations and two joins on node keys over the links alone; the links are staged in the shared folder
every turn, so lineage stays short. A hub's links are never one group: minima come from partial aggregations and are
staged, so that the join that brings them back has a plain shuffle on either side, which adaptive execution splits where
one key holds many rows, or is a broadcast. Nodes that are their own minimum, as the hubs of finished stars are, need no
join partner at all. Turns needed grow with the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Far above what the logarithm asks for; to reach it is an error, never a silent stop.
MOST_TURNS = 60


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """links (u > v) to (u > v): hang each node's neighbours on the least node it knows."""
    if large:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.staged(both.groupBy("u").agg(F.min("v").alias("m")).filter("m < u"), "least")
        moved = both.filter("v > u").join(least, "u", "left").select(F.col("v").alias("u"), F.coalesce("m", "u").alias("v"))
    else:
        least = common.staged(links.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = links.join(least, "u")
        moved = moved.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("l")).select("l.*")
    return moved.filter("u != v").distinct()


def with_least(labelled: DataFrame, key: str) -> DataFrame:
    """The key and component_id, the least ``least`` of its root, of each row of ``labelled`` (key, root, least).

    Roots' minima are staged, so that a root that holds many rows is split in the join.
    """
    labelled = common.staged(labelled.select(key, "root", "least"), "labelled")
    least = common.staged(labelled.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    return labelled.select(key, "root").join(least, "root").select(key, "component_id")


def contracted(links: DataFrame, roots: DataFrame) -> DataFrame:
    """links (a, b) as distinct links of roots: an end without a row in ``roots`` (node, root) is its own, and none links to itself."""
    of = lambda k: roots.select(F.col("node").alias(k), F.col("root").alias("of_" + k))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    return ends.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root for each node of ``links`` (a, b, orderable of one type); root is the least node it reaches.

    Self-links, repeated links and either direction are allowed; an empty table gives no rows.
    """
    now = common.staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "links")
    mark = None
    for _ in range(MOST_TURNS):
        large = common.staged(_stars(now, True), "large-stars")  # else both its uses in the small stars would join it anew
        new = common.staged(_stars(large, False), "links")
        sums = new.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        now = new
        if sums == mark:
            break
        mark = sums
    else:
        raise RuntimeError(f"links still change after {MOST_TURNS} turns")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
