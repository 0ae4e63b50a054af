"""Operators on an is-a graph: closure with distances, depths, ancestors in common, similarities, credits."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import checkpointed

ROUND = 6


def closure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """term, ancestor, up: the reflexive transitive closure with the fewest steps up.

    ``nodes`` is (term), ``edges`` (child, parent). Level by level: only pairs that the last level found are extended and
    only new ones kept, so a pair's first level is its distance, and paths are never enumerated. Every level is
    checkpointed, so that none is computed twice. Graphs of any depth will do; a cycle gives no new
    pairs, ends the search like any other graph and is then reported as an error.
    """
    edges = checkpointed(edges.select("child", "parent").distinct())
    found = [checkpointed(nodes.select("term", F.col("term").alias("ancestor"), F.lit(0).alias("up")).distinct())]
    for level in count(1):
        step = found[-1].join(edges, found[-1]["ancestor"] == edges["child"]).select("term", F.col("parent").alias("ancestor")).distinct()
        known = reduce(DataFrame.unionByName, found)
        found.append(checkpointed(step.join(known, ["term", "ancestor"], "left_anti").withColumn("up", F.lit(level))))
        if found[-1].isEmpty():
            break
    looped = edges.join(known, (F.col("parent") == F.col("term")) & (F.col("child") == F.col("ancestor"))).limit(1).collect()
    if looped:
        raise ValueError(f"the graph has a cycle through {looped[0].child}")
    return known


def depths(closed: DataFrame, root: str) -> DataFrame:
    """term, depth: fewest steps from the root, -1 where it isn't reached."""
    return closed.groupBy("term").agg(F.coalesce(F.min(F.when(F.col("ancestor") == root, F.col("up"))), F.lit(-1)).alias("depth"))


def descendants(closed: DataFrame) -> DataFrame:
    """term, n_descendants, itself included."""
    return closed.groupBy(F.col("ancestor").alias("term")).agg(F.count("*").alias("n_descendants"))


def information_content(closed: DataFrame, root: str) -> DataFrame:
    """term, ic = -ln(descendants / descendants of the root)."""
    n = descendants(closed)
    total = n.filter(F.col("term") == root).select(F.col("n_descendants").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("term", F.round(F.abs(F.log(F.col("n_descendants") / F.col("total"))), ROUND).alias("ic"))


def reduced_parents(closed: DataFrame) -> DataFrame:
    """child, parent: the transitive reduction, strict ancestors that no other strict ancestor lies below."""
    strict = closed.filter(F.col("up") > 0).select("term", "ancestor")
    lower, upper = strict.select(F.col("term").alias("t"), F.col("ancestor").alias("q")), strict.select(F.col("term").alias("q"), F.col("ancestor").alias("p"))
    covered = lower.join(upper, "q").select(F.col("t").alias("term"), F.col("p").alias("ancestor")).distinct()
    return strict.join(covered, ["term", "ancestor"], "left_anti").select(F.col("term").alias("child"), F.col("ancestor").alias("parent"))


def branches(closed: DataFrame, root: str) -> DataFrame:
    """term, branch, branches: the smallest ancestor at depth 1, and all of them; the root has none."""
    depth = depths(closed, root)
    tops = depth.filter("depth = 1").select(F.col("term").alias("ancestor"))  # may be many: the join's kind is the planner's choice
    found = closed.join(tops, "ancestor").groupBy("term").agg(F.sort_array(F.collect_set("ancestor")).alias("branches"))
    return closed.select("term").distinct().join(found, "term", "left").select("term", F.get("branches", F.lit(0)).alias("branch"), F.coalesce("branches", F.array().cast("array<string>")).alias("branches"))


def term_features(closed: DataFrame, root: str) -> DataFrame:
    """term, depth, parents, ancestors (array of id, up, depth, ic), rep and twin: one row a term.

    Terms with nothing below them and the same strict ancestors, as far up, are alike: they differ in their names only. ``rep`` and
    ``twin`` are the first and the last term that is like the row's; a term that has terms below is like itself alone.
    """
    depth, ic = depths(closed, root), information_content(closed, root)
    about = depth.join(ic, "term").select(F.col("term").alias("ancestor"), F.col("depth").alias("a_depth"), "ic")
    rows = closed.join(about, "ancestor").groupBy("term").agg(F.sort_array(F.collect_list(F.struct(F.col("ancestor").alias("id"), "up", F.col("a_depth").alias("depth"), "ic"))).alias("ancestors"))
    grand = checkpointed(reduced_parents(closed))
    parents = grand.groupBy(F.col("child").alias("term")).agg(F.sort_array(F.collect_set("parent")).alias("parents"))
    above = grand.alias("a").join(grand.alias("b"), F.col("a.parent") == F.col("b.child")).groupBy(F.col("a.child").alias("term")).agg(F.collect_set("b.parent").alias("grandparents"))
    none = F.array().cast("array<string>")
    inner = closed.filter(F.col("up") > 0).select(F.col("ancestor").alias("term")).distinct().withColumn("inner", F.lit(True))
    strict = F.transform(F.filter("ancestors", lambda p: p["up"] > 0), lambda p: F.struct(p["id"].alias("id"), p["up"].alias("up")))
    leaves = rows.join(inner, "term", "left_anti").select("term", strict.alias("strict"))
    alike = leaves.groupBy("strict").agg(F.min("term").alias("rep"), F.max("term").alias("twin"))
    reps = leaves.join(alike, "strict").select("term", "rep", "twin")
    return (
        rows.join(depth, "term").join(parents, "term", "left").join(above, "term", "left").join(reps, "term", "left")
        .select("term", "depth", "ancestors", F.coalesce("parents", none).alias("parents"), F.coalesce("grandparents", none).alias("grandparents"), F.coalesce("rep", "term").alias("rep"), F.coalesce("twin", "term").alias("twin"))
    )


def pair_features(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """Features of (a, b): lca, lca_depth, path, distance, resnik, hybrid, simple and kinship flags.

    A term that isn't in the graph has null features. Of common ancestors with equal depth the smallest id is the LCA;
    those that the root doesn't reach are never one. Pairs of terms that are alike have the same features, so these are found
    once for such pairs, and long rows meet short pairs only.
    """
    known = terms.select("term", "rep", "twin")
    rows = pairs.join(known.select(F.col("term").alias("a"), F.col("rep").alias("like_a"), "twin"), "a", "left").join(known.select(F.col("term").alias("b"), F.col("rep").alias("like_b")), "b", "left")
    like_a, like_b = F.coalesce("like_a", "a"), F.coalesce("like_b", "b")
    # two terms that are like each other are as the first and the last of their kind
    like_b = F.when((F.col("a") != F.col("b")) & (like_a == like_b), F.col("twin")).otherwise(like_b)
    rows = checkpointed(rows.select(*pairs.columns, like_a.alias("like_a"), like_b.alias("like_b")))
    found = _features(rows.select(F.col("like_a").alias("a"), F.col("like_b").alias("b")).distinct(), terms.drop("rep", "twin"))
    found = found.withColumnsRenamed({"a": "_a", "b": "_b"})
    rows = rows.join(found, F.col("like_a").eqNullSafe(F.col("_a")) & F.col("like_b").eqNullSafe(F.col("_b")))
    lca = F.when(F.col("lca") == F.col("like_a"), F.col("a")).otherwise(F.col("lca"))  # of a term that is like others, with itself
    return rows.withColumn("lca", lca).drop("_a", "_b", "like_a", "like_b")


def _features(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    deepest = F.broadcast(terms.agg(F.greatest(F.max("depth"), F.lit(1)).alias("max_depth")))
    x = terms.select(*[F.col(c).alias(("a" if c == "term" else c + "_a")) for c in terms.columns])
    y = terms.select(*[F.col(c).alias(("b" if c == "term" else c + "_b")) for c in terms.columns])
    rows = pairs.join(x, "a", "left").join(y, "b", "left").crossJoin(deepest)
    shared = F.filter("ancestors_a", lambda p: F.exists("ancestors_b", lambda q: q["id"] == p["id"]))
    rows = rows.withColumn("common", shared)
    best = F.array_min(F.transform(F.filter("common", lambda c: c["depth"] >= 0), lambda c: F.struct((-c["depth"]).alias("d"), c["id"].alias("id"))))
    ups = F.transform("common", lambda c: c["up"] + F.element_at(F.filter("ancestors_b", lambda q: q["id"] == c["id"]), 1)["up"])
    rows = rows.withColumns({"best": best, "distance": F.array_min(ups), "resnik": F.coalesce(F.array_max(F.transform("common", lambda c: c["ic"])), F.lit(0.0))})
    rows = rows.withColumns({"lca": F.col("best.id"), "lca_depth": -F.col("best.d")})
    total = F.col("depth_a") + F.col("depth_b")
    rows = rows.withColumn("path", F.greatest(total - 2 * F.col("lca_depth"), F.lit(0)))
    part = 0.7 * F.col("lca_depth") / F.col("max_depth") + 0.3 * (1 - F.coalesce(F.try_divide(F.col("path"), total), F.lit(0.0)))
    known = F.col("ancestors_a").isNotNull() & F.col("ancestors_b").isNotNull()
    unknown = F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0)
    hybrid = F.when(~known, unknown).when(F.col("a") == F.col("b"), 1.0).when(F.col("lca").isNull(), 0.0).when(F.col("path") == 0, 1.0).otherwise(unit(part))
    simple = F.when(~known, unknown).when(F.col("a") == F.col("b"), 1.0).when(F.col("lca").isNull(), 0.0).otherwise(unit(F.col("lca_depth") / F.col("max_depth")))
    up_to = lambda own, other: F.exists(F.coalesce(F.col(own), F.array().cast("array<struct<id:string,up:int,depth:int,ic:double>>")), lambda p: p["id"] == F.col(other)) & (F.col("a") != F.col("b"))
    return rows.withColumns({
        "hybrid": F.round(hybrid, ROUND), "simple": F.round(simple, ROUND),
        "a_below": up_to("ancestors_a", "b"), "a_above": up_to("ancestors_b", "a"),
        "siblings": F.coalesce(F.arrays_overlap("parents_a", "parents_b"), F.lit(False)),
        "cousins": F.coalesce(F.arrays_overlap("grandparents_a", "grandparents_b"), F.lit(False)),
    }).drop("best", "common", "ancestors_a", "ancestors_b", "parents_a", "parents_b", "grandparents_a", "grandparents_b", "max_depth")


def unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def match_kind(floor: float = 0.30) -> Column:
    """Of a predicted term (a) and a gold term (b) with ``pair_features``."""
    return (
        F.when(F.col("a") == F.col("b"), "exact").when(F.col("a_below"), "descendant").when(F.col("a_above"), "ancestor")
        .when(F.col("siblings"), "sibling").when(F.col("cousins"), "cousin").when(F.col("hybrid") >= floor, "semantic").otherwise("unrelated")
    )


def pair_credit(floor: float = 0.30) -> Column:
    kind, d, sim = match_kind(floor), F.col("distance"), F.col("hybrid")
    return F.round(
        F.when(kind == "exact", 1.0)
        .when(kind == "descendant", F.greatest(F.lit(0.75), 0.95 - 0.05 * (d - 1)))
        .when(kind == "ancestor", F.greatest(F.lit(0.5), 0.85 - 0.08 * (d - 1)))
        .when(kind == "sibling", F.greatest(sim, F.lit(0.65)))
        .when(kind == "cousin", F.greatest(sim, F.lit(0.45)))
        .when(kind == "semantic", sim).otherwise(0.0), ROUND
    )


def partial_credit() -> Column:
    kind, d = match_kind(floor=2.0), F.col("distance")
    return F.round(
        F.when(kind == "exact", 1.0).when(kind == "ancestor", F.greatest(F.lit(0.5), 1 - 0.1 * d)).when(kind == "descendant", F.greatest(F.lit(0.7), 1 - 0.05 * d))
        .when(kind == "sibling", 0.7).when(kind == "cousin", 0.5).otherwise(0.0), ROUND
    )
