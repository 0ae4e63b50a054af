"""URL filters: rules by host and path prefix, and for other URLs a tree of path templates for each host.

Rules give some URLs a verdict, and these are the labels of the tree. Paths are masked first (runs of digits, long hexadecimal
strings) and counted by host and masked path: a table of shapes, which the tree's levels work on instead of the URLs. Level by
level, from the host down, the segments that follow a node are its branches. A branch stays a constant if it has LEAST_ROWS
URLs and differs from its siblings' pool, in the share of blocked labels or in the share of paths that end there, by Z standard
errors, or if it has no siblings; all others are variable or statistically similar, and merge into one wildcard. A template's purity is
its share of blocked labels, smoothed by PRIOR labels of its parent's purity, up to the host's and the whole table's;
templates with a purity of REJECT or more are rejected.

Each branch is compared with one pool, never with all siblings. A hot host is no hot key: counts are summed before they move,
and joins are broadcasts up to a checked size, else shuffled ones whose large side adaptive execution may split.

Odd rows: a null URL or one without "://" has an empty host and path; repeated rows and ids are rows each; null ids stay null;
segments beyond DEPTH - 1 make one segment; URLs of any length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Rules of the contract, as verdict, host and path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: A branch of fewer URLs is variable; standard errors by which a branch must differ; labels that a parent's purity counts as.
LEAST_ROWS, Z, PRIOR = 8, 2.58, 4

#: Smoothed share of blocked labels at which a template is rejected; levels of the tree.
REJECT, DEPTH = 2 / 3, 8

_HOST, _PATH = r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)"
_HEX, _DIGITS = r"[0-9A-Fa-f]{8,}(-[0-9A-Fa-f]{4,})*", "[0-9]+"


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host and path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.translate(F.regexp_extract(url, _HOST, 1), string.ascii_uppercase, string.ascii_lowercase)
    return pages.select("page_id", host.alias("host"), F.regexp_extract(url, _PATH, 1).alias("path"))


def rule_and_verdict(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits host and path, as "host/path", and its verdict; null where none fits. Of rules of one
    length that fit (they are equal then) the first counts. Rules are a parameter: some thousands at most."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def shape() -> Column:
    """A path with its runs of digits and long hexadecimal strings masked."""
    return F.regexp_replace(F.regexp_replace("path", _HEX, "{h}"), _DIGITS, "{n}")


def _differ(hits: str, of: str, all_hits: str, all_of: str) -> Column:
    """Whether a branch's share and its siblings' differ by Z standard errors; half a hit is added on either side."""
    a, n, b, m = F.col(hits), F.col(of), F.col(all_hits) - F.col(hits), F.col(all_of) - F.col(of)
    pooled = (a + b + F.lit(1.0)) / (n + m + F.lit(2.0))
    apart = (a + F.lit(0.5)) / (n + F.lit(1.0)) - (b + F.lit(0.5)) / (m + F.lit(1.0))
    return (n > 0) & (m > 0) & (apart * apart > F.lit(Z * Z) * pooled * (F.lit(1.0) - pooled) * (F.lit(1.0) / (n + F.lit(1.0)) + F.lit(1.0) / (m + F.lit(1.0))))


def _looked_up(df: DataFrame, small: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join with a table of one row a key, staged and counted first: broadcast up to BROADCAST_ROWS."""
    small = common.staged(small, "urls-lookup")
    return df.join(F.broadcast(small) if small.count() <= common.BROADCAST_ROWS else small, keys, how)


def _purity(parent: Column) -> Column:
    return (F.col("blocked") + F.lit(float(PRIOR)) * parent) / (F.col("labelled") + F.lit(float(PRIOR)))


def templates(urls: DataFrame) -> DataFrame:
    """host, shape, template and purity of every shape of ``urls`` (host, path, verdict: a rule's or null)."""
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    shapes = urls.groupBy("host", shape().alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.count("verdict").alias("labelled"), F.count_if(F.col("verdict") == "block").alias("blocked"))
    shapes = common.staged(shapes, "urls-shapes")
    depth, labelled, blocked = shapes.agg(F.max(F.size(F.split("shape", "/", DEPTH + 1)) - 1), F.sum("labelled"), F.sum("blocked")).first()
    hosts = shapes.groupBy("host").agg(*sums).select("host", _purity(F.lit(((blocked or 0) + 1) / ((labelled or 0) + 2))).alias("purity"))
    tree = _looked_up(shapes.withColumn("segments", F.split("shape", "/", DEPTH + 1)), hosts, ["host"]).withColumn("template", F.lit(""))
    for level in range(1, (depth or 0) + 1):
        tree = common.staged(tree.withColumn("segment", F.get("segments", F.lit(level))), "urls-tree")
        ends = F.sum(F.when(F.size("segments") == level + 1, F.col("n")).otherwise(0)).alias("ends")
        branches = tree.where(F.col("segment").isNotNull()).groupBy("host", "template", "segment").agg(*sums, ends)
        pools = branches.groupBy("host", "template").agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "blocked", "ends")])
        apart = _differ("blocked", "labelled", "all_blocked", "all_labelled") | _differ("ends", "n", "all_ends", "all_n") | (F.col("n") == F.col("all_n"))
        constants = _looked_up(branches.where(F.col("n") >= LEAST_ROWS), pools, ["host", "template"]).where(apart)
        step = F.when(F.col("segment").isNotNull(), F.concat(F.col("template"), F.lit("/"), F.when(F.col("constant"), F.col("segment")).otherwise("*")))
        tree = _looked_up(tree, constants.select("host", "template", "segment", F.lit(True).alias("constant")), ["host", "template", "segment"])
        tree = common.staged(tree.withColumn("step", step).drop("constant"), "urls-steps")
        nodes = tree.where(F.col("step").isNotNull()).groupBy("host", "step").agg(*sums, F.max("purity").alias("parent"))
        nodes = nodes.select("host", "step", _purity(F.col("parent")).alias("own"))
        tree = _looked_up(tree, nodes, ["host", "step"])
        tree = tree.withColumn("purity", F.coalesce("own", "purity")).withColumn("template", F.coalesce("step", "template")).drop("own", "step", "segment")
    return common.staged(tree.select("host", "shape", "template", "purity"), "urls-templates")


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict (the rule's, else the template's), template and its smoothed purity."""
    rule, verdict = rule_and_verdict(rules)
    urls = parsed(pages).withColumns({"rule": rule, "verdict": verdict})
    found = templates(urls.select("host", "path", "verdict"))
    if found.count() <= common.BROADCAST_ROWS:
        found = F.broadcast(found)
    urls = urls.withColumn("shape", shape()).join(found, ["host", "shape"], "left")
    verdict = F.coalesce("verdict", F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    return urls.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def oracle(rules: Sequence[tuple[str, str, str]] = RULES, depth: int = DEPTH) -> str:
    """DuckDB SQL for page_id, host, path, rule, verdict and template: the same tree, every level written out."""
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", k, h + p) for k, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))]
    differ = lambda a, n, b, m: f"({n} > 0 AND {m} > 0 AND pow(({a} + 0.5::DOUBLE) / ({n} + 1) - ({b} + 0.5::DOUBLE) / ({m} + 1), 2) > {Z * Z}::DOUBLE * (({a} + {b} + 1.0::DOUBLE) / ({n} + {m} + 2)) * (1 - ({a} + {b} + 1.0::DOUBLE) / ({n} + {m} + 2)) * (1.0::DOUBLE / ({n} + 1) + 1.0::DOUBLE / ({m} + 1)))"
    parts = [f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{_HOST}', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
  regexp_extract(coalesce(url, ''), '{_PATH}', 1) AS path FROM pages),
r AS (SELECT *, CASE {' '.join(f"WHEN {f} THEN '{name}'" for f, _, name in fits)} END AS rule, CASE {' '.join(f"WHEN {f} THEN '{kind}'" for f, kind, _ in fits)} END AS own,
  regexp_replace(regexp_replace(path, '{_HEX}', '{{h}}', 'g'), '{_DIGITS}', '{{n}}', 'g') AS shape FROM u),
total AS (SELECT (count_if(own = 'block') + 1.0::DOUBLE) / (count(own) + 2) AS purity FROM r),
h AS (SELECT host, (count_if(own = 'block') + {PRIOR} * (SELECT purity FROM total)) / (count(own) + {PRIOR}) AS purity FROM r GROUP BY host),
s AS (SELECT r.host, shape, string_split(shape, '/') AS parts, count(*) AS n, count(own) AS labelled, count_if(own = 'block') AS blocked, any_value(h.purity) AS purity
  FROM r JOIN h ON h.host = r.host GROUP BY r.host, shape),
t0 AS MATERIALIZED (SELECT host, shape, n, labelled, blocked, purity, '' AS template,
  CASE WHEN len(parts) > {depth + 1} THEN list_append(parts[1:{depth}], array_to_string(parts[{depth + 1}:], '/')) ELSE parts END AS parts FROM s)"""]  # fmt: skip
    for level in range(1, depth + 1):
        t, at = f"t{level - 1}", level + 1
        parts.append(f"""
b{level} AS (SELECT host, template, parts[{at}] AS segment, sum(n) AS n, sum(labelled) AS l, sum(blocked) AS k, sum(CASE WHEN len(parts) = {at} THEN n ELSE 0 END) AS e
  FROM {t} WHERE len(parts) >= {at} GROUP BY ALL),
c{level} AS (SELECT b.* FROM b{level} b JOIN (SELECT host, template, sum(n) AS an, sum(l) AS al, sum(k) AS ak, sum(e) AS ae FROM b{level} GROUP BY ALL) p USING (host, template)
  WHERE n >= {LEAST_ROWS} AND (n = an OR {differ('k', 'l', '(ak - k)', '(al - l)')} OR {differ('e', 'n', '(ae - e)', '(an - n)')})),
s{level} AS MATERIALIZED (SELECT x.*, CASE WHEN len(parts) >= {at} THEN x.template || '/' || coalesce(c.segment, '*') END AS step
  FROM {t} x LEFT JOIN c{level} c ON c.host = x.host AND c.template = x.template AND c.segment = parts[{at}]),
n{level} AS (SELECT host, step, (sum(blocked) + {PRIOR} * max(purity)) / (sum(labelled) + {PRIOR}) AS own FROM s{level} WHERE step IS NOT NULL GROUP BY ALL),
t{level} AS MATERIALIZED (SELECT x.host, shape, n, labelled, blocked, coalesce(own, purity) AS purity, coalesce(x.step, template) AS template, parts
  FROM s{level} x LEFT JOIN n{level} o ON o.host = x.host AND o.step = x.step)""")
    return ",".join(parts) + f"""
SELECT page_id, r.host, path, rule, coalesce(own, CASE WHEN purity >= {REJECT}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict, template
FROM r JOIN t{depth} t ON t.host = r.host AND t.shape = r.shape"""
