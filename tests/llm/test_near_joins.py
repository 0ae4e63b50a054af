"""What near copies' links cost in joins: no link is joined twice, and a group's rows grow as the group does."""

import re

import numpy as np

from termloom.llm import components, near_copies

from .fixtures import frame, words


def edited(n):
    base, rows = words(11, 150).split(), []
    for i in range(n):
        rng, own = np.random.default_rng(i), list(base)
        for at in rng.choice(150, rng.integers(1, 9), replace=False):
            own[at] = f"x{i}y{at}"
        rows.append((i, " ".join(own)))
    return rows


def star_rows(spark, run):
    """Rows of the large stars' joins, all turns together, by Spark's own counts."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    known = {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}
    run()
    bus.waitUntilEmpty(30_000)
    rows, found = 0, store.executionsList()
    for number in {found.apply(i).executionId() for i in range(found.size())} - known:
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in map(nodes.apply, range(nodes.size())):
            if "Join" in node.name() and re.search(r"\[u#\d+L?\], \[u#\d+L?\], LeftOuter", node.desc()):
                for metric in map(node.metrics().apply, range(node.metrics().size())):
                    if metric.name() == "number of output rows" and values.get(metric.accumulatorId()).isDefined():
                        rows += int(values.get(metric.accumulatorId()).get().replace(",", ""))
    return rows


def test_links_are_joined_once_a_turn(spark):
    links = spark.createDataFrame([(a, b) for a in range(40) for b in range(a + 1, 40)], "a long, b long")
    # 780 links, then a star of 39 links, which is looked at twice
    assert 780 <= star_rows(spark, lambda: components.components(links).collect()) <= 780 + 3 * 39


def test_a_dense_groups_links_are_joined_once(spark, monkeypatch):
    kept = {}
    tried = near_copies._tried
    monkeypatch.setattr(near_copies, "_tried", lambda *x: kept.setdefault("tried", tried(*x)))
    rows = star_rows(spark, lambda: near_copies.near_groups(frame(spark, edited(300))).collect())
    alike, close = kept["tried"].filter("alike").count(), kept["tried"].filter("dense and not alike").count()
    assert alike > 1000 and close > 1000  # dense, and left apart
    assert rows <= alike + close + 10 * 300  # turns after the first are over stars of a link a text


def test_contracted_links_are_of_roots(spark):
    roots = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)], "node long, root long")
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 8), (8, 2), (9, 3), (9, 10)], "a long, b long")
    assert sorted(map(tuple, components.contracted(links, roots).collect())) == [(1, 7), (1, 9), (9, 10)]
