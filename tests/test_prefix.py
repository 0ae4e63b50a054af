"""Running sums by ranges against plain ones: hot keys, null keys, ties, empty tables."""

import random

from pyspark.sql import functions as F

from termloom.operators.prefix import running


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot"] * 8 + ["a", None]), rng.randrange(50)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, k string, v int")
    got = {r.id: (r.n, r.s) for r in running(df, [F.col("id")], {"n": F.lit(1), "s": F.col("v")}, ("k",)).collect()}
    want, seen = {}, {}
    for i, k, v in rows:
        n, s = seen.get(k, (0, 0))
        want[i] = n, s
        seen[k] = n + 1, s + v
    assert got == want
    down = {r.id: r.n for r in running(df, [F.desc("id")], {"n": F.lit(1)}).collect()}
    assert down == {i: 599 - i for i in range(600)}


def test_empty(spark):
    assert running(spark.createDataFrame([], "id long, v int"), [F.col("id")], {"n": F.lit(1)}).collect() == []
