"""Seeded Poisson bootstrap in one pass: each task sums all draws of its rows in arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distribution function of Poisson(1) at 0, 1, ...; a larger weight has a probability of under 1e-6.
LIMITS = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975, 0.99999887)
_C1, _C2, _C3 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Weights that a task holds at a time.
_HELD = 1 << 21


def weights(keys: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """A Poisson(1) weight for each key and draw, from a hash of both: a row needs no partner in other partitions."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64)[:, None] * np.uint64(_C1) + np.arange(1, draws + 1, dtype=np.uint64)[None, :] * np.uint64(_C2) + np.uint64(seed * _C3 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_C2)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_C3)
        x ^= x >> np.uint64(31)
    return np.searchsorted(np.array([int(p * (1 << 40)) for p in LIMITS], dtype=np.int64), (x >> np.uint64(24)).astype(np.int64), side="right")


def weights_sql(source: str, draws: int, seed: int) -> str:
    """DuckDB: the rows of ``source`` (key, ...) with a draw and its weight w, by the same hash in 128-bit integers."""
    wrap = lambda x: f"(({x}) % 18446744073709551616::UHUGEINT)::UBIGINT"
    h0 = wrap(f"key::UHUGEINT * {_C1}::UHUGEINT + draw::UHUGEINT * {_C2}::UHUGEINT + {seed * _C3 % (1 << 64)}::UHUGEINT")
    step = lambda h, by, c: wrap(f"xor({h}, {h} >> {by})::UHUGEINT * {c}::UHUGEINT")
    steps = " + ".join(f"(u >= {int(p * (1 << 40))})::INTEGER" for p in LIMITS)
    return f"""(SELECT * EXCLUDE (h0, h1, h2, u), {steps} AS w FROM (SELECT *, xor(h2, h2 >> 31) >> 24 AS u FROM (SELECT *, {step("h1", 27, _C3)} AS h2 FROM (SELECT *, {step("h0", 30, _C2)} AS h1
FROM (SELECT s.*, draw, {h0} AS h0 FROM {source} s, range(1, {draws + 1}) t(draw))))))"""


def sums(values: DataFrame, columns: list[str], draws: int, seed: int = 42) -> DataFrame:
    """draw, w (the weights' sum) and the weighted sums of the columns of ``values`` (key, non-negative, and the columns).

    A task gives one row a draw, so the shuffle has tasks times draws rows whatever the number of values. Null values
    count as zero; rows with a null key are left out.
    """
    names = ["w", *columns]

    def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), draws))
        for batch in batches:
            keys = batch.column("key").to_numpy()
            x = np.stack([np.ones(len(keys)), *(np.nan_to_num(batch.column(c).to_numpy(zero_copy_only=False)) for c in columns)])
            for at in range(0, len(keys), max(1, _HELD // draws)):
                part = slice(at, at + max(1, _HELD // draws))
                total += x[:, part] @ weights(keys[part], draws, seed)
        yield pa.RecordBatch.from_pydict({"draw": pa.array(np.arange(1, draws + 1), pa.int32()), **{n: pa.array(t) for n, t in zip(names, total, strict=True)}})

    rows = values.filter("key IS NOT NULL").select(F.col("key").cast("long"), *[F.col(c).cast("double") for c in columns])
    each = rows.mapInArrow(_sum, "draw int, " + ", ".join(f"{n} double" for n in names))
    return each.groupBy("draw").agg(*[F.sum(n).alias(n) for n in names])
