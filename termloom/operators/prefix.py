"""Running sums in order, without all rows in one task: range partitions, sums within each, and offsets before each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import checkpointed


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], within: tuple[str, ...] = ()) -> DataFrame:
    """Adds for each name the sum of its column over the rows before (by ``order``, among those with the same ``within``).

    Rows are dealt by range of (within, order), so a key of ``within`` that holds most rows spreads over many tasks. The offsets
    are one row a partition and key: a window over them sees no data rows. ``order`` should tell rows apart; rows that it doesn't
    come in any order.
    """
    keys = [*map(F.col, within), *order]
    placed = rows.repartitionByRange(*keys).withColumn("range_part", F.spark_partition_id())
    placed = checkpointed(placed.withColumns({f"own_{name}": c.cast("long") for name, c in sums.items()}))
    local = Window.partitionBy("range_part", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*within).orderBy("range_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("range_part", *within).agg(*[F.sum(f"own_{name}").alias(f"of_{name}") for name in sums])
    parts = parts.select("range_part", *within, *[F.coalesce(F.sum(f"of_{name}").over(before), F.lit(0)).alias(f"before_{name}") for name in sums])
    offsets = parts.select(F.col("range_part").alias("offset_part"), *[F.col(w).alias(f"offset_{w}") for w in within], *[f"before_{name}" for name in sums])
    same = F.col("range_part") == F.col("offset_part")
    for w in within:
        same = same & F.col(w).eqNullSafe(F.col(f"offset_{w}"))
    found = placed.join(offsets, same)
    found = found.withColumns({name: F.coalesce(F.sum(f"own_{name}").over(local), F.lit(0)) + F.col(f"before_{name}") for name in sums})
    return found.select(*rows.columns, *sums)

