"""Consecutive numbers without a single sorted partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): distinct keys with consecutive numbers from 0 in their
    order. Sorted ranges are numbered apart; only one count per range reaches
    the driver."""
    keys = stored(df.select(key).distinct().sort(key).withColumn("__part", F.spark_partition_id()), "keys")
    sizes = {r["__part"]: r["count"] for r in keys.groupBy("__part").count().collect()}
    start, table = 0, []
    for part in sorted(sizes):
        table += [F.lit(part), F.lit(start)]
        start += sizes[part]
    base = F.create_map(*table)[F.col("__part")] if table else F.lit(0)
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1
    return keys.select(key, (rank + base).cast("long").alias(name))


def first_n(df: DataFrame, order: list[str], n: int) -> DataFrame | None:
    """The first n rows in an order (ascending, no ties), or None where there
    are fewer. Rows are sorted by ranges; whole ranges stay or go, and only the
    one in which the n-th row lies is ranked."""
    rows = stored(df.sort(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = {r["__part"]: r["count"] for r in rows.groupBy("__part").count().collect()}
    left = n
    for part in sorted(sizes):
        if left <= sizes[part]:
            rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
            last = rows.where(F.col("__part") == part).withColumn("__rank", rank).where(F.col("__rank") <= left).drop("__rank")
            return rows.where(F.col("__part") < part).unionByName(last).drop("__part")
        left -= sizes[part]
    return rows.drop("__part") if not left else None
