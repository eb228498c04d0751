"""Running totals along an order within a key, where one key may hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.storage import materialize


def in_blocks(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows with ``block``, the number of their range of (key, order).

    A key of many rows spans many ranges; rows equal in both share one. The
    table pins the ranges, so that all that is counted by block agrees.
    """
    return materialize(df.repartitionByRange(key, *order).withColumn("block", F.spark_partition_id()))


def with_blocks(rows: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """Rows joined to a table of (key, block, ...); null is a key like others."""
    other = blocks.withColumnsRenamed({key: "_key", "block": "_block"})
    return rows.join(other, F.col(key).eqNullSafe(F.col("_key")) & (F.col("block") == F.col("_block"))).drop("_key", "_block")


def with_before(blocked: DataFrame, key: str, order: list[str], weight: Column) -> DataFrame:
    """Rows of ``in_blocks`` with ``before``: the summed weight of the key's earlier rows.

    Each block is summed by itself and starts from the totals of those before
    it, of which a key has at most one row a partition.
    """
    up_to = (Window.unboundedPreceding, -1)
    inside = F.sum(weight).over(Window.partitionBy(key, "block").orderBy(*order).rowsBetween(*up_to))
    totals = blocked.groupBy(key, "block").agg(F.sum(weight).alias("total"))
    earlier = F.sum("total").over(Window.partitionBy(key).orderBy("block").rowsBetween(*up_to))
    starts = totals.select(key, "block", F.coalesce(earlier, F.lit(0)).alias("_start"))
    rows = with_blocks(blocked.withColumn("_inside", F.coalesce(inside, F.lit(0))), starts, key)
    return rows.withColumn("before", F.col("_start") + F.col("_inside")).drop("_start", "_inside")
