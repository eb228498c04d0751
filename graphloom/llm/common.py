"""Shared helpers over intermediate tables: counts, numbers in order and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import discard, materialize, owned_tables

__all__ = ["connected_components", "discard", "materialize", "numbered_in_order", "owned_tables", "row_count"]


def row_count(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]


def numbered_in_order(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` written with ``nth`` from 0 in the given order: ranges are numbered on their own, then moved by what stands before."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = materialize(ranged.withColumns({"_range": F.spark_partition_id(), "_within": within}))
    # as many rows as there are partitions
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = ranged.join(sizes.select("_range", before.alias("_before")), "_range").withColumn("nth", F.col("_before") + F.col("_within"))
    out = materialize(moved.drop("_range", "_within", "_before"))
    discard(ranged)
    return out


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node on an edge; a component is named by its least node.

    Alternating large-star and small-star rounds: each is a grouped minimum
    and an equi-join on the vertex, so that a vertex with many neighbours is
    pre-aggregated before one shuffle and split by the skew join in the other.
    Empty input gives an empty table.
    """
    hi, lo = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    e = materialize(edges.where(F.col(a) != F.col(b)).select(hi, lo).distinct())
    state = None
    while True:
        stamp = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if stamp == state or stamp[0] == 0:
            break
        state = stamp
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least2 = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(least2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(moved.union(least2.select("u", F.col("m").alias("v"))).distinct())
        discard(e, least, large, least2)
        e = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
