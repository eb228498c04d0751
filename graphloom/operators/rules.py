"""Conformance rules: each rule is a DataFrame of violations, the report one plan over all of them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.registry import RULES
from graphloom.sources.storage import materialize
from graphloom.sources.tables import layer_of

LISTED = 20


def degree_table(edges: DataFrame) -> DataFrame:
    """(node_id, node_type, rel_type, direction, n, doubted): the number of a node's edges and of the AMBIGUOUS among them.

    One pass over the edges answers all rules that count them.
    """

    def end(name: str, direction: str) -> Column:
        return F.struct(F.col(f"{name}_id").alias("node_id"), F.col(f"{name}_type").alias("node_type"), F.lit(direction).alias("direction"))

    ends = edges.select("rel_type", "confidence", F.explode(F.array(end("source", "outgoing"), end("target", "incoming"))).alias("end"))
    doubt = F.coalesce("confidence", F.lit("EXTRACTED")) == "AMBIGUOUS"
    return ends.groupBy("end.node_id", "end.node_type", "rel_type", "end.direction").agg(F.count(F.lit(1)).alias("n"), F.count_if(doubt).alias("doubted"))


def minimum_connections(nodes: DataFrame, degrees: DataFrame, entity_type: str, rel_type: str, direction: str, min_count: int) -> DataFrame:
    """(node_id): nodes of a type with fewer than ``min_count`` edges of a relation in a direction."""
    mine = degrees.where((F.col("rel_type") == rel_type) & (F.col("direction") == direction))
    counts = mine.groupBy("node_id").agg(F.sum("n").alias("n"))
    return nodes.where(F.col("node_type") == entity_type).join(counts, "node_id", "left").where(F.coalesce("n", F.lit(0)) < min_count).select("node_id")


def forbidden_edges(edges: DataFrame, source_type: str, target_type: str, rel_type: str) -> DataFrame:
    """(source_id, target_id): edges of a relation that must not join these types."""
    hit = (F.col("source_type") == source_type) & (F.col("target_type") == target_type) & (F.col("rel_type") == rel_type)
    return edges.where(hit).select("source_id", "target_id")


def orphans(nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    """(node_id): nodes on no edge."""
    return nodes.join(degrees, "node_id", "left_anti").select("node_id")


def ambiguous_only(degrees: DataFrame) -> DataFrame:
    """(node_id): nodes all of whose edges are AMBIGUOUS."""
    sums = degrees.groupBy("node_id").agg(F.sum("n").alias("n"), F.sum("doubted").alias("doubted"))
    return sums.where("n = doubted").select("node_id")


def high_fan_in(degrees: DataFrame, entity_type: str, rel_type: str, threshold: int) -> DataFrame:
    """(node_id, n): nodes of a type with more than ``threshold`` incoming edges of a relation."""
    chosen = degrees.where((F.col("rel_type") == rel_type) & (F.col("node_type") == entity_type) & (F.col("direction") == "incoming"))
    return chosen.groupBy("node_id").agg(F.sum("n").alias("n")).where(F.col("n") > threshold)


def min_entities_per_doc(docs: DataFrame, mentions: DataFrame, min_count: int) -> DataFrame:
    """(doc_id, n): documents that mention fewer than ``min_count`` entities."""
    counts = mentions.groupBy("doc_id").agg(F.count_distinct("node_id").alias("n"))
    return docs.select("doc_id").join(counts, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < min_count)


def missing_layers(nodes: DataFrame, required: Sequence[str]) -> DataFrame:
    """(layer): required layers of which there is no node."""
    wanted = nodes.sparkSession.createDataFrame([(x,) for x in required], "layer string")
    return wanted.join(nodes.select(layer_of(F.col("node_type")).alias("layer")).distinct(), "layer", "left_anti")


def unreachable(edges: DataFrame, nodes: DataFrame, start_type: str, entity_type: str, hops: int = 3) -> DataFrame:
    """(node_id): nodes of a type that no directed walk of up to ``hops`` edges from ``start_type`` reaches.

    The frontier is a set of nodes, not of pairs, so it never exceeds the nodes.
    """
    step = materialize(edges.select(F.col("source_id").alias("node_id"), F.col("target_id").alias("next")))
    at = nodes.where(F.col("node_type") == start_type).select("node_id")
    found = []
    for _ in range(hops):
        at = at.join(step, "node_id").select(F.col("next").alias("node_id")).distinct()
        found.append(at)
    return nodes.where(F.col("node_type") == entity_type).join(reduce(DataFrame.unionAll, found), "node_id", "left_anti").select("node_id")


def violations(rule: dict, nodes: DataFrame, edges: DataFrame, docs: DataFrame, mentions: DataFrame, degrees: DataFrame) -> DataFrame:
    """(rule_id, severity, item): what breaks one rule; ``degrees`` is the ``degree_table`` of the edges."""
    kind = rule["type"]
    if kind == "minimum_connections":
        found = minimum_connections(nodes, degrees, rule["entity_type"], rule["rel_type"], rule["direction"], rule["min_count"]).select("node_id")
    elif kind == "forbidden_edge":
        found = forbidden_edges(edges, rule["source_type"], rule["target_type"], rule["rel_type"]).select(F.concat_ws("->", "source_id", "target_id"))
    elif kind == "no_orphans":
        found = orphans(nodes, degrees)
    elif kind == "ambiguous_only":
        found = ambiguous_only(degrees)
    elif kind == "high_fan_in":
        found = high_fan_in(degrees, rule["entity_type"], rule["rel_type"], rule["threshold"]).select("node_id")
    elif kind == "min_entities_per_doc":
        found = min_entities_per_doc(docs, mentions, rule["min_count"]).select(F.col("doc_id").cast("string"))
    elif kind == "layer_coverage":
        found = missing_layers(nodes, rule["required_layers"])
    elif kind == "reachability":
        found = unreachable(edges, nodes, rule["source_type"], rule["entity_type"])
    else:
        raise ValueError(f"unknown rule type {kind!r}")
    return found.toDF("item").select(F.lit(rule["rule_id"]).alias("rule_id"), F.lit(rule["severity"]).alias("severity"), "item")


def conformance(nodes: DataFrame, edges: DataFrame, docs: DataFrame, mentions: DataFrame, rules: Sequence[dict] = RULES) -> DataFrame:
    """(rule_id, severity, n_violations, status): one row per rule; a rule without violations has passed."""
    degrees = materialize(degree_table(edges))
    found = reduce(DataFrame.unionByName, (violations(r, nodes, edges, docs, mentions, degrees) for r in rules))
    counts = found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    named = nodes.sparkSession.createDataFrame([(r["rule_id"], r["severity"]) for r in rules], "rule_id string, severity string")
    n = F.coalesce("n", F.lit(0))
    return named.join(counts, "rule_id", "left").select("rule_id", "severity", n.alias("n_violations"), F.when(n == 0, "passed").otherwise(F.col("severity")).alias("status"))


def listed(found: DataFrame, most: int = LISTED) -> DataFrame:
    """The first ``most`` violations of each rule."""
    from pyspark.sql import Window

    order = Window.partitionBy("rule_id").orderBy("item")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")


def nonconforming(edges: DataFrame, allowed: DataFrame) -> DataFrame:
    """Edges whose (relation, source type, target type) is not in ``allowed``."""
    return edges.join(allowed, ["rel_type", "source_type", "target_type"], "left_anti")
