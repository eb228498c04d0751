"""Writes as plans: upserts, replacement, cascades, duplicates, costs and catalogue rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import uuid5

# Tokens are charged for by the million.
PRICES = {"input": 0.30, "output": 2.50, "flex_input": 0.15, "flex_output": 1.25, "embed_text": 0.20, "embed_image": 0.45}
RERANK_PRICE = 0.001
CHARS_PER_TOKEN = 4
CATALOGUE = uuid.uuid5(uuid.NAMESPACE_URL, "graphloom/catalogue")


def last_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows of one key the last counts."""
    latest = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def upsert(rows: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with those of ``new`` in place of, or beside, rows of their keys; ``new`` has one row per key."""
    return rows.join(new, keys, "left_anti").unionByName(new)


def delete_cascade(parent: DataFrame, children: dict[str, DataFrame], key: str, gone: Column) -> dict[str, DataFrame]:
    """The parent table and its children without the parents that are gone."""
    lost = parent.where(gone).select(key)
    return {"": parent.where(~gone)} | {name: df.join(lost, key, "left_anti") for name, df in children.items()}


def duplicates(rows: DataFrame, by: str) -> DataFrame:
    """(by, n): values that more than one row has."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def newest(rows: DataFrame, by: str, *order: Column) -> DataFrame:
    latest = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def key_faults(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(n_null, n_repeated): what a unique and present key forbids."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    null = F.greatest(*(F.col(k).isNull().cast("int") for k in keys)) if len(keys) > 1 else F.col(keys[0]).isNull().cast("int")
    return counts.agg(F.coalesce(F.sum(F.col("n") * null), F.lit(0)).alias("n_null"), F.count_if(F.col("n") > 1).alias("n_repeated"))


def price(input_tokens: Column, output_tokens: Column, cached: Column, thinking: Column | None = None, tier: Column | None = None) -> Column:
    """Dollars of a generating call: cached input tokens are free, thinking tokens are billed as output; the tier ``flex`` has prices of its own."""
    billed = F.greatest(input_tokens - cached, F.lit(0))
    out = output_tokens if thinking is None else output_tokens + thinking
    cost = lambda i, o: (billed * PRICES[i] + out * PRICES[o]) / 1e6
    return cost("input", "output") if tier is None else F.when(tier == "flex", cost("flex_input", "flex_output")).otherwise(cost("input", "output"))


def embed_tokens(chars: Column) -> Column:
    """Tokens of an embedded text, told from its characters: one at least."""
    return F.greatest(F.floor(chars / CHARS_PER_TOKEN), F.lit(1))


def embed_price(chars: Column, image: Column) -> Column:
    """Dollars of an embedding of a text or an image."""
    return embed_tokens(chars) * F.when(image, PRICES["embed_image"]).otherwise(PRICES["embed_text"]) / 1e6


def spent(costs: DataFrame, as_of: str, days: int) -> DataFrame:
    """Rows of the days before ``as_of``."""
    end = F.to_timestamp(F.lit(as_of))
    return costs.where((F.col("created_at") > end - F.expr(f"INTERVAL {days} DAYS")) & (F.col("created_at") <= end))


def catalogue_entries(nodes: DataFrame) -> DataFrame:
    """(entry_id, node_id, entry_type, display_name) of data and business objects, with ids made from their names."""
    kind = F.when(F.col("node_type") == "DataObject", "data-object").otherwise("business-object")
    chosen = nodes.where(F.col("node_type").isin("DataObject", "BusinessObject"))
    return chosen.select(uuid5(CATALOGUE, F.concat_ws("/", "node_id", "name")).alias("entry_id"), "node_id", kind.alias("entry_type"), F.col("name").alias("display_name"))


def catalogue_links(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(source_id, target_id, link_type) of access and realization edges to entries."""
    kind = F.when(F.col("rel_type") == "Access", "accesses")
    kind = kind.when((F.col("source_type") == "DataObject") & (F.col("target_type") == "BusinessObject"), "definition").otherwise("realizes")
    chosen = edges.where(F.col("rel_type").isin("Access", "Realization"))
    return chosen.join(entries, chosen["target_id"] == entries["node_id"], "left_semi").select("source_id", "target_id", kind.alias("link_type"))


def glossary(nodes: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(node_id, name, synonyms): terms with the sorted names that are linked to them in either direction."""
    pairs = synonyms.select(F.col("source_id").alias("node_id"), F.col("target_id").alias("other_id"))
    pairs = pairs.unionAll(synonyms.select("target_id", "source_id")).where("node_id <> other_id")
    names = nodes.select(F.col("node_id").alias("other_id"), F.col("name").alias("other"))
    grouped = pairs.join(names, "other_id").groupBy("node_id").agg(F.sort_array(F.collect_set("other")).alias("synonyms"))
    return nodes.join(grouped, "node_id").select("node_id", "name", F.array_join("synonyms", ",").alias("synonyms"))
