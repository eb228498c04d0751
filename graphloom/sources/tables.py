"""The knowledge graph over plain tables: nodes, edges, documents, chunks, costs and progress events.

One ``nodes`` and one ``edges`` table hold all types, so that an operator is one
plan. Edge keys repeat in the line items; they are reduced before anything joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.registry import LAYERS

CHUNK_SIZE = 1500
CHUNK_STEP = 1300
#: Rows that a task groups at once, about.
GROUP_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, number: Column, name: str, of: DataFrame) -> DataFrame:
    """Rows with the column ``name``: the number modulo the count of another table's rows, so that all of those are reached."""
    n = of.agg(F.count(F.lit(1)).alias("_n"))  # one row
    return df.crossJoin(F.broadcast(n)).withColumn(name, F.try_mod(number, F.col("_n"))).drop("_n")


def layer_of(node_type: Column, otherwise: str = "Other") -> Column:
    layers = F.create_map(*(F.lit(x) for pair in LAYERS.items() for x in pair))
    return F.coalesce(layers[node_type], F.lit(otherwise))


# table, id prefix, key, type, name
_NODES = (
    ("region", "reg:", "r_regionkey", "BusinessFunction", "r_name"),
    ("nation", "nat:", "n_nationkey", "BusinessRole", "n_name"),
    ("customer", "cus:", "c_custkey", "BusinessActor", "c_name"),
    ("supplier", "sup:", "s_suppkey", "ApplicationComponent", "s_name"),
    ("part", "prt:", "p_partkey", "DataObject", "p_name"),
    ("orders", "ord:", "o_orderkey", "BusinessProcess", None),
)


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, node_type, name) of all node types."""
    parts = []
    for source, prefix, key, kind, name in _NODES:
        label = F.col(name) if name else _id("Order#", key)
        parts.append(table(spark, sf_dir, source).select(_id(prefix, key).alias("node_id"), F.lit(kind).alias("node_type"), label.alias("name")))
    return reduce(DataFrame.unionByName, parts)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, source_type, target_id, target_type, rel_type, confidence), one row per key."""

    items = table(spark, sf_dir, "lineitem")
    n_items = items.count()

    def lines(a: str, b: str) -> DataFrame:
        rank = F.expr("max(CASE l_returnflag WHEN 'N' THEN 2 WHEN 'R' THEN 1 ELSE 0 END)")
        best = F.element_at(F.array(F.lit("AMBIGUOUS"), F.lit("INFERRED"), F.lit("EXTRACTED")), rank + 1)
        return dealt(items.select(a, b, "l_returnflag"), n_items, a, b).groupBy(a, b).agg(best.alias("confidence"))

    def edge(df: DataFrame, source: tuple, target: tuple, rel: str, confidence: Column) -> DataFrame:
        return df.select(
            _id(*source[:2]).alias("source_id"), F.lit(source[2]).alias("source_type"), _id(*target[:2]).alias("target_id"),
            F.lit(target[2]).alias("target_type"), F.lit(rel).alias("rel_type"), confidence.alias("confidence"),
        )

    status = F.expr("CASE o_orderstatus WHEN 'O' THEN 'EXTRACTED' WHEN 'F' THEN 'INFERRED' END")
    sure, guess = F.lit("EXTRACTED"), F.lit("INFERRED")
    order = "ord:", "l_orderkey", "BusinessProcess"
    nation = "nat:", "n_nationkey", "BusinessRole"
    parts = [
        edge(lines("l_suppkey", "l_orderkey"), ("sup:", "l_suppkey", "ApplicationComponent"), order, "Serving", F.col("confidence")),
        edge(lines("l_orderkey", "l_partkey"), order, ("prt:", "l_partkey", "DataObject"), "Access", F.col("confidence")),
        edge(table(spark, sf_dir, "orders"), ("cus:", "o_custkey", "BusinessActor"), ("ord:", "o_orderkey", "BusinessProcess"), "Assignment", status),
        edge(table(spark, sf_dir, "customer"), ("nat:", "c_nationkey", "BusinessRole"), ("cus:", "c_custkey", "BusinessActor"), "Aggregation", sure),
        edge(table(spark, sf_dir, "supplier"), ("nat:", "s_nationkey", "BusinessRole"), ("sup:", "s_suppkey", "ApplicationComponent"), "Association", guess),
        edge(table(spark, sf_dir, "nation"), ("reg:", "n_regionkey", "BusinessFunction"), nation, "Composition", sure),
    ]
    return reduce(DataFrame.unionByName, parts)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, title, tenant_id, text, source, n_chars)."""
    tenant = F.expr("CASE doc_id % 3 WHEN 0 THEN 'tenant_a' WHEN 1 THEN '__shared__:alpha' ELSE '__shared__:beta' END")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id")).alias("title"), tenant.alias("tenant_id"), "text", "source", "n_chars")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan over all cores: only an input of fewer splits than there are cores is moved, so never a large one."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, chunk_index, chunk_id, chunk_text): overlapping windows of the documents."""
    return chunks_of(documents(spark, sf_dir).select("doc_id", "text"))


def chunks_of(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, chunk_id, chunk_text) of (doc_id, text); other columns of a document go with its chunks, so that none is joined to them."""
    from graphloom.functions.text import window_chunks

    return window_chunks(spread(docs), CHUNK_SIZE, CHUNK_STEP)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows dealt by ``keys``, about ``GROUP_ROWS`` of ``rows`` a task; fewer than that for each core stay as they are.

    A grouping by the keys follows in the same tasks: for keys that hardly repeat, a first grouping of each
    whole split of the input, and tasks that grow with the input, would only take memory.
    """
    n = -(-rows // GROUP_ROWS)
    return df.repartition(n, *keys) if n > df.sparkSession.sparkContext.defaultParallelism else df


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log_id, tenant_id, operation_type, total_cost_usd, input_tokens, created_at)."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("log_id"),
        F.concat(F.lit("u"), F.col("user_id")).alias("tenant_id"),
        F.col("event_type").alias("operation_type"),
        F.col("value").alias("total_cost_usd"),
        F.get_json_object("props", "$.k").cast("bigint").alias("input_tokens"),
        F.col("ts").alias("created_at"),
    )


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, event_id, event_type, file_id, ts, value): ingestion events of ten jobs."""
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).alias("job_id"), "event_id", "event_type", (F.col("user_id") % 97).alias("file_id"), "ts", "value"
    )
