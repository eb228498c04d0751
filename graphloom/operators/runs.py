"""An evaluation run over recorded lists: where each expected entity is first met, and what follows for every limit at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.metrics import arm_winner, attrition

# Chunks that an answer is made of, candidates that a search keeps, and the limits that a sweep tries.
TOP, LIMIT = 15, 40
LIMITS = (5, 10, 15, 20, 30, 40, 50, 60, 100)
#: Entities that the constant arm shows to every question.
CONSTANT = 5


def _thousandths(part: Column, whole: Column) -> Column:
    """``part / whole`` in whole thousandths, half up, without the doubt of binary fractions."""
    return F.floor((part * 2000 + whole) / (whole * 2)).cast("bigint")


def first_ranks(expected: DataFrame, ranked: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, entity, rank) of expected (query_id, entity): the least rank of a listed chunk that holds the name in any case; none where no chunk does.

    ``ranked`` has (query_id, chunk_id, rank). A question's entities go to its chunks as one list, and only listed chunks are read.
    """
    wanted = expected.groupBy("query_id").agg(F.collect_set("entity").alias("entities"))
    rows = ranked.select("query_id", "chunk_id", "rank").join(wanted, "query_id").join(texts.select("chunk_id", F.lower("chunk_text").alias("text")), "chunk_id")
    held = F.filter("entities", lambda e: F.contains("text", F.lower(e)))
    return rows.select("query_id", "rank", F.explode(held).alias("entity")).groupBy("query_id", "entity").agg(F.min("rank").alias("rank"))


def recorded(questions: DataFrame, expected: DataFrame, pool: DataFrame, vector: DataFrame, texts: DataFrame, top: int = TOP) -> DataFrame:
    """(query_id, n_expected, pool_size, ranks, vector_recall) of each question (query_id): the search's pool and the baseline's list, read once.

    ``ranks`` are the places in the pool at which expected entities are first met; recalls are in thousandths, all of them where nothing is expected.
    """
    expected = expected.select("query_id", "entity").distinct()
    counts = expected.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    places = first_ranks(expected, pool, texts).groupBy("query_id").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))
    base = first_ranks(expected, vector.where(F.col("rank") <= top), texts).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_vector"))
    sizes = pool.groupBy("query_id").agg(F.count(F.lit(1)).alias("size"))
    rows = questions.select("query_id").distinct()
    for part in (counts, places, base, sizes):
        rows = rows.join(part, "query_id", "left")
    n = F.coalesce("n", F.lit(0))
    recall = F.when(n == 0, 1000).otherwise(_thousandths(F.coalesce("n_vector", F.lit(0)), n)).cast("bigint")
    return rows.select(
        "query_id", n.alias("n_expected"), F.coalesce("size", F.lit(0)).alias("pool_size"), F.coalesce("ranks", F.array().cast("array<int>")).alias("ranks"), recall.alias("vector_recall")
    )


def at_limits(records: DataFrame, limits: tuple[int, ...] = LIMITS, top: int = TOP) -> DataFrame:
    """(query_id, cap, n_expected, pool_size, graph_recall, vector_recall, uplift, bucket) of each question at each limit of its pool; the pool itself isn't repeated."""
    rows = records.withColumn("cap", F.explode(F.array(*map(F.lit, limits))))
    met = lambda most: F.size(F.filter("ranks", lambda r: r <= most))
    n, cap = F.col("n_expected"), F.col("cap")
    shown = met(F.least(cap, F.lit(top)))
    recall = F.when(n == 0, 1000).otherwise(_thousandths(shown, n)).cast("bigint")
    bucket = attrition(n > 0, shown == n, met(cap) == n, F.col("pool_size"), cap, F.col("pool_size") > cap)
    rows = rows.withColumns({"graph_recall": recall, "bucket": bucket})
    return rows.select("query_id", "cap", "n_expected", "pool_size", "graph_recall", "vector_recall", (F.col("graph_recall") - F.col("vector_recall")).alias("uplift"), "bucket")


def sweep(rows: DataFrame) -> DataFrame:
    """(cap, graph_recall, vector_recall, uplift, n_helped, n_hit, n_capped, n_below, n_never, n_none) of rows of :func:`at_limits`; means in thousandths, half up."""
    mean = lambda c: F.floor((F.sum(c) * 2 + F.count(F.lit(1))) / (F.count(F.lit(1)) * 2)).cast("bigint").alias(c)
    buckets = {"n_hit": "hit", "n_capped": "capped", "n_below": "below_top_k", "n_never": "never_in_pool", "n_none": "none_expected"}
    counts = [F.count_if(F.col("bucket") == b).alias(name) for name, b in buckets.items()]
    return rows.groupBy("cap").agg(mean("graph_recall"), mean("vector_recall"), mean("uplift"), F.count_if(F.col("uplift") > 0).alias("n_helped"), *counts)


def arms(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """(arm, score, is_reference, winner) at one limit: search, vectors, and a constant context of the most frequent entities, beside the bounds."""
    expected = expected.select("query_id", "entity").distinct()
    common = expected.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "entity").limit(CONSTANT)
    context = common.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("n"), "entity"))), lambda x: F.lower(x["entity"])), " ").alias("context"))
    known = expected.crossJoin(F.broadcast(context)).groupBy("query_id").agg(F.count_if(F.contains("context", F.lower("entity"))).alias("n_known"))  # one row
    scored = rows.join(known, "query_id", "left")
    n = F.col("n_expected")
    constant = F.when(n == 0, 1000).otherwise(_thousandths(F.coalesce("n_known", F.lit(0)), n)) / 1000
    scored = scored.select(
        (F.col("graph_recall") / 1000).alias("graph"), (F.col("vector_recall") / 1000).alias("vector_only"), constant.alias("constant"),
        F.lit(1.0).alias("oracle"), F.when(n > 0, 0.0).otherwise(1.0).alias("blind"),
    )
    return arm_winner(scored, ["graph", "vector_only", "constant"], ["oracle", "blind"])
