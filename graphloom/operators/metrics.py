"""Quality metrics as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import normalize_answer
from graphloom.operators.ordered import in_blocks, with_before


def token_f1(answers: DataFrame, key: str, given: str, expected: str) -> DataFrame:
    """(key, f1, exact): overlap of the two answers' words as multisets, 0 where either has none."""
    g, e = normalize_answer(F.col(given)), normalize_answer(F.col(expected))

    def of(text: Column, side: str) -> DataFrame:
        bag = answers.select(key, F.explode(F.array_remove(F.split(text, " "), "")).alias("word"))
        return bag.groupBy(key, "word").agg(F.count(F.lit(1)).alias(side))

    both = of(g, "a").join(of(e, "b"), [key, "word"], "full_outer").fillna(0, ["a", "b"])
    sums = both.groupBy(key).agg(F.sum(F.least("a", "b")).alias("common"), F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    score = F.coalesce(F.round(F.try_divide(2 * F.col("common"), F.col("n_a") + F.col("n_b")), 6), F.lit(0.0))
    exact = answers.select(key, (g == e).cast("int").alias("exact"))
    return exact.join(sums, key, "left").select(key, F.when(F.col("common") > 0, score).otherwise(0.0).alias("f1"), "exact")


def precision_recall(expected: DataFrame, found: DataFrame, by: str, item: str) -> DataFrame:
    """(by, tp, fp, fn, precision, recall, f1) of two sets of items."""
    a = expected.select(by, F.lower(item).alias("item")).distinct().withColumn("e", F.lit(1))
    b = found.select(by, F.lower(item).alias("item")).distinct().withColumn("f", F.lit(1))
    counts = a.join(b, [by, "item"], "full_outer").groupBy(by).agg(
        F.count_if(F.col("e").isNotNull() & F.col("f").isNotNull()).alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn")
    )

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(F.round(F.try_divide(a, b), 6), F.lit(0.0))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(by, tp, fp, fn, share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def percentiles(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, least, median, p90, most), with linear interpolation; exact.

    Values are found by their ranks: equal ones are counted first, and the
    counts of a group of many values are summed up in many tasks.
    """
    weight = F.count(value)  # 0 for null, which keeps a group of nulls
    counts = df.groupBy(F.col(by).alias("by"), F.col(value).alias("x")).agg(weight.alias("n"))
    rows = with_before(in_blocks(counts, "by", "x"), "by", ["x"], F.col("n"))
    sizes = rows.groupBy(F.col("by").alias("_by")).agg(F.sum("n").alias("total"))
    rows = rows.join(sizes, F.col("by").eqNullSafe(F.col("_by")))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")), F.col("x")))

    def part(share: float) -> list[Column]:
        place = (F.col("total") - 1) * share
        return [at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))]

    shares = {"median": 0.5, "p90": 0.9}
    found = rows.groupBy("by").agg(F.min("x").alias("least"), F.max("x").alias("most"), *(c.alias(f"{k}{i}") for k, s in shares.items() for i, c in enumerate(part(s))))
    between = {k: F.round((1 - F.col(f"{k}2")) * F.col(f"{k}0") + F.col(f"{k}2") * F.col(f"{k}1"), 6).alias(k) for k in shares}
    return found.select(F.col("by").alias(by), "least", between["median"], between["p90"], "most")


def arm_winner(scores: DataFrame, arms: list[str], references: Sequence[str] = ()) -> DataFrame:
    """(arm, score, is_reference, winner): mean score of each arm, a column of ``scores``.

    The best arm wins, of equals the first one given; ``references`` are shown
    beside the others and don't compete. Arms without any score have null and don't win.
    """
    every = [*arms, *references]
    long = scores.agg(*(F.round(F.avg(a), 6).alias(a) for a in every)).unpivot([], every, "arm", "score")
    place = F.array_position(F.array(*map(F.lit, every)), F.col("arm"))
    rows = long.withColumns({"is_reference": F.col("arm").isin(*references), "place": place})
    best = F.max_by("arm", F.when(~F.col("is_reference") & F.col("score").isNotNull(), F.struct("score", -F.col("place")))).alias("best")
    return rows.join(F.broadcast(rows.groupBy().agg(best))).select("arm", "score", "is_reference", F.coalesce(F.col("arm") == F.col("best"), F.lit(False)).alias("winner"))  # one row


def attrition(expected: Column, in_top: Column, in_pool: Column, pool_size: Column, limit: int, cut: Column | None = None) -> Column:
    """Where a question lost an expected item on its way to the answer.

    ``in_top`` and ``in_pool`` say whether all expected items are there. A pool
    that holds them all lost some below the top, whatever its size; one that
    lacks some was capped if it was ``cut`` or is as large as the limit.
    """
    full = pool_size >= limit if cut is None else cut | (pool_size >= limit)
    return F.when(~expected, "none_expected").when(in_top, "hit").when(in_pool, "below_top_k").when(full, "capped").otherwise("never_in_pool")


def limit_sweep(ranked: DataFrame, limits: list[int]) -> DataFrame:
    """(cap, n_hits, recall): hits within each cap on the rank; a row has ``rank`` and ``hit``."""
    total = F.count_if(F.col("hit"))
    counts = [F.count_if(F.col("hit") & (F.col("rank") <= x)).alias(str(x)) for x in limits]
    wide = ranked.agg(total.alias("total"), *counts)
    return wide.unpivot(["total"], [str(x) for x in limits], "cap", "n_hits").select(
        F.col("cap").cast("int").alias("cap"), "n_hits", F.coalesce(F.round(F.try_divide("n_hits", "total"), 6), F.lit(0.0)).alias("recall")
    )
