"""Roll-ups of an evaluation: coverage, uplift, judges, rerankers, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _mean(x: Column, digits: int = 4) -> Column:
    return F.coalesce(F.round(F.avg(x), digits), F.lit(0.0))


def rolled_up(per_type: DataFrame) -> DataFrame:
    """(macro_f1, micro_f1) of rows (tp, fp, fn, precision, recall): from mean precision and recall, and from summed counts."""
    p, r = F.avg("precision"), F.avg("recall")
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    half = lambda a, b: F.coalesce(F.round(F.try_divide(a, b), 4), F.lit(0.0))
    return per_type.agg(half(2 * p * r, p + r).alias("macro_f1"), half(2 * tp, 2 * tp + fp + fn).alias("micro_f1"))


def relation_coverage(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(rel_type, n_expected, n_found, delta, coverage): counts by relation; ``coverage`` is the share of expected relations found at all."""
    count = lambda df, name: df.groupBy("rel_type").agg(F.count(F.lit(1)).alias(name))
    both = count(expected, "n_expected").join(count(found, "n_found"), "rel_type", "full_outer").fillna(0, ["n_expected", "n_found"])
    share = both.agg(F.coalesce(F.round(F.try_divide(F.count_if((F.col("n_expected") > 0) & (F.col("n_found") > 0)), F.count_if(F.col("n_expected") > 0)), 4), F.lit(0.0)).alias("coverage"))
    return both.crossJoin(F.broadcast(share)).select("rel_type", "n_expected", "n_found", (F.col("n_found") - F.col("n_expected")).alias("delta"), "coverage")  # one row


def uplift(scores: DataFrame, arm: str, base: str, hops: str) -> DataFrame:
    """(uplift, multi_hop_uplift, n_helped, n_questions): how far ``arm`` is above ``base`` over all questions and those of more than one hop."""
    gain = F.col(arm) - F.col(base)
    return scores.agg(
        _mean(gain).alias("uplift"), _mean(F.when(F.col(hops) > 1, gain)).alias("multi_hop_uplift"), F.count_if(gain > 0).alias("n_helped"), F.count(F.lit(1)).alias("n_questions")
    )


def judged(scores: DataFrame, columns: list[str]) -> DataFrame:
    """(criterion, score, n_errors): means without the negative scores that mark a judge's errors."""
    long = scores.unpivot([], columns, "criterion", "value")
    return long.groupBy("criterion").agg(_mean(F.when(F.col("value") >= 0, F.col("value"))).alias("score"), F.count_if(F.col("value") < 0).alias("n_errors"))


def compared(runs: DataFrame, arms: list[str]) -> DataFrame:
    """(arm, recall, latency_ms, n_wins) of rows with ``<arm>_recall`` and ``<arm>_ms``: an arm wins alone, a tie is nobody's."""
    best = F.greatest(*(F.col(f"{a}_recall") for a in arms))
    alone = sum((F.col(f"{a}_recall") == best).cast("int") for a in arms) == 1
    parts = [
        runs.agg(_mean(F.col(f"{a}_recall")).alias("recall"), _mean(F.col(f"{a}_ms"), 1).alias("latency_ms"), F.count_if(alone & (F.col(f"{a}_recall") == best)).alias("n_wins")).select(
            F.lit(a).alias("arm"), "recall", "latency_ms", "n_wins"
        )
        for a in arms
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def most_common(values: DataFrame, by: str, value: str, most: int = 5) -> DataFrame:
    """(by, value, n, rank): the most frequent values, counted before they are ranked."""
    counts = values.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(by).orderBy(F.desc("n"), value)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def title_recall(found: Column, gold: Column) -> Column:
    """The share of distinct gold titles among those found; 0 without gold."""
    return F.coalesce(F.round(F.try_divide(F.size(F.array_intersect(found, gold)), F.size(F.array_distinct(gold))), 4), F.lit(0.0))


def split_of(key: Column, seed: int, dev_share: float = 0.5) -> Column:
    """``dev`` or ``test`` by a hash of the key and the seed: the same for a key wherever and in whatever order it is met."""
    at = F.conv(F.substring(F.sha1(F.concat_ws(":", F.lit(seed).cast("string"), key.cast("string"))), 1, 8), 16, 10).cast("bigint")
    return F.when(at < int(dev_share * (1 << 32)), "dev").otherwise("test")


def leaked(split: DataFrame, key: str) -> DataFrame:
    """(key, n_splits): keys that stand in more than one split, which a fair test forbids."""
    return split.groupBy(key).agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")
