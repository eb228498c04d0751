"""URL filters: explicit host and path rules, then gradient-boosted trees on lexical features."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, row_count

#: (verdict, host and path): a rule fits its host, all subdomains, and paths that start with its path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: At most about this many labelled URLs are learned from.
SAMPLE = 20_000
FOLDS = 5
TREES, TREE_DEPTH = 10, 3
FEATURES = ("length", "host_length", "depth", "labels", "digits", "hyphens", "entropy", "parameters", "fragment", "suffix_rate", "suffix_rows")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host with A-Z lower-cased, and path; both empty for a null URL or one without ``://``."""
    cut = F.instr(url, "://")
    rest = F.when(cut > 0, F.substring(url, cut + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: F.Column, path: F.Column, rules=RULES) -> tuple[F.Column, F.Column]:
    """The longest rule that fits and its verdict, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule in sorted(rules, key=lambda r: len(r[1])):
        top, _, rest = rule.partition("/")
        fits = ((host == top) | host.endswith("." + top)) & path.startswith("/" + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with columns host and path, the URL's lexical features and its host's suffix."""
    u = F.coalesce(F.col(url), F.lit(""))
    host, path = host_and_path(F.col(url))
    n = F.greatest(F.length(u), F.lit(1))
    shares = F.transform(F.array_distinct(F.split(u, "")), lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n)
    entropy = -F.aggregate(F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda a, p: a + p * F.log2(p))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    return df.withColumn("host", host).withColumn("path", path).withColumns(
        {
            "length": F.length(u).cast("double"),
            "host_length": F.length("host").cast("double"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda p: p != "")).cast("double"),
            "labels": F.size(F.split("host", r"\.")).cast("double"),
            "digits": F.length(F.regexp_replace(u, "[^0-9]", "")) / n,
            "hyphens": F.length(F.regexp_replace("host", "[^-]", "")).cast("double"),
            "entropy": entropy,
            "parameters": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")),
            "fragment": F.instr(u, "#").cast("boolean").cast("double"),
            "suffix": F.substring_index("host", ".", -1),
        }
    )


class UrlModel:
    """Boosted trees and the labelled URLs' suffix statistics; without both classes a constant."""

    def __init__(self, suffixes: DataFrame | None, trees, constant: float):
        self.suffixes, self.trees, self.constant = suffixes, trees, constant

    def block_probability(self, rows: DataFrame) -> DataFrame:
        """``rows`` of :func:`lexical` with the column p_block."""
        if self.trees is None:
            return rows.withColumn("p_block", F.lit(self.constant))
        rows = _with_suffixes(rows, self.suffixes, ["suffix"])
        scored = self.trees.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows))
        from pyspark.ml.functions import vector_to_array

        return scored.withColumn("p_block", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def _with_suffixes(rows: DataFrame, suffixes: DataFrame, on: list[str]) -> DataFrame:
    # no more rows than the bounded sample has, times its folds
    joined = rows.join(F.broadcast(suffixes), on, "left")
    return joined.fillna({"suffix_rate": 0.5, "suffix_rows": 0.0})


def _statistics(blocked: Column, n: Column) -> list[Column]:
    return [((blocked + 1) / (n + 2)).alias("suffix_rate"), F.log1p(n).alias("suffix_rows")]


def train(labelled: DataFrame, url: str = "url", label: str = "blocked", sample: int = SAMPLE) -> UrlModel:
    """Boosted trees from labelled URLs (``label``: 1 to block, 0 to allow), at most about ``sample`` different ones by hash.

    A URL counts once for each label, weighted by its rows. Suffix statistics are
    the smoothed block rate and number of the sample's URLs on a host's last
    label; the trees are fitted on those of the other ``FOLDS`` - 1 folds of
    URLs, so that no URL's own label is among its features.
    """
    rows = labelled.select(F.col(url).alias("url"), F.col(label).cast("double").alias("label")).where("label is not null")
    rows = materialize(rows.groupBy("url", "label").agg(F.count(F.lit(1)).cast("double").alias("weight")))
    share = min(1.0, sample / max(1, row_count(rows)))
    chosen = rows.where(F.pmod(F.xxhash64("url", F.lit("sample")), F.lit(1 << 20)) < share * (1 << 20))
    chosen = materialize(lexical(chosen).withColumn("fold", F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(FOLDS))).coalesce(4))
    discard(rows)
    seen = chosen.agg(F.avg("label")).first()[0]
    if seen in (None, 0.0, 1.0):
        return UrlModel(None, None, 0.0 if seen is None else seen)
    by_fold = chosen.groupBy("suffix", "fold").agg(F.sum("label").alias("blocked"), F.count(F.lit(1)).alias("n"))
    whole = materialize(by_fold.groupBy("suffix").agg(F.sum("blocked").alias("all_blocked"), F.sum("n").alias("all")).coalesce(1))
    others = by_fold.join(F.broadcast(whole), "suffix").select("suffix", "fold", *_statistics(F.col("all_blocked") - F.col("blocked"), F.col("all") - F.col("n")))
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(_with_suffixes(chosen, others, ["suffix", "fold"]))
    trees = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=TREES, maxDepth=TREE_DEPTH, stepSize=0.3, seed=5)
    fitted = trees.fit(table.select("features", "label", "weight"))
    return UrlModel(whole.select("suffix", *_statistics(F.col("all_blocked"), F.col("all"))), fitted, seen)


def judge(pages: DataFrame, model: UrlModel | None = None, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """Per row: key, host, path, rule, verdict, p_block.

    The longest fitting rule decides, else the model (block at a probability of
    a half or more). Without a model one is trained with the rules' verdicts as
    labels. A null URL has empty host and path and fits no rule; a null key stays
    null; URLs of any length are judged whole. Of rules of equal length the later
    one wins. An empty table gives an empty result; other columns are ignored;
    repeated rows stay.
    """
    rows = pages.select(F.col(key), F.col(url).cast("string").alias("url"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    featured = lexical(rows).withColumn("rule", name).withColumn("verdict", verdict)
    if model is None:
        model = train(featured.where("rule is not null").select("url", (F.col("verdict") == "block").cast("double").alias("blocked")))
    scored = model.block_probability(featured)
    said = F.coalesce("verdict", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow"))
    return scored.select(key, "host", "path", "rule", said.alias("verdict"), "p_block")
