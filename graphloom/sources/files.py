"""File trees and JSON files as tables."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MARKS = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}


def _pattern(glob: str) -> str:
    """A glob as a pattern on a path below the root; ``**`` crosses folders."""
    return "^" + "".join(_MARKS.get(part) or re.escape(part) for part in re.split(r"(\*\*/|\*\*|\*|\?)", glob)) + "$"


def walk(spark: SparkSession, root: str, include: tuple[str, ...] = ("**/*",), exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path, size, text): the files below ``root`` that an include glob fits and no exclude glob does.

    Spark reads no empty file, so those are left out. Paths are relative to the root; texts are UTF-8, with marks for bytes that aren't.
    Folders are listed and files read by Spark, so the root can be in any store
    that it reads.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split("://")[-1].rstrip("/") + "/"
    below = F.substring_index(F.col("path"), base, -1)

    def fits(globs: tuple[str, ...]):
        return reduce(or_, (F.col("path").rlike(_pattern(g)) for g in globs), F.lit(False))

    named = files.select(below.alias("path"), F.col("length").alias("size"), "content")
    return named.where(fits(include) & ~fits(exclude)).select("path", "size", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of JSON files, each an array of them or one of its own."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


RULE_FIELDS = "rule_id string, severity string, type string, entity_type string, source_type string, target_type string, rel_type string, direction string, min_count int, threshold int, required_layers array<string>"


def conformance_rules(spark: SparkSession, path: str) -> list[dict]:
    """Rules from JSON files, in the order of their ids, each with the fields that it has; an id that repeats or lacks is an error.

    Rules shape the plan, so they are read while it is built; they are written by hand and few.
    """
    found = [{k: v for k, v in r.asDict().items() if v is not None} for r in json_table(spark, path, RULE_FIELDS).orderBy("rule_id").collect()]
    ids = [r.get("rule_id") for r in found]
    if None in ids or len(set(ids)) < len(ids):
        raise ValueError(f"rules of {path} need ids of their own, found {ids}")
    return found
