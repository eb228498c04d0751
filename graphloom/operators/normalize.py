"""Edge lines as free text: strict ones in three parts, and loose ones whose ends are looked up among a document's nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import classify_verb
from graphloom.registry import CONFIDENCE_FACTOR

# Grades that a strict edge may give instead of a confidence, in any case.
GRADES = ("high", "medium", "low")


def stripped(x: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")


def strict_edge(line: Column) -> Column:
    """struct of ``Type:name->Relation[...]->Type:name``, else null: exactly three parts, both ends typed, nothing trimmed.

    Of a relation that ends with a bracket, the last confidence or grade in it counts; without one it is EXTRACTED.
    """
    parts = F.split(line, "->")
    source, rel, target = (F.get(parts, i) for i in range(3))
    bracket = r"(?s)^(.*)\[([^\[]*)\]\z"
    labels = F.transform(F.split(F.regexp_extract(rel, bracket, 2), ","), stripped)
    sure = F.filter(labels, lambda p: p.isin(*CONFIDENCE_FACTOR) | F.lower(p).isin(*GRADES))
    kind = lambda x: F.substring_index(x, ":", 1)
    name = lambda x: F.substring(x, F.length(kind(x)) + 2, F.length(x))
    return F.when(
        (F.size(parts) == 3) & source.contains(":") & target.contains(":"),
        F.struct(
            kind(source).alias("source_type"), name(source).alias("source_name"),
            F.when(rel.rlike(bracket), F.regexp_extract(rel, bracket, 1)).otherwise(rel).alias("rel_type"),
            F.coalesce(F.try_element_at(sure, F.lit(-1)), F.lit("EXTRACTED")).alias("confidence"),
            kind(target).alias("target_type"), name(target).alias("target_name"),
        ),
    )


def loose_edge(line: Column) -> Column:
    """struct(source, rel_type, target) of ``end->verb->end``, else null: brackets around a verb don't count, a target may hold arrows."""
    parts = F.split(line, "->")
    verb = F.translate(stripped(F.get(parts, 1)), "[]", "")
    target = stripped(F.array_join(F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1))), "->"))
    return F.when(F.size(parts) >= 3, F.struct(stripped(F.get(parts, 0)).alias("source"), classify_verb(verb).alias("rel_type"), target.alias("target")))


def spellings(nodes: DataFrame) -> DataFrame:
    """(doc_id, spelling, key) of nodes (doc_id, seq, key, name): each text that finds a node of its document, once.

    A node is found by its whole key, its name, or what follows a colon of its
    key. A whole key goes before the others; of several nodes that have a
    spelling the first by ``seq``, then by key, is meant.
    """
    parts = F.split("key", ":")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i + 1, F.size(parts)), ":"))
    after = F.slice(ends, F.lit(1), F.size(parts) - 1)  # the last, after no colon, is none
    others = F.array_except(F.array_union(F.array("name"), after), F.array("key"))
    whole = nodes.select("doc_id", "seq", "key", F.lit(0).alias("place"), F.col("key").alias("spelling"))
    rest = nodes.select("doc_id", "seq", "key", F.lit(1).alias("place"), F.explode(others).alias("spelling"))
    best = F.min(F.struct("place", "seq", "key"))
    return whole.union(rest).groupBy("doc_id", "spelling").agg(best.alias("b")).select("doc_id", "spelling", F.col("b.key").alias("key"))


def normalized_edges(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, seq, source_key, rel_type, target_key) of lines (doc_id, seq, line) whose two ends are nodes of the document.

    Ends are resolved by equi-joins on their spelling; other lines go, and a null name or line finds nothing.
    """
    found = spellings(nodes.where("key IS NOT NULL"))
    out = lines.select("doc_id", "seq", loose_edge(F.col("line")).alias("e")).where("e IS NOT NULL").select("doc_id", "seq", "e.*")
    for end in ("source", "target"):
        out = out.join(found.select("doc_id", F.col("spelling").alias(end), F.col("key").alias(f"{end}_key")), ["doc_id", end])
    return out.select("doc_id", "seq", "source_key", "rel_type", "target_key")
