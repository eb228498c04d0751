"""A brief of the whole graph, as lines of its sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import graph, rules
from graphloom.registry import NODE_TYPES, RELATIONS, RULES
from graphloom.sources.storage import materialize
from graphloom.sources.tables import layer_of

SECTIONS = ("overview", "hubs", "node types", "relations", "connections", "gaps", "conformance", "documents")
# Percentages from which ambiguous and unlabelled edges are gaps; hubs with connections, connections of a relation, and of all.
AMBIGUOUS_FROM, UNLABELLED_FROM = 5, 10
CONNECTED, PER_RELATION, CONNECTIONS = 5, 3, 20


def _joined(*parts: str | Column) -> Column:
    """Text and columns as one text; null counts as empty."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def _lines(df: DataFrame, section: str, order: str, line: Column) -> DataFrame:
    """Lines of a section; ``order`` is a column or a number."""
    return df.select(F.lit(section).alias("section"), F.expr(order).cast("long").alias("ord"), line.alias("line"))


def _share(part: str) -> Column:
    return F.coalesce(F.round(F.try_divide(F.col(part) * 100, F.col("n_edges"))).cast("long"), F.lit(0))


def _absent(known: tuple[str, ...], found: DataFrame, column: str) -> DataFrame:
    """One row: the sorted names of ``known`` that no row has, as ``names``, null if there is none."""
    names = found.sparkSession.createDataFrame([(k,) for k in known], f"{column} string").join(found, column, "left_anti")
    return names.agg(F.array_join(F.array_sort(F.collect_list(column)), ", ").alias("names")).where("names <> ''")


def brief(nodes: DataFrame, edges: DataFrame, docs: DataFrame, chunks: DataFrame, mentions: DataFrame, top: int = 15, checks=RULES) -> DataFrame:
    """(section, ord, line): counts, hubs, types, relations, connections, gaps, rules and documents.

    Edges are written once. Types and relations, each a few dozen rows, are
    ranked in one task; documents are in the order of their ids and all listed.
    """
    edges = materialize(edges)
    label = F.coalesce("confidence", F.lit("NULL"))
    by_relation = materialize(edges.groupBy("rel_type", label.alias("label")).agg(F.count(F.lit(1)).alias("n")))
    by_type = materialize(nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n")))
    labels = ("EXTRACTED", "INFERRED", "AMBIGUOUS", "NULL")
    shares = by_relation.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_edges"), *(F.coalesce(F.sum(F.when(F.col("label") == x, F.col("n"))), F.lit(0)).alias(x) for x in labels))
    counted = by_type.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_nodes"), F.count(F.lit(1)).alias("n_types"))
    sizes = docs.agg(F.count(F.lit(1)).alias("n_docs")).crossJoin(chunks.agg(F.count(F.lit(1)).alias("n_chunks")))

    largest = F.row_number().over(Window.orderBy(F.desc("n"), "name"))
    types = by_type.select(F.col("node_type").alias("name"), "n").withColumn("rank", largest)
    relations = by_relation.groupBy(F.col("rel_type").alias("name")).agg(F.sum("n").alias("n")).withColumn("rank", largest)
    hubs = materialize(graph.hubs(nodes, edges, top).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("degree"), "node_id"))))

    first = hubs.where(F.col("rank") <= CONNECTED).select(F.col("node_id").alias("source_id"), "rank", "name")
    order = Window.partitionBy("source_id", "rel_type").orderBy("target_id")
    few = edges.join(F.broadcast(first), "source_id").withColumn("n", F.row_number().over(order)).where(F.col("n") <= PER_RELATION)
    few = few.withColumn("place", F.row_number().over(Window.orderBy("rank", "rel_type", "target_id"))).where(F.col("place") <= CONNECTIONS)
    label = F.coalesce("confidence", F.lit("EXTRACTED"))

    report = materialize(rules.conformance(nodes, edges, docs, mentions, checks))
    passed, n = F.col("status") == "passed", F.col("n_violations")
    summary = report.agg(F.count_if(passed).alias("passed"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "warning").alias("warnings"), F.count_if(F.col("status") == "error").alias("errors"))
    outcome = F.when(passed, "PASS").otherwise(_joined(F.upper("severity"), ", ", n, " violations"))
    met = mentions.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_mentions"))

    parts = [
        _lines(counted, "overview", "1", _joined(F.col("n_nodes"), " entities across ", F.col("n_types"), " types")),
        _lines(shares, "overview", "2", _joined(F.col("n_edges"), " relationships (", _share("EXTRACTED"), "% EXTRACTED, ", _share("INFERRED"), "% INFERRED, ", _share("AMBIGUOUS"), "% AMBIGUOUS)")),
        _lines(sizes, "overview", "3", _joined(F.col("n_docs"), " source documents, ", F.col("n_chunks"), " chunks")),
        _lines(hubs, "hubs", "rank", _joined(F.col("name"), " (", F.col("node_type"), "), ", F.col("degree"), " connections")),
        _lines(types, "node types", "rank", _joined(F.col("name"), " [", layer_of(F.col("name"), ""), "]: ", F.col("n"))),
        _lines(relations, "relations", "rank", _joined(F.col("name"), ": ", F.col("n"))),
        _lines(few, "connections", "place", _joined(F.col("name"), " (", F.col("source_type"), ") -[", F.col("rel_type"), ", ", label, "]-> (", F.col("target_type"), ")")),
        _lines(shares.where(F.col("AMBIGUOUS") * 100 > F.col("n_edges") * AMBIGUOUS_FROM), "gaps", "1", _joined(_share("AMBIGUOUS"), "% of edges are AMBIGUOUS")),
        _lines(shares.where(F.col("NULL") * 100 > F.col("n_edges") * UNLABELLED_FROM), "gaps", "2", _joined(_share("NULL"), "% of edges have no label")),
        _lines(_absent(NODE_TYPES, by_type, "node_type"), "gaps", "3", _joined("No entities of ", F.col("names"))),
        _lines(_absent(RELATIONS, by_relation, "rel_type"), "gaps", "4", _joined("No edges of ", F.col("names"))),
        _lines(summary, "conformance", "0", _joined(F.col("passed"), "/", F.col("total"), " passed, ", F.col("warnings"), " warnings, ", F.col("errors"), " errors")),
        _lines(report.withColumn("rank", F.row_number().over(Window.orderBy("rule_id"))), "conformance", "rank", _joined(F.col("rule_id"), " [", outcome, "]")),
        _lines(docs.join(met, "doc_id", "left"), "documents", "doc_id", _joined(F.coalesce("title", F.lit("Untitled")), ": ", F.coalesce("n_mentions", F.lit(0)))),
    ]
    return reduce(DataFrame.unionByName, parts)
