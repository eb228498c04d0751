"""From extracted lines to the graph's tables: nodes, edges, mentions, replacement of documents, and payloads."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import parse_edge, parse_node, uuid5
from graphloom.operators.tables import last_per_key

GRAPH = uuid.uuid5(uuid.NAMESPACE_URL, "graphloom/graph")
# An inspector shows this many items of a document, and keeps an artifact this long after its job's end.
SHOWN = 200
KEEP_MINUTES = 30
# Files that the artifacts of a job hold, bytes of a source beyond which it is cut, and the mark of a cut.
JOB_FILES, SOURCE_BYTES, CUT_MARK = 500, 50 * 1024, "\n...truncated..."


def node_rows(lines: DataFrame) -> DataFrame:
    """(node_id, node_type, name, source_doc_id) of lines (doc_id, seq, line): one row for each ``Type:Name``, the last line's."""
    parsed = lines.select("doc_id", "seq", parse_node(F.col("line")).alias("n")).where("n IS NOT NULL")
    rows = last_per_key(parsed.select(F.col("n.node_type"), F.col("n.name"), F.col("doc_id").alias("source_doc_id"), "seq"), ["node_type", "name"], "seq")
    return rows.select(uuid5(GRAPH, F.concat_ws(":", "node_type", "name")).alias("node_id"), "node_type", "name", "source_doc_id")


def edge_rows(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source_id, target_id, rel_type, detail, confidence) of edge lines whose two ends are nodes; the last line of an edge counts.

    Ends are resolved by equi-joins on type and name; an unresolved edge goes.
    """
    parsed = lines.select("seq", parse_edge(F.col("line")).alias("e")).where("e IS NOT NULL").select("seq", "e.*")
    for end in ("source", "target"):
        named = nodes.select(F.col("node_type").alias(f"{end}_type"), F.col("name").alias(f"{end}_name"), F.col("node_id").alias(f"{end}_id"))
        parsed = parsed.join(named, [f"{end}_type", f"{end}_name"])
    return last_per_key(parsed, ["source_id", "target_id", "rel_type"], "seq").select("source_id", "target_id", "rel_type", "detail", "confidence")


def replace_documents(docs: DataFrame, children: dict[str, DataFrame], new: DataFrame, new_children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables after ``new`` documents take the place of those of their title and tenant, children with them."""
    old = docs.join(new.select("title", "tenant_id").distinct(), ["title", "tenant_id"], "left_semi").select("doc_id")
    after = {"documents": docs.join(old, "doc_id", "left_anti").unionByName(new)}
    return after | {name: df.join(old, "doc_id", "left_anti").unionByName(new_children[name]) for name, df in children.items()}


def append(df: DataFrame, path: str) -> None:
    """Add rows to a table; a job that fails leaves none of its rows."""
    df.write.mode("append").parquet(path)


def as_json(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, payload): the other columns as one JSON object."""
    return df.select(*keys, F.to_json(F.struct(*(c for c in df.columns if c not in keys))).alias("payload"))


def inspector(items: DataFrame, by: str, order: str, shown: int = SHOWN) -> DataFrame:
    """The first ``shown`` items of each ``by``, with how many there are and whether some are left out."""
    counts = items.groupBy(by).agg(F.count(F.lit(1)).alias("n_items"))
    first = Window.partitionBy(by).orderBy(order)
    kept = items.withColumn("position", F.row_number().over(first)).where(F.col("position") <= shown)
    return kept.join(counts, by).withColumn("truncated", F.col("n_items") > shown)


def artifacts(puts: DataFrame, files: int = JOB_FILES) -> DataFrame:
    """(job_id, file_path, source) of puts (job_id, file_path, at, source): the first ``files`` files of a job, each as last put.

    Puts of a job need different ``at``. A source beyond ``SOURCE_BYTES`` bytes
    is cut to as many characters and marked; a null source is empty.
    """
    last = puts.groupBy("job_id", "file_path").agg(F.min("at").alias("first"), F.max_by("source", "at").alias("source"))
    order = Window.partitionBy("job_id").orderBy("first", "file_path")
    kept = last.withColumn("n", F.row_number().over(order)).where(F.col("n") <= files)
    source = F.coalesce("source", F.lit(""))
    cut = F.when(F.octet_length(source) > SOURCE_BYTES, F.concat(F.left(source, F.lit(SOURCE_BYTES)), F.lit(CUT_MARK))).otherwise(source)
    return kept.select("job_id", "file_path", cut.alias("source"))


def alive(closed: DataFrame, as_of: Column, minutes: int = KEEP_MINUTES) -> DataFrame:
    """Jobs (job_id, closed_at) whose artifacts are still kept: open ones, and those closed at most ``minutes`` ago."""
    return closed.where(F.col("closed_at").isNull() | (F.col("closed_at") >= as_of - F.expr(f"INTERVAL {minutes} MINUTES")))


#: A module that is imported counts as a component that its importer composes, with this mark on the edge.
PLACEHOLDER = "placeholder"


def code_graph(modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of parsed code.

    ``modules`` has module_name, classes (name, entity, refs, views), functions
    (``name`` or ``Class.name``), routes (label, handler) and imports. A module
    and each of its classes is a component, a class that is an entity a data
    object; the module composes them. A public function is a service that its class or
    module realises; names with a leading underscore are private. A route is an interface
    realised by its handler's service, or by the module where that is private. ``refs``
    of a class are accesses to data objects of the module, ``views`` realisations
    of them. Every import is a component composed as a ``PLACEHOLDER``, known or not.
    """
    m = modules.select("module_name", "classes", "functions", "routes", "imports")
    component, data, service, interface = "ApplicationComponent", "DataObject", "ApplicationService", "ApplicationInterface"
    full = lambda x: F.concat_ws(".", "module_name", x)

    def edge(df: DataFrame, source_type, source, rel: str, target_type, target, detail: str = "") -> DataFrame:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        return df.select(
            lit(source_type).alias("source_type"), source.alias("source_name"), F.lit(rel).alias("rel_type"), F.lit(detail).alias("detail"), F.lit("EXTRACTED").alias("confidence"),
            lit(target_type).alias("target_type"), target.alias("target_name"),
        )

    owner = F.col("module_name")
    c = m.select("module_name", F.explode("classes").alias("c")).select("module_name", "c.*")
    c = c.withColumns({"full": full("name"), "kind": F.when(F.col("entity"), data).otherwise(component)})
    held = lambda column: c.select("module_name", "kind", "full", F.explode(column).alias("other"))
    f = m.select("module_name", F.explode("functions").alias("name"))
    f = f.where(~F.substring_index("name", ".", -1).startswith("_")).withColumn("full", full("name"))
    own, methods = f.where(~F.contains("name", F.lit("."))), f.where(F.contains("name", F.lit(".")))
    methods = methods.withColumn("class", full(F.regexp_replace("name", r"\.[^.]*$", "")))
    kinds = c.select(F.col("full").alias("class"), "kind").distinct()
    r = m.select("module_name", F.explode("routes").alias("r")).select("module_name", "r.label", full("r.handler").alias("full"))
    served = r.join(f.select("full").distinct().withColumn("known", F.lit(True)), "full", "left")
    known = F.coalesce("known", F.lit(False))
    imports = m.select("module_name", F.explode("imports").alias("other")).where("other <> ''")
    parts = [
        edge(c, component, owner, "Composition", F.col("kind"), F.col("full")),
        edge(held("refs"), F.col("kind"), F.col("full"), "Access", data, full("other")),
        edge(held("views"), F.col("kind"), F.col("full"), "Realization", data, full("other")),
        edge(methods.join(kinds, "class"), F.col("kind"), F.col("class"), "Realization", service, F.col("full")),
        edge(own, component, owner, "Realization", service, F.col("full")),
        edge(served, F.when(known, service).otherwise(component), F.when(known, F.col("full")).otherwise(owner), "Realization", interface, F.col("label")),
        edge(imports, component, owner, "Composition", component, F.col("other"), PLACEHOLDER),
    ]
    edges = reduce(DataFrame.unionByName, parts).distinct()
    ends = m.select(F.lit(component).alias("node_type"), owner.alias("name"))
    for end in ("source", "target"):
        ends = ends.unionByName(edges.select(F.col(f"{end}_type").alias("node_type"), F.col(f"{end}_name").alias("name")))
    return ends.distinct(), edges
