"""Graph writes, payloads and small column rules as queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import retrieval, tables, writes
from graphloom.sources.tables import chunks, documents, edges, layer_of, nodes, progress, table

from .views import sql

# A stand-in for extraction: customers and orders as typed lines; a fifth of the customers is named on edges only.


def _node_lines(spark, sf):
    c = table(spark, sf, "customer").where("c_custkey % 5 <> 0")
    first = c.select((F.col("c_custkey") % 7).alias("doc_id"), F.col("c_custkey").alias("seq"), F.concat(F.lit("BusinessActor:"), "c_name").alias("line"))
    again = c.where("c_custkey % 3 = 0").select(F.lit(9).cast("bigint").alias("doc_id"), (F.col("c_custkey") + 10**9).alias("seq"), F.concat(F.lit("BusinessActor:"), "c_name").alias("line"))
    o = table(spark, sf, "orders").select((F.col("o_orderkey") % 7).alias("doc_id"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("BusinessProcess:Order#"), "o_orderkey").alias("line"))
    return first.unionByName(again).unionByName(o)


def _edge_lines(spark, sf):
    named = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    status = F.when(F.col("o_orderstatus") == "O", "EXTRACTED").otherwise("INFERRED")
    line = F.concat(F.lit("BusinessActor:"), "c_name", F.lit("->Assignment[places,"), status, F.lit("]->BusinessProcess:Order#"), "o_orderkey")
    return named.select(F.col("o_orderkey").alias("seq"), line.alias("line"))


def graph_write_nodes(spark, sf):
    return writes.node_rows(_node_lines(spark, sf))


def graph_write_edges(spark, sf):
    return writes.edge_rows(_edge_lines(spark, sf), writes.node_rows(_node_lines(spark, sf)))


def graph_write_mentions(spark, sf):
    """Chunks by the nodes whose names, the first words of benchmark passages, stand in them, with the title of their document."""
    first = F.split(F.lower("text"), " ")[0]
    names = table(spark, sf, "benchmark").groupBy(first.alias("name")).agg(F.concat(F.lit("b:"), F.min("item_id")).alias("node_id")).where(F.length("name") > 3)
    found = retrieval.mentions(chunks(spark, sf), names)
    context = F.concat(F.lit("named in "), "title")
    return found.join(documents(spark, sf).select("doc_id", "title"), "doc_id").select("doc_id", "chunk_id", "node_id", context.alias("mention_context"))


def _replaced(spark, sf):
    """Every fifth document comes again, with a new id and without its last chunk."""
    d, c = documents(spark, sf).select("doc_id", "title", "tenant_id"), chunks(spark, sf).select("doc_id", "chunk_index")
    again = d.where("doc_id % 5 = 0").withColumn("doc_id", F.col("doc_id") + 10**9)
    new = c.where("doc_id % 5 = 0 AND chunk_index > 0").select((F.col("doc_id") + 10**9).alias("doc_id"), (F.col("chunk_index") - 1).alias("chunk_index"))
    return writes.replace_documents(d, {"chunks": c}, again, {"chunks": new})


def replace_documents(spark, sf):
    return _replaced(spark, sf)["documents"]


def replace_document_chunks(spark, sf):
    return _replaced(spark, sf)["chunks"].groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))


def chunk_export(spark, sf):
    """Chunks of one tenant with their titles, in the order of title and index."""
    mine = retrieval.scoped(documents(spark, sf), retrieval.Scope("tenant_a", mode="mine")).select("doc_id", "title")
    c = chunks(spark, sf).where(F.length("chunk_text") > 100)
    return c.join(mine, "doc_id").select("title", "chunk_index", F.length("chunk_text").alias("size")).orderBy("title", "chunk_index")


def document_list(spark, sf):
    d = retrieval.scoped(documents(spark, sf), retrieval.Scope("tenant_a"))
    return d.orderBy("title").select("doc_id", text.or_else(F.col("title"), F.lit("Untitled")).alias("title"), text.or_else(F.col("source"), F.lit("")).alias("source"), F.col("tenant_id").startswith("__shared__").alias("shared"))


def column_rules(spark, sf):
    """Filters and display rules: comma lists, UUID shapes, defaults for empty names, cut texts."""
    d = documents(spark, sf)
    raw = F.concat(F.lit(" "), F.coalesce("source", F.lit("")), F.lit(", ,x"), "doc_id", F.lit(" ,"))
    some_id = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("0000000A-1111-2222-3333-"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))).otherwise(F.concat(F.lit("id-"), "doc_id"))
    name = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("title"))
    return d.select(
        "doc_id", F.array_join(text.listed_values(raw), "|").alias("listed"), text.is_uuid(some_id).alias("is_uuid"),
        text.or_else(name, F.lit("Untitled")).alias("name"), F.length(text.shown(F.col("text"), 200)).alias("snippet_size"),
    )


def markdown_documents(spark, sf):
    """Title and first paragraph of texts as Markdown."""
    d = documents(spark, sf).where("text IS NOT NULL")
    md = F.concat(F.lit("## small\n# "), "title", F.lit("\n\n## part\n\n"), F.lit("first  paragraph of\n"), "source", F.lit("\n\nrest"))
    return d.where("source IS NOT NULL").select("doc_id", text.markdown_title(md).alias("md_title"), text.markdown_paragraph(md).alias("paragraph"))


def judge_json(spark, sf):
    """Scores out of fenced answers of a judge; broken ones give null."""
    e = table(spark, sf, "events")
    body = F.concat(F.lit('{"score": '), F.col("event_id") % 6, F.when(F.col("event_id") % 4 == 0, "").otherwise("}"))
    said = F.concat(F.lit("Sure!\n```json\n"), body, F.lit("\n```"))
    return e.select("event_id", text.fenced_json(said, "score int")["score"].alias("score"))


def entity_payloads(spark, sf):
    return writes.as_json(nodes(spark, sf).where("node_type = 'BusinessRole'").select("node_id", "node_type", "name"), "node_id")


def inspector_items(spark, sf):
    """The first edges of each hub-like source, with how many there are."""
    e = edges(spark, sf).where("rel_type = 'Serving'").select("source_id", "target_id")
    return writes.inspector(e, "source_id", "target_id", 200)


def code_graph_nodes(spark, sf):
    return writes.code_graph(_modules(spark, sf))[0]


def code_graph_edges(spark, sf):
    return writes.code_graph(_modules(spark, sf))[1]


def _modules(spark, sf):
    """Nations as modules; suppliers as classes, every fourth an entity that refers to another, with a public and a private method; routes by market segment."""
    k = F.col("s_suppkey")
    name = F.concat(F.lit("C"), k)
    ref = lambda there: F.when(there, F.array(F.concat(F.lit("C"), k + 25))).otherwise(F.array().cast("array<string>"))
    classes = F.struct(name.alias("name"), (k % 4 == 0).alias("entity"), ref(k % 4 == 0).alias("refs"), ref(k % 10 == 3).alias("views"))
    methods = F.array(F.concat(name, F.lit(".run")), F.concat(name, F.lit("._load")))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.collect_list(classes).alias("classes"), F.flatten(F.collect_list(methods)).alias("methods"))
    segment = F.lower("c_mktsegment")
    handler = F.concat(F.when(F.length(segment) % 2 == 0, F.lit("on_")).otherwise(F.lit("_on_")), segment)
    route = F.struct(F.concat(F.lit("GET /"), segment, F.lit(": "), handler).alias("label"), handler.alias("handler"))
    r = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.collect_set(route).alias("routes"))
    imports = F.array(F.concat(F.lit("m"), F.col("n_nationkey") + 1), F.lit("os"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("m"), "n_nationkey").alias("module_name"), imports.alias("imports"))
    own = F.transform("routes", lambda x: x["handler"])
    functions = F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in (F.col("methods"), own)))
    return n.join(s, "k", "left").join(r, "k", "left").select("module_name", "classes", functions.alias("functions"), "routes", "imports")


def batch_breakdown(spark, sf):
    """Edges of a batch by the layer of their source and by confidence."""
    return edges(spark, sf).groupBy(layer_of(F.col("source_type")).alias("layer"), F.coalesce("confidence", F.lit("EXTRACTED")).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


def kept_artifacts(spark, sf):
    """Jobs whose artifacts are kept half an hour after the end; jobs end at their last purchase."""
    p = progress(spark, sf).groupBy("job_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("closed_at"), F.max("ts").alias("last_at"))
    return writes.alive(p.select("job_id", "closed_at", "last_at"), F.col("last_at") + F.expr("INTERVAL 20 MINUTES"), 30).select("job_id")


def job_artifacts(spark, sf):
    """Documents as files put by their sources, some again under the same path, every fiftieth a hundred times as long."""
    source = F.when(F.col("doc_id") % 50 == 0, F.repeat("text", F.lit(100))).otherwise(F.col("text"))
    d = documents(spark, sf).select(F.coalesce("source", F.lit("")).alias("job_id"), F.concat(F.lit("f"), F.col("doc_id") % 900).alias("file_path"), F.col("doc_id").alias("at"), source.alias("source"))
    return writes.artifacts(d).select("job_id", "file_path", F.md5("source").alias("source_md5"))


def late_events(spark, sf):
    """Events after their job's terminal event: kept, and told apart."""
    p = progress(spark, sf).select("job_id", "event_id", "event_type", "ts")
    closed = p.where("event_type = 'error'").groupBy("job_id").agg(F.min("ts").alias("closed_at"))
    joined = p.join(closed, "job_id", "left").withColumn("late", F.coalesce(F.col("ts") > F.col("closed_at"), F.lit(False)))
    return joined.groupBy("job_id", "late").agg(F.count(F.lit(1)).alias("n"))


_LINES = """WITH n AS (
  SELECT 'BusinessActor' AS node_type, c_name AS name, c_custkey % 7 AS doc_id, c_custkey AS seq FROM customer WHERE c_custkey % 5 <> 0
  UNION ALL SELECT 'BusinessActor', c_name, 9, c_custkey + 1000000000 FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 3 = 0
  UNION ALL SELECT 'BusinessProcess', 'Order#' || o_orderkey, o_orderkey % 7, o_orderkey FROM orders),
u AS (SELECT node_type, name, arg_max(doc_id, seq)::BIGINT AS source_doc_id, sha1('{namespace}'::BLOB || (node_type || ':' || name)::BLOB) AS h FROM n GROUP BY 1, 2),
w AS (SELECT *, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1)
  || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS node_id FROM u)
""".replace("{namespace}", "".join(f"\\x{b:02X}" for b in writes.GRAPH.bytes))
_MODULE_SQL = """WITH m AS (SELECT n_nationkey AS k, 'm' || n_nationkey AS module_name FROM nation),
c AS (SELECT module_name || '.C' || s_suppkey AS name, module_name, CASE WHEN s_suppkey % 4 = 0 THEN 'DataObject' ELSE 'ApplicationComponent' END AS kind, s_suppkey AS s,
  module_name || '.C' || (s_suppkey + 25) AS other FROM supplier JOIN m ON s_nationkey = k),
h AS (SELECT DISTINCT module_name, lower(c_mktsegment) AS seg, CASE WHEN length(c_mktsegment) % 2 = 0 THEN 'on_' ELSE '_on_' END || lower(c_mktsegment) AS fn FROM customer JOIN m ON c_nationkey = k),
e AS (
  SELECT 'ApplicationComponent' AS source_type, module_name AS source_name, 'Composition' AS rel_type, '' AS detail, kind AS target_type, name AS target_name FROM c
  UNION SELECT kind, name, 'Access', '', 'DataObject', other FROM c WHERE s % 4 = 0
  UNION SELECT kind, name, 'Realization', '', 'DataObject', other FROM c WHERE s % 10 = 3
  UNION SELECT kind, name, 'Realization', '', 'ApplicationService', name || '.run' FROM c
  UNION SELECT 'ApplicationComponent', module_name, 'Realization', '', 'ApplicationService', module_name || '.' || fn FROM h WHERE fn NOT LIKE '\\_%' ESCAPE '\\'
  UNION SELECT 'ApplicationService', module_name || '.' || fn, 'Realization', '', 'ApplicationInterface', 'GET /' || seg || ': ' || fn FROM h WHERE fn NOT LIKE '\\_%' ESCAPE '\\'
  UNION SELECT 'ApplicationComponent', module_name, 'Realization', '', 'ApplicationInterface', 'GET /' || seg || ': ' || fn FROM h WHERE fn LIKE '\\_%' ESCAPE '\\'
  UNION SELECT 'ApplicationComponent', module_name, 'Composition', 'placeholder', 'ApplicationComponent', unnest(['m' || (k + 1), 'os']) FROM m)
"""
SQL = {
    "graph_write_nodes": _LINES + "SELECT node_id, node_type, name, source_doc_id FROM w",
    "graph_write_edges": _LINES + """SELECT a.node_id AS source_id, b.node_id AS target_id, 'Assignment' AS rel_type, 'places' AS detail,
  CASE WHEN o_orderstatus = 'O' THEN 'EXTRACTED' ELSE 'INFERRED' END AS confidence
FROM orders JOIN customer ON c_custkey = o_custkey JOIN w a ON a.node_type = 'BusinessActor' AND a.name = c_name JOIN w b ON b.name = 'Order#' || o_orderkey""",
    "graph_write_mentions": sql(
        r""", names AS (SELECT regexp_extract(lower(text), '^[^ ]*') AS name, 'b:' || min(item_id) AS node_id FROM benchmark
  WHERE length(regexp_extract(lower(text), '^[^ ]*')) > 3 GROUP BY 1),
hits AS (SELECT DISTINCT chunk_id, doc_id, node_id FROM (
  SELECT chunk_id, doc_id, unnest(list_distinct(string_split_regex(lower(chunk_text), '[\x20\x09-\x0D]+'))) AS word FROM chunks) JOIN names ON name = word)
SELECT doc_id, chunk_id, node_id, 'named in doc-' || doc_id AS mention_context FROM hits""", "chunks"),
    "replace_documents": sql("SELECT CASE WHEN doc_id % 5 = 0 THEN doc_id + 1000000000 ELSE doc_id END AS doc_id, title, tenant_id FROM docs", "docs"),
    "replace_document_chunks": sql(
        """SELECT CASE WHEN doc_id % 5 = 0 THEN doc_id + 1000000000 ELSE doc_id END AS doc_id, count(*) AS n_chunks FROM chunks
WHERE doc_id % 5 <> 0 OR chunk_index > 0 GROUP BY 1""", "chunks"),
    "chunk_export": sql(
        """SELECT title, chunk_index, length(chunk_text)::INT AS size FROM chunks JOIN docs USING (doc_id)
WHERE tenant_id = 'tenant_a' AND length(chunk_text) > 100 ORDER BY title, chunk_index""", "chunks", "docs"),
    "document_list": sql(
        "SELECT doc_id, title, coalesce(source, '') AS source, starts_with(tenant_id, '__shared__') AS shared FROM docs ORDER BY title", "docs"),
    "column_rules": """SELECT doc_id, CASE WHEN coalesce(source, '') = '' THEN '' ELSE source || '|' END || 'x' || doc_id AS listed, doc_id % 2 = 0 AS is_uuid,
  CASE WHEN doc_id % 3 = 0 THEN 'Untitled' ELSE 'doc-' || doc_id END AS name, length(substr(coalesce(text, ''), 1, 200))::INT AS snippet_size FROM documents""",
    "markdown_documents": "SELECT doc_id, 'doc-' || doc_id AS md_title, 'first  paragraph of' || chr(10) || source AS paragraph FROM documents WHERE text IS NOT NULL AND source IS NOT NULL",
    "judge_json": "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN (event_id % 6)::INT END AS score FROM events",
    "entity_payloads": sql("""SELECT node_id, '{"node_type":"BusinessRole","name":"' || name || '"}' AS payload FROM nodes WHERE node_type = 'BusinessRole'""", "nodes"),
    "inspector_items": sql(
        """, s AS (SELECT source_id, target_id, (row_number() OVER (PARTITION BY source_id ORDER BY target_id))::INT AS position,
  count(*) OVER (PARTITION BY source_id) AS n_items FROM edges WHERE rel_type = 'Serving')
SELECT *, n_items > 200 AS truncated FROM s WHERE position <= 200""", "edges"),
    "code_graph_nodes": _MODULE_SQL + """SELECT source_type AS node_type, source_name AS name FROM e UNION SELECT target_type, target_name FROM e
UNION SELECT 'ApplicationComponent', module_name FROM m""",
    "code_graph_edges": _MODULE_SQL + "SELECT *, 'EXTRACTED' AS confidence FROM e",
    "batch_breakdown": None,
    "kept_artifacts": sql(
        """, p AS (SELECT job_id, max(ts) FILTER (event_type = 'purchase') AS closed_at, max(ts) AS last_at FROM progress GROUP BY 1)
SELECT job_id FROM p WHERE closed_at IS NULL OR closed_at >= last_at + INTERVAL 20 MINUTES - INTERVAL 30 MINUTES""", "progress"),
    "job_artifacts": """WITH p AS (SELECT coalesce(source, '') AS job_id, 'f' || doc_id % 900 AS file_path, doc_id AS nth,
  CASE WHEN doc_id % 50 = 0 THEN repeat(coalesce(text, ''), 100) ELSE coalesce(text, '') END AS body FROM documents),
f AS (SELECT job_id, file_path, min(nth) AS first, arg_max(body, nth) AS body FROM p GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY first) AS n FROM f)
SELECT job_id, file_path, md5(CASE WHEN strlen(body) > 51200 THEN left(body, 51200) || chr(10) || '...truncated...' ELSE body END) AS source_md5 FROM r WHERE n <= 500""",
    "late_events": sql(
        """, c AS (SELECT job_id, min(ts) AS closed_at FROM progress WHERE event_type = 'error' GROUP BY 1)
SELECT job_id, coalesce(ts > closed_at, false) AS late, count(*) AS n FROM progress LEFT JOIN c USING (job_id) GROUP BY 1, 2""", "progress"),
}


def _layers():
    from graphloom.registry import LAYERS

    return "CASE source_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LAYERS.items()) + " ELSE 'Other' END"


SQL["batch_breakdown"] = sql(f"SELECT {_layers()} AS layer, coalesce(confidence, 'EXTRACTED') AS confidence, count(*) AS n FROM edges GROUP BY 1, 2", "edges")
QUERIES = {name: globals()[name] for name in SQL}
