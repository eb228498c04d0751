"""Ingestion queries, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom.operators import code, ingest, writes
from graphloom.sources.tables import chunks, documents, layer_of, nodes, table

from .views import sql


def source_chunks(spark, sf):
    return ingest.source_chunks(documents(spark, sf))


def image_chunks(spark, sf):
    """Up to two images of each document, every fourth document's without captions, after its chunks."""
    d = documents(spark, sf)
    images = d.select("doc_id", F.explode(F.expr("slice(array(1L, 2L), 1, int(doc_id % 3))")).alias("position"), "source")
    images = images.select(
        "doc_id", "position", (F.col("position") * 2).alias("page"), F.concat_ws("/", F.lit("img"), "doc_id", "position").alias("image_uri"),
        F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("caption"),
    )
    return ingest.image_chunks(chunks(spark, sf), images)


def _entries(spark, sf):
    """Parts as catalogue entries of several types, some without names."""
    p = table(spark, sf, "part")
    kind = F.expr("CASE p_size % 3 WHEN 0 THEN 'types/spanner-table' WHEN 1 THEN 'bigquery-dataset' ELSE 'types/topic' END")
    name = F.when(F.col("p_partkey") % 11 != 0, F.concat(F.lit("entries/"), F.col("p_partkey")))
    return p.select(
        name.alias("entry_name"), kind.alias("entry_type"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("qualified_name"),
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).alias("resource"), F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_type")).alias("display_name"),
        F.lit(None).cast("string").alias("description"),
    )


def catalog_import(spark, sf):
    return ingest.catalogue_import(_entries(spark, sf))


def catalog_import_counts(spark, sf):
    return ingest.import_counts(ingest.catalogue_import(_entries(spark, sf)))


def glossary_pull(spark, sf):
    near = F.array(*(F.concat(F.lit("term-"), (F.col("p_partkey") + d).cast("string")) for d in (0, 1, 7)))
    return ingest.glossary_pull(table(spark, sf, "part").select(F.concat(F.lit("t:"), "p_partkey").alias("node_id"), F.concat(F.lit("term-"), "p_partkey").alias("name"), near.alias("synonyms")))


def gain_pruning(spark, sf):
    e = table(spark, sf, "events").select((F.col("event_id") % 97).alias("query_id"), F.col("event_id").alias("chunk_id"), (F.col("value") / 1000 - 0.02).alias("gain"))
    return ingest.prune_by_gain(e).select("query_id", "chunk_id", "rank")


def _sources(spark, sf):
    """Nations as Python files with their suppliers as classes, and routes by market segment; every fifth one is broken."""
    class_line = F.concat(F.lit("class C"), "s_suppkey", F.lit("(C"), F.greatest(F.col("s_suppkey") - 25, F.lit(0)), F.lit("):\n    pass"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.array_join(F.collect_list(class_line), "\n").alias("classes"))
    name = F.lower("c_mktsegment")
    route = F.concat(F.lit('@app.get("/'), name, F.lit('")\ndef on_'), name, F.lit("():\n    pass"))
    r = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.array_join(F.collect_set(route), "\n").alias("routes"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("src/m"), "n_nationkey", F.lit(".py")).alias("path"))
    head = F.concat(F.lit("import os, m"), F.col("k") + 1, F.when(F.col("k") % 5 == 0, " =").otherwise(""))
    return n.join(s, "k", "left").join(r, "k", "left").select("path", F.concat_ws("\n", head, "classes", "routes").alias("text"))


def parsed_modules(spark, sf):
    m = code.python_modules(_sources(spark, sf))
    return m.select("path", "module_name", F.size("classes").alias("n_classes"), F.size("functions").alias("n_functions"), F.array_join("imports", ",").alias("imports"), "error")


def parsed_code_edges(spark, sf):
    return writes.code_graph(code.python_modules(_sources(spark, sf)).where("error IS NULL"))[1]


def file_languages(spark, sf):
    """Parts as files with extensions in either case."""
    ends = F.array(*map(F.lit, ("py", "TSX", "md", "txt", "tar.sql", "go")))
    path = F.concat(F.lit("d.x/f"), "p_partkey", F.lit("."), F.get(ends, (F.col("p_size") % 6).cast("int")))
    return table(spark, sf, "part").groupBy(code.language_of(path).alias("language")).agg(F.count(F.lit(1)).alias("n"))


def markdown_pages(spark, sf):
    """Every third text has no title and every fourth no paragraph."""
    d = documents(spark, sf)
    title = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("# Page "), "doc_id", F.lit("\n\n"))).otherwise("")
    body = F.when(F.col("doc_id") % 4 != 0, F.repeat(F.lit("some  words\n"), (F.col("doc_id") % 150).cast("int"))).otherwise("")
    files = d.select(F.concat(F.lit("docs/"), "doc_id", F.lit(".md")).alias("path"), F.concat(title, F.lit("## part\n\n"), body).alias("text"))
    return code.markdown_pages(files)


def layer_categories(spark, sf):
    """Nodes by the category of a glossary that their layer is kept in."""
    n = nodes(spark, sf)
    return n.groupBy(ingest.category_of(layer_of(F.col("node_type"))).alias("category")).agg(F.count(F.lit(1)).alias("n"))


SQL = {
    "source_chunks": r"""WITH p AS (SELECT doc_id, p0, substr(text, p0, 1500) AS chunk_text FROM (
  SELECT doc_id, text, unnest(range(1, length(text) + 1, 1500)) AS p0 FROM documents WHERE text IS NOT NULL)),
n AS (SELECT doc_id, chunk_text, (row_number() OVER (PARTITION BY doc_id ORDER BY p0) - 1)::INT AS chunk_index FROM p WHERE regexp_matches(chunk_text, '\S'))
SELECT doc_id, chunk_index, md5(doc_id || ':c' || chunk_index) AS chunk_id, chunk_text FROM n""",
    "glossary_pull": """SELECT 't:' || a.p_partkey AS source_id, 't:' || b.p_partkey AS target_id FROM part a JOIN part b ON b.p_partkey IN (a.p_partkey + 1, a.p_partkey + 7)""",
    "image_chunks": sql(
        """, u AS (SELECT doc_id, max(chunk_index) + 1 AS used FROM chunks GROUP BY 1)
SELECT doc_id, coalesce(used, 0) + p - 1 AS chunk_index, '[Image from page ' || (2 * p) || ']' || CASE WHEN doc_id % 4 <> 0 AND trim(source) <> '' THEN ' ' || trim(source) ELSE '' END AS chunk_text,
  2 * p AS page, 'img/' || doc_id || '/' || p AS image_uri FROM documents LEFT JOIN u USING (doc_id), (VALUES (1), (2)) AS t(p) WHERE p <= doc_id % 3""", "chunks"),
    "gain_pruning": """WITH g AS (SELECT event_id % 97 AS query_id, event_id AS chunk_id, value / 1000 - 0.02::DOUBLE AS gain FROM events),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, chunk_id))::INT AS rank, max(gain) OVER q AS top, count(*) OVER q AS n_all FROM g WINDOW q AS (PARTITION BY query_id)),
k AS (SELECT *, count(*) FILTER (gain >= greatest(0.05::DOUBLE, top * 0.3::DOUBLE)) OVER (PARTITION BY query_id) AS n_enough FROM r)
SELECT query_id, chunk_id, rank FROM k WHERE n_all <= 3 OR rank <= least(greatest(n_enough, 3), 10)""",
}
_ENTRIES = """WITH e AS (SELECT CASE WHEN p_partkey % 11 <> 0 THEN 'entries/' || p_partkey END AS entry_name, p_size % 3 < 2 AS known,
  coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_name END, CASE WHEN p_partkey % 3 = 0 THEN p_brand END, CASE WHEN p_partkey % 11 <> 0 THEN 'entries/' || p_partkey END) AS fqn,
  CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS shown FROM part),
s AS (SELECT *, CASE WHEN entry_name IS NULL THEN 'failed' WHEN known THEN 'imported' ELSE 'skipped' END AS status, sha1('{namespace}'::BLOB || entry_name::BLOB) AS h FROM e)
""".replace("{namespace}", "".join(f"\\x{b:02X}" for b in uuid.NAMESPACE_DNS.bytes))
SQL["catalog_import"] = _ENTRIES + """SELECT entry_name, status,
  CASE WHEN status = 'imported' THEN substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
    || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) END AS node_id, CASE WHEN status = 'imported' THEN fqn END AS name,
  CASE WHEN status = 'imported' THEN coalesce(shown, fqn) END AS display_name, CASE WHEN status = 'imported' THEN '' END AS description FROM s"""
SQL["catalog_import_counts"] = _ENTRIES + "SELECT status, count(*) AS n FROM s GROUP BY 1"
_CODE = """WITH m AS (SELECT n_nationkey AS k, 'm' || n_nationkey AS module_name FROM nation), g AS (SELECT * FROM m WHERE k % 5 <> 0),
c AS (SELECT k, module_name, module_name || '.C' || s_suppkey AS name, module_name || '.C' || (s_suppkey - 25) AS base FROM supplier JOIN g ON s_nationkey = k),
r AS (SELECT DISTINCT k, module_name, lower(c_mktsegment) AS seg, 'GET /' || lower(c_mktsegment) || ': on_' || lower(c_mktsegment) AS name FROM customer JOIN g ON c_nationkey = k)
"""
SQL["parsed_modules"] = _CODE + """SELECT 'src/' || module_name || '.py' AS path, module_name, coalesce(n_classes, 0) AS n_classes, coalesce(n_functions, 0) AS n_functions,
  CASE WHEN k % 5 <> 0 THEN 'os,m' || (k + 1) ELSE '' END AS imports, CASE WHEN k % 5 = 0 THEN 'SyntaxError' END AS error
FROM m LEFT JOIN (SELECT k, count(*)::INT AS n_classes FROM c GROUP BY 1) USING (k) LEFT JOIN (SELECT k, count(*)::INT AS n_functions FROM r GROUP BY 1) USING (k)"""
SQL["parsed_code_edges"] = _CODE + """, e AS (SELECT 'ApplicationComponent' AS source_type, module_name AS source_name, 'Composition' AS rel_type, '' AS detail, 'ApplicationComponent' AS target_type, name AS target_name FROM c
UNION SELECT 'ApplicationComponent', module_name, 'Composition', 'placeholder', 'ApplicationComponent', unnest(['os', 'm' || (k + 1)]) FROM g
UNION SELECT 'ApplicationComponent', module_name, 'Realization', '', 'ApplicationService', module_name || '.on_' || seg FROM r
UNION SELECT 'ApplicationService', module_name || '.on_' || seg, 'Realization', '', 'ApplicationInterface', name FROM r)
SELECT *, 'EXTRACTED' AS confidence FROM e"""
SQL["file_languages"] = """SELECT ['python', 'typescript', 'markdown', NULL, 'sql', 'go'][p_size % 6 + 1] AS language, count(*) AS n FROM part GROUP BY 1"""
SQL["markdown_pages"] = """SELECT 'docs/' || doc_id || '.md' AS path, CASE WHEN doc_id % 3 <> 0 THEN 'Page ' || doc_id ELSE 'docs/' || doc_id || '.md' END AS title,
  CASE WHEN doc_id % 4 <> 0 THEN left(rtrim(repeat('some  words' || chr(10), (doc_id % 150)::INT), chr(10)), 1000) ELSE '' END AS summary FROM documents"""
SQL["layer_categories"] = sql(
    """, c AS (SELECT CASE WHEN node_type = 'Capability' THEN 'strategy' WHEN node_type LIKE 'Business%' OR node_type = 'Contract' THEN 'business'
  WHEN node_type LIKE 'Application%' OR node_type = 'DataObject' THEN 'application' END AS category FROM nodes)
SELECT category, count(*) AS n FROM c GROUP BY 1""", "nodes")

QUERIES = {n: globals()[n] for n in SQL}
