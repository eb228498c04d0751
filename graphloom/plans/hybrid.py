"""Hybrid search over embedded texts: keyword, vector and graph lists, each step as a query with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import embedding, vectors
from graphloom.operators import expansion, retrieval
from graphloom.sources.storage import materialize
from graphloom.sources.tables import chunks_of, documents, table

from .search import _QUESTIONS, _mine, _questions, _seen
from .views import sql

#: Types of the entities, by their number, and relations of the edges, by their line.
TYPES = ("Capability", "BusinessProcess", "Goal")
RELATIONS = ("Realization", "Influence", "Association")
ASKED, NEAR = 20, 15


def _entities(spark, sf):
    """(node_id, node_type, name, description): items by the first word of their text."""
    first = F.split(F.lower("text"), " ")[0]
    items = table(spark, sf, "benchmark").groupBy(first.alias("name")).agg(F.min(F.struct("item_id", "text")).alias("i")).where(F.length("name") > 3)
    kind = F.get(F.array(*map(F.lit, TYPES)), (F.col("i.item_id") % len(TYPES)).cast("int"))
    return items.select(F.concat(F.lit("b:"), "i.item_id").alias("node_id"), kind.alias("node_type"), "name", F.col("i.text").alias("description"))


def _links(spark, sf, sources=None):
    """(source_id, source_type, target_id, target_type, rel_type, confidence): suppliers and parts of line items as items, by their numbers.

    Of given ``sources`` (source_id) only: other line items go before the edges are grouped.
    """
    n = table(spark, sf, "benchmark").agg(F.count(F.lit(1)).alias("n"))  # one row
    kinds = F.array(*map(F.lit, TYPES))
    rank = F.max(F.expr("CASE l_returnflag WHEN 'N' THEN 2 WHEN 'R' THEN 1 ELSE 0 END"))
    rows = table(spark, sf, "lineitem").crossJoin(F.broadcast(n)).select(
        F.expr("try_mod(l_suppkey, n)").alias("s"), F.expr("try_mod(l_partkey, n)").alias("t"), "l_returnflag", F.get(F.array(*map(F.lit, RELATIONS)), (F.col("l_linenumber") % 3).cast("int")).alias("rel_type")
    )
    if sources is not None:
        rows = rows.join(sources.select(F.substring("source_id", 3, 20).cast("bigint").alias("s")).distinct(), "s", "left_semi")
    pairs = rows.groupBy("s", "t", "rel_type").agg(F.element_at(F.array(*map(F.lit, ("AMBIGUOUS", "INFERRED", "EXTRACTED"))), rank + 1).alias("confidence"))
    end = lambda c: [F.concat(F.lit("b:"), c), F.get(kinds, (F.col(c) % len(TYPES)).cast("int"))]
    (a, x), (b, y) = end("s"), end("t")
    return pairs.select(a.alias("source_id"), x.alias("source_type"), b.alias("target_id"), y.alias("target_type"), "rel_type", "confidence")


def _cut(docs):
    """The chunks of documents with their title and context: the source of a document is its chunks' context."""
    return chunks_of(docs.select("doc_id", "title", F.concat(F.lit("From "), "source").alias("context"), "text"))


def _embedded(cut):
    return cut.select("chunk_id", embedding.embedding_text(F.col("title"), F.col("context"), F.col("chunk_text")).alias("embedded"))


def _stored(spark, sf):
    """What is stored and embedded of each chunk."""
    stored = embedding.stored_text(F.col("context"), F.col("chunk_text")).alias("stored")
    return _cut(documents(spark, sf)).select("chunk_id", stored, embedding.embedding_text(F.col("title"), F.col("context"), F.col("chunk_text")).alias("embedded"))


def stored_chunks(spark, sf):
    return _stored(spark, sf).select("chunk_id", F.length("stored").alias("n_stored"), F.md5("stored").alias("stored"), F.md5("embedded").alias("embedded"))


def chunk_embeddings(spark, sf):
    """The vectors of the chunks as embedded, by place."""
    return embedding.embed(_embedded(_cut(documents(spark, sf))), ["chunk_id"], "embedded").select("chunk_id", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("embedding"))


def _turns(spark, sf, of="true"):
    """The vectors of user turns, of the conversations named."""
    q = table(spark, sf, "conversations").where(f"role = 'user' AND text IS NOT NULL AND {of}").select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), "text")
    return embedding.embed(q, ["query_id"], "text").withColumnRenamed("embedding", "query")


def _asked(spark, sf):
    """The stated query set of the searches."""
    return _turns(spark, sf, "conv_id % 100 = 0")


def _found(spark, sf):
    e = _entities(spark, sf)
    known = e.join(embedding.embed(e.select("node_id", F.concat_ws(" ", "name", "description").alias("text")), ["node_id"], "text"), "node_id")
    near = materialize(expansion.seeds(_asked(spark, sf), known))
    return expansion.connections(near, _links(spark, sf, near.select(F.col("node_id").alias("source_id"))), e)


def graph_seeds(spark, sf):
    """The entities nearest to each question, five of each type."""
    e = _entities(spark, sf)
    known = e.join(embedding.embed(e.select("node_id", F.concat_ws(" ", "name", "description").alias("text")), ["node_id"], "text"), "node_id")
    return expansion.seeds(_asked(spark, sf), known)


def graph_connections(spark, sf):
    """One hop from the seeds of each question, as the labels shown to its answerer."""
    return _found(spark, sf).select("query_id", expansion.label().alias("label"))


def graph_expansion(spark, sf):
    """The chunks that mention the entities discovered for a question."""
    return _expanded(_seen(spark, sf), _entities(spark, sf), expansion.discovered(_found(spark, sf)))


def _expanded(seen, nodes, names):
    return expansion.naming_chunks(expansion.named_entities(names, nodes), nodes, seen)


def search_lists(spark, sf, keyword=ASKED, vector=ASKED):
    """(chunks of the lists, lists of a tenant by name, names, connections): what is fused; every table is written once.

    Chunks are written with title and context, of which the embedded text is made when it is read.
    """
    seen = materialize(_cut(_mine(spark, sf)))
    kw = retrieval.keyword_ranks(_questions(spark, sf), seen, keyword)
    held = embedding.embed(_embedded(seen), ["chunk_id"], "embedded").withColumnRenamed("chunk_id", "vec_id")
    vec = vectors.nearest(_asked(spark, sf), held, vector).select("query_id", F.col("vec_id").alias("chunk_id"), "distance", "rank")
    found = materialize(_found(spark, sf))
    names = expansion.discovered(found)
    lists = {"keyword": kw, "vector": vec, "graph": _expanded(seen, _entities(spark, sf), names)}
    lists = {k: materialize(v.select("query_id", "chunk_id", "rank")) for k, v in lists.items()}
    return materialize(retrieval.listed(lists, seen.select("chunk_id", "chunk_text"))), lists, names, found


def hybrid_search(spark, sf, most=NEAR):
    """Keyword, vector and graph lists of the chunks a tenant may see, fused; the question's discovered names boost the chunks that hold them."""
    texts, lists, names, found = search_lists(spark, sf)
    return fused(texts, lists, names, found, most)


def fused(texts, lists, names, found, most):
    """The lists fused, with the boost of the names that stand in their chunks' ``texts``."""
    candidates = retrieval.candidates(lists).join(texts, "chunk_id")
    return retrieval.fuse(lists, texts, most, expansion.boosts(candidates, names, found))


def query_variants(spark, sf):
    """Each conversation's user turns as variants of one question: a chunk found by several keeps its least distance; the best ten stay."""
    held = embedding.embed(_embedded(_cut(documents(spark, sf))), ["chunk_id"], "embedded").withColumnRenamed("chunk_id", "vec_id")
    near = vectors.nearest(_turns(spark, sf), held, 10).withColumn("conv_id", F.substring_index("query_id", ":", 1))
    best = near.groupBy("conv_id", "vec_id").agg(F.min("distance").alias("distance"), F.count(F.lit(1)).alias("n_variants"))
    order = Window.partitionBy("conv_id").orderBy("distance", "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where("rank <= 10")
    return ranked.select("conv_id", F.col("vec_id").alias("chunk_id"), "distance", "n_variants", "rank")


def _vector_sql(name, rows):
    """CTEs that end in ``name`` (key, v) for ``rows`` of (key, t); zero vectors are left out."""
    return rf""", {name}_h AS (SELECT key, ('0x' || substr(md5(word), 1, 7))::BIGINT AS h
  FROM (SELECT key, unnest(list_filter(string_split_regex(lower(t), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '')) AS word FROM ({rows}))),
{name}_s AS (SELECT key, h % 64 AS i, sum(CASE WHEN h // 64 % 2 = 0 THEN 1 ELSE -1 END)::INT AS x FROM {name}_h GROUP BY 1, 2),
{name}_all AS (SELECT key, list_transform(range(64), lambda i: coalesce(map_extract(m, i)[1], 0)::DOUBLE) AS v FROM (SELECT key, map(list(i), list(x)) AS m FROM {name}_s GROUP BY 1)),
{name} AS (SELECT * FROM {name}_all WHERE list_sum(list_transform(v, lambda x: x * x)) > 0)"""


_STORED = r""", stored AS (
  SELECT chunk_id, doc_id, chunk_index, chunk_text, left(CASE WHEN source IS NULL THEN '' ELSE 'From ' || source || chr(10) || '---' || chr(10) END || chunk_text, 10000) AS stored,
    title || chr(10) || '---' || chr(10) || CASE WHEN source IS NULL THEN '' ELSE 'From ' || source || chr(10) || '---' || chr(10) END || chunk_text AS embedded
  FROM chunks JOIN docs USING (doc_id))"""
_ASKED = _vector_sql("qv", "SELECT conv_id || ':' || turn AS key, text AS t FROM conversations WHERE role = 'user' AND conv_id % 100 = 0 AND text IS NOT NULL")
_TURNS = _vector_sql("qv", "SELECT conv_id || ':' || turn AS key, text AS t FROM conversations WHERE role = 'user' AND text IS NOT NULL")
_GRAPH = f""", ents AS (SELECT 'b:' || item_id AS node_id, {list(TYPES)}[item_id % 3 + 1] AS node_type, name, description FROM (
  SELECT regexp_extract(lower(text), '^[^ ]*') AS name, min(item_id) AS item_id, arg_min(text, item_id) AS description FROM benchmark GROUP BY 1) WHERE length(name) > 3),
links AS (SELECT 'b:' || s AS source_id, {list(TYPES)}[s % 3 + 1] AS source_type, 'b:' || t AS target_id, {list(TYPES)}[t % 3 + 1] AS target_type, rel_type,
  ['AMBIGUOUS', 'INFERRED', 'EXTRACTED'][max(CASE l_returnflag WHEN 'N' THEN 3 WHEN 'R' THEN 2 ELSE 1 END)] AS confidence
  FROM (SELECT l_suppkey % n AS s, l_partkey % n AS t, l_returnflag, {list(RELATIONS)}[l_linenumber % 3 + 1] AS rel_type FROM lineitem, (SELECT count(*) AS n FROM benchmark)) GROUP BY s, t, rel_type)
""" + _vector_sql("ev", "SELECT node_id AS key, name || ' ' || description AS t FROM ents") + """,
seeds AS (SELECT qv.key AS query_id, node_id, node_type, round(list_cosine_distance(qv.v, ev.v), 6) AS distance FROM qv, ev JOIN ents ON node_id = ev.key
  QUALIFY row_number() OVER (PARTITION BY qv.key, node_type ORDER BY round(list_cosine_distance(qv.v, ev.v), 6), node_id) <= 5),
conns AS (SELECT query_id, distance, source_id, s.name AS source_name, source_type, rel_type, confidence, target_id, t.name AS target_name, target_type FROM (
  SELECT * FROM (SELECT seeds.query_id, distance, links.* FROM links JOIN seeds ON seeds.node_id = source_id AND seeds.node_type = source_type)
  QUALIFY row_number() OVER (PARTITION BY query_id, source_type, rel_type ORDER BY source_id, target_id) <= 5) JOIN ents s ON s.node_id = source_id JOIN ents t ON t.node_id = target_id),
found AS (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY spot, name) AS place FROM (SELECT query_id, name, min(spot) AS spot FROM (
  SELECT query_id, source_name AS name, {'d': distance, 's': source_id, 'r': rel_type, 't': target_id, 'e': 0} AS spot FROM conns
  UNION ALL SELECT query_id, target_name, {'d': distance, 's': source_id, 'r': rel_type, 't': target_id, 'e': 1} FROM conns) GROUP BY 1, 2)),
wanted AS (SELECT query_id, node_id FROM found JOIN ents USING (name) WHERE place <= 10 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY place, node_id) <= 15)"""
_EXPANDED = r""", hits AS (SELECT DISTINCT chunk_id, doc_id, chunk_index, node_id FROM (
  SELECT chunk_id, doc_id, chunk_index, unnest(list_distinct(string_split_regex(lower(chunk_text), '[\x20\x09-\x0D]+'))) AS word FROM seen) JOIN ents ON name = word),
expanded AS (SELECT query_id, chunk_id, n_entities, (row_number() OVER (PARTITION BY query_id ORDER BY n_entities DESC, doc_id, chunk_index))::INT AS rank FROM (
  SELECT query_id, chunk_id, doc_id, chunk_index, count(DISTINCT node_id) AS n_entities FROM hits JOIN wanted USING (node_id) GROUP BY ALL) QUALIFY rank <= 10)"""
_FUSED = """, vec AS (SELECT qv.key AS query_id, cv.key AS chunk_id, round(list_cosine_distance(qv.v, cv.v), 6) AS distance, row_number() OVER (PARTITION BY qv.key
  ORDER BY round(list_cosine_distance(qv.v, cv.v), 6), cv.key) AS rank FROM qv, cv WHERE cv.key IN (SELECT chunk_id FROM seen) QUALIFY rank <= 20),
l AS (SELECT query_id, chunk_id, 'keyword' AS list, 0.4::DOUBLE AS weight, rank FROM kw UNION ALL SELECT query_id, chunk_id, 'vector', 1.0, rank FROM vec UNION ALL SELECT query_id, chunk_id, 'graph', 0.5, rank FROM expanded),
share AS (SELECT query_id, 0.5 + 0.5 * count(*) FILTER (confidence = 'EXTRACTED')::DOUBLE / count(*) AS weight FROM conns GROUP BY 1),
boost AS (SELECT query_id, chunk_id, round(0.3::DOUBLE * max(s.weight) * count(*) / 61, 6) AS boost FROM (SELECT DISTINCT query_id, chunk_id FROM l) JOIN chunks USING (chunk_id)
  JOIN found USING (query_id) JOIN share s USING (query_id) WHERE contains(lower(chunk_text), name) GROUP BY 1, 2),
b AS (SELECT query_id, substr(chunk_text, 1, 150) AS start, list, max(weight) AS weight, min(rank) AS rank, min(chunk_id) AS chunk_id, max(coalesce(boost, 0)) AS boost
  FROM l JOIN chunks USING (chunk_id) LEFT JOIN boost USING (query_id, chunk_id) GROUP BY 1, 2, 3),
fused AS (SELECT query_id, min(chunk_id) AS chunk_id, string_agg(list, '+' ORDER BY list) AS lists, round(sum(weight / (60 + rank)) + max(boost), 6) AS rrf FROM b GROUP BY query_id, start)"""
_CHUNK_VECTORS = _vector_sql("cv", "SELECT chunk_id AS key, embedded AS t FROM stored")

SQL = {
    "stored_chunks": sql(_STORED + "SELECT chunk_id, length(stored)::INT AS n_stored, md5(stored) AS stored, md5(embedded) AS embedded FROM stored", "chunks", "docs"),
    "chunk_embeddings": sql(
        _STORED + _CHUNK_VECTORS + "SELECT chunk_id, array_to_string(list_transform(coalesce(v, list_resize([]::DOUBLE[], 64, 0)), lambda x: x::INT), ',') AS embedding FROM stored LEFT JOIN cv_all ON key = chunk_id",
        "chunks", "docs",
    ),
    "graph_seeds": "WITH " + (_ASKED + _GRAPH)[2:] + "SELECT query_id, node_id, node_type, distance FROM seeds",
    "graph_connections": "WITH " + (_ASKED + _GRAPH)[2:] + """SELECT query_id,
  source_name || ' (' || source_type || ') -[' || rel_type || ', ' || confidence || ']-> ' || target_name || ' (' || target_type || ')' AS label FROM conns""",
    "graph_expansion": sql(_QUESTIONS + _ASKED + _GRAPH + _EXPANDED + "SELECT * FROM expanded", "chunks", "docs"),
    "hybrid_search": sql(
        _QUESTIONS + _STORED + _ASKED + _CHUNK_VECTORS + _GRAPH + _EXPANDED + _FUSED
        + "SELECT query_id, chunk_id, lists, rrf, (row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id))::INT AS rank FROM fused QUALIFY rank <= 15", "chunks", "docs"),
    "query_variants": sql(
        _STORED + _TURNS + _CHUNK_VECTORS + """, f AS (SELECT split_part(qv.key, ':', 1) AS conv_id, cv.key AS chunk_id, round(list_cosine_distance(qv.v, cv.v), 6) AS distance FROM qv, cv
  QUALIFY row_number() OVER (PARTITION BY qv.key ORDER BY round(list_cosine_distance(qv.v, cv.v), 6), cv.key) <= 10)
SELECT conv_id, chunk_id, min(distance) AS distance, count(*) AS n_variants, (row_number() OVER (PARTITION BY conv_id ORDER BY min(distance), chunk_id))::INT AS rank FROM f GROUP BY 1, 2 QUALIFY rank <= 10""",
        "chunks", "docs"),
}
QUERIES = {name: globals()[name] for name in SQL}
