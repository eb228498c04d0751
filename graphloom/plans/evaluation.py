"""Evaluation and pattern queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import vectors
from graphloom.operators import evaluation, graph, metrics, retrieval, tables
from graphloom.sources.storage import materialize
from graphloom.sources.tables import chunks, edges, nodes, numbered, table

from .views import sql


def _per_type(spark, sf):
    d = table(spark, sf, "documents").where("lang IS NOT NULL").select("lang", F.concat(F.lit("Item-"), F.col("doc_id") % 200).alias("item"), "doc_id")
    return metrics.precision_recall(d.where("doc_id % 3 <> 0"), d.where("doc_id % 4 <> 0"), "lang", "item")


def f1_rollup(spark, sf):
    return evaluation.rolled_up(_per_type(spark, sf))


def relation_coverage(spark, sf):
    """Extracted edges against all but customers' ones and, beside them, an unknown relation."""
    e = edges(spark, sf)
    found = e.where("rel_type <> 'Assignment' AND confidence = 'EXTRACTED'").select("rel_type").unionAll(e.where("rel_type = 'Composition'").select(F.lit("Flow").alias("rel_type")))
    return evaluation.relation_coverage(e.select("rel_type"), found)


def _scores(spark, sf):
    value = F.col("event_id") % 11 / 10
    return table(spark, sf, "events").select("event_id", value.alias("full"), (F.col("event_id") % 7 / 10).alias("vector"), (F.col("user_id") % 3).alias("hops"))


def arm_uplift(spark, sf):
    return evaluation.uplift(_scores(spark, sf), "full", "vector", "hops")


def judge_scores(spark, sf):
    e = table(spark, sf, "events").select((F.col("event_id") % 7 - 1).alias("faithfulness"), (F.col("event_id") % 5).alias("relevancy"), (F.col("user_id") % 6 - 1).alias("correctness"))
    return evaluation.judged(e, ["faithfulness", "relevancy", "correctness"])


def reranker_wins(spark, sf):
    e = table(spark, sf, "events").select(
        (F.col("event_id") % 5 / 4).alias("api_recall"), (F.col("event_id") % 900).cast("double").alias("api_ms"),
        (F.col("event_id") % 4 / 3).alias("model_recall"), (F.col("event_id") % 9000).cast("double").alias("model_ms"),
    )
    return evaluation.compared(e, ["api", "model"])


def most_common_parts(spark, sf):
    return evaluation.most_common(table(spark, sf, "lineitem"), "l_returnflag", "l_suppkey", 5)


def title_recall(spark, sf):
    k = F.col("o_orderkey")
    found, gold = F.array(k % 5, k % 7, k % 3), F.array(k % 5, k % 5, F.lit(2).cast("bigint"), F.lit(6).cast("bigint"))
    return table(spark, sf, "orders").select("o_orderkey", evaluation.title_recall(found, gold).alias("recall"))


def dev_test_split(spark, sf):
    q = table(spark, sf, "conversations").select("conv_id").distinct()
    return q.select("conv_id", evaluation.split_of(F.col("conv_id"), 42).alias("split"))


def split_leakage(spark, sf):
    """A question is in both splits if its turns were dealt out one by one: those are named."""
    t = table(spark, sf, "conversations").select("conv_id", evaluation.split_of(F.concat_ws(":", "conv_id", "turn"), 42).alias("split"))
    return evaluation.leaked(t, "conv_id")


def api_costs(spark, sf):
    """Calls, tokens and dollars by interface and tier: turns as calls that generate, embed a text or an image, or rerank."""
    t = table(spark, sf, "conversations").where("text IS NOT NULL").select(
        F.expr("CASE (conv_id + turn) % 4 WHEN 0 THEN 'embed' WHEN 1 THEN 'rerank' ELSE 'generate' END").alias("api"), F.expr("if(conv_id % 5 = 0, 'flex', 'standard')").alias("tier"),
        F.length("text").alias("chars"), F.expr("length(text) div 4").alias("tokens"), F.expr("turn % 3 * 7").alias("cached"), F.expr("turn % 4 * 10").alias("thinking"),
    )
    n, image = F.col("tokens"), F.col("tier") == "flex"
    generated = tables.price(n, F.floor(n / 2), F.col("cached"), F.col("thinking"), F.col("tier"))
    cost = F.when(F.col("api") == "generate", generated).when(F.col("api") == "embed", tables.embed_price(F.col("chars"), image)).otherwise(tables.RERANK_PRICE)
    used = F.when(F.col("api") == "generate", n).when(F.col("api") == "embed", tables.embed_tokens(F.col("chars"))).otherwise(0)
    return t.groupBy("api", "tier").agg(F.count(F.lit(1)).alias("calls"), F.sum(used).cast("bigint").alias("tokens"), F.round(F.sum(cost), 6).alias("cost"))


def _seeds(spark, sf, n):
    """The vectors nearest to vector 0, as suppliers by number: a stand-in for entities found by their embeddings."""
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    ask = v.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    near = numbered(vectors.nearest(ask, v, n), F.col("vec_id"), "k", table(spark, sf, "supplier"))
    return near.select(F.concat(F.lit("sup:"), F.col("k") + 1).alias("n0"), "distance").groupBy("n0").agg(F.min("distance").alias("distance"))


# The typed chains that a question is answered by: types of the middle and the last node.
CHAINS = (("BusinessProcess", "BusinessActor"), ("BusinessProcess", "DataObject"), ("BusinessRole", "BusinessActor"), ("BusinessRole", "BusinessFunction"), ("BusinessRole", "ApplicationComponent"))


def typed_chains(spark, sf):
    """The first three chains of each of five type triples, from the seeds nearest to a query, edges in either direction."""
    e, seeds = materialize(edges(spark, sf)), materialize(_seeds(spark, sf, 8))
    # the first hop of at most 8 seeds is written, so that the second join knows its size
    first = {m: materialize(graph.chain(e, seeds.select("n0"), [(None, "any", m)]).select(F.col("n0").alias("seed"), F.col("n1").alias("n0")).distinct()) for m in dict.fromkeys(m for m, _ in CHAINS)}
    out = None
    for i, (middle, last) in enumerate(CHAINS):
        met = graph.chain(e, first[middle], [(None, "any", last)])
        found = met.select(F.col("seed").alias("n0"), F.col("n0").alias("n1"), F.col("n1").alias("n2")).where("n2 <> n0").distinct()
        order = Window.partitionBy("pattern").orderBy("distance", "n0", "n1", "n2")
        ranked = found.join(F.broadcast(seeds), "n0").withColumn("pattern", F.lit(i)).withColumn("rank", F.row_number().over(order)).where("rank <= 3")  # at most 8 seeds
        out = ranked if out is None else out.unionByName(ranked)
    return out.select("pattern", "rank", "n0", "n1", "n2")


def vector_pattern(spark, sf):
    """One hop from suppliers whose vector is within 0.9 of the query's, the nearest first."""
    near = _seeds(spark, sf, 200).where("distance < 0.9").withColumnRenamed("n0", "source_id")
    e = edges(spark, sf).where("rel_type = 'Serving'").select("source_id", "target_id")
    return e.join(F.broadcast(near), "source_id").orderBy("distance", "source_id", "target_id").limit(50)  # at most 200 seeds


def motif_in_sql(spark, sf):
    """A pattern as a view inside SQL, counted by what it starts from."""
    start = nodes(spark, sf).where("node_type = 'BusinessFunction'").select(F.col("node_id").alias("n0"))
    graph.chain(edges(spark, sf), start, [("Composition", "outgoing", "BusinessRole"), ("Association", "outgoing", "ApplicationComponent")]).createOrReplaceTempView("motif_rows")
    return spark.sql("SELECT n0 AS node_id, count(DISTINCT n2) AS n_components FROM motif_rows GROUP BY n0")


def neighborhood_names(spark, sf):
    """The neighbourhood with names, only along edges that are sure or inferred; a node without a row keeps its id as its name."""
    e = edges(spark, sf).where(F.coalesce("confidence", F.lit("EXTRACTED")).isin("EXTRACTED", "INFERRED"))
    reached = graph.neighborhood(e, "nat:3", 2, 100)
    return reached.join(nodes(spark, sf).select("node_id", "node_type", "name"), "node_id", "left").select("node_id", "hop", "node_type", F.coalesce("name", "node_id").alias("name"))


def entity_search(spark, sf):
    """Suppliers by name (1.0), description (0.6) or vector (0.8 of the similarity): the best score of each counts."""
    s = table(spark, sf, "supplier").select(F.concat(F.lit("sup:"), "s_suppkey").alias("node_id"), F.col("s_name").alias("name"), F.concat(F.lit("Supplier of nation "), "s_nationkey").alias("description"))
    like = F.when(F.contains(F.lower("name"), F.lit("7")), 1.0).when(F.contains(F.lower("description"), F.lit("7")), 0.6)
    by_text = s.select("node_id", like.alias("score")).where("score IS NOT NULL")
    by_vector = _seeds(spark, sf, 40).select(F.col("n0").alias("node_id"), F.round(F.greatest(1 - F.col("distance"), F.lit(0.0)) * 0.8, 6).alias("score"))
    best = by_text.unionByName(by_vector).groupBy("node_id").agg(F.max("score").alias("score"))
    return s.join(best, "node_id").orderBy(F.desc("score"), "node_id").limit(20).select("node_id", "name", "score")


def first_occurrences(spark, sf):
    """Chunks told apart by how they start: the first of a start, in the order of documents and chunks, stays."""
    c = chunks(spark, sf).withColumn("start", F.substring("chunk_text", 1, 150))
    first = c.groupBy("start").agg(F.min(F.struct("doc_id", "chunk_index")).alias("f"), F.count(F.lit(1)).alias("n"))
    return first.select("f.doc_id", "f.chunk_index", "n")


def type_sample(spark, sf):
    """At most a share of a limit of each node type: 20 at least, 200 at most, by id."""
    order = Window.partitionBy("node_type").orderBy("node_id")
    cap = min(200, max(20, 1000 // 22))
    return nodes(spark, sf).withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap).select("node_id", "node_type")


def source_references(spark, sf):
    """One reference for each source and page, the first chunk's."""
    c = chunks(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    c = c.select(F.coalesce("source", F.lit("")).alias("source"), F.expr("chunk_index div 3 + 1").alias("page"), "doc_id", "chunk_index")
    return c.groupBy("source", "page").agg(F.min(F.struct("doc_id", "chunk_index")).alias("f")).select("source", "page", "f.doc_id", "f.chunk_index")


def graph_boost(spark, sf):
    """Chunks by what the entities that they name add to their score, surer edges adding more."""
    first = F.split(F.lower("text"), " ")[0]
    names = table(spark, sf, "benchmark").groupBy(first.alias("name")).agg(F.concat(F.lit("b:"), F.min("item_id")).alias("node_id")).where(F.length("name") > 3)
    found = retrieval.mentions(chunks(spark, sf), names)
    e = numbered(edges(spark, sf).where("rel_type = 'Access'"), F.substring("target_id", 5, 20).cast("bigint"), "k", table(spark, sf, "benchmark"))
    e = e.select(F.concat(F.lit("b:"), "k").alias("node_id"), "confidence")
    return retrieval.graph_boost(found, e).select("chunk_id", "n_mentions", "boost")


def scaled_points(spark, sf):
    """The first three coordinates of each vector, over the largest of them all."""
    v = table(spark, sf, "embeddings").select("vec_id", *(F.get("embedding", i).cast("double").alias(c) for i, c in enumerate("xyz")))
    most = v.agg(F.max(F.greatest(*(F.abs(c) for c in "xyz"))).alias("most"))
    return v.crossJoin(F.broadcast(most)).select("vec_id", *(F.round(F.try_divide(F.col(c), F.col("most")), 4).alias(c) for c in "xyz"))  # one row


_PAIRS = """WITH ask AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
near AS (SELECT vec_id, round(list_cosine_distance(embedding::DOUBLE[], q), 6) AS distance FROM embeddings, ask),
seed_{n} AS (SELECT 'sup:' || (vec_id % (SELECT count(*) FROM supplier) + 1) AS n0, min(distance) AS distance FROM (SELECT * FROM near ORDER BY distance, vec_id LIMIT {n}) GROUP BY 1)
"""


def _seeded(n, views):
    return _PAIRS.replace("{n}", str(n)) + "," + sql("", *views).removeprefix("WITH ")


_PATTERNS = " UNION ALL ".join(
    f"""SELECT {i} AS pattern, (row_number() OVER (ORDER BY distance, n0, n1, n2))::INT AS rank, n0, n1, n2 FROM (
  SELECT DISTINCT n0, distance, a.other_id AS n1, b.other_id AS n2 FROM seed_8 JOIN ways a ON a.node_id = n0 AND a.other_type = '{m}'
  JOIN ways b ON b.node_id = a.other_id AND b.other_type = '{z}' WHERE b.other_id <> n0)"""
    for i, (m, z) in enumerate(CHAINS)
)
SQL = {
    "f1_rollup": """WITH d AS (SELECT lang, lower('Item-' || doc_id % 200) AS item, doc_id FROM documents WHERE lang IS NOT NULL),
e AS (SELECT DISTINCT lang, item FROM d WHERE doc_id % 3 <> 0), f AS (SELECT DISTINCT lang, item FROM d WHERE doc_id % 4 <> 0),
c AS (SELECT coalesce(e.lang, f.lang) AS lang, count(*) FILTER (e.item IS NOT NULL AND f.item IS NOT NULL) AS tp, count(*) FILTER (e.item IS NULL) AS fp, count(*) FILTER (f.item IS NULL) AS fn
  FROM e FULL JOIN f ON e.lang = f.lang AND e.item = f.item GROUP BY 1),
p AS (SELECT *, round(tp::DOUBLE / (tp + fp), 6) AS p, round(tp::DOUBLE / (tp + fn), 6) AS r FROM c)
SELECT round(2 * avg(p) * avg(r) / (avg(p) + avg(r)), 4) AS macro_f1, round(2 * sum(tp)::DOUBLE / (2 * sum(tp) + sum(fp) + sum(fn)), 4) AS micro_f1 FROM p""",
    "relation_coverage": sql(
        """, e AS (SELECT rel_type, count(*) AS n FROM edges GROUP BY 1),
f AS (SELECT rel_type, count(*) AS n FROM (SELECT rel_type FROM edges WHERE rel_type <> 'Assignment' AND confidence = 'EXTRACTED'
  UNION ALL SELECT 'Flow' FROM edges WHERE rel_type = 'Composition') GROUP BY 1),
b AS (SELECT coalesce(e.rel_type, f.rel_type) AS rel_type, coalesce(e.n, 0) AS n_expected, coalesce(f.n, 0) AS n_found FROM e FULL JOIN f ON e.rel_type = f.rel_type)
SELECT rel_type, n_expected, n_found, n_found - n_expected AS delta,
  (SELECT round(count(*) FILTER (n_expected > 0 AND n_found > 0)::DOUBLE / count(*) FILTER (n_expected > 0), 4) FROM b) AS coverage FROM b""", "edges"),
    "arm_uplift": """WITH s AS (SELECT event_id % 11 / 10 AS f, event_id % 7 / 10 AS v, user_id % 3 AS hops FROM events)
SELECT round(avg(f - v), 4) AS uplift, round(avg(f - v) FILTER (hops > 1), 4) AS multi_hop_uplift, count(*) FILTER (f - v > 0) AS n_helped, count(*) AS n_questions FROM s""",
    "judge_scores": """WITH l AS (SELECT 'faithfulness' AS criterion, event_id % 7 - 1 AS v FROM events UNION ALL SELECT 'relevancy', event_id % 5 FROM events
  UNION ALL SELECT 'correctness', user_id % 6 - 1 FROM events)
SELECT criterion, round(avg(v) FILTER (v >= 0), 4) AS score, count(*) FILTER (v < 0) AS n_errors FROM l GROUP BY 1""",
    "reranker_wins": """WITH e AS (SELECT event_id % 5 / 4 AS a, (event_id % 900)::DOUBLE AS am, event_id % 4 / 3 AS m, (event_id % 9000)::DOUBLE AS mm FROM events)
SELECT 'api' AS arm, round(avg(a), 4) AS recall, round(avg(am), 1) AS latency_ms, count(*) FILTER (a > m) AS n_wins FROM e
UNION ALL SELECT 'model', round(avg(m), 4), round(avg(mm), 1), count(*) FILTER (m > a) FROM e""",
    "most_common_parts": """SELECT l_returnflag, l_suppkey, count(*) AS n, (row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_suppkey))::INT AS rank
FROM lineitem GROUP BY 1, 2 QUALIFY rank <= 5""",
    "title_recall": """SELECT o_orderkey, round(len(list_intersect(list_distinct([k % 5, k % 7, k % 3]), list_distinct([k % 5, 2, 6])))::DOUBLE / len(list_distinct([k % 5, 2, 6])), 4) AS recall
FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)""",
    "dev_test_split": """SELECT DISTINCT conv_id, CASE WHEN ('0x' || substr(sha1('42:' || conv_id), 1, 8))::BIGINT < 2147483648 THEN 'dev' ELSE 'test' END AS split FROM conversations""",
    "split_leakage": """SELECT conv_id, count(DISTINCT ('0x' || substr(sha1('42:' || conv_id || ':' || turn), 1, 8))::BIGINT < 2147483648) AS n_splits FROM conversations GROUP BY 1
HAVING count(DISTINCT ('0x' || substr(sha1('42:' || conv_id || ':' || turn), 1, 8))::BIGINT < 2147483648) > 1""",
    "api_costs": """WITH t AS (SELECT CASE (conv_id + turn) % 4 WHEN 0 THEN 'embed' WHEN 1 THEN 'rerank' ELSE 'generate' END AS api, conv_id % 5 = 0 AS flex,
  length(text) // 4 AS tokens, turn % 3 * 7 AS cached, turn % 4 * 10 AS thinking FROM conversations WHERE text IS NOT NULL),
c AS (SELECT api, CASE WHEN flex THEN 'flex' ELSE 'standard' END AS tier, CASE api WHEN 'generate' THEN tokens WHEN 'embed' THEN greatest(tokens, 1) ELSE 0 END AS used, CASE api
  WHEN 'generate' THEN (greatest(tokens - cached, 0) * CASE WHEN flex THEN 0.15::DOUBLE ELSE 0.30 END + (tokens // 2 + thinking) * CASE WHEN flex THEN 1.25::DOUBLE ELSE 2.50 END) / 1e6::DOUBLE
  WHEN 'embed' THEN greatest(tokens, 1) * CASE WHEN flex THEN 0.45::DOUBLE ELSE 0.20 END / 1e6::DOUBLE ELSE 0.001 END AS cost FROM t)
SELECT api, tier, count(*) AS calls, sum(used)::BIGINT AS tokens, round(sum(cost), 6) AS cost FROM c GROUP BY 1, 2""",
    "typed_chains": _seeded(8, ("ways",)) + _PATTERNS.replace("SELECT 0 AS", "SELECT * FROM (SELECT 0 AS", 1) + ") WHERE rank <= 3",
    "vector_pattern": _seeded(200, ("edges",)) + """SELECT source_id, target_id, distance FROM edges JOIN seed_200 ON n0 = source_id WHERE rel_type = 'Serving' AND distance < 0.9
ORDER BY distance, source_id, target_id LIMIT 50""",
    "motif_in_sql": sql(
        """SELECT a.source_id AS node_id, count(DISTINCT b.target_id) AS n_components FROM edges a JOIN edges b ON b.source_id = a.target_id
WHERE a.rel_type = 'Composition' AND b.rel_type = 'Association' GROUP BY 1""", "edges"),
    "neighborhood_names": sql(
        """, se AS (SELECT * FROM edges WHERE coalesce(confidence, 'EXTRACTED') IN ('EXTRACTED', 'INFERRED')),
k1 AS (SELECT source_id, target_id FROM (SELECT *, row_number() OVER (PARTITION BY rel_type ORDER BY source_id, target_id) AS n FROM se
  WHERE source_id = 'nat:3' OR target_id = 'nat:3') WHERE n <= 100),
h1 AS (SELECT source_id AS node_id FROM k1 UNION SELECT target_id FROM k1 EXCEPT SELECT 'nat:3'),
k2 AS (SELECT source_id, target_id FROM (SELECT *, row_number() OVER (PARTITION BY rel_type ORDER BY source_id, target_id) AS n FROM se
  WHERE source_id IN (FROM h1) OR target_id IN (FROM h1)) WHERE n <= 100),
h2 AS ((SELECT source_id AS node_id FROM k2 UNION SELECT target_id FROM k2) EXCEPT (SELECT node_id FROM h1 UNION SELECT 'nat:3')),
r AS (SELECT 'nat:3' AS node_id, 0 AS hop UNION ALL SELECT node_id, 1 FROM h1 UNION ALL SELECT node_id, 2 FROM h2)
SELECT node_id, hop, node_type, coalesce(name, node_id) AS name FROM r LEFT JOIN nodes USING (node_id)""", "edges", "nodes"),
    "entity_search": _PAIRS.replace("{n}", "40") + """, s AS (SELECT 'sup:' || s_suppkey AS node_id, s_name AS name, 'Supplier of nation ' || s_nationkey AS description FROM supplier),
a AS (SELECT node_id, CASE WHEN contains(lower(name), '7') THEN 1.0::DOUBLE WHEN contains(lower(description), '7') THEN 0.6::DOUBLE END AS score FROM s
  UNION ALL SELECT n0, round(greatest(1 - distance, 0) * 0.8::DOUBLE, 6) FROM seed_40)
SELECT node_id, name, max(score) AS score FROM a JOIN s USING (node_id) WHERE score IS NOT NULL GROUP BY 1, 2 ORDER BY score DESC, node_id LIMIT 20""",
    "first_occurrences": sql(
        """, r AS (SELECT doc_id, chunk_index, row_number() OVER (PARTITION BY substr(chunk_text, 1, 150) ORDER BY doc_id, chunk_index) AS k,
  count(*) OVER (PARTITION BY substr(chunk_text, 1, 150)) AS n FROM chunks) SELECT doc_id, chunk_index, n FROM r WHERE k = 1""", "chunks"),
    "type_sample": sql("SELECT node_id, node_type FROM nodes QUALIFY row_number() OVER (PARTITION BY node_type ORDER BY node_id) <= 45", "nodes"),
    "source_references": sql(
        """SELECT coalesce(source, '') AS source, (chunk_index // 3 + 1)::BIGINT AS page, doc_id, chunk_index FROM chunks JOIN documents USING (doc_id)
QUALIFY row_number() OVER (PARTITION BY coalesce(source, ''), chunk_index // 3 ORDER BY doc_id, chunk_index) = 1""", "chunks"),
    "graph_boost": sql(
        r""", names AS (SELECT regexp_extract(lower(text), '^[^ ]*') AS name, 'b:' || min(item_id) AS node_id FROM benchmark
  WHERE length(regexp_extract(lower(text), '^[^ ]*')) > 3 GROUP BY 1),
hits AS (SELECT DISTINCT chunk_id, doc_id, node_id FROM (
  SELECT chunk_id, doc_id, unnest(list_distinct(string_split_regex(lower(chunk_text), '[\x20\x09-\x0D]+'))) AS word FROM chunks) JOIN names ON name = word),
c AS (SELECT 'b:' || (substr(target_id, 5)::BIGINT % (SELECT count(*) FROM benchmark)) AS node_id, count(*) AS total, count(*) FILTER (coalesce(confidence, 'EXTRACTED') = 'EXTRACTED') AS sure
  FROM edges WHERE rel_type = 'Access' GROUP BY 1)
SELECT chunk_id, count(*) AS n_mentions, round(0.3::DOUBLE * (0.5 + 0.5 * coalesce(sum(sure)::DOUBLE / sum(total), 0)) * count(*) / 61, 6) AS boost
FROM hits LEFT JOIN c USING (node_id) GROUP BY 1""", "chunks", "edges"),
    "scaled_points": """WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
m AS (SELECT max(greatest(abs(x), abs(y), abs(z))) AS most FROM v) SELECT vec_id, round(x / most, 4) AS x, round(y / most, 4) AS y, round(z / most, 4) AS z FROM v, m""",
}
QUERIES = {name: globals()[name] for name in SQL}
