"""Cost, metric, catalogue, table and progress queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import graph, metrics, tables
from graphloom.sources.tables import chunks, costs, documents, edges, nodes, progress, table
from graphloom.streaming import progress as stream

from .views import sql

AS_OF = "2024-01-31"


def _n():
    return F.count(F.lit(1))


def cost_by_type(spark, sf):
    kind = F.coalesce("operation_type", F.lit("other")).alias("operation_type")
    return costs(spark, sf).groupBy(kind).agg(_n().alias("n"), F.round(F.sum("total_cost_usd"), 4).alias("cost"), F.sum("input_tokens").alias("tokens"))


def cost_by_day(spark, sf):
    day = F.to_date("created_at").alias("day")
    return tables.spent(costs(spark, sf), AS_OF, 7).groupBy(day).agg(_n().alias("n"), F.round(F.sum("total_cost_usd"), 4).alias("cost"))


def top_tenants(spark, sf):
    spent = tables.spent(costs(spark, sf), AS_OF, 30).groupBy("tenant_id").agg(F.round(F.sum("total_cost_usd"), 4).alias("cost"), _n().alias("n"))
    return spent.orderBy(F.desc("cost"), "tenant_id").limit(10)


def tenant_stats(spark, sf):
    shared = F.col("tenant_id").startswith("__shared__")
    return documents(spark, sf).agg(F.count_if(F.col("tenant_id") == "tenant_a").alias("mine"), F.count_if(shared).alias("shared"), _n().alias("total"))


def _answers(spark, sf):
    """Adjacent user and assistant turns."""
    c = table(spark, sf, "conversations").where("text IS NOT NULL").groupBy("conv_id", "turn", "role").agg(F.min("text").alias("text"))
    user = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("given"))
    said = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("expected"))
    return user.join(said, ["conv_id", "turn"]).select(F.concat_ws(":", "conv_id", "turn").alias("qa_id"), "given", "expected")


def token_f1(spark, sf):
    return metrics.token_f1(_answers(spark, sf), "qa_id", "given", "expected")


def f1_by_group_sets(spark, sf):
    scores = metrics.token_f1(_answers(spark, sf), "qa_id", "given", "expected")
    a, b = (F.substring_index("qa_id", ":", 1).cast("bigint") % 3).alias("kind"), (F.substring_index("qa_id", ":", 1).cast("bigint") % 2).alias("level")
    return scores.select(a, b, "f1").groupingSets([[], [F.col("kind")], [F.col("level")]], "kind", "level").agg(_n().alias("n"), F.round(F.avg("f1"), 4).alias("f1"))


def context_recall(spark, sf):
    expected = F.array(F.lit("the"), F.lit("Model"), F.lit("zzz"), F.col("lang"))
    docs = table(spark, sf, "documents").where("text IS NOT NULL AND lang IS NOT NULL")
    return docs.select("doc_id", text.context_recall(F.col("text"), expected).alias("recall"))


def prf_by_type(spark, sf):
    d = table(spark, sf, "documents").where("lang IS NOT NULL").select("lang", F.concat(F.lit("Item-"), F.col("doc_id") % 200).alias("item"), "doc_id")
    return metrics.precision_recall(d.where("doc_id % 3 <> 0"), d.where("doc_id % 4 <> 0"), "lang", "item")


def percentiles(spark, sf):
    return metrics.percentiles(costs(spark, sf), "operation_type", "total_cost_usd")


def arm_winner(spark, sf):
    """Two arms are equally good; the reference arm is better than both."""
    shares = {"full": 1.0, "keyword": 0.9, "vector": 1.1, "again": 1.1, "oracle": 2.0}
    d = table(spark, sf, "events").select(*((F.col("value") * x).alias(a) for a, x in shares.items()))
    return metrics.arm_winner(d, ["full", "keyword", "vector", "again"], ["oracle"])


def attrition(spark, sf):
    e = table(spark, sf, "events")
    bucket = metrics.attrition(F.expr("user_id % 5 <> 0"), F.expr("event_id % 7 < 3"), F.expr("event_id % 3 <> 0"), F.expr("event_id % 40"), 20, F.expr("user_id % 11 = 0"))
    return e.groupBy(bucket.alias("bucket")).agg(_n().alias("n"))


def limit_sweep(spark, sf):
    return metrics.limit_sweep(table(spark, sf, "events").select((F.col("event_id") % 50 + 1).alias("rank"), (F.col("user_id") % 4 == 0).alias("hit")), [1, 5, 10, 20, 50])


def dedup_titles(spark, sf):
    rows = nodes(spark, sf).where("node_type = 'DataObject'").withColumn("title", F.substring("name", 1, 6))
    return tables.newest(rows, "title", F.desc("node_id")).select("title", "node_id")


def duplicate_entities(spark, sf):
    return tables.duplicates(table(spark, sf, "part").select(F.col("p_brand").alias("name")), "name")


def upsert_nodes(spark, sf):
    n = nodes(spark, sf)
    late = table(spark, sf, "customer").select(F.concat(F.lit("cus:"), F.col("c_custkey") + 50).alias("node_id"), F.lit("BusinessActor").alias("node_type"), F.concat("c_name", F.lit(" v2")).alias("name"), "c_custkey")
    return tables.upsert(n, tables.last_per_key(late, ["node_id"], "c_custkey").drop("c_custkey"), ["node_id"])


def cascade_delete(spark, sf):
    d = documents(spark, sf)
    left = tables.delete_cascade(d.select("doc_id", "tenant_id"), {"chunks": chunks(spark, sf)}, "doc_id", F.col("tenant_id") == "tenant_a")
    return left["chunks"].groupBy("doc_id").agg(_n().alias("n_chunks"))


def key_faults(spark, sf):
    return tables.key_faults(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def call_costs(spark, sf):
    i, o, c = (F.col(x) for x in ("l_partkey", "l_suppkey", "l_linenumber"))
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(_n().alias("calls"), F.round(F.sum(tables.price(i, o, c)), 4).alias("cost"))


def catalog_entries(spark, sf):
    return tables.catalogue_entries(nodes(spark, sf))


def catalog_links(spark, sf):
    return tables.catalogue_links(edges(spark, sf), tables.catalogue_entries(nodes(spark, sf)))


def glossary_terms(spark, sf):
    return tables.glossary(nodes(spark, sf), edges(spark, sf).where("rel_type = 'Association'"))


def brief(spark, sf):
    """The overview as lines of sections."""
    n, e = nodes(spark, sf), edges(spark, sf)
    kinds = n.groupBy("node_type").agg(_n().alias("x")).select(F.lit(1).alias("section"), F.concat_ws(": ", "node_type", "x").alias("line"))
    hubs = graph.hubs(n, e, 10).select(F.lit(2).alias("section"), F.concat_ws(": ", "name", "degree").alias("line"))
    rels = e.groupBy("rel_type").agg(_n().alias("x")).select(F.lit(3).alias("section"), F.concat_ws(": ", "rel_type", "x").alias("line"))
    return kinds.unionByName(hubs).unionByName(rels)


def event_ring_buffer(spark, sf):
    return stream.ring_buffer(progress(spark, sf)).select("job_id", "event_id", "age")


def event_fold_latest(spark, sf):
    return stream.latest_state(progress(spark, sf)).withColumn("total", F.round("total", 4))


def event_dedup(spark, sf):
    p = progress(spark, sf)
    return stream.distinct_events(p.unionAll(p)).groupBy("job_id").agg(_n().alias("n"))


def event_sequence(spark, sf):
    return stream.numbered(progress(spark, sf)).select("job_id", "event_id", "seq")


def event_session_windows(spark, sf):
    return stream.sessions(progress(spark, sf))


def event_windows(spark, sf):
    return stream.windowed(progress(spark, sf))


def _less(x):
    """Without the articles between two that are no letters, digits or underscores; of two in a row, which share what is between, the second goes next time."""
    return rf"regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}_])(a|an|the)($|[^\p{{L}}\p{{N}}_])', '\1 \3', 'g')"


_ANSWERS = """, c AS (SELECT conv_id, turn, role, min(text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY 1, 2, 3),
qa AS (SELECT u.conv_id || ':' || u.turn AS qa_id, u.text AS given, a.text AS expected FROM c u JOIN c a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'),
m AS (SELECT qa_id, """ + ", ".join(
    rf"trim(regexp_replace({_less(_less(rf'''regexp_replace(lower({x}), '[!-/:-@\[-`{{-~]', '', 'g')'''))}, '\s+', ' ', 'g')) AS {x}" for x in ("given", "expected")
) + """ FROM qa),
wa AS (SELECT qa_id, word, count(*) AS a FROM (SELECT qa_id, unnest(string_split(given, ' ')) AS word FROM m) WHERE word <> '' GROUP BY 1, 2),
wb AS (SELECT qa_id, word, count(*) AS b FROM (SELECT qa_id, unnest(string_split(expected, ' ')) AS word FROM m) WHERE word <> '' GROUP BY 1, 2),
s AS (SELECT qa_id, sum(least(coalesce(a, 0), coalesce(b, 0))) AS common, sum(coalesce(a, 0)) + sum(coalesce(b, 0)) AS n FROM wa FULL JOIN wb USING (qa_id, word) GROUP BY 1),
f AS (SELECT qa_id, CASE WHEN common > 0 THEN round(2 * common::DOUBLE / n, 6) ELSE 0 END::DOUBLE AS f1, (given = expected)::INT AS exact FROM m LEFT JOIN s USING (qa_id))
"""
_F1 = "WITH " + _ANSWERS[2:]
SQL = {
    "cost_by_type": sql(
        "SELECT coalesce(operation_type, 'other') AS operation_type, count(*) AS n, round(sum(total_cost_usd), 4) AS cost, sum(input_tokens)::BIGINT AS tokens FROM costs GROUP BY 1", "costs"),
    "cost_by_day": sql(
        """SELECT created_at::DATE AS day, count(*) AS n, round(sum(total_cost_usd), 4) AS cost FROM costs
WHERE created_at > TIMESTAMP '2024-01-24' AND created_at <= TIMESTAMP '2024-01-31' GROUP BY 1""", "costs"),
    "top_tenants": sql(
        """SELECT tenant_id, round(sum(total_cost_usd), 4) AS cost, count(*) AS n FROM costs
WHERE created_at > TIMESTAMP '2024-01-01' AND created_at <= TIMESTAMP '2024-01-31' GROUP BY 1 ORDER BY cost DESC, tenant_id LIMIT 10""", "costs"),
    "tenant_stats": sql("SELECT count_if(tenant_id = 'tenant_a')::BIGINT AS mine, count_if(tenant_id LIKE '\\_\\_shared%' ESCAPE '\\')::BIGINT AS shared, count(*) AS total FROM docs", "docs"),
    "token_f1": _F1 + "SELECT * FROM f",
    "f1_by_group_sets": _F1 + """, g AS (SELECT string_split(qa_id, ':')[1]::BIGINT % 3 AS kind, string_split(qa_id, ':')[1]::BIGINT % 2 AS level, f1 FROM f)
SELECT kind, level, count(*) AS n, round(avg(f1), 4) AS f1 FROM g GROUP BY GROUPING SETS ((), (kind), (level))""",
    "context_recall": """SELECT doc_id, round((contains(lower(text), 'the')::INT + contains(lower(text), 'model')::INT + contains(lower(text), 'zzz')::INT
  + contains(lower(text), lower(lang))::INT) / 4.0::DOUBLE, 3) AS recall FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL""",
    "prf_by_type": """WITH d AS (SELECT lang, 'item-' || doc_id % 200 AS item, doc_id FROM documents WHERE lang IS NOT NULL),
a AS (SELECT DISTINCT lang, item, 1 AS e FROM d WHERE doc_id % 3 <> 0), b AS (SELECT DISTINCT lang, item, 1 AS f FROM d WHERE doc_id % 4 <> 0),
c AS (SELECT lang, count_if(e IS NOT NULL AND f IS NOT NULL)::BIGINT AS tp, count_if(e IS NULL)::BIGINT AS fp, count_if(f IS NULL)::BIGINT AS fn FROM a FULL JOIN b USING (lang, item) GROUP BY 1)
SELECT lang, tp, fp, fn, coalesce(round(tp / nullif(tp + fp, 0)::DOUBLE, 6), 0) AS precision, coalesce(round(tp / nullif(tp + fn, 0)::DOUBLE, 6), 0) AS recall,
  coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6), 0) AS f1 FROM c""",
    "percentiles": sql(
        """SELECT operation_type, min(total_cost_usd) AS least, round(quantile_cont(total_cost_usd, 0.5), 6) AS median, round(quantile_cont(total_cost_usd, 0.9), 6) AS p90,
  max(total_cost_usd) AS most FROM costs GROUP BY 1""", "costs"),
    "arm_winner": """WITH m AS (SELECT a.arm, a.nth, a.arm = 'oracle' AS is_reference, round(avg(value * a.share), 6) AS score
  FROM events, (VALUES (1, 'full', 1.0::DOUBLE), (2, 'keyword', 0.9), (3, 'vector', 1.1), (4, 'again', 1.1), (5, 'oracle', 2.0)) AS a(nth, arm, share) GROUP BY 1, 2, 3)
SELECT arm, score, is_reference, arm = (SELECT arm FROM m WHERE NOT is_reference ORDER BY score DESC, nth LIMIT 1) AS winner FROM m""",
    "attrition": """SELECT CASE WHEN user_id % 5 = 0 THEN 'none_expected' WHEN event_id % 7 < 3 THEN 'hit' WHEN event_id % 3 <> 0 THEN 'below_top_k'
  WHEN event_id % 40 >= 20 OR user_id % 11 = 0 THEN 'capped' ELSE 'never_in_pool' END AS bucket, count(*) AS n FROM events GROUP BY 1""",
    "limit_sweep": """WITH r AS (SELECT event_id % 50 + 1 AS rank FROM events WHERE user_id % 4 = 0)
SELECT cap, count_if(rank <= cap)::BIGINT AS n_hits, round(count_if(rank <= cap) / count(*)::DOUBLE, 6) AS recall FROM r, (VALUES (1), (5), (10), (20), (50)) AS t(cap) GROUP BY 1""",
    "dedup_titles": sql("SELECT substr(name, 1, 6) AS title, max(node_id) AS node_id FROM nodes WHERE node_type = 'DataObject' GROUP BY 1", "nodes"),
    "duplicate_entities": "SELECT p_brand AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1",
    "upsert_nodes": sql(
        """, late AS (SELECT 'cus:' || (c_custkey + 50) AS node_id, 'BusinessActor' AS node_type, c_name || ' v2' AS name FROM customer)
SELECT * FROM nodes WHERE node_id NOT IN (SELECT node_id FROM late) UNION ALL SELECT * FROM late""", "nodes"),
    "cascade_delete": sql("SELECT doc_id, count(*) AS n_chunks FROM chunks WHERE doc_id % 3 <> 0 GROUP BY 1", "chunks"),
    "key_faults": "SELECT 0::BIGINT AS n_null, count_if(n > 1)::BIGINT AS n_repeated FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)",
    "call_costs": """SELECT l_returnflag, count(*) AS calls, round(sum((greatest(l_partkey - l_linenumber, 0) * 0.3::DOUBLE + l_suppkey * 2.5::DOUBLE) / 1e6), 4) AS cost FROM lineitem GROUP BY 1""",
    "catalog_links": sql("SELECT source_id, target_id, 'accesses' AS link_type FROM edges WHERE rel_type = 'Access'", "edges"),
    "glossary_terms": sql(
        """, p AS (SELECT source_id AS node_id, target_id AS other_id FROM edges WHERE rel_type = 'Association' UNION SELECT target_id, source_id FROM edges WHERE rel_type = 'Association'),
g AS (SELECT p.node_id, string_agg(DISTINCT o.name, ',' ORDER BY o.name) AS synonyms FROM p JOIN nodes o ON o.node_id = p.other_id GROUP BY 1)
SELECT node_id, name, synonyms FROM nodes JOIN g USING (node_id)""", "nodes", "edges"),
    "brief": sql(
        """, d AS (SELECT node_id, count(*) AS degree FROM (SELECT source_id AS node_id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY 1),
h AS (SELECT name, degree FROM d JOIN nodes USING (node_id) ORDER BY degree DESC, node_id LIMIT 10)
SELECT 1 AS section, node_type || ': ' || count(*) AS line FROM nodes GROUP BY node_type
UNION ALL SELECT 2, name || ': ' || degree FROM h UNION ALL SELECT 3, rel_type || ': ' || count(*) FROM edges GROUP BY rel_type""", "nodes", "edges"),
    "event_ring_buffer": sql(
        "SELECT job_id, event_id, (row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC))::INT AS age FROM progress QUALIFY age <= 500", "progress"),
    "event_fold_latest": sql(
        """SELECT job_id, file_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n_events, round(sum(value), 4) AS total FROM progress GROUP BY 1, 2""", "progress"),
    "event_dedup": sql("SELECT job_id, count(*) AS n FROM (SELECT DISTINCT job_id, event_id, ts FROM progress) GROUP BY 1", "progress"),
    "event_sequence": sql("SELECT job_id, event_id, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS seq FROM progress", "progress"),
    "event_session_windows": sql(
        """, g AS (SELECT job_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY job_id ORDER BY ts) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS new FROM progress),
k AS (SELECT job_id, ts, sum(new) OVER (PARTITION BY job_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS n FROM g)
SELECT job_id, min(ts) AS start, count(*) AS n_events FROM k GROUP BY job_id, n""", "progress"),
    "event_windows": sql("SELECT job_id, date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS n_events FROM progress GROUP BY 1, 2", "progress"),
}

_NAMESPACE = "".join(f"\\x{b:02X}" for b in tables.CATALOGUE.bytes)
SQL["catalog_entries"] = sql(
    f""", h AS (SELECT *, sha1('{_NAMESPACE}'::BLOB || (node_id || '/' || name)::BLOB) AS h FROM nodes WHERE node_type IN ('DataObject', 'BusinessObject'))
SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1)
  || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS entry_id, node_id, CASE node_type WHEN 'DataObject' THEN 'data-object' ELSE 'business-object' END AS entry_type,
  name AS display_name FROM h""",
    "nodes",
)
QUERIES = {n: globals()[n] for n in SQL}
