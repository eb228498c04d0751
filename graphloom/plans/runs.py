"""Evaluation of the hybrid search by its own lists: keywords of the answers, looked for in what was found, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions.text import keywords
from graphloom.operators import runs
from graphloom.sources.storage import materialize
from graphloom.sources.tables import table

from .hybrid import _ASKED, _CHUNK_VECTORS, _EXPANDED, _FUSED, _GRAPH, _QUESTIONS, _STORED, fused, search_lists
from .search import _KEYWORDS
from .views import sql

#: More candidates than the lists of a question have.
ALL = 1_000


def _questions(spark, sf):
    q = table(spark, sf, "conversations").where("role = 'user' AND conv_id % 100 = 0 AND text IS NOT NULL")
    return q.select(F.concat_ws(":", "conv_id", "turn").alias("query_id")).distinct()


def _expected(spark, sf):
    """The keywords of the turn after a question, its answer."""
    said = table(spark, sf, "conversations").where("role = 'assistant' AND conv_id % 100 = 0")
    named = said.select(F.concat_ws(":", "conv_id", F.col("turn") - 1).alias("query_id"), F.explode(keywords(F.col("text"))).alias("entity"))
    return named.join(_questions(spark, sf), "query_id", "left_semi").distinct()


def _run(spark, sf, limits):
    """(rows at the limits, expected entities) of one run of the search."""
    texts, lists, names, found = search_lists(spark, sf)
    pool = fused(texts, lists, names, found, ALL)
    expected = materialize(_expected(spark, sf))
    records = runs.recorded(_questions(spark, sf), expected, materialize(pool.select("query_id", "chunk_id", "rank")), lists["vector"], texts)
    return runs.at_limits(materialize(records), limits), expected


def evaluation_run(spark, sf):
    """Each question's recall with and without the graph, in thousandths, and where it lost what it expected."""
    return _run(spark, sf, (runs.LIMIT,))[0].drop("cap")


def evaluation_sweep(spark, sf):
    return runs.sweep(_run(spark, sf, runs.LIMITS)[0])


def evaluation_arms(spark, sf):
    return runs.arms(*_run(spark, sf, (runs.LIMIT,)))


def _sql(query: str, limits: tuple[int, ...]) -> str:
    rows = f""", pool AS (SELECT query_id, f.chunk_id, lower(chunk_text) AS text, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, f.chunk_id) AS rank FROM fused f JOIN chunks USING (chunk_id)),
near AS (SELECT query_id, lower(chunk_text) AS text FROM vec JOIN chunks USING (chunk_id) WHERE rank <= {runs.TOP}),
asked AS (SELECT DISTINCT conv_id || ':' || turn AS query_id FROM conversations WHERE role = 'user' AND conv_id % 100 = 0 AND text IS NOT NULL),
want AS (SELECT DISTINCT query_id, name AS entity FROM (SELECT conv_id || ':' || (turn - 1) AS query_id, unnest({_KEYWORDS}) AS name
  FROM conversations WHERE role = 'assistant' AND conv_id % 100 = 0) WHERE query_id IN (FROM asked)),
base AS (SELECT query_id, (SELECT count(*) FROM want WHERE want.query_id = asked.query_id) AS n, (SELECT count(*) FROM pool WHERE pool.query_id = asked.query_id) AS size,
  (SELECT count(*) FROM want WHERE want.query_id = asked.query_id AND EXISTS (FROM near WHERE near.query_id = want.query_id AND contains(near.text, entity))) AS in_vector FROM asked),
tried AS (SELECT base.*, cap, (SELECT count(*) FROM want WHERE want.query_id = base.query_id AND EXISTS (
    FROM pool WHERE pool.query_id = want.query_id AND rank <= least(cap, {runs.TOP}) AND contains(pool.text, entity))) AS shown,
  (SELECT count(*) FROM want WHERE want.query_id = base.query_id AND EXISTS (FROM pool WHERE pool.query_id = want.query_id AND rank <= cap AND contains(pool.text, entity))) AS held
  FROM base, (SELECT unnest({list(limits)}) AS cap)),
ran AS (SELECT query_id, cap, n AS n_expected, size AS pool_size, (CASE n WHEN 0 THEN 1000 ELSE (2000 * shown + n) // (2 * n) END)::BIGINT AS graph_recall,
  (CASE n WHEN 0 THEN 1000 ELSE (2000 * in_vector + n) // (2 * n) END)::BIGINT AS vector_recall, graph_recall - vector_recall AS uplift,
  CASE WHEN n = 0 THEN 'none_expected' WHEN shown = n THEN 'hit' WHEN held = n THEN 'below_top_k' WHEN size >= cap THEN 'capped' ELSE 'never_in_pool' END AS bucket FROM tried)
"""
    return sql(_QUESTIONS + _STORED + _ASKED + _CHUNK_VECTORS + _GRAPH + _EXPANDED + _FUSED + rows + query, "chunks", "docs")


_MEAN = "floor((2 * sum({0}) + count(*))::DOUBLE / (2 * count(*)))::BIGINT AS {0}"
SQL = {
    "evaluation_run": _sql("SELECT * EXCLUDE (cap) FROM ran", (runs.LIMIT,)),
    "evaluation_sweep": _sql(
        f"""SELECT cap, {_MEAN.format('graph_recall')}, {_MEAN.format('vector_recall')}, {_MEAN.format('uplift')}, count(*) FILTER (uplift > 0) AS n_helped,
  count(*) FILTER (bucket = 'hit') AS n_hit, count(*) FILTER (bucket = 'capped') AS n_capped, count(*) FILTER (bucket = 'below_top_k') AS n_below,
  count(*) FILTER (bucket = 'never_in_pool') AS n_never, count(*) FILTER (bucket = 'none_expected') AS n_none FROM (
    SELECT query_id, cap, graph_recall, vector_recall, uplift, bucket FROM ran) GROUP BY cap""", runs.LIMITS),
    "evaluation_arms": _sql(
        f""", shown5 AS (SELECT string_agg(entity, ' ' ORDER BY n DESC, entity) AS context FROM (SELECT entity, count(*) AS n FROM want GROUP BY 1 ORDER BY n DESC, entity LIMIT {runs.CONSTANT})),
known AS (SELECT query_id, count(*) FILTER (contains(context, entity)) AS k FROM want, shown5 GROUP BY 1),
s AS (SELECT round(avg(graph_recall / 1000), 6) AS graph, round(avg(vector_recall / 1000), 6) AS vector_only,
  round(avg(CASE n_expected WHEN 0 THEN 1000 ELSE (2000 * k + n_expected) // (2 * n_expected) END / 1000), 6) AS constant, round(avg(CASE WHEN n_expected > 0 THEN 0.0::DOUBLE ELSE 1.0 END), 6) AS blind
  FROM ran LEFT JOIN known USING (query_id)),
a AS (SELECT 'graph' AS arm, graph AS score, false AS is_reference, 1 AS place FROM s UNION ALL SELECT 'vector_only', vector_only, false, 2 FROM s UNION ALL SELECT 'constant', constant, false, 3 FROM s
  UNION ALL SELECT 'oracle', 1.0, true, 4 FROM s UNION ALL SELECT 'blind', blind, true, 5 FROM s)
SELECT arm, score, is_reference, arm = (SELECT arm FROM a WHERE NOT is_reference ORDER BY score DESC, place LIMIT 1) AS winner FROM a""", (runs.LIMIT,)),
}
QUERIES = {name: globals()[name] for name in SQL}
