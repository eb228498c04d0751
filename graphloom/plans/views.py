"""The fixture views as SQL, for the oracle side of the comparison."""

from __future__ import annotations

VIEWS = {
    "nodes": """nodes AS (
  SELECT 'reg:' || r_regionkey AS node_id, 'BusinessFunction' AS node_type, r_name AS name FROM region
  UNION ALL SELECT 'nat:' || n_nationkey, 'BusinessRole', n_name FROM nation
  UNION ALL SELECT 'cus:' || c_custkey, 'BusinessActor', c_name FROM customer
  UNION ALL SELECT 'sup:' || s_suppkey, 'ApplicationComponent', s_name FROM supplier
  UNION ALL SELECT 'prt:' || p_partkey, 'DataObject', p_name FROM part
  UNION ALL SELECT 'ord:' || o_orderkey, 'BusinessProcess', 'Order#' || o_orderkey FROM orders)""",
    "edges": """ranked AS (
  SELECT l_suppkey AS s, l_orderkey AS o, l_partkey AS p, CASE l_returnflag WHEN 'N' THEN 2 WHEN 'R' THEN 1 ELSE 0 END AS r FROM lineitem),
edges AS (
  SELECT 'sup:' || s AS source_id, 'ApplicationComponent' AS source_type, 'ord:' || o AS target_id, 'BusinessProcess' AS target_type,
         'Serving' AS rel_type, CASE max(r) WHEN 2 THEN 'EXTRACTED' WHEN 1 THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS confidence
  FROM ranked GROUP BY s, o
  UNION ALL SELECT 'ord:' || o, 'BusinessProcess', 'prt:' || p, 'DataObject', 'Access',
         CASE max(r) WHEN 2 THEN 'EXTRACTED' WHEN 1 THEN 'INFERRED' ELSE 'AMBIGUOUS' END FROM ranked GROUP BY o, p
  UNION ALL SELECT 'cus:' || o_custkey, 'BusinessActor', 'ord:' || o_orderkey, 'BusinessProcess', 'Assignment',
         CASE o_orderstatus WHEN 'O' THEN 'EXTRACTED' WHEN 'F' THEN 'INFERRED' END FROM orders
  UNION ALL SELECT 'nat:' || c_nationkey, 'BusinessRole', 'cus:' || c_custkey, 'BusinessActor', 'Aggregation', 'EXTRACTED' FROM customer
  UNION ALL SELECT 'nat:' || s_nationkey, 'BusinessRole', 'sup:' || s_suppkey, 'ApplicationComponent', 'Association', 'INFERRED' FROM supplier
  UNION ALL SELECT 'reg:' || n_regionkey, 'BusinessFunction', 'nat:' || n_nationkey, 'BusinessRole', 'Composition', 'EXTRACTED' FROM nation)""",
    "ways": """ways AS (
  SELECT source_id AS node_id, target_id AS other_id, target_type AS other_type, rel_type, confidence, 'outgoing' AS direction FROM edges
  UNION ALL SELECT target_id, source_id, source_type, rel_type, confidence, 'incoming' FROM edges)""",
    "docs": """docs AS (
  SELECT doc_id, 'doc-' || doc_id AS title, CASE doc_id % 3 WHEN 0 THEN 'tenant_a' WHEN 1 THEN '__shared__:alpha' ELSE '__shared__:beta' END AS tenant_id,
         text, source, n_chars FROM documents)""",
    "chunks": """cut AS (
  SELECT doc_id, text, unnest(range(0, length(text), 1300)) AS p0 FROM documents WHERE text IS NOT NULL),
chunks AS (
  SELECT doc_id, (p0 // 1300)::INT AS chunk_index, doc_id || ':' || (p0 // 1300) AS chunk_id, substr(text, p0 + 1, 1500) AS chunk_text
  FROM cut WHERE regexp_matches(substr(text, p0 + 1, 1500), '\\S'))""".replace("\\\\", "\\"),
    "costs": """costs AS (
  SELECT event_id AS log_id, 'u' || user_id AS tenant_id, event_type AS operation_type, value AS total_cost_usd,
         json_extract_string(props, '$.k')::BIGINT AS input_tokens, ts AS created_at FROM events)""",
    "progress": "progress AS (SELECT user_id % 10 AS job_id, event_id, event_type, user_id % 97 AS file_id, ts, value FROM events)",
}
_NEEDS = {"ways": ("edges",)}


def sql(query: str, *views: str, recursive: bool = False) -> str:
    """``query`` after the named views; it may go on with its own views after a comma."""
    order: list[str] = []
    for v in views:
        order += [n for n in (*_NEEDS.get(v, ()), v) if n not in order]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(VIEWS[v] for v in order) + "\n" + query
