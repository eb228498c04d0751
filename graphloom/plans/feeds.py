"""Change feed, replay of events and edges in loose spellings as queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import normalize
from graphloom.sources.tables import progress, table
from graphloom.streaming import feed, ring
from graphloom.streaming import progress as stream

from .views import sql

# A stand-in for a feed: events as messages in eight forms, some of which name no entry.
_ENTRY = "concat('entry-', user_id)"
_DATA = f"""CASE event_id % 8
  WHEN 0 THEN concat('{{"entry":{{"name":"', {_ENTRY}, '"}},"props":', props, '}}')
  WHEN 1 THEN concat('{{"entry":{{"name":5}},"asset":{{"name":"', {_ENTRY}, '"}},"props":', props, '}}')
  WHEN 2 THEN concat('{{"entry":"x","asset":{{"name":""}},"name":"', {_ENTRY}, '"}}')
  WHEN 3 THEN '' WHEN 4 THEN concat('{{"name":', {_ENTRY}) WHEN 5 THEN '[1,2]' ELSE concat('{{"props":', props, '}}') END"""
_BY_NAME, _BY_ENTRY = "event_id % 8 IN (4, 5, 6)", "event_id % 8 = 3"


def _messages(spark, sf):
    attributes = f"CASE WHEN {_BY_ENTRY} THEN map('name', 'no', 'entry_name', {_ENTRY}) WHEN {_BY_NAME} THEN map('entry_name', '', 'name', {_ENTRY}) END"
    return table(spark, sf, "events").select(F.col("event_id").alias("message_id"), F.expr(_DATA).alias("data"), F.expr(attributes).alias("attributes"), F.col("ts").alias("at"))


def feed_entries(spark, sf):
    return feed.named(_messages(spark, sf)).select("message_id", "entry_name", "outcome")


def feed_current(spark, sf):
    """Messages delivered twice make the same state."""
    m = feed.named(_messages(spark, sf))
    return feed.newest(m.unionAll(m)).select("entry_name", "message_id", "data")


def _log(spark, sf):
    return stream.numbered(progress(spark, sf))


def event_ring_held(spark, sf):
    return ring.held(_log(spark, sf)).select("job_id", "event_id", "seq")


def event_replay_tail(spark, sf):
    """The log holds the first four fifths of each job; the live events begin at seven tenths and come twice."""
    log = _log(spark, sf)
    sized = log.join(log.groupBy("job_id").agg(F.max("seq").alias("n")), "job_id")
    live = sized.where("seq > n * 0.7")
    return ring.replay_then_tail(sized.where("seq <= n * 0.8"), live.unionAll(live)).select("job_id", "event_id", "seq")


# A stand-in for extraction: the customers and suppliers of a nation are the nodes and edges of one document.


def _nodes(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("seq"), F.lit("BusinessActor").alias("kind"), F.col("c_name").alias("name"))
    s = table(spark, sf, "supplier")
    in_group = s.select("s_nationkey", F.col("s_suppkey") + 10**9, F.lit("ApplicationComponent"), F.concat(F.lit("svc:"), F.col("s_suppkey") % 7, F.lit(":"), "s_name"))
    alone = s.select("s_nationkey", F.col("s_suppkey") + 2 * 10**9, F.lit("DataObject"), "s_name")
    goals = table(spark, sf, "nation").select("n_nationkey", F.lit(0).cast("bigint"), F.lit("Goal"), F.concat(F.lit("a->b "), "n_name"))
    out = c.union(in_group).union(alone).union(goals)
    return out.select("doc_id", "seq", F.concat_ws(":", "kind", "name").alias("key"), "name")


_FORMS = """concat(CASE c_custkey % 4 WHEN 0 THEN concat('BusinessActor:', c_name) WHEN 1 THEN c_name WHEN 2 THEN concat('  ', c_name, ' ') ELSE 'nobody' END, '->',
  CASE c_custkey % 5 WHEN 0 THEN '[depends on]' WHEN 1 THEN 'USES' WHEN 2 THEN ' flow ' WHEN 3 THEN 'zaps' ELSE 'works [in]' END,
  CASE WHEN c_custkey % 13 = 0 THEN '' ELSE '->' END,
  CASE c_custkey % 4 WHEN 0 THEN s_name WHEN 1 THEN concat('a->b ', n_name) WHEN 2 THEN concat('Goal:a->b ', n_name) ELSE s_name END)"""
_STRICT = """concat('BusinessActor:', c_name, '->Serving', CASE c_custkey % 5 WHEN 0 THEN '[places,INFERRED]' WHEN 1 THEN '[ High , x]' WHEN 2 THEN '[[AMBIGUOUS]' WHEN 3 THEN '' ELSE '[extracted]' END,
  '->', CASE WHEN c_custkey % 6 = 0 THEN 'Goal' ELSE 'Goal:' END, CASE WHEN c_custkey % 7 = 0 THEN 'a->b' ELSE 'a:b' END)"""


def normalized_edges(spark, sf):
    first = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_name").alias("s_name"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    lines = table(spark, sf, "customer").join(first, "c_nationkey").join(n, "c_nationkey")
    lines = lines.select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("seq"), F.expr(_FORMS).alias("line"))
    return normalize.normalized_edges(lines, _nodes(spark, sf))


def strict_edges(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", normalize.strict_edge(F.expr(_STRICT)).alias("e"))
    return rows.where("e IS NOT NULL").select("c_custkey", "e.*")


_MESSAGES = f"""m AS (SELECT event_id AS message_id, ts AS sent, {_DATA} AS data,
  CASE WHEN {_BY_ENTRY} OR {_BY_NAME} THEN {_ENTRY} END AS attribute FROM events),
j AS (SELECT *, CASE WHEN data = '' THEN '{{}}' WHEN json_valid(data) THEN data END AS p FROM m),
e AS (SELECT message_id, sent, data, CASE WHEN json_type(p) = 'OBJECT' THEN coalesce(
  CASE WHEN json_type(p, '$.entry.name') = 'VARCHAR' THEN nullif(json_extract_string(p, '$.entry.name'), '') END,
  CASE WHEN json_type(p, '$.asset.name') = 'VARCHAR' THEN nullif(json_extract_string(p, '$.asset.name'), '') END,
  CASE WHEN json_type(p, '$.name') = 'VARCHAR' THEN nullif(json_extract_string(p, '$.name'), '') END, attribute) END AS entry_name FROM j)
"""
_SEQ = ", q AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS seq, count(*) OVER (PARTITION BY job_id) AS n FROM progress)\n"

SQL = {
    "feed_entries": f"WITH {_MESSAGES} SELECT message_id, entry_name, CASE WHEN entry_name IS NULL THEN 'malformed' ELSE 'entry' END AS outcome FROM e",
    "feed_current": f"""WITH {_MESSAGES} SELECT entry_name, message_id, data FROM e WHERE entry_name IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY entry_name ORDER BY sent DESC, message_id DESC) = 1""",
    "event_ring_held": sql(_SEQ + "SELECT job_id, event_id, seq FROM q WHERE seq > n - 500", "progress"),
    "event_replay_tail": sql(
        _SEQ + """, h AS (SELECT *, max(seq) OVER (PARTITION BY job_id) AS last FROM q WHERE seq <= n * 0.8)
SELECT job_id, event_id, seq FROM h WHERE seq > last - 500 UNION SELECT job_id, event_id, seq FROM q WHERE seq > n * 0.7""", "progress"),
    "normalized_edges": f"""WITH nodes AS (
  SELECT c_nationkey AS doc_id, c_custkey AS seq, 'BusinessActor:' || c_name AS key, c_name AS name FROM customer
  UNION ALL SELECT s_nationkey, s_suppkey + 1000000000, 'ApplicationComponent:svc:' || s_suppkey % 7 || ':' || s_name, 'svc:' || s_suppkey % 7 || ':' || s_name FROM supplier
  UNION ALL SELECT s_nationkey, s_suppkey + 2000000000, 'DataObject:' || s_name, s_name FROM supplier
  UNION ALL SELECT n_nationkey, 0, 'Goal:a->b ' || n_name, 'a->b ' || n_name FROM nation),
f AS (SELECT s_nationkey AS c_nationkey, min(s_name) AS s_name FROM supplier GROUP BY 1),
lines AS (SELECT c_nationkey AS doc_id, c_custkey AS seq, string_split({_FORMS}, '->') AS p
  FROM customer JOIN f USING (c_nationkey) JOIN nation ON n_nationkey = c_nationkey),
ends AS (SELECT doc_id, seq, trim(p[1]) AS source, trim(array_to_string(p[3:], '->')) AS target, replace(upper(trim(replace(replace(p[2], '[', ''), ']', ''))), ' ', '_') AS verb
  FROM lines WHERE len(p) >= 3),
named AS (SELECT e.*, n.key, s.side FROM ends e, (VALUES ('source'), ('target')) s(side), nodes n
  WHERE n.doc_id = e.doc_id AND (n.key = CASE side WHEN 'source' THEN source ELSE target END OR n.name = CASE side WHEN 'source' THEN source ELSE target END
    OR ends_with(n.key, ':' || CASE side WHEN 'source' THEN source ELSE target END))
  QUALIFY row_number() OVER (PARTITION BY e.doc_id, e.seq, side ORDER BY n.key <> CASE side WHEN 'source' THEN source ELSE target END, n.seq, n.key) = 1)
SELECT a.doc_id, a.seq, a.key AS source_key, CASE a.verb WHEN 'DEPENDS_ON' THEN 'Serving' WHEN 'USES' THEN 'Serving' WHEN 'FLOW' THEN 'Flow' WHEN 'WORKS_IN' THEN 'Assignment' ELSE 'Association' END AS rel_type,
  b.key AS target_key FROM named a JOIN named b ON a.doc_id = b.doc_id AND a.seq = b.seq AND a.side = 'source' AND b.side = 'target'""",
    "strict_edges": f"""WITH p AS (SELECT c_custkey, string_split({_STRICT}, '->') AS p FROM customer),
r AS (SELECT c_custkey, p[1] AS s, p[2] AS r, p[3] AS t, ends_with(p[2], ']') AND contains(p[2], '[') AS b, len(p[2]) - strpos(reverse(p[2]), '[') + 1 AS cut
  FROM p WHERE len(p) = 3 AND contains(p[1], ':') AND contains(p[3], ':'))
SELECT c_custkey, split_part(s, ':', 1) AS source_type, substr(s, strpos(s, ':') + 1) AS source_name, CASE WHEN b THEN substr(r, 1, cut - 1) ELSE r END AS rel_type,
  coalesce(CASE WHEN b THEN list_filter(list_transform(string_split(substr(r, cut + 1, len(r) - cut - 1), ','), lambda x: trim(x)),
    lambda x: x IN ('EXTRACTED', 'INFERRED', 'AMBIGUOUS') OR lower(x) IN ('high', 'medium', 'low'))[-1] END, 'EXTRACTED') AS confidence,
  split_part(t, ':', 1) AS target_type, substr(t, strpos(t, ':') + 1) AS target_name FROM r""",
}
QUERIES = {n: globals()[n] for n in SQL}
