"""Graph and rule queries over the fixture graph, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import brief, graph, rules
from graphloom.registry import LAYERS, LAYER_RANK, NODE_TYPES, RELATIONS, RULES
from graphloom.sources.tables import chunks, documents, edges, layer_of, nodes, numbered, table

from .views import sql

IMPACT_FROM = "reg:0"
PAGE_TYPES = ("BusinessActor", "ApplicationComponent", "DataObject")
_LAYER_CASE = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LAYERS.items()) + " ELSE 'Other' END"
_RANK_CASE = "CASE {0} " + " ".join(f"WHEN '{k}' THEN {LAYER_RANK[v]}" for k, v in LAYERS.items()) + " END"


def god_nodes(spark, sf):
    return graph.hubs(nodes(spark, sf), edges(spark, sf), 10)


def graph_stats_nodes(spark, sf):
    n = F.count(F.lit(1))
    return nodes(spark, sf).groupBy("node_type").agg(n.alias("n")).withColumn("layer", layer_of(F.col("node_type")))


def graph_stats_edges(spark, sf):
    return edges(spark, sf).groupBy("rel_type", F.coalesce("confidence", F.lit("NULL")).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


def confidence_shares(spark, sf):
    counts = edges(spark, sf).groupBy(F.coalesce("confidence", F.lit("EXTRACTED")).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.join(F.broadcast(total)).select("confidence", "n", F.round(100 * F.col("n") / F.col("total"), 1).alias("percent"))


def connections_one_hop(spark, sf):
    return graph.connections(edges(spark, sf), "nat:3")


def graph_page(spark, sf):
    return graph.page(nodes(spark, sf), PAGE_TYPES, 40, 500)


def graph_page_edges(spark, sf):
    shown = graph.page(nodes(spark, sf), ("BusinessRole", "BusinessActor", "ApplicationComponent"), 0, 500)
    return graph.internal_edges(edges(spark, sf), shown)


def entity_lookup(spark, sf):
    return nodes(spark, sf).where((F.col("node_type") == "BusinessRole") & (F.lower("name") == F.lower(F.lit("Nation_3"))))


def entity_search_like(spark, sf):
    q = "1"
    hit = F.when(F.lower("name").contains(q), 1.0).when(F.lower("node_type").contains(q), 0.6)
    return nodes(spark, sf).select("node_id", "name", hit.alias("score")).where("score IS NOT NULL")


def hub_connections(spark, sf):
    e = edges(spark, sf)
    return graph.hub_connections(e, graph.hubs(nodes(spark, sf), e, 5))


def motif_two_hop(spark, sf):
    e = edges(spark, sf)
    start = nodes(spark, sf).where("node_type = 'BusinessFunction'").select(F.col("node_id").alias("n0"))
    return graph.chain(e, start, [("Composition", "outgoing", "BusinessRole"), ("Association", "outgoing", "ApplicationComponent")])


def motif_typed_chain(spark, sf):
    """From every component over what it serves to its actors."""
    start = nodes(spark, sf).where("node_type = 'ApplicationComponent'").select(F.col("node_id").alias("n0"))
    return graph.chain(edges(spark, sf), start, [("Serving", "any", "BusinessProcess"), (None, "any", "BusinessActor")])


def var_length_paths(spark, sf):
    start = nodes(spark, sf).where("node_type = 'BusinessFunction'").select(F.col("node_id").alias("start"))
    return graph.reachable(edges(spark, sf), start, 1, 3)


def pattern_group_count(spark, sf):
    e = edges(spark, sf).where("rel_type = 'Serving'")
    named = nodes(spark, sf).select(F.col("node_id").alias("source_id"), "name")
    return e.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).join(named, "source_id").select("name", "n")


def next_chain(spark, sf):
    """Targets of the most served orders: aggregate, keep, match again."""
    e = edges(spark, sf)
    busy = e.where("rel_type = 'Serving'").groupBy("target_id").agg(F.count(F.lit(1)).alias("n_serving")).where("n_serving >= 7")
    more = e.where("rel_type = 'Access'").select(F.col("source_id").alias("target_id"), F.col("target_id").alias("part_id"))
    return busy.join(more, "target_id")


def cross_layer(spark, sf):
    a, b = layer_of(F.col("source_type")), layer_of(F.col("target_type"))
    return edges(spark, sf).where(a != b).groupBy("rel_type", a.alias("source_layer"), b.alias("target_layer")).agg(F.count(F.lit(1)).alias("n"))


def impact_analysis(spark, sf):
    return graph.impact(edges(spark, sf), IMPACT_FROM, 4)


def impact_layers(spark, sf):
    reached = graph.impact(edges(spark, sf), IMPACT_FROM, 4).where("hops > 0").join(nodes(spark, sf), "node_id")
    return reached.groupBy(layer_of(F.col("node_type")).alias("layer")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 1).alias("weighted"), F.max("hops").alias("max_hop")
    )


def neighborhood(spark, sf):
    return graph.neighborhood(edges(spark, sf), "nat:3", 2, 100)


def impact_paths(spark, sf):
    """The fifty nearest nodes that a change of a region reaches, with the way to each."""
    return graph.impact_paths(edges(spark, sf), nodes(spark, sf), IMPACT_FROM, 4)


def neighborhood_edges(spark, sf):
    return graph.neighborhood_edges(edges(spark, sf), "nat:3", 2, 100)


def edge_canonicalise(spark, sf):
    return graph.canonical(edges(spark, sf))


def _mentions(spark, sf):
    """Documents by the supplier and customer keys that their numbers name: a deterministic stand-in for extraction."""
    factors = F.array(*map(F.lit, (1, 3, 7, 11, 13)))
    d = documents(spark, sf).select("doc_id", F.explode(F.when(F.col("doc_id") % 4 != 0, factors).otherwise(F.slice(factors, 1, 2))).alias("i"))
    met = numbered(d, F.col("doc_id") * F.col("i"), "k", table(spark, sf, "customer"))
    return met.select("doc_id", F.concat(F.lit("cus:"), F.col("k") + 1).alias("node_id"))


_MENTIONS = """, mentions AS (
  SELECT doc_id, 'cus:' || ((doc_id * i) % (SELECT count(*) FROM customer) + 1) AS node_id
  FROM documents, (VALUES (1, 1), (2, 3), (3, 7), (4, 11), (5, 13)) AS t(pos, i) WHERE doc_id % 4 <> 0 OR pos <= 2)
"""


def doc_lineage(spark, sf):
    m, n = _mentions(spark, sf), nodes(spark, sf)
    return documents(spark, sf).select("doc_id", "title").join(m, "doc_id").join(n, "node_id").groupBy("node_id", "name").agg(F.count_distinct("doc_id").alias("n_docs"))


def rule_min_connections(spark, sf):
    return rules.minimum_connections(nodes(spark, sf), rules.degree_table(edges(spark, sf)), "BusinessProcess", "Serving", "incoming", 3)


def rule_forbidden_edge(spark, sf):
    return rules.forbidden_edges(edges(spark, sf), "ApplicationComponent", "BusinessProcess", "Serving")


def rule_orphans(spark, sf):
    kept = ~((F.col("rel_type") == "Access") & (F.substring("target_id", 5, 99).cast("bigint") % 7 == 0))
    return rules.orphans(nodes(spark, sf), rules.degree_table(edges(spark, sf).where(kept)))


def rule_ambiguous_only(spark, sf):
    return rules.ambiguous_only(rules.degree_table(edges(spark, sf).where("rel_type IN ('Serving', 'Access')")))


def rule_high_fan_in(spark, sf):
    return rules.high_fan_in(rules.degree_table(edges(spark, sf)), "DataObject", "Access", 30)


def rule_min_entities_per_doc(spark, sf):
    return rules.min_entities_per_doc(documents(spark, sf), _mentions(spark, sf), 5)


def rule_layer_coverage(spark, sf):
    return rules.missing_layers(nodes(spark, sf), RULES[8]["required_layers"])


def rule_reachability(spark, sf):
    return rules.unreachable(edges(spark, sf), nodes(spark, sf), "ApplicationComponent", "DataObject", 2)


def rule_allowed_patterns(spark, sf):
    allowed = spark.createDataFrame(
        [("Serving", "ApplicationComponent", "BusinessProcess"), ("Access", "BusinessProcess", "DataObject"), ("Assignment", "BusinessActor", "BusinessProcess")],
        "rel_type string, source_type string, target_type string",
    )
    return rules.nonconforming(edges(spark, sf), allowed).select("rel_type", "source_id", "target_id")


def conformance_summary(spark, sf):
    return rules.conformance(nodes(spark, sf), edges(spark, sf), documents(spark, sf), _mentions(spark, sf))


def knowledge_brief(spark, sf):
    """The whole brief: counts, hubs, types, relations, connections, gaps, rules and documents."""
    return brief.brief(nodes(spark, sf), edges(spark, sf), documents(spark, sf), chunks(spark, sf), _mentions(spark, sf))


def _rank_names(rows: str) -> str:
    return f"(VALUES {rows})"


_CHECKS = """, s AS (SELECT source_id, count(*) AS n FROM edges WHERE rel_type = 'Serving' GROUP BY 1),
t AS (SELECT target_id, rel_type, count(*) AS n FROM edges GROUP BY 1, 2),
v AS (
  SELECT 'ARCH-001' AS rule_id, 'warning' AS severity, count(*) AS n FROM nodes WHERE node_type = 'ApplicationComponent' AND node_id NOT IN (SELECT source_id FROM s)
  UNION ALL SELECT 'ARCH-002', 'error', count(*) FROM edges WHERE source_type = 'SystemSoftware' AND target_type = 'BusinessProcess' AND rel_type = 'Serving'
  UNION ALL SELECT 'ARCH-003', 'warning', count(*) FROM nodes WHERE node_type = 'BusinessProcess' AND node_id NOT IN (SELECT target_id FROM t WHERE rel_type = 'Serving')
  UNION ALL SELECT 'ARCH-004', 'warning', count(*) FROM nodes WHERE node_type = 'DataObject' AND node_id NOT IN (SELECT target_id FROM t WHERE rel_type = 'Access')
  UNION ALL SELECT 'QUAL-001', 'warning', count(*) FROM nodes WHERE node_id NOT IN (SELECT node_id FROM ways)
  UNION ALL SELECT 'QUAL-002', 'info', count(*) FROM (SELECT node_id FROM ways GROUP BY 1 HAVING bool_and(coalesce(confidence, 'EXTRACTED') = 'AMBIGUOUS'))
  UNION ALL SELECT 'QUAL-003', 'info', count(*) FROM t WHERE rel_type = 'Access' AND n > 3
  UNION ALL SELECT 'COMP-001', 'warning', count(*) FROM (SELECT doc_id FROM documents LEFT JOIN mentions USING (doc_id) GROUP BY 1 HAVING count(DISTINCT node_id) < 5)
  UNION ALL SELECT 'COMP-002', 'error', 2
  UNION ALL SELECT 'DG-001', 'warning', count(*) FROM t WHERE rel_type = 'Access' AND n > 3)"""
_BRIEF = f""",
r AS (SELECT rule_id, severity, n, CASE WHEN n = 0 THEN 'passed' ELSE severity END AS status FROM v),
e AS (SELECT count(*) AS n, count_if(confidence = 'EXTRACTED') AS x, count_if(confidence = 'INFERRED') AS i, count_if(confidence = 'AMBIGUOUS') AS a, count_if(confidence IS NULL) AS u FROM edges),
d AS (SELECT node_id, count(*) AS degree FROM (SELECT source_id AS node_id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY 1),
h AS (SELECT node_id, node_type, name, degree, row_number() OVER (ORDER BY degree DESC, node_id) AS rank FROM d JOIN nodes USING (node_id) QUALIFY rank <= 15),
few AS (SELECT h.name, h.rank, edges.* FROM edges JOIN h ON source_id = node_id WHERE rank <= 5 QUALIFY row_number() OVER (PARTITION BY source_id, rel_type ORDER BY target_id) <= 3),
placed AS (SELECT *, row_number() OVER (ORDER BY rank, rel_type, target_id) AS place FROM few QUALIFY place <= 20),
met AS (SELECT doc_id, count(*) AS n FROM mentions GROUP BY 1)
SELECT 'overview' AS section, 1::BIGINT AS ord, count(*) || ' entities across ' || count(DISTINCT node_type) || ' types' AS line FROM nodes
UNION ALL SELECT 'overview', 2, n || ' relationships (' || round(100 * x / n)::BIGINT || '% EXTRACTED, ' || round(100 * i / n)::BIGINT || '% INFERRED, ' || round(100 * a / n)::BIGINT || '% AMBIGUOUS)' FROM e
UNION ALL SELECT 'overview', 3, (SELECT count(*) FROM documents) || ' source documents, ' || (SELECT count(*) FROM chunks) || ' chunks'
UNION ALL SELECT 'hubs', rank, name || ' (' || node_type || '), ' || degree || ' connections' FROM h
UNION ALL SELECT 'node types', row_number() OVER (ORDER BY count(*) DESC, node_type), node_type || ' [' || {_LAYER_CASE.format("node_type").replace("'Other'", "''")} || ']: ' || count(*) FROM nodes GROUP BY node_type
UNION ALL SELECT 'relations', row_number() OVER (ORDER BY count(*) DESC, rel_type), rel_type || ': ' || count(*) FROM edges GROUP BY rel_type
UNION ALL SELECT 'connections', place, name || ' (' || source_type || ') -[' || rel_type || ', ' || coalesce(confidence, 'EXTRACTED') || ']-> (' || target_type || ')' FROM placed
UNION ALL SELECT 'gaps', 1, round(100 * a / n)::BIGINT || '% of edges are AMBIGUOUS' FROM e WHERE a * 100 > n * 5
UNION ALL SELECT 'gaps', 2, round(100 * u / n)::BIGINT || '% of edges have no label' FROM e WHERE u * 100 > n * 10
UNION ALL SELECT 'gaps', 3, 'No entities of ' || string_agg(x, ', ' ORDER BY x) FROM (SELECT unnest({list(NODE_TYPES)}) AS x) WHERE x NOT IN (SELECT node_type FROM nodes) HAVING count(*) > 0
UNION ALL SELECT 'gaps', 4, 'No edges of ' || string_agg(x, ', ' ORDER BY x) FROM (SELECT unnest({list(RELATIONS)}) AS x) WHERE x NOT IN (SELECT rel_type FROM edges) HAVING count(*) > 0
UNION ALL SELECT 'conformance', 0, count_if(status = 'passed') || '/' || count(*) || ' passed, ' || count_if(status = 'warning') || ' warnings, ' || count_if(status = 'error') || ' errors' FROM r
UNION ALL SELECT 'conformance', row_number() OVER (ORDER BY rule_id), rule_id || ' [' || CASE WHEN n = 0 THEN 'PASS' ELSE upper(severity) || ', ' || n || ' violations' END || ']' FROM r
UNION ALL SELECT 'documents', doc_id, 'doc-' || doc_id || ': ' || coalesce(n, 0) FROM documents LEFT JOIN met USING (doc_id)"""


SQL = {
    "god_nodes": sql(
        """, d AS (SELECT node_id, count(*) AS degree FROM (SELECT source_id AS node_id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY 1)
SELECT node_id, node_type, name, degree FROM d JOIN nodes USING (node_id) ORDER BY degree DESC, node_id LIMIT 10""", "nodes", "edges"),
    "graph_stats_nodes": sql(f"SELECT node_type, count(*) AS n, {_LAYER_CASE.format('node_type')} AS layer FROM nodes GROUP BY node_type", "nodes"),
    "graph_stats_edges": sql("SELECT rel_type, coalesce(confidence, 'NULL') AS confidence, count(*) AS n FROM edges GROUP BY 1, 2", "edges"),
    "confidence_shares": sql(
        """SELECT coalesce(confidence, 'EXTRACTED') AS confidence, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS percent
FROM edges GROUP BY 1""", "edges"),
    "connections_one_hop": sql("SELECT other_id, other_type, rel_type, confidence, direction FROM ways WHERE node_id = 'nat:3'", "ways"),
    "graph_page": sql(
        """, c AS (SELECT *, CASE node_type WHEN 'BusinessActor' THEN 1 WHEN 'ApplicationComponent' THEN 2 ELSE 3 END AS o FROM nodes
  WHERE node_type IN ('BusinessActor', 'ApplicationComponent', 'DataObject')), t AS (SELECT count(*) AS total FROM c)
SELECT node_id, node_type, name, total, total > 540 AS has_more FROM (SELECT * FROM c ORDER BY o, node_id LIMIT 500 OFFSET 40), t""", "nodes"),
    "graph_page_edges": sql(
        """, c AS (SELECT node_id FROM nodes WHERE node_type IN ('BusinessRole', 'BusinessActor', 'ApplicationComponent')
  ORDER BY CASE node_type WHEN 'BusinessRole' THEN 1 WHEN 'BusinessActor' THEN 2 ELSE 3 END, node_id LIMIT 500)
SELECT * FROM edges WHERE source_id IN (FROM c) AND target_id IN (FROM c)""", "nodes", "edges"),
    "entity_lookup": sql("SELECT * FROM nodes WHERE node_type = 'BusinessRole' AND lower(name) = lower('Nation_3')", "nodes"),
    "entity_search_like": sql("SELECT node_id, name, 1.0::DOUBLE AS score FROM nodes WHERE lower(name) LIKE '%1%'", "nodes"),
    "hub_connections": sql(
        """, d AS (SELECT node_id, count(*) AS degree FROM (SELECT source_id AS node_id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY 1),
h AS (SELECT node_id FROM d JOIN nodes USING (node_id) ORDER BY degree DESC, node_id LIMIT 5),
r AS (SELECT source_id, rel_type, target_id, row_number() OVER (PARTITION BY source_id, rel_type ORDER BY target_id) AS n FROM edges WHERE source_id IN (FROM h))
SELECT source_id, rel_type, target_id FROM r WHERE n <= 3 ORDER BY 1, 2, 3 LIMIT 20""", "nodes", "edges"),
    "motif_two_hop": sql(
        """SELECT a.source_id AS n0, a.rel_type AS r1, a.target_id AS n1, b.rel_type AS r2, b.target_id AS n2 FROM edges a JOIN edges b ON a.target_id = b.source_id
WHERE a.rel_type = 'Composition' AND b.rel_type = 'Association'""", "edges"),
    "motif_typed_chain": sql(
        """SELECT a.node_id AS n0, a.rel_type AS r1, a.other_id AS n1, b.rel_type AS r2, b.other_id AS n2 FROM ways a JOIN ways b ON a.other_id = b.node_id
WHERE a.node_id IN (SELECT node_id FROM nodes WHERE node_type = 'ApplicationComponent') AND a.rel_type = 'Serving' AND a.other_type = 'BusinessProcess' AND b.other_type = 'BusinessActor'""", "ways", "nodes"),
    "var_length_paths": sql(
        """, walk(start, "end", n) AS (SELECT source_id, target_id, 1 FROM edges WHERE source_type = 'BusinessFunction'
  UNION SELECT start, e.target_id, n + 1 FROM walk JOIN edges e ON e.source_id = walk."end" WHERE n < 3)
SELECT DISTINCT start, "end" FROM walk""", "edges", recursive=True),
    "pattern_group_count": sql("SELECT name, n FROM (SELECT source_id, count(*) AS n FROM edges WHERE rel_type = 'Serving' GROUP BY 1) JOIN nodes ON node_id = source_id", "nodes", "edges"),
    "next_chain": sql(
        """, b AS (SELECT target_id, count(*) AS n_serving FROM edges WHERE rel_type = 'Serving' GROUP BY 1 HAVING count(*) >= 7)
SELECT b.target_id, n_serving, e.target_id AS part_id FROM b JOIN edges e ON e.source_id = b.target_id WHERE rel_type = 'Access'""", "edges"),
    "cross_layer": sql(
        f"""SELECT rel_type, source_layer, target_layer, count(*) AS n FROM (
  SELECT rel_type, {_LAYER_CASE.format("source_type")} AS source_layer, {_LAYER_CASE.format("target_type")} AS target_layer FROM edges)
WHERE source_layer <> target_layer GROUP BY 1, 2, 3""", "edges"),
    "neighborhood": sql(
        """, k1 AS (SELECT source_id, target_id FROM (SELECT *, row_number() OVER (PARTITION BY rel_type ORDER BY source_id, target_id) AS n FROM edges
  WHERE source_id = 'nat:3' OR target_id = 'nat:3') WHERE n <= 100),
h1 AS (SELECT source_id AS node_id FROM k1 UNION SELECT target_id FROM k1 EXCEPT SELECT 'nat:3'),
k2 AS (SELECT source_id, target_id FROM (SELECT *, row_number() OVER (PARTITION BY rel_type ORDER BY source_id, target_id) AS n FROM edges
  WHERE source_id IN (FROM h1) OR target_id IN (FROM h1)) WHERE n <= 100),
h2 AS ((SELECT source_id AS node_id FROM k2 UNION SELECT target_id FROM k2) EXCEPT (SELECT node_id FROM h1 UNION SELECT 'nat:3'))
SELECT 'nat:3' AS node_id, 0 AS hop UNION ALL SELECT node_id, 1 FROM h1 UNION ALL SELECT node_id, 2 FROM h2""", "edges"),
    "neighborhood_edges": sql(
        """, k1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rel_type ORDER BY source_id, target_id) AS n FROM edges
  WHERE source_id = 'nat:3' OR target_id = 'nat:3') WHERE n <= 100),
h1 AS (SELECT source_id AS node_id FROM k1 UNION SELECT target_id FROM k1 EXCEPT SELECT 'nat:3'),
k2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rel_type ORDER BY source_id, target_id) AS n FROM edges
  WHERE source_id IN (FROM h1) OR target_id IN (FROM h1)) WHERE n <= 100)
SELECT DISTINCT source_id, target_id, rel_type, coalesce(confidence, 'EXTRACTED') AS confidence FROM (SELECT * FROM k1 UNION ALL SELECT * FROM k2)""", "edges"),
    "edge_canonicalise": sql(
        f"""SELECT CASE WHEN swapped THEN target_id ELSE source_id END AS source_id, CASE WHEN swapped THEN target_type ELSE source_type END AS source_type,
  CASE WHEN swapped THEN source_id ELSE target_id END AS target_id, CASE WHEN swapped THEN source_type ELSE target_type END AS target_type, rel_type, confidence, swapped
FROM (SELECT *, CASE WHEN rel_type IN ('Realization', 'Serving', 'Access') THEN {_RANK_CASE.format("source_type")} < {_RANK_CASE.format("target_type")}
  WHEN rel_type = 'Assignment' THEN {_RANK_CASE.format("source_type")} > {_RANK_CASE.format("target_type")} ELSE false END AS swapped FROM edges)""", "edges"),
    "doc_lineage": sql(_MENTIONS + "SELECT node_id, name, count(DISTINCT doc_id) AS n_docs FROM mentions JOIN nodes USING (node_id) GROUP BY 1, 2", "nodes"),
    "rule_min_connections": sql(
        """SELECT node_id FROM nodes LEFT JOIN (SELECT target_id, count(*) AS n FROM edges WHERE rel_type = 'Serving' GROUP BY 1) ON target_id = node_id
WHERE node_type = 'BusinessProcess' AND coalesce(n, 0) < 3""", "nodes", "edges"),
    "rule_forbidden_edge": sql("SELECT source_id, target_id FROM edges WHERE source_type = 'ApplicationComponent' AND target_type = 'BusinessProcess' AND rel_type = 'Serving'", "edges"),
    "rule_orphans": sql(
        """, e AS (SELECT * FROM edges WHERE NOT (rel_type = 'Access' AND substr(target_id, 5)::BIGINT % 7 = 0))
SELECT node_id FROM nodes ANTI JOIN (SELECT source_id AS node_id FROM e UNION SELECT target_id FROM e) USING (node_id)""", "nodes", "edges"),
    "rule_ambiguous_only": sql(
        "SELECT node_id FROM ways WHERE rel_type IN ('Serving', 'Access') GROUP BY node_id HAVING bool_and(coalesce(confidence, 'EXTRACTED') = 'AMBIGUOUS')", "ways"),
    "rule_high_fan_in": sql("SELECT target_id AS node_id, count(*) AS n FROM edges WHERE rel_type = 'Access' GROUP BY 1 HAVING count(*) > 30", "edges"),
    "rule_min_entities_per_doc": sql(
        _MENTIONS + "SELECT doc_id, count(DISTINCT node_id) AS n FROM docs LEFT JOIN mentions USING (doc_id) GROUP BY 1 HAVING count(DISTINCT node_id) < 5", "docs"),
    "rule_layer_coverage": sql(
        f"SELECT layer FROM (VALUES ('Business'), ('Application'), ('Technology'), ('Motivation')) AS t(layer) EXCEPT SELECT {_LAYER_CASE.format('node_type')} FROM nodes", "nodes"),
    "rule_reachability": sql(
        """, one AS (SELECT DISTINCT target_id AS node_id FROM edges WHERE source_type = 'ApplicationComponent'),
two AS (SELECT target_id FROM edges JOIN one ON node_id = source_id)
SELECT node_id FROM nodes WHERE node_type = 'DataObject' AND node_id NOT IN (FROM one) AND node_id NOT IN (FROM two)""", "nodes", "edges"),
    "rule_allowed_patterns": sql("SELECT rel_type, source_id, target_id FROM edges WHERE rel_type NOT IN ('Serving', 'Access', 'Assignment')", "edges"),
    "knowledge_brief": sql(_MENTIONS + _CHECKS + _BRIEF, "nodes", "ways", "chunks"),
    "conformance_summary": sql(
        _MENTIONS + _CHECKS + """
SELECT rule_id, severity, n AS n_violations, CASE WHEN n = 0 THEN 'passed' ELSE severity END AS status FROM v""", "nodes", "ways"),
}

_WALK = """, f AS (SELECT node_id, other_id, max(CASE coalesce(confidence, 'EXTRACTED') WHEN 'INFERRED' THEN 0.5 WHEN 'AMBIGUOUS' THEN 0.0 ELSE 1.0 END)::DOUBLE AS factor
  FROM ways GROUP BY 1, 2),
walk(node_id, confidence, hops) AS (SELECT 'reg:0', 1.0::DOUBLE, 0
  UNION SELECT f.other_id, walk.confidence * factor, hops + 1 FROM walk JOIN f ON f.node_id = walk.node_id WHERE hops < 4 AND walk.confidence * factor >= 0.1),
best AS (SELECT node_id, max(confidence) AS confidence FROM walk GROUP BY 1),
reached AS (SELECT node_id, confidence, min(hops)::INT AS hops FROM walk JOIN best USING (node_id, confidence) GROUP BY 1, 2)
"""
SQL["impact_analysis"] = sql(_WALK + "SELECT * FROM reached", "ways", recursive=True)
SQL["impact_layers"] = sql(
    _WALK + f"""SELECT {_LAYER_CASE.format("node_type")} AS layer, count(*) AS n, round(sum(confidence), 1) AS weighted, max(hops) AS max_hop
FROM reached JOIN nodes USING (node_id) WHERE hops > 0 GROUP BY 1""",
    "ways", "nodes", recursive=True,
)



def _traced(hops):
    """Unrolled walks from a node: what rose at each number of hops, with the way to it."""
    factor = "CASE lab WHEN 'INFERRED' THEN 0.5::DOUBLE WHEN 'AMBIGUOUS' THEN 0.0 ELSE 1.0 END"
    parts = [f""", w AS (SELECT node_id AS prev, other_id AS node_id, other_type, rel_type, direction, coalesce(confidence, 'EXTRACTED') AS lab FROM ways),
f0 AS (SELECT node_id, 1.0::DOUBLE AS conf, 0 AS hops, node_type AS other_type, name AS path FROM nodes WHERE node_id = '{IMPACT_FROM}')"""]
    for h in range(1, hops + 1):
        known = " UNION ALL ".join(f"SELECT node_id, conf FROM f{i}" for i in range(h))
        parts.append(f"""c{h} AS (SELECT w.*, f.conf * {factor} AS conf, f.path FROM f{h - 1} f JOIN w ON w.prev = f.node_id WHERE f.conf * {factor} >= 0.1),
f{h} AS (SELECT node_id, c.conf, {h} AS hops, other_type, path || CASE direction WHEN 'outgoing' THEN ' -[' || rel_type || ', ' || lab || ']-> (' ELSE ' <-[' || rel_type || ', ' || lab || ']- (' END
  || other_type || ')' AS path FROM (SELECT * FROM c{h} QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY conf DESC, prev, rel_type, direction, lab, other_type) = 1) c
  LEFT JOIN (SELECT node_id, max(conf) AS known FROM ({known}) GROUP BY 1) k USING (node_id) WHERE known IS NULL OR c.conf > known)""")
    rows = " UNION ALL ".join(f"SELECT * FROM f{i}" for i in range(hops + 1))
    parts.append(f"r AS (SELECT * FROM ({rows}) QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY conf DESC, hops) = 1)")
    return ",\n".join(parts)


SQL["impact_paths"] = sql(
    _traced(4) + f"""SELECT node_id, coalesce(name, node_id) AS name, other_type AS node_type, {_LAYER_CASE.format("other_type")} AS layer, hops, round(conf, 3) AS confidence, path
FROM r LEFT JOIN nodes USING (node_id) WHERE hops > 0 ORDER BY hops, conf DESC, node_id LIMIT 50""",
    "ways", "nodes",
)

QUERIES = {name: globals()[name] for name in SQL}
