"""Text, vector and retrieval queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text, vectors
from graphloom.operators import graph, index, retrieval
from graphloom.registry import NAME_WORDS, STOP_WORDS
from graphloom.sources.tables import chunks, chunks_of, documents, edges, nodes, table

from .views import sql


NAME_ENDS = (".jar", "/billing.war", " .zip bundle", "-backup.tar", "é.ear", " Postgres.", "-os", " app.zip", " host name", " Model T", "hostname", " éhost")


def _vectors(spark, sf):
    return table(spark, sf, "embeddings")


def _asked(spark, sf):
    """The stated query set: every vector whose id is divisible by 100."""
    return _vectors(spark, sf).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def _questions(spark, sf):
    """The stated query set: user turns of every conversation whose id is divisible by 100."""
    t = table(spark, sf, "conversations").where("role = 'user' AND conv_id % 100 = 0 AND text IS NOT NULL")
    return t.select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), "conv_id", text.keywords(F.col("text")).alias("keywords"))


def _names(spark, sf):
    first = F.split(F.lower("text"), " ")[0]
    return table(spark, sf, "benchmark").groupBy(first.alias("name")).agg(F.concat(F.lit("b:"), F.min("item_id")).alias("node_id")).where(F.length("name") > 3)


def window_chunks(spark, sf):
    return chunks(spark, sf)


def semantic_chunks(spark, sf):
    docs = documents(spark, sf).where("text IS NOT NULL")
    return docs.select("doc_id", F.posexplode(text.semantic_chunks(F.col("text"))).alias("chunk_index", "chunk_text"))


def page_estimate(spark, sf):
    joined = chunks(spark, sf).join(documents(spark, sf).select("doc_id", "text"), "doc_id")
    return joined.select("chunk_id", text.page_of(F.col("chunk_text"), F.col("text")).alias("page"))


def keywords_extract(spark, sf):
    t = table(spark, sf, "conversations").where("role = 'user' AND text IS NOT NULL")
    return t.select("conv_id", "turn", F.array_join(text.keywords(F.col("text")), " ").alias("keywords"))


def parse_edges(spark, sf):
    e = edges(spark, sf)
    label = F.when(F.col("confidence").isNull(), "").otherwise(F.concat(F.lit("[Read,"), F.lower("confidence"), F.lit("]")))
    line = F.concat("source_type", F.lit(":"), "source_id", F.lit("->"), "rel_type", label, F.lit("->"), "target_type", F.lit(":"), "target_id")
    return e.select(line.alias("line")).select(text.parse_edge(F.col("line")).alias("e")).select("e.*")


def classify_nodes(spark, sf):
    """Turns of conversations, and parts as names of files and things."""
    t = table(spark, sf, "conversations").where("text IS NOT NULL").select("text")
    ends = F.array(*map(F.lit, NAME_ENDS))
    t = t.unionByName(table(spark, sf, "part").select(F.concat(F.lower("p_brand"), F.get(ends, (F.col("p_partkey") % len(NAME_ENDS)).cast("int"))).alias("text")))
    return t.groupBy(text.classify_name(F.col("text")).alias("node_type")).agg(F.count(F.lit(1)).alias("n"))


def chunk_mentions(spark, sf):
    return retrieval.mentions(chunks(spark, sf), _names(spark, sf))


def scope_semi_join(spark, sf):
    """Chunks that mention a pinned name: those of the first half of the alphabet."""
    pinned = _names(spark, sf).where("name < 'n'")
    c = chunks(spark, sf)
    return c.join(retrieval.mentions(c, pinned), ["doc_id", "chunk_id"], "left_semi").select("doc_id", "chunk_id")


def _long_names(spark, sf):
    """The first one, two and three words of every item, of four letters or fewer too."""
    words = F.split(F.lower("text"), " ")
    return table(spark, sf, "benchmark").select(F.explode(F.array(*(F.array_join(F.slice(words, 1, n), " ") for n in (1, 2, 3)))).alias("name")).distinct()


def substring_mentions(spark, sf):
    """Names that stand anywhere in a chunk, within words too."""
    return retrieval.containing(chunks(spark, sf), _long_names(spark, sf))


def keyword_search_like(spark, sf):
    return retrieval.keyword_ranks_like(_questions(spark, sf), _seen(spark, sf))


def _scope(mode):
    def query(spark, sf):
        return retrieval.scoped(documents(spark, sf), retrieval.Scope("tenant_a", mode=mode)).select("doc_id", "title", "tenant_id")

    return query


def knn_chunks(spark, sf):
    return vectors.nearest(_asked(spark, sf), _vectors(spark, sf).select("vec_id", "embedding"), 20)


def knn_per_type(spark, sf):
    return vectors.nearest(_asked(spark, sf), _vectors(spark, sf), 3, ("label",))


def theme_search(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    best = vectors.nearest(_asked(spark, sf), _vectors(spark, sf), 3, ("label",)).drop("rank")
    return best.withColumn("rank", F.row_number().over(order)).where("rank <= 10")


def qa_fast_path(spark, sf):
    """The three nearest other vectors at a similarity of 0.75 or more, for queries whose best is that near."""
    near = vectors.nearest(_asked(spark, sf), _vectors(spark, sf).select("vec_id", "embedding"), 4)
    return near.where("vec_id <> query_id AND 1 - distance >= 0.75").select("query_id", "vec_id", F.round(1 - F.col("distance"), 6).alias("similarity"))


def knn_index(spark, sf):
    """The stated queries by the index of cells: about the twenty nearest."""
    v = _vectors(spark, sf).select("vec_id", "embedding")
    return index.search(index.build(v), _asked(spark, sf), 20)


def knn_index_all(spark, sf):
    """The same with every cell probed, which is exact."""
    v = _vectors(spark, sf).select("vec_id", "embedding")
    built = index.build(v)
    return index.search(built, _asked(spark, sf), 20, len(built.centroids))


def reconcile_entities(spark, sf):
    """Odd vectors as new entities: the exact name, else the nearest of the type within 0.15, else a new id."""
    v = _vectors(spark, sf).select("vec_id", "label", "embedding")
    new = v.where("vec_id % 2 = 1").withColumn("name", F.concat(F.lit("Name-"), F.col("vec_id") * 3 + 1))
    old = v.where("vec_id % 2 = 0")
    named = old.select(F.col("vec_id").alias("old_id"), "label", F.concat(F.lit("name-"), "vec_id").alias("old_name"))
    exact = new.join(named, (new["label"] == named["label"]) & (F.lower("name") == F.lower("old_name"))).select("vec_id", "old_id", F.lit("exact").alias("how"))
    near = index.within(new.join(exact, "vec_id", "left_anti").select("vec_id", "label", "embedding"), old, 0.15, "label")
    found = exact.unionByName(near.select(F.col("left_id").alias("vec_id"), F.col("right_id").alias("old_id"), F.lit("near").alias("how")))
    return new.select("vec_id").join(found, "vec_id", "left").select("vec_id", "old_id", F.coalesce("how", F.lit("new")).alias("how"))


def mean_embedding(spark, sf):
    return vectors.mean_vector(_vectors(spark, sf), "label").withColumn("mean", F.round("mean", 6))


def pca_projection(spark, sf):
    return vectors.principal_axes(_vectors(spark, sf))


def query_projection(spark, sf):
    """The stated queries in the space fitted to all vectors."""
    v = _vectors(spark, sf)
    return vectors.fitted_axes(v)(v.where("vec_id % 100 = 0"))


def scatter_scaled(spark, sf):
    """The first three numbers of each vector, scaled for a plot."""
    points = _vectors(spark, sf).select("vec_id", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")))
    return vectors.scaled(points, *"xyz").select("vec_id", *(F.round(c, 6).alias(c) for c in "xyz"))


def _mine(spark, sf):
    """The documents of the asking tenant and of those shared sets that it may see."""
    return retrieval.scoped(documents(spark, sf), retrieval.Scope("tenant_a", ("__shared__:alpha",)))


def _seen(spark, sf):
    """The chunks that the asking tenant may see: its own and those of shared sets."""
    return chunks_of(_mine(spark, sf).select("doc_id", "text"))


def keyword_search(spark, sf):
    return retrieval.keyword_ranks(_questions(spark, sf), _seen(spark, sf))


def budget_cut(spark, sf):
    """The labels of the hubs' edges that fit into 2000 characters, surest first."""
    e, n = edges(spark, sf), nodes(spark, sf)
    mine = e.join(graph.hubs(n, e, 10).select(F.col("node_id").alias("source_id")), "source_id", "left_semi")
    conf = F.coalesce("confidence", F.lit("EXTRACTED"))
    label = F.concat(F.col("source_id"), F.lit(" -["), F.col("rel_type"), F.lit(", "), conf, F.lit("]-> "), F.col("target_id"))
    surest = F.expr("CASE coalesce(confidence, 'EXTRACTED') WHEN 'EXTRACTED' THEN 0 WHEN 'INFERRED' THEN 1 ELSE 2 END")
    rows = mine.select("source_id", label.alias("label"), surest.alias("cls"))
    return retrieval.within_budget(rows, "source_id", "label", ["cls", "label"]).select("source_id", "label", "used")


_FIRST = "regexp_extract(lower(text), '^[^ ]*')"
_NAMES = f""", names AS (SELECT {_FIRST} AS name, 'b:' || min(item_id) AS node_id FROM benchmark WHERE length({_FIRST}) > 3 GROUP BY 1),
hits AS (SELECT DISTINCT chunk_id, doc_id, node_id FROM (
  SELECT chunk_id, doc_id, unnest(list_distinct(string_split_regex(lower(chunk_text), '[\\x20\\x09-\\x0D]+'))) AS word FROM chunks) JOIN names ON name = word)
"""
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_KEYWORDS = rf"""list_slice(list_filter(list_transform(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: lower(regexp_replace(w, '[^\p{{L}}\p{{N}}_]', '', 'g'))),
  lambda w: length(w) > 2 AND w NOT IN ({_STOP})), 1, 8)"""
_UNIT = """, u AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
far AS (SELECT q.vec_id AS query_id, u.vec_id, u.label, round(list_cosine_distance(q.v, u.v), 6) AS distance FROM u q, u WHERE q.vec_id % 100 = 0)
"""
# SQL's own boundaries know ASCII letters only: they are spelled out, extensions with a letter or digit before their dot.
_LETTER, _NONE = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"


def _bounded(words):
    dotted = [w for w in words.split("|") if w.startswith(r"\.")]
    plain = "|".join(w for w in words.split("|") if w not in dotted)
    return f"(?i)(?:(?:^|{_NONE})(?:{plain})" + (f"|{_LETTER}(?:{'|'.join(dotted)})" if dotted else "") + f")(?:$|{_NONE})"


_LADDER = "CASE " + " ".join(f"WHEN regexp_matches(text, '{_bounded(w)}') THEN '{k}'" for k, w in NAME_WORDS) + (
    r" WHEN regexp_matches(trim(text), '^\p{Lu}\S*(\s+\p{Lu}\S*){0,2}$') THEN 'BusinessActor' ELSE 'BusinessObject' END"
)
_QUESTIONS = rf""", q AS (SELECT conv_id || ':' || turn AS query_id, conv_id, unnest(list_distinct({_KEYWORDS})) AS word FROM conversations
  WHERE role = 'user' AND conv_id % 100 = 0 AND text IS NOT NULL),
seen AS (SELECT * FROM chunks WHERE doc_id IN (SELECT doc_id FROM docs WHERE tenant_id IN ('tenant_a', '__shared__:alpha'))),
w AS (SELECT chunk_id, doc_id, chunk_index, unnest(list_distinct(string_split_regex(lower(chunk_text), '[\x20\x09-\x0D]+'))) AS word FROM seen),
c AS (SELECT query_id, chunk_id, doc_id, chunk_index, count(*) AS n_matched FROM w JOIN q USING (word) GROUP BY ALL),
kw AS (SELECT query_id, chunk_id, n_matched, (row_number() OVER (PARTITION BY query_id ORDER BY n_matched DESC, doc_id, chunk_index))::INT AS rank FROM c
  QUALIFY rank <= 20)
"""

_SCOPES = {"mine": "('tenant_a')", "shared": "('__shared__:alpha', '__shared__:beta')", "all": "('tenant_a', '__shared__:alpha', '__shared__:beta')"}
SQL = {
    "window_chunks": sql("SELECT * FROM chunks", "chunks"),
    "page_estimate": sql(
        r"""SELECT chunk_id, CASE WHEN regexp_matches(chunk_text, '(Slide|Page|Pagina)\s+\d+') THEN regexp_extract(chunk_text, '(?:Slide|Page|Pagina)\s+(\d+)', 1)::INT
  WHEN strpos(text, substr(chunk_text, 1, 100)) > 0 THEN ((strpos(text, substr(chunk_text, 1, 100)) - 1) // 3000 + 1)::INT END AS page
FROM chunks JOIN documents USING (doc_id)""", "chunks"),
    "keywords_extract": f"SELECT conv_id, turn, coalesce(array_to_string({_KEYWORDS}, ' '), '') AS keywords FROM conversations WHERE role = 'user' AND text IS NOT NULL",
    "parse_edges": sql(
        """SELECT source_type, source_id AS source_name, rel_type, CASE WHEN confidence IS NULL THEN '' ELSE 'Read' END AS detail,
  coalesce(confidence, 'EXTRACTED') AS confidence, target_type, target_id AS target_name FROM edges""", "edges"),
    "classify_nodes": f"""SELECT {_LADDER} AS node_type, count(*) AS n FROM (SELECT text FROM conversations WHERE text IS NOT NULL
  UNION ALL SELECT lower(p_brand) || {list(NAME_ENDS)}[p_partkey % {len(NAME_ENDS)} + 1] FROM part) GROUP BY 1""",
    "chunk_mentions": sql(_NAMES + "SELECT chunk_id, doc_id, node_id FROM hits", "chunks"),
    "substring_mentions": sql(
        """, n AS (SELECT DISTINCT array_to_string(list_slice(string_split(lower(text), ' '), 1, k), ' ') AS name FROM benchmark, (VALUES (1), (2), (3)) AS t(k))
SELECT chunk_id, name FROM chunks JOIN n ON contains(lower(chunk_text), name) WHERE name <> ''""", "chunks"),
    "keyword_search_like": sql(
        _QUESTIONS + """, lk AS (SELECT query_id, chunk_id, count(*) AS n_matched, (row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, doc_id, chunk_index))::INT AS rank
  FROM seen JOIN q ON contains(lower(chunk_text), word) GROUP BY query_id, chunk_id, doc_id, chunk_index) SELECT * FROM lk WHERE rank <= 20""", "chunks", "docs"),
    "scope_semi_join": sql(_NAMES + "SELECT DISTINCT doc_id, chunk_id FROM hits WHERE node_id IN (SELECT node_id FROM names WHERE name < 'n')", "chunks"),
    "knn_chunks": "WITH " + _UNIT[2:] + """SELECT query_id, vec_id, distance, (row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id))::INT AS rank FROM far
QUALIFY rank <= 20""",
    "knn_index_all": "WITH " + _UNIT[2:] + """SELECT query_id, vec_id, distance, (row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id))::INT AS rank FROM far
QUALIFY rank <= 20""",
    "knn_per_type": "WITH " + _UNIT[2:] + """SELECT *, (row_number() OVER (PARTITION BY query_id, label ORDER BY distance, vec_id))::INT AS rank FROM far QUALIFY rank <= 3""",
    "theme_search": "WITH " + _UNIT[2:] + """, b AS (SELECT * FROM far QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY distance, vec_id) <= 3)
SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id))::INT AS rank FROM b QUALIFY rank <= 10""",
    "qa_fast_path": "WITH " + _UNIT[2:] + """, b AS (SELECT * FROM far QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 4)
SELECT query_id, vec_id, round(1 - distance, 6) AS similarity FROM b WHERE vec_id <> query_id AND 1 - distance >= 0.75""",
    "reconcile_entities": """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
x AS (SELECT n.vec_id, o.vec_id AS old_id FROM v n JOIN v o ON n.label = o.label AND n.vec_id * 3 + 1 = o.vec_id WHERE n.vec_id % 2 = 1 AND o.vec_id % 2 = 0),
f AS (SELECT n.vec_id, o.vec_id AS old_id FROM v n JOIN v o ON n.label = o.label WHERE n.vec_id % 2 = 1 AND o.vec_id % 2 = 0 AND n.vec_id NOT IN (SELECT vec_id FROM x)
  AND round(list_cosine_distance(n.v, o.v), 6) < 0.15
  QUALIFY row_number() OVER (PARTITION BY n.vec_id ORDER BY round(list_cosine_distance(n.v, o.v), 6), o.vec_id) = 1)
SELECT vec_id, coalesce(x.old_id, f.old_id) AS old_id, CASE WHEN x.old_id IS NOT NULL THEN 'exact' WHEN f.old_id IS NOT NULL THEN 'near' ELSE 'new' END AS how
FROM v LEFT JOIN x USING (vec_id) LEFT JOIN f USING (vec_id) WHERE vec_id % 2 = 1""",
    "mean_embedding": """SELECT label, pos, round(avg(x), 6) AS mean FROM (
  SELECT label, unnest(embedding)::DOUBLE AS x, (generate_subscripts(embedding, 1) - 1)::INT AS pos FROM embeddings) GROUP BY ALL""",
    "scatter_scaled": """WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
s AS (SELECT max(greatest(abs(x), abs(y), abs(z), 1e-6)) AS scale FROM p)
SELECT vec_id, round(x / scale, 6) AS x, round(y / scale, 6) AS y, round(z / scale, 6) AS z FROM p, s""",
    "keyword_search": sql(_QUESTIONS + "SELECT * FROM kw", "chunks", "docs"),
    "budget_cut": sql(
        """, d AS (SELECT node_id, count(*) AS degree FROM (SELECT source_id AS node_id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY 1),
h AS (SELECT node_id FROM d JOIN nodes USING (node_id) ORDER BY degree DESC, node_id LIMIT 10),
r AS (SELECT source_id, source_id || ' -[' || rel_type || ', ' || coalesce(confidence, 'EXTRACTED') || ']-> ' || target_id AS label,
  CASE coalesce(confidence, 'EXTRACTED') WHEN 'EXTRACTED' THEN 0 WHEN 'INFERRED' THEN 1 ELSE 2 END AS cls FROM edges WHERE source_id IN (FROM h))
SELECT source_id, label, (sum(length(label)) OVER (PARTITION BY source_id ORDER BY cls, label ROWS UNBOUNDED PRECEDING))::BIGINT AS used FROM r QUALIFY used <= 2000""",
        "nodes", "edges"),
} | {f"tenant_scope_{m}": sql(f"SELECT doc_id, title, tenant_id FROM docs WHERE tenant_id IN {x}", "docs") for m, x in _SCOPES.items()}

QUERIES = {n: globals()[n] for n in [*SQL, "knn_index", "semantic_chunks", "pca_projection", "query_projection"] if n in globals()} | {f"tenant_scope_{m}": _scope(m) for m in _SCOPES}
