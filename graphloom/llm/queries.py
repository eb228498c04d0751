"""The operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_kmeans, exact_dedup, fingerprint, language_id, mixing, near_dup, packing, periodic, quality, secret_scan, substring_dedup, url_filter, weak_pii


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated(_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~language_id.fold()))
    named = docs.select(F.struct("doc_id", language_id.fold().alias("held_out")).alias("doc"), "text")
    return language_id.identify(named, model, "doc").select("doc.doc_id", "doc.held_out", "lang_pred", "score", "ambiguous")


def op6_near_dup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings, _ = secret_scan.scan(_table(spark, sf_dir, "documents"), path="doc_id")
    return secret_scan.digests(findings)


def secret_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second scan, of documents and pages, by the ledger of a first one of documents: only the pages' texts are read through."""
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), "doc_id").alias("path"), "text")
    pages = _table(spark, sf_dir, "pages").select(F.concat(F.lit("page:"), "page_id").alias("path"), F.col("html").alias("text"))
    _, ledger = secret_scan.scan(docs)
    findings, _ = secret_scan.scan(docs.unionByName(pages), ledger)
    return secret_scan.digests(findings, "path")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(~language_id.fold()).groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("quality"))
    model = quality.train_joined(docs, labels)
    named = docs.select(F.struct("doc_id", language_id.fold().alias("held_out")).alias("doc"), "text")
    return quality.classify(named, model, "doc").select("doc.doc_id", "doc.held_out", "score", "predicted")


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def with_planted_period(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of a tenth of the documents the words from a place on repeat the first ones from there, joined by spaces."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(words):
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # a one-element array binds the words once for all places
    edited = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeat(w)))[0]
    return docs.select("doc_id", F.when(h % 10 == 0, edited).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapse_runs(with_planted_period(_table(spark, sf_dir, "documents")))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    start, period = -F.col("top.start"), -F.col("top.period")
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), F.col("top.length").alias("length"), period.alias("period"),
        F.floor(F.lit(1000) * F.col("top.length") / period).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"),
    )


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.sha2(F.concat(F.lit("3:"), F.col("id").cast("string")), 256)
    return ball_kmeans.clusters(_table(spark, sf_dir, "embeddings"), 64, order)


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = weak_pii.personal_data(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: ~s["added"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, weak_pii.BASE), F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_substring_dedup, op2_exact_dedup, op3_packing, op4_mixing, op5_language_id,
        op6_near_dup_join, op7_url_filter, op8_secret_scan, op9_quality, op10_fingerprint,
        op11_periodic_runs, op12_ball_kmeans, op13_personal_data,
    )
    return {f.__name__: f for f in own} | {"secret_rescan": secret_rescan}


def oracle_sql() -> dict[str, str]:
    pages = f"{_PATHS} UNION ALL SELECT 'page:' || page_id, coalesce(html, '') FROM pages"
    return {
        "op1_substring_dedup": OP1_SQL,
        "op2_exact_dedup": OP2_SQL,
        "op8_secret_scan": OP8_SQL.format(key="doc_id", versions="SELECT doc_id, coalesce(text, '') AS t FROM documents"),
        "op11_periodic_runs": OP11_SQL,
        "op12_ball_kmeans": op12_sql(),
        "secret_rescan": OP8_SQL.format(key="path", versions=pages),
    }


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), n AS (
  SELECT doc_id, words, len(words) AS n_words FROM w
), win AS (
  SELECT doc_id, i, list_slice(words, i, i + 12) AS run
  FROM (SELECT doc_id, words, unnest(range(1, n_words - 11)) AS i FROM n WHERE n_words >= 13)
), owner AS (SELECT run, min(doc_id) AS first_doc FROM win GROUP BY run HAVING min(doc_id) < max(doc_id)
), hit AS (SELECT win.doc_id, win.i FROM win JOIN owner USING (run) WHERE win.doc_id > owner.first_doc
), gone AS (SELECT DISTINCT doc_id, i + o AS i FROM hit, (SELECT unnest(range(0, 13)) AS o)
), pos AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, n_words + 1)) AS i FROM n
), kept AS (
  SELECT pos.doc_id, string_agg(pos.word, ' ' ORDER BY pos.i) AS t, count(*) AS k
  FROM pos LEFT JOIN gone ON pos.doc_id = gone.doc_id AND pos.i = gone.i WHERE gone.i IS NULL GROUP BY pos.doc_id
)
SELECT n.doc_id, n.n_words::BIGINT AS n_words, (n.n_words - coalesce(k, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM n LEFT JOIN kept ON n.doc_id = kept.doc_id
"""

OP2_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t
"""

_PATHS = "SELECT 'doc:' || doc_id AS path, coalesce(text, '') AS t FROM documents"

# Positions are running sums of the texts between matches and of the matches. Letters of either case are listed: SQL's own folding goes beyond ASCII.
OP8_SQL = r"""
WITH v AS (SELECT {key}, t, row_number() OVER () AS r FROM ({versions})),
rules(nth, kind, pattern, grp, least, added) AS (VALUES
  (0, 'assign', '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6, false),
  (1, 'access', '()(AKIA[A-Z0-9]+)', 2, 20, false),
  (2, 'hex', '()([0-9a-f]+)', 2, 24, false),
  (3, 'private_key', '()(-----BEGIN [A-Z ]*PRIVATE KEY-----)', 2, 1, true),
  (4, 'web_token', '()(eyJ[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]*)', 2, 1, true),
  (5, 'hosting_token', '()(gh[pousr]_[A-Za-z0-9]{{36,}})', 2, 1, true),
  (6, 'chat_token', '()(xox[abprs]-[A-Za-z0-9-]{{10,}})', 2, 1, true)
), m AS (
  SELECT r, nth, kind, least, added, regexp_extract_all(t, pattern) AS hits, regexp_extract_all(t, pattern, grp) AS judged, string_split_regex(t, pattern) AS gaps FROM v, rules
), u AS (
  SELECT r, nth, kind, least, added, unnest(hits) AS hit, unnest(judged) AS judged, unnest(gaps[1:len(hits)]) AS gap, unnest(range(len(hits))) AS i FROM m WHERE len(hits) > 0
), s AS (
  SELECT *, (sum(length(gap) + length(hit)) OVER (PARTITION BY r, nth ORDER BY i))::BIGINT AS "end" FROM u
), f AS (
  SELECT r, nth, kind, added, "end" - length(hit) AS start, kind || ':' || ("end" - length(hit)) || ':' || "end" AS span FROM s WHERE length(judged) >= least
), g AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(span, ',' ORDER BY start, nth) FILTER (NOT added) AS base, string_agg(span, ',' ORDER BY start, nth) AS spans FROM f GROUP BY r
)
SELECT {key}, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM v LEFT JOIN g USING (r)
"""

# A crc32 step by step: the bytes of a number's digits, then eight shifts of each. Runs of all periods are islands of matches; of those at one place the least period counts.
OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), c AS (
  SELECT r, doc_id, words, len(words) AS n, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda s, b: xor(xor(s, b) >> 1, 3988292384::BIGINT * (xor(s, b) & 1)))) AS h FROM d
), e AS (
  SELECT r, doc_id, words, n, h % 10 = 0 AND n > 0 AS edited, (h // 10) % greatest(n, 1) AS a, h // 10 AS g FROM c
), f AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM e
), w AS (
  SELECT r, i, words[CASE WHEN edited AND i >= a THEN a + (i - a) % p ELSE i END + 1] AS word FROM (SELECT *, unnest(range(n)) AS i FROM f)
), m AS (
  SELECT x.r, y.i - x.i AS q, x.i AS i FROM w x JOIN w y ON x.r = y.r AND x.word = y.word AND y.i > x.i
), k AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM m
), l AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM k GROUP BY r, q, island HAVING count(*) + q >= greatest(12, 2 * q)
), runs AS (SELECT r, start, length, min(q) AS period FROM l GROUP BY r, start, length
), top AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    max(length) AS length, arg_min(start, (-length, start, period)) AS start, arg_min(period, (-length, start, period)) AS period FROM runs GROUP BY r
), gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM (SELECT * FROM w ANTI JOIN gone USING (r, i)) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN top USING (r) LEFT JOIN kept USING (r)
"""


def op12_sql(rounds: int = ball_kmeans.ROUNDS) -> str:
    """Every round compares every vector with every centroid."""
    parts = [
        """v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v AS w FROM v ORDER BY c LIMIT 8
)"""
    ]
    for i in range(rounds + 1):
        parts.append(f"""far{i} AS (
  SELECT r, c, list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{i}
), a{i} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM far{i} GROUP BY r)""")
        if i < rounds:
            parts.append(f"""s{i} AS (SELECT c, j, sum(x) AS total, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS j FROM a{i} JOIN v USING (r)) GROUP BY c, j
), m{i} AS (SELECT c, list(((total - ((total % n) + n) % n) // n)::BIGINT ORDER BY j) AS w FROM s{i} GROUP BY c
), c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.w, c{i}.w) AS w FROM c{i} LEFT JOIN m{i} USING (c))""")
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} USING (c)"""
    )
