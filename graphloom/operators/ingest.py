"""From sources to rows of the graph: code declarations, catalogue entries, glossary terms, and pruning by gain."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import uuid5

# Kinds of catalogue entries that become data objects.
ENTRY_TYPES = (
    "bigquery-table", "bigquery-dataset", "cloud-bigtable-table", "spanner-table", "spanner-database",
    "cloud-sql-postgres-table", "cloud-sql-postgres-database", "alloydb-postgres-table", "alloydb-postgres-database",
)

# The least gain, its share of the best gain, and how many chunks stay.
GAIN_FLOOR, GAIN_SHARE, GAIN_LEAST, GAIN_MOST = 0.05, 0.3, 3, 10

# Words that declare a name, and words that may stand before them.
DECLARES = ("class", "struct", "interface", "enum", "trait", "object", "module", "fn", "func", "function", "def")
MODIFIERS = ("export", "public", "private", "protected", "static", "async", "abstract", "final")

# Layers that a glossary keeps a category for, named by the layer in small letters.
CATEGORY_LAYERS = ("Strategy", "Business", "Application", "Technology", "Motivation")


def category_of(layer: Column) -> Column:
    """The glossary category of a layer, else null."""
    return F.when(layer.isin(*CATEGORY_LAYERS), F.lower(layer))


def layer_of_category(category: Column) -> Column:
    """The layer that a glossary category stands for, else null."""
    return F.when(category.isin(*map(str.lower, CATEGORY_LAYERS)), F.initcap(category))


def stem(path: Column) -> Column:
    """The file name of a path without its last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def declarations(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, position, name, qualified_name): names declared at the start of a line, each once for a file, in order.

    A line is read word by word: modifiers are skipped, then the word must be
    one that declares, and the letters, digits and underscores that the next
    word starts with are the name.
    """

    def declared(line: Column) -> Column:
        words = F.split(F.trim(F.replace(line, F.lit("\t"), F.lit(" "))), " +")
        skipped = F.size(words) - F.size(F.filter(words, lambda w: ~w.isin(*MODIFIERS)))
        # modifiers count only where they lead; elsewhere the word before the name is another
        name = F.regexp_substr(F.get(words, skipped + 1), F.lit("^[A-Za-z_]\\w*"))
        leads = F.size(F.filter(F.slice(words, F.lit(1), skipped), lambda w: w.isin(*MODIFIERS))) == skipped
        return F.when(F.get(words, skipped).isin(*DECLARES) & leads, name)

    names = F.filter(F.transform(F.split(F.col(text), "\r?\n"), declared), lambda n: n.isNotNull())
    rows = files.select(path, F.posexplode(F.array_distinct(names)).alias("position", "name"))
    return rows.select(path, "position", "name", F.concat_ws(".", stem(F.col(path)), "name").alias("qualified_name"))


def image_chunks(chunks: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, chunk_text, page, image_uri): a document's images as chunks after those of its text.

    ``images`` has (doc_id, position, page, image_uri, caption); an image
    without a caption tells its page only. A document without text starts at 0.
    """
    used = chunks.groupBy("doc_id").agg((F.max("chunk_index") + 1).alias("used"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("position")) - 1
    caption = F.nullif(F.trim("caption"), F.lit(""))
    said = F.concat_ws(" ", F.concat(F.lit("[Image from page "), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit("]")), caption)
    return images.withColumn("place", place).join(used, "doc_id", "left").select(
        "doc_id", (F.coalesce("used", F.lit(0)) + F.col("place")).alias("chunk_index"), said.alias("chunk_text"), "page", "image_uri"
    )


_NAME = r"[`\"\[]?(?:\w+[`\"\]]?\.[`\"\[]?)*(\w+)"


def table_links(scripts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, name, rel_type, other): tables and views that a script creates.

    A foreign key is an Access to its table, a view a Realization of each table
    that it selects from; one without either has a null relation. The first
    statement that creates a name counts.
    """
    bare = F.regexp_replace(F.regexp_replace(F.col(text), r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " ")
    rows = scripts.select(path, F.posexplode(F.split(bare, ";")).alias("nth", "statement"))
    create = rf"(?is)^\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(table|view)\s+(?:if\s+not\s+exists\s+)?{_NAME}"
    rows = rows.select(path, "nth", "statement", F.lower(F.regexp_extract("statement", create, 1)).alias("kind"), F.regexp_extract("statement", create, 2).alias("name")).where("name <> ''")
    first = Window.partitionBy(path, "name").orderBy("nth")
    rows = rows.withColumn("n", F.row_number().over(first)).where("n = 1")
    keys = F.regexp_extract_all("statement", F.lit(rf"(?is)\bforeign\s+key\s*\([^)]*\)\s*references\s+{_NAME}"), 1)
    read = F.array_except(F.regexp_extract_all("statement", F.lit(rf"(?is)\b(?:from|join)\s+{_NAME}"), 1), F.array("name"))
    view = F.col("kind") == "view"
    rows = rows.withColumn("other", F.explode_outer(F.array_distinct(F.when(view, read).otherwise(keys))))
    return rows.select(path, "name", F.when(F.col("other").isNotNull(), F.when(view, "Realization").otherwise("Access")).alias("rel_type"), "other")


def source_chunks(files: DataFrame, key: str = "doc_id", text: str = "text", size: int = 1500) -> DataFrame:
    """(key, chunk_index, chunk_id, chunk_text): adjoining pieces that aren't blank, numbered without gaps."""
    body = F.coalesce(text, F.lit(""))
    starts = F.when(F.length(body) > 0, F.sequence(F.lit(1), F.length(body), F.lit(size)))
    pieces = F.filter(F.transform(starts, lambda at: F.substring(body, at, F.lit(size))), lambda p: p.rlike(r"\S"))
    rows = files.select(key, F.posexplode(pieces).alias("chunk_index", "chunk_text"))
    return rows.select(key, "chunk_index", F.md5(F.concat(F.col(key).cast("string"), F.lit(":c"), F.col("chunk_index").cast("string"))).alias("chunk_id"), "chunk_text")


def parse_data_uri(uri: Column) -> Column:
    """struct(mime, content) of a base64 data URI, else null."""
    form = r"^data:([^;,]+);base64,([A-Za-z0-9+/=\s]*)$"
    return F.when(uri.rlike(form), F.struct(F.regexp_extract(uri, form, 1).alias("mime"), F.unbase64(F.regexp_extract(uri, form, 2)).alias("content")))


def catalogue_import(entries: DataFrame, types: tuple[str, ...] = ENTRY_TYPES) -> DataFrame:
    """(entry_name, status, node_id, name, display_name, description) of entries (entry_name, entry_type, qualified_name, resource, display_name, description).

    An entry without a name has failed; one of another type is skipped. A name
    falls back from the qualified name to the resource to the entry's own.
    """
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    name = F.coalesce(some("qualified_name"), some("resource"), F.col("entry_name"))
    known = F.substring_index(F.coalesce("entry_type", F.lit("")), "/", -1).isin(*types)
    status = F.when(some("entry_name").isNull(), "failed").when(known, "imported").otherwise("skipped")
    rows = entries.withColumns({"status": status, "name": name, "display_name": F.coalesce(some("display_name"), name), "description": F.coalesce("description", F.lit(""))})
    kept = lambda c: F.when(F.col("status") == "imported", c)
    return rows.select(
        "entry_name", "status", kept(uuid5(uuid.NAMESPACE_DNS, F.col("entry_name"))).alias("node_id"),
        *(kept(F.col(c)).alias(c) for c in ("name", "display_name", "description")),
    )


def import_counts(imported: DataFrame) -> DataFrame:
    """(status, n) of :func:`catalogue_import`."""
    return imported.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def glossary_pull(terms: DataFrame) -> DataFrame:
    """(source_id, target_id): synonym edges between terms (node_id, name, synonyms) of the batch; of equal names the last id counts."""
    named = terms.groupBy("name").agg(F.max("node_id").alias("target_id"))
    pairs = terms.select("name", F.explode("synonyms").alias("synonym")).distinct()
    mine = pairs.join(named.withColumnRenamed("target_id", "source_id"), "name")
    met = mine.join(named.withColumnRenamed("name", "synonym"), "synonym")
    return met.where("source_id <> target_id").select("source_id", "target_id").distinct()


def uncertainty(steps: Column, k: int = 5) -> Column:
    """The mean entropy of tokens over ln k, of arrays of log-probabilities; a half without a step."""

    def entropy(step: Column) -> Column:
        sure = F.filter(step, lambda x: x.isNotNull())
        e = F.transform(sure, lambda x: F.exp(x - F.array_max(sure)))
        total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
        return -F.aggregate(F.transform(e, lambda x: x / total), F.lit(0.0), lambda a, p: a + F.when(p > 0, p * F.ln(p)).otherwise(0.0))

    given = F.filter(steps, lambda s: F.exists(s, lambda x: x.isNotNull()))
    found = F.transform(given, entropy)
    return F.coalesce(F.try_divide(F.aggregate(found, F.lit(0.0), lambda a, x: a + x), F.size(given)) / F.ln(F.lit(float(k))), F.lit(0.5))


def prune_by_gain(chunks: DataFrame, query: str = "query_id", chunk: str = "chunk_id", gain: str = "gain") -> DataFrame:
    """(query, chunk, gain, rank): the chunks that tell enough, the best first.

    A chunk stays if its gain reaches the floor and a share of the best one's,
    up to ten; where fewer than three stay, the best three do. Queries of at
    most three chunks keep all.
    """
    best = Window.partitionBy(query)
    order = best.orderBy(F.desc(gain), chunk)
    # no rank beyond the most can stay, and enough is a prefix of the order: the first ranks tell all, and tasks cut them before the shuffle
    rows = chunks.select(query, chunk, gain).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= GAIN_MOST)
    rows = rows.withColumns({"top": F.max(gain).over(best), "all": F.count(F.lit(1)).over(best)})
    enough = F.col(gain) >= F.greatest(F.lit(GAIN_FLOOR), F.col("top") * GAIN_SHARE)
    rows = rows.withColumn("n_enough", F.count_if(enough).over(best))
    keep = F.least(F.greatest(F.col("n_enough"), F.lit(GAIN_LEAST)), F.lit(GAIN_MOST))
    return rows.where((F.col("all") <= GAIN_LEAST) | (F.col("rank") <= keep)).select(query, chunk, gain, "rank")
