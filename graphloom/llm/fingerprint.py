"""Document fingerprints: threshold-scaled sketches, in DataFrame functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range, the
same for texts of any length. Sketches of parts merge to the sketch of the
whole, and containment and similarity of very unequal documents can be
estimated from them. A sketch also counts its text's shingles: where none lies
below the fraction, that tells a short text from an empty one.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, numbered_in_order, row_count

SHINGLE_WORDS = 5
FRACTION = 1 / 4
_TOP = 1 << 63
#: Documents of a range whose next documents one task finds, about, as long as that makes no more than ``SMALL_RANGES`` ranges; beyond them, about so many bytes of text.
RANGE_ROWS, SMALL_RANGES, RANGE_BYTES = 256, 20_000, 1 << 27


def sketch(text: Column, words: int = SHINGLE_WORDS, fraction: float = FRACTION) -> Column:
    """struct(shingles, hashes): how many shingles the text has, and its sorted distinct hashes below the fraction.

    A text of fewer words than a shingle has one shingle, all its words; one
    without words has none.
    """
    tokens = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    limit = F.lit(int(fraction * _TOP))

    def of_tokens(w: Column) -> Column:
        return F.transform(w, lambda x: F.xxhash64(x))

    def of_words(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(h) - words, F.lit(0)))
        # a place past the end is null and adds nothing to the hash
        shingles = F.transform(starts, lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(words))).bitwiseAND(F.lit(_TOP - 1)))
        return F.when(F.size(h) == 0, F.expr("cast(array() as array<bigint>)")).otherwise(shingles)

    def of_hashes(h: Column) -> Column:
        return F.struct(F.size(h).alias("shingles"), F.sort_array(F.array_distinct(F.filter(h, lambda x: x < limit))).alias("hashes"))

    # one-element arrays bind a value once for a whole expression
    hashed = F.transform(F.array(tokens), of_tokens)
    return F.transform(F.transform(hashed, of_words), of_hashes)[0]


def _estimate(a: Column, b: Column, all_of: Column) -> Column:
    """The share of hashes in both sketches among ``all_of``; without any of those, 1 if both texts are empty, else 0."""
    both = F.size(F.array_intersect(a["hashes"], b["hashes"]))
    neither = F.when((a["shingles"] == 0) & (b["shingles"] == 0), 1.0).otherwise(0.0)
    return F.coalesce(F.try_divide(both, all_of), neither).cast("double")


def similarity(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches; where neither holds a hash, 1 for two texts without words, else 0."""
    return _estimate(a, b, F.size(F.array_union(a["hashes"], b["hashes"])))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first sketch's shingles that the second has too; all, for a text without words."""
    return F.when(a["shingles"] == 0, 1.0).otherwise(_estimate(a, b, F.size(a["hashes"])))


def merge(a: Column, b: Column) -> Column:
    """The sketch of the union of two sketched sets; ``shingles`` then counts repeats."""
    return F.struct((a["shingles"] + b["shingles"]).alias("shingles"), F.sort_array(F.array_union(a["hashes"], b["hashes"])).alias("hashes"))


def as_text(s: Column) -> Column:
    """A sketch's hashes in base 64: the first six bytes of each, moved up by the bit that is always 0, so eight characters for a hash."""
    return F.base64(F.unhex(F.array_join(F.transform(s["hashes"], lambda h: F.substring(F.lpad(F.hex(F.shiftleft(h, 1)), 16, "0"), 1, 12)), "")))


def _place(key: Column, kind: str) -> Column:
    """What orders the keys: whole numbers as such, others as text."""
    return key.cast("bigint" if kind in ("tinyint", "smallint", "int", "bigint") else "string")


def _bounds(places: DataFrame, ranges: int, n: int) -> list:
    """Least places of all ranges but the first, so that each has as many of the ``n`` rows; null is no place. All bytes of a text count."""
    if ranges < 2:
        return []
    step = max(1, n // ranges)
    ordered = numbered_in_order(places.where("place IS NOT NULL"), "place")
    # as many rows as ranges
    found = [r.place for r in ordered.where((F.col("nth") > 0) & (F.col("nth") % step == 0)).select("place").distinct().collect()]
    discard(ordered)
    return sorted(found)


def _range(place: Column, bounds: list, kind: str) -> Column:
    """How many of the sorted ``bounds`` are at or below the place: a binary search in one constant array."""
    if not bounds:
        return F.lit(0)
    table = F.from_json(F.lit(json.dumps(bounds)), f"array<{kind}>")
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))))
    fits = lambda at, step: F.coalesce(F.get(table, at + step - 1) <= place, F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(fits(at, step), at + step).otherwise(at))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, fraction: float = FRACTION) -> DataFrame:
    """Per document: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text ends in as much of the next document's start as a quarter
    of its characters, in place of its own. A null text is empty. Rows without a
    key come last in order. Rows of one key stand next to each other, by text,
    in one range. A single document is its own next one. The key is a whole
    number, or a string in the order of its bytes. An empty table gives an empty
    result; other columns are ignored. Texts are read whole; a task holds the longest
    a few times, with eight bytes for each of its words. Documents are dealt out in ranges of the
    order, cut at quantiles of the whole keys, whose number grows with the table.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    place = _place(F.col("id"), kind)
    n = row_count(rows.select("id"))
    ranges = max(1, n // RANGE_ROWS)
    if ranges > SMALL_RANGES:
        ranges = max(SMALL_RANGES, (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES)
    places = rows.select(place.alias("place"))
    bounds = _bounds(places, ranges, n)
    # rows without a key: ranges of their own after the others, by a hash of their texts
    after = F.lit(len(bounds) + 1) + F.pmod(F.xxhash64("text"), F.lit(ranges)).cast("int")
    rows = rows.withColumn("range", F.when(place.isNull(), after).otherwise(_range(place, bounds, places.schema["place"].dataType.simpleString())))
    # the first text of each range: at most two rows for each range
    first = materialize(rows.groupBy("range").agg(F.min("id").alias("first")))
    at = F.broadcast(first.withColumnRenamed("range", "r"))
    heads = rows.join(at, (F.col("range") == F.col("r")) & F.col("id").eqNullSafe(F.col("first"))).groupBy("range").agg(F.min("text").alias("head"))
    ring = first.select("range", F.coalesce(F.lead("range").over(Window.orderBy("range")), F.min("range").over(Window.partitionBy())).alias("n_range"))
    heads = materialize(heads.withColumnRenamed("range", "n_range").join(ring, "n_range").select("range", "head"))
    own = Window.partitionBy("range").orderBy(F.asc_nulls_last("id"), "text")
    # sorted alike by the window: a merge join moves no document again
    rows = rows.withColumn("n_text", F.lead("text").over(own)).join(heads.hint("merge"), "range").withColumn("n_text", F.coalesce("n_text", "head"))
    return _against_next(rows, (words, fraction)).withColumnRenamed("id", key)


def _against_next(rows: DataFrame, options: tuple) -> DataFrame:
    """The result's columns for ``rows`` (id, text, n_text)."""
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    cut = F.expr("cast(n_chars div 4 as int)")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring("n_text", F.lit(1), cut)))
    rows = rows.withColumns({f"{x}_sketch": sketch(F.col(x), *options) for x in ("text", "edited", "n_text")})
    mine, edited = F.col("text_sketch"), F.col("edited_sketch")
    return rows.select(
        "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(mine).alias("fingerprint"), as_text(edited).alias("edited_fingerprint"),
        # equal texts are alike even where no hash of theirs is kept
        F.when(F.col("text") == F.col("edited"), 1.0).otherwise(similarity(mine, edited)).alias("near_edited"),
        F.when(F.col("text") == F.col("n_text"), 1.0).otherwise(similarity(mine, F.col("n_text_sketch"))).alias("near_next"),
    )
