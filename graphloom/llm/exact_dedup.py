"""Exact deduplication by deterministic block naming.

Every text is cut into blocks of a fixed size. Equal blocks get one integer
name, different blocks different names; then adjacent pairs of names are named
in the same way, level by level, until each document has a single name. Names
stand for equality of the content itself, so two documents have equal
identities exactly when their texts are equal: no hash can collide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

BLOCK_BYTES = 4096


def _cut(block: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text").cast(pa.large_binary()).fill_null(b"")
            if not len(text):
                continue
            _, offsets, data = text.buffers()
            offsets = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
            size = np.diff(offsets)
            n = np.maximum(1, -(-size // block))
            doc = np.repeat(np.arange(len(n)), n)
            index = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            ends = np.minimum(offsets[doc] + (index + 1) * block, offsets[doc + 1])
            cuts = np.concatenate([offsets[:1], ends])
            blocks = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(cuts.tobytes()), data])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_key").take(pa.array(doc)), pa.array(index, pa.int64()), pa.array(n[doc], pa.int64()), blocks.cast(pa.binary())],
                ["row_key", "idx", "n", "block"],
            )

    return cut


def _name(parts: DataFrame, key: list[str]) -> DataFrame:
    """Parts with ``name``: an integer for each distinct key, in sorted order within a partition of them.

    The names are written before use: a task that runs again can't number anew.
    """
    names = parts.select(*key).distinct().sortWithinPartitions(*key).withColumn("name", F.monotonically_increasing_id())
    names = materialize(names)
    out = materialize(parts.join(names, key).select("row_key", "idx", "n", "name"))
    discard(names)
    return out


def block_identities(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row_key, n, name): equal (n, name) exactly for equal texts; null counts as empty.

    ``n`` is the number of blocks. A text of any length takes about log2(n)
    rounds, in which only documents of more than one block take part.
    """
    schema = f"row_key {docs.schema[key].dataType.simpleString()}, idx bigint, n bigint, block binary"
    blocks = docs.select(F.col(key).alias("row_key"), F.col(text).cast("string").alias("text")).mapInArrow(_cut(block_bytes), schema)
    level = _name(blocks, ["block"])
    done = [level.where("n = 1").select("row_key", "n", "name")]
    width = 1
    longest = level.agg(F.max("n")).first()[0] or 1
    level = level.where("n > 1").distinct()
    while width < longest:
        # a document's whole text is one pair deep when two names are left
        left = level.where("idx % 2 = 0").select("row_key", F.expr("idx div 2").alias("idx"), "n", F.col("name").alias("a"))
        right = level.where("idx % 2 = 1").select(F.col("row_key").alias("k"), F.expr("idx div 2").alias("i"), F.col("name").alias("b"))
        pairs = left.join(right, (F.col("row_key") == F.col("k")) & (F.col("idx") == F.col("i")), "left")
        pairs = materialize(pairs.select("row_key", "idx", "n", "a", F.coalesce("b", F.lit(-1)).alias("b")))
        level = _name(pairs, ["a", "b"])
        discard(pairs)
        width *= 2
        done.append(level.where((F.col("n") <= width) & (F.col("n") > width // 2)).select("row_key", "n", "name"))
        level = level.where(F.col("n") > width)
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row_key, id, text, text_sha256): a row's own key is its id and its text's digest, so that an id may stand on several texts."""
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("text_sha256", F.sha2("text", 256))
    name = F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("")).cast("binary")
    return rows.withColumn("row_key", F.concat(F.unhex("text_sha256"), name))


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row: key, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal texts (null counts as empty, nothing else is normalised) the one
    with the largest key stays. ``group_size`` counts rows. Rows repeated with
    key and text all stay or all go. Rows without a key count too and go if a
    row of their text has a key; else nothing tells them apart and all stay,
    with a null ``keep_id``. An empty table gives an empty result; other columns
    are ignored. The group's size and keeper are partial aggregates, and the
    join back to the members can be split, so that a hot text is no hot task.
    """
    docs = _keyed(docs, key, text)
    named = materialize(block_identities(docs, "row_key", "text", block_bytes).distinct())
    rows = materialize(docs.select("row_key", "id", "text_sha256").join(named, "row_key").drop("row_key"))
    discard(named)
    groups = materialize(rows.groupBy("n", "name").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    kept = F.col("id").eqNullSafe(F.col("keep_id"))
    return rows.join(groups, ["n", "name"]).select(F.col("id").alias(key), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with their columns."""
    kept = exact_duplicates(docs, key, text).where("kept").select(F.col(key).alias("_kept"), F.col("text_sha256").alias("_sha256")).distinct()
    # ids grow with the documents: the same join at every size
    kept = materialize(kept).hint("merge")
    own = F.sha2(F.coalesce(docs[text].cast("string"), F.lit("")), 256)
    return docs.join(kept, docs[key].eqNullSafe(kept["_kept"]) & (own == kept["_sha256"]), "left_semi")
