"""Texts as vectors: what of a chunk is embedded and stored, and signed feature hashing as the embedding.

:func:`embed` is the one place where texts become vectors; a model takes the hashing's
place there by a function of the same form.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What stands between a chunk's title, context and text, and the most characters stored.
SEPARATOR = "\n---\n"
STORED = 10_000
#: Numbers of a hashed vector.
SIZE = 64


def _joined(*parts: Column) -> Column:
    return F.concat_ws(SEPARATOR, *(F.nullif(p, F.lit("")) for p in parts[:-1]), F.coalesce(parts[-1], F.lit("")))


def embedding_text(title: Column, context: Column, text: Column) -> Column:
    """What is embedded of a chunk: its document's title, its context and its text; null or empty ones before the text are left out."""
    return _joined(title, context, text)


def stored_text(context: Column, text: Column) -> Column:
    """What is stored of a chunk: context and text, cut to ``STORED`` characters; the title is for the embedding only."""
    return F.left(_joined(context, text), F.lit(STORED))


def plain_words(text: Column) -> Column:
    """The words of a text, lower-cased: runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def word_code(word: str) -> int:
    """The hash of a word: its place is the remainder by the vector's size, its sign what is over."""
    return int(hashlib.md5(word.encode()).hexdigest()[:7], 16)


def _hashed(size: int):
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pc.fill_null(batch.column("_words"), [])
            row = pc.list_parent_indices(words).to_numpy()
            each = words.flatten().dictionary_encode()
            codes = np.array([word_code(w) for w in each.dictionary.to_pylist()], np.int64)[each.indices.to_numpy()] if len(each) else np.zeros(0, np.int64)
            sign = 1.0 - 2.0 * (codes // size % 2)
            sums = np.bincount(row * size + codes % size, sign, batch.num_rows * size).astype(np.float32)
            offsets = pa.array(np.arange(0, (batch.num_rows + 1) * size, size, dtype=np.int32))
            vector = pa.ListArray.from_arrays(offsets, pa.array(sums, pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["_words"]).columns, vector], [*(n for n in batch.schema.names if n != "_words"), "embedding"])

    return vectors


def hashed(df: DataFrame, keys: list[str], text: str, size: int = SIZE) -> DataFrame:
    """(keys, embedding): each word adds 1 or -1 to the place that its hash names.

    Rows stay where they are; a batch hashes each of its different words once. A
    null text, or one without a word, is the zero vector, which means no embedding.
    """
    rows = df.select(*keys, plain_words(F.col(text)).alias("_words"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_words"), "embedding array<float>"])
    return rows.mapInArrow(_hashed(size), schema)


def embed(df: DataFrame, keys: list[str], text: str, embedder: Callable[[DataFrame, list[str], str], DataFrame] = hashed) -> DataFrame:
    """(keys, embedding) of the texts by the given function, whose vectors must all have one size."""
    return embedder(df, keys, text)
