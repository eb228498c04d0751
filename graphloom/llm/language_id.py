"""Language identification with error-correcting output codes.

Each language has a codeword of bits. For every bit a binary n-gram classifier
(naive Bayes over hashed byte 2- and 3-grams of the lower-cased letters) tells
languages whose bit is 1 from those whose bit is 0. Decoding adds up a loss of
each bit's margin against each codeword, weighted by how far apart the two
sides of that bit are, and takes the language of the least loss; near ties are
flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .words import Slice, text_slices

BIGRAMS, TRIGRAMS = 2048, 8192
DIM = BIGRAMS + TRIGRAMS
EXHAUSTIVE = 6
RANDOM_BITS = 63
AMBIGUOUS = 0.6
UNKNOWN = "und"
#: Bytes and rows of text whose dense gram counts are held at once.
SLICE_BYTES, SLICE_ROWS = 1 << 18, 128
#: More learned languages than this mean that the labels are no languages.
MAX_LANGUAGES = 1000


def _grams(s: Slice) -> np.ndarray:
    """Relative frequencies of the hashed n-grams of each row's letters.

    Grams are counted for ``SLICE_BYTES`` places at a time, however long a text is.
    """
    d = s.data
    letter = ((d >= 97) & (d <= 122)) | (d >= 128)
    out = np.zeros((s.rows, DIM), np.float32)
    for n, size, base in ((2, BIGRAMS, 0), (3, TRIGRAMS, BIGRAMS)):
        counts = np.zeros((s.rows, size), np.int64)
        for lo in range(0, max(0, len(d) - n + 1), SLICE_BYTES):
            hi = min(lo + SLICE_BYTES, len(d) - n + 1)
            first, end = int(np.searchsorted(s.offsets, lo, "right")) - 1, int(np.searchsorted(s.offsets, hi + n - 1))
            sizes = np.minimum(s.offsets[first + 1 : end + 1], hi + n - 1) - np.maximum(s.offsets[first:end], lo)
            rows = np.repeat(np.arange(end - first), sizes)
            part = letter[lo : hi + n - 1]
            x = np.where(part, d[lo : hi + n - 1], 32).astype(np.uint32)
            code, some = x[: hi - lo].copy(), part[: hi - lo].copy()
            for i in range(1, n):
                code = code * np.uint32(257) + x[i : i + hi - lo]
                some |= part[i : i + hi - lo]
            bucket = (code * np.uint32(2654435761)) >> np.uint32(32 - int(size).bit_length() + 1)
            same = (rows[: hi - lo] == rows[n - 1 :]) & some
            flat = rows[: hi - lo][same] * size + bucket[same]
            last = int(rows[-1]) + 1
            counts[first : first + last] += np.bincount(flat, minlength=last * size).reshape(last, size)
        out[:, base : base + size] = counts / np.maximum(1, counts.sum(1, keepdims=True))
    return out


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for s in text_slices(batch.column("text"), SLICE_BYTES, SLICE_ROWS):
            grams = _grams(s)
            own = langs[s.first : s.first + s.rows]
            for lang in set(own.tolist()):
                mine = grams[own == lang]
                part = np.rint(mine * 1e6).astype(np.int64).sum(0)
                sums[lang] = sums.get(lang, 0) + part
                docs[lang] = docs.get(lang, 0) + len(mine)
    for lang, total in sums.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], docs[lang]), pa.int64())], ["lang", "bucket", "total"]
        )


def codewords(n: int) -> np.ndarray:
    """(n, bits) of 0 and 1: every split of few languages, else pseudo-random splits far apart."""
    if n < 2:
        return np.zeros((n, 0), int)
    if n <= EXHAUSTIVE:
        bits = np.arange(1, 1 << (n - 1))
        return np.array([(bits >> i) & 1 for i in range(n)])
    rng = np.random.Generator(np.random.PCG64(7))
    tried = [rng.integers(0, 2, (n, RANDOM_BITS)) for _ in range(50)]
    tried = [c for c in tried if (c.min(0) != c.max(0)).all()] or tried
    return max(tried, key=lambda c: min((c[i] != c[j]).sum() for i in range(n) for j in range(i)))


class LanguageModel:
    """Languages, their codewords and the bits' weights; small and independent of the corpus size."""

    def __init__(self, langs: list[str], profiles: np.ndarray):
        self.langs = langs
        self.code = codewords(len(langs))
        bits = self.code.shape[1]
        self.weights = np.zeros((DIM, bits), np.float32)
        self.middle, self.reach = np.zeros(bits), np.ones(bits)
        for b in range(bits):
            one = self.code[:, b] == 1
            w = np.log(profiles[one].mean(0) + 1e-5) - np.log(profiles[~one].mean(0) + 1e-5)
            margin = profiles @ w
            self.weights[:, b] = w
            self.middle[b] = (margin[one].min() + margin[~one].max()) / 2
            self.reach[b] = max(1e-6, (margin[one].min() - margin[~one].max()) / 2)
        self.trust = self.reach / self.reach.sum() if bits else self.reach

    def decode(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its score and whether it's ambiguous, for each row."""
        if not self.langs:
            n = len(grams)
            return np.full(n, -1), np.zeros(n), np.ones(n, bool)
        z = (grams @ self.weights - self.middle) / self.reach
        sign = 2.0 * self.code - 1
        loss = np.zeros((len(z), len(self.langs)))
        for k in range(len(self.langs)):
            loss[:, k] = np.logaddexp(0, -2 * sign[k] * z) @ self.trust
        best = loss.argmin(1)
        p = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
        score = 1 / p.sum(1)
        return best, score, score < AMBIGUOUS


def train(docs: DataFrame, lang: str = "lang", text: str = "text") -> LanguageModel:
    """Fit on all given rows with a language and a text: sums per language and bucket reach the driver.

    More than ``MAX_LANGUAGES`` languages are an error.
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.lower(F.col(text).cast("string")).alias("text")).where("lang is not null and text is not null")
    totals = rows.mapInArrow(_profiles, "lang string, bucket int, total bigint").groupBy("lang", "bucket").agg(F.sum("total").alias("total"))
    totals = materialize(totals)
    if totals.where("bucket < 0").limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in column {lang}")
    got = totals.toPandas()
    discard(totals)
    counts = got[got.bucket < 0].set_index("lang").total.sort_index()
    profiles = np.zeros((len(counts), DIM))
    place = {x: i for i, x in enumerate(counts.index)}
    got = got[got.bucket >= 0]
    profiles[got.lang.map(place).to_numpy(int), got.bucket.to_numpy(int)] = got.total / 1e6
    profiles /= np.maximum(1, counts.to_numpy())[:, None]
    return LanguageModel(list(counts.index), profiles)


def _predict(model: LanguageModel):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.langs, UNKNOWN], object)
        for batch in batches:
            letters = batch.column("letters").fill_null(False).to_numpy(zero_copy_only=False)
            for s in text_slices(batch.column("text"), SLICE_BYTES, SLICE_ROWS):
                best, score, vague = model.decode(_grams(s))
                known = letters[s.first : s.first + s.rows]
                best = np.where(known, best, -1)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(s.first, s.rows) for c in batch.schema.names if c not in ("text", "letters")),
                        pa.array(names[best].tolist(), pa.string()),
                        pa.array(np.where(best >= 0, score, 0.0)),
                        pa.array(np.where(best >= 0, vague, True)),
                    ],
                    [*(c for c in batch.schema.names if c not in ("text", "letters")), "lang_pred", "score", "ambiguous"],
                )

    return predict


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, lang_pred, score, ambiguous.

    A null text, or one without a letter, is ``und`` with score 0; so is every
    row if the model has learned no language. A null key stays null. Texts are
    read whole, however long; of equal losses the first language in order wins.
    An empty table gives an empty result; other columns are ignored; repeated
    rows give repeated results.
    """
    kind = docs.schema[key].dataType.simpleString()
    x = F.col(text).cast("string")
    rows = docs.select(F.col(key).alias("id"), F.lower(x).alias("text"), F.coalesce(x.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(_predict(model), f"id {kind}, lang_pred string, score double, ambiguous boolean").withColumnRenamed("id", key)


def keep_identified(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows, with their columns, whose language is known and not ambiguous; a row without an id is judged like others."""
    columns = docs.columns
    whole = docs.select(F.struct(*columns).alias("row"), F.col(text).alias("_text"))
    told = identify(whole, model, "row", "_text").where((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous"))
    return told.select(*(F.col("row")[c].alias(c) for c in columns))


def fold(key: str = "doc_id") -> F.Column:
    """True for rows that are held out of learning: crc32 of the key as text, modulo 3, is 1; false for a null key."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
