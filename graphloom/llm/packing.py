"""Packing documents into fixed-length sequences as a cutting-stock problem.

Every document's tokens are cut into full sequences and a remainder, which is
cut once more if longer than half a sequence. The
histogram of piece lengths, in classes of ``unit`` tokens, is a linear program
over patterns (how many pieces of each class a sequence holds). Columns are
generated: the duals price the classes and a knapsack dynamic program finds the
best new pattern. The rounded patterns are dealt to pieces ranked within their
class. The program's size depends on the sequence length only, not on the corpus.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize
from .words import Slice, text_slices

SEQUENCE = 2048
UNIT = 4
END_ID = 1
MAX_COLUMNS = 4000
#: The word store turns when it holds more words than this; a word takes about 200 bytes.
CACHE_WORDS = 200_000
#: Bytes of text encoded at once.
SLICE_BYTES = 1 << 21
#: Words encoded by one call.
LIST_WORDS = 2000
ROWS_PER_SALT = 20_000

#: UTF-8 bytes of the Unicode blanks beyond ASCII.
_TWO_BYTE_BLANKS = ((0xC2, 0x85), (0xC2, 0xA0))
_THREE_BYTE_BLANKS = (
    (0xE1, 0x9A, 0x80), *((0xE2, 0x80, b) for b in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0xE2, 0x81, 0x9F), (0xE3, 0x80, 0x80),
)

_BLANK, _LETTER, _DIGIT, _MARK = 1, 2, 3, 4
#: Kinds of bytes; 0 is anything that isn't surely of one of them.
_KINDS = np.zeros(256, np.uint8)
_KINDS[33:127] = _MARK
_KINDS[48:58] = _DIGIT
_KINDS[65:91] = _KINDS[97:123] = _LETTER
_KINDS[9:14] = _KINDS[32] = _BLANK


def _after_wide_blank(d: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a Unicode blank beyond ASCII ends before each position of valid UTF-8 bytes."""
    out = np.zeros(len(at), bool)
    wide = np.flatnonzero(d[at - 1] >= 0x80)
    a, b, c = (d[at[wide] - n] for n in (3, 2, 1))
    for y, z in _TWO_BYTE_BLANKS:
        out[wide] |= (b == y) & (c == z)
    for x, y, z in _THREE_BYTE_BLANKS:
        out[wide] |= (a == x) & (b == y) & (c == z)
    return out


class _Store:
    """Token ids of words, one after the other, and each word's place among them."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.ids, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(1 << 15, np.int64)

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        n = len(self.place)
        upto = self.ends[n - 1] if n else 0
        while upto + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(words) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[upto : upto + len(ids)] = ids
        self.ends[n : n + len(words)] = upto + np.cumsum(sizes)
        self.place.update(zip(words, range(n, n + len(words))))
        return np.arange(n, n + len(words))

    def find(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))

    def take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words at ``places``, and how many each has."""
        ends = self.ends[places]
        sizes = ends - np.where(places > 0, self.ends[places - 1], 0)
        total = np.cumsum(sizes)
        n = int(total[-1]) if len(total) else 0
        return self.ids[np.repeat(ends - total, sizes) + np.arange(n)], sizes


class WordEncoder:
    """A byte-level BPE tokenizer that encodes each word once while it is in use.

    Words met since the last turn of the store are in ``young``; at a turn it
    becomes ``old``, and a word met again moves back, so that frequent words stay.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(names.values()) + 1, np.int64)  # bytes of text that each id stands for
        for name, i in names.items():
            self.width[i] = len(name)
        for name in self.special:
            self.width[self.tokenizer.token_to_id(name)] = len(name.encode())
        self.young, self.old = _Store(), _Store()

    def __call__(self, words: list[str], widths: np.ndarray) -> tuple[_Store, np.ndarray]:
        """A store, and the places in it of all ``words``, whose lengths in bytes are ``widths``."""
        if len(self.young.place) > CACHE_WORDS:
            self.young, self.old = _Store(), self.young
        places = self.young.find(words)
        missing = np.flatnonzero(places < 0)
        before = self.old.find([words[i] for i in missing.tolist()])
        again = missing[before >= 0]
        places[again] = self.young.add([words[i] for i in again.tolist()], *self.old.take(before[before >= 0]))
        new = missing[before < 0]
        for lo in range(0, len(new), LIST_WORDS):
            at = new[lo : lo + LIST_WORDS]
            some = [words[i] for i in at.tolist()]
            # a list of words is encoded word by word into one row of ids; the ids' widths tell where each word ends
            ids = np.array(self.tokenizer.encode_batch_fast([some], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
            upto = np.cumsum(self.width[ids])
            ends = np.searchsorted(upto, np.cumsum(widths[at])) + 1
            if not np.array_equal(upto[ends - 1], np.cumsum(widths[at])):
                raise ValueError("not a byte-level tokenizer: its tokens don't cover the text")
            places[at] = self.young.add(some, ids, np.diff(ends, prepend=0))
        return self.young, places


@cache
def _encoder(path: str) -> WordEncoder:
    """The encoder of a file, once for each Python worker."""
    return WordEncoder(path)


def _word_starts(s: Slice, special: list[str]) -> np.ndarray:
    """Where the pre-tokenizer surely begins anew, whatever stands around.

    That is before a space after anything but a blank (its blanks are Unicode's:
    a run of them is never cut), and between an ASCII letter, digit or mark and
    one of another of these kinds, unless the first is an apostrophe. A special
    token's own name is never cut.
    """
    d = s.data
    kind = _KINDS[d]
    cut = np.zeros(len(d) + 1, bool)
    cut[1:-1] = (d[1:] == 32) & (kind[:-1] != _BLANK)
    spaces = np.flatnonzero(cut)
    cut[spaces[_after_wide_blank(d, spaces)]] = False
    cut[1:-1] |= (kind[1:] != kind[:-1]) & (kind[1:] > _BLANK) & (kind[:-1] > _BLANK) & (d[:-1] != 39)
    whole = d.tobytes()
    for name in special:
        at, name = -1, name.encode()
        while (at := whole.find(name, at + 1)) >= 0:
            cut[at + 1 : at + len(name)] = False
    cut[s.offsets[:-1][s.lengths() > 0]] = True
    cut[len(d)] = False
    return np.flatnonzero(cut)


def token_ids(column: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of texts: first row, all token ids, and each row's number of ids."""
    encoder = _encoder(path)
    for s in text_slices(column, SLICE_BYTES):
        starts = _word_starts(s, encoder.special)
        if not len(starts):
            yield s.first, np.zeros(0, np.uint32), np.zeros(s.rows, np.int64)
            continue
        bounds = np.append(starts, len(s.data))
        words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(s.data)]).dictionary_encode()
        names = words.dictionary
        store, places = encoder(names.to_pylist(), pc.binary_length(names).to_numpy())
        ids, sizes = store.take(places[words.indices.to_numpy()])
        upto = np.concatenate([[0], np.cumsum(sizes)])
        yield s.first, ids, np.diff(upto[np.searchsorted(starts, s.offsets)])


def cut_pieces(counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and length of all pieces of documents of ``counts`` ids: full sequences, then at most two halves."""
    full, rest = counts // length, counts % length
    halves = -(-rest // (length // 2))
    n = full + halves
    row = np.repeat(np.arange(len(counts)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = np.where(nth < full[row], nth * length, full[row] * length + (nth - full[row]) * (length // 2))
    last = np.ones(len(row), bool)
    last[:-1] = row[1:] != row[:-1]
    end = np.where(last, counts[row], np.append(start[1:], 0))
    return row, start, end - start


def _pieces(path: str, length: int, end_id: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, ids, counts in token_ids(batch.column("text"), path):
                own = np.insert(ids, np.cumsum(counts), end_id).astype("<u4", copy=False)
                counts = counts + 1
                row, start, size = cut_pieces(counts, length)
                ends = np.cumsum(size)
                view = memoryview(own).cast("B")
                crc = [zlib.crc32(view[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(first + row)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(counts[row])],
                    ["id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    return pieces


def _best_pattern(sizes: np.ndarray, price: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: an unbounded knapsack by dynamic programming over the capacity."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    fit = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c], choice[c] = best[c - 1], -1
        if fit[c]:
            value = best[c - sizes[: fit[c]]] + price[: fit[c]]
            i = int(value.argmax())
            if value[i] > best[c] + 1e-12:
                best[c], choice[c] = value[i], i
    pattern = np.zeros(len(sizes))
    c = capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[choice[c]] += 1
            c -= sizes[choice[c]]
    return best[capacity], pattern


def solve_patterns(demand: dict[int, int], capacity: int, max_columns: int = MAX_COLUMNS) -> list[tuple[int, dict[int, int]]]:
    """(times, {class: pieces}) covering the demand exactly, with few patterns in all.

    Revised simplex with generated columns down to a relative gap of 1e-4, or to
    ``max_columns`` columns; then the fractional rest by first-fit decreasing.
    """
    sizes = np.array(sorted(demand))
    need = np.array([demand[c] for c in sizes.tolist()], float)
    if not len(sizes):
        return []
    per = capacity // sizes
    basis = np.diag(per.astype(float))
    inverse = np.diag(1 / per)
    x = need / per
    for _ in range(max_columns):
        price = inverse.sum(0)
        value, column = _best_pattern(sizes, price, capacity)
        if value <= 1 + 1e-4:
            break
        u = inverse @ column
        ratio = np.where(u > 1e-9, x / np.where(u > 1e-9, u, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(x - step * u, 0)
        x[out] = step
        row = inverse[out] / u[out]
        inverse -= np.outer(u, row)
        inverse[out] = row
        basis[:, out] = column
    left = need.astype(np.int64)
    patterns: Counter = Counter()
    for j in np.argsort(-x, kind="stable"):
        times = int(x[j] + 1e-9)
        a = basis[:, j].astype(np.int64)
        if times and a.any():
            times = min(times, int((left[a > 0] // a[a > 0]).min()))
            left -= times * a
            patterns[tuple(a.tolist())] += times
    bins: list[tuple[int, Counter]] = []
    while left.any():  # the fullest sequence that the rest still allows, largest class first
        room, taken = capacity, Counter()
        for i in range(len(sizes) - 1, -1, -1):
            n = min(int(left[i]), room // int(sizes[i]))
            if n:
                taken[i] = n
                room -= n * int(sizes[i])
        times = min(int(left[i]) // n for i, n in taken.items())
        for i, n in taken.items():
            left[i] -= n * times
        bins.append((times, taken))
    out_list = [(t, {int(sizes[i]): n for i, n in enumerate(p) if n}) for p, t in patterns.items() if t]
    return out_list + [(t, {int(sizes[i]): n for i, n in b.items()}) for t, b in bins]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    key: str = "doc_id",
    text: str = "text",
    length: int = SEQUENCE,
    unit: int = UNIT,
    end_id: int = END_ID,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty and gives one piece, the end id. Rows repeated with
    their key are packed each on their own; a null key stays null. An empty
    table gives an empty result; other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()
    spark = docs.sparkSession
    base = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    schema = f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    pieces = materialize(base.mapInArrow(_pieces(tokenizer_path, length, end_id), schema).withColumn("class", F.ceil(F.col("length") / unit)))
    histogram = {r[0]: r[1] for r in pieces.groupBy("class").count().collect()}  # at most length / unit rows
    slots, base_id = [], 0
    used: Counter = Counter()
    for times, pattern in solve_patterns(histogram, length // unit):
        slot = 0
        for c in sorted(pattern, reverse=True):
            for _ in range(pattern[c]):
                slots.append((c, used[c], used[c] + times, base_id, slot))
                used[c] += times
                slot += 1
        base_id += times
    slots = spark.createDataFrame(slots, "slot_class bigint, low bigint, high bigint, first_sequence bigint, slot int")
    salts = max(8, sum(histogram.values()) // rows_per_salt)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "start"), F.lit(salts)))
    before = Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("class", "salt").agg(F.count(F.lit(1)).alias("n"))
    offsets = materialize(offsets.select("class", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    inside = Window.partitionBy("class", "salt").orderBy("id", "start")
    ranked = salted.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["class", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    # slots: patterns of the linear program, a few thousand rows at any corpus size
    dealt = ranked.join(F.broadcast(slots), (F.col("class") == F.col("slot_class")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    dealt = dealt.withColumn("sequence_id", F.col("first_sequence") + F.col("rank") - F.col("low"))
    filled = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.select(
        F.col("id").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(filled), F.lit(0)).alias("offset")
    )
