"""Vectorised words and shingles of Arrow text batches, for use inside tasks.

A word is ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes. Work goes over slices of
a few megabytes, whole documents each, so that memory is bounded by the slice
or by the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SLICE_ROWS = 10_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd base and of its inverse, modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        tables = []
        for x in (base, inverse):
            t = np.full(size, x, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        have = _powers[int(base)] = (tables[0], tables[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Slice:
    """Some rows' texts: bytes, and where each row's begins and ends."""

    first: int
    rows: int
    data: np.ndarray
    offsets: np.ndarray

    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    counts: np.ndarray
    data: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same wherever the word stands."""
        n = len(self.data)
        power, inverse = _power_tables(_BASE, n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        h = (total[self.ends] - total[self.starts]) * inverse[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64) * _STEP)


def part_sum(part: np.ndarray, at: int) -> int:
    """What the bytes from place ``at`` of a word add to the sum that its hash is made from."""
    power, _ = _power_tables(_BASE, len(part) + 1)
    return int(((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)]).sum()) * pow(int(_BASE), at, 1 << 64)


def word_hash(total: int, size: int) -> int:
    """The hash of a word, as :meth:`Words.hashes` gives it, from the sum of its parts."""
    return int(mix(np.array([(total + size * int(_STEP)) % (1 << 64)], np.uint64))[0])


def text_slices(column: pa.Array, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[Slice]:
    """The texts of an Arrow column (null: empty) in slices of about ``limit`` bytes and at most ``rows`` rows."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1))
        yield Slice(lo, hi - lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def find_words(s: Slice) -> Words:
    d = s.data
    inside = ~((d == 32) | ((d >= 9) & (d <= 13)))
    edge = np.zeros(len(d) + 1, bool)
    edge[s.offsets] = True
    before = np.empty(len(d) + 1, bool)
    before[0] = False
    before[1:] = inside
    starts = np.flatnonzero(inside & (~before[:-1] | edge[:-1]))
    after = np.empty(len(d) + 1, bool)
    after[-1] = False
    after[:-1] = inside
    ends = np.flatnonzero(inside & (~after[1:] | edge[1:])) + 1
    bounds = np.searchsorted(starts, s.offsets)
    counts = np.diff(bounds)
    return Words(starts, ends, np.repeat(np.arange(s.rows), counts), counts, d)


def windows(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, and whether each lies within one document."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    power, inverse = _power_tables(_STEP, len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[: len(h)], out=total[1:])
    return mix((total[k:] - total[:-k]) * inverse[:n]), doc[:n] == doc[k - 1 :]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours, by doubling."""
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def shingle_sets(h: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of ``k``-word shingles of each document, and how many each has.

    A document of 1 to k-1 words has one shingle, all its words; one without words none.
    """
    doc = np.repeat(np.arange(len(counts)), counts)
    w, valid = windows(h, doc, k)
    value, owner = w[valid], doc[: len(w)][valid]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.concatenate([[0], np.cumsum(counts)])[short]
        extra = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            has = counts[short] > i
            extra[has] = mix(extra[has] * _STEP + h[first[has] + i])
        value, owner = np.concatenate([value, extra]), np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.bincount(owner[new], minlength=len(counts))


def spans_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run, given the runs' lengths."""
    ends = np.cumsum(counts)
    return ends - counts, ends


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
