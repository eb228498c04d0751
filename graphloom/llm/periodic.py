"""Periodic runs of words, found by heavy/light counting of lags.

A lag ``q`` of a text has a match where two words ``q`` apart are the same. A
run of period ``q`` is an island of neighbouring matches, so a lag can hold a
run only if it has enough matches. They are counted for all lags at once:
frequent words by an exact FFT autocorrelation of where they stand, rare ones by
the differences of their positions. Only lags with enough matches get a scan for
islands; matches that a run of a shorter period explains no longer count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least this many words, and at least twice its period.
LEAST = 12
#: Pairs of positions whose differences are held at once.
PAIRS = 1 << 20
#: Places of the least island that a scan looks at first.
PROBES = 16
#: Bytes of kept text that a task hands on at once.
OUT_BYTES = 1 << 22

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def word_numbers(words: list) -> np.ndarray:
    """Each word's number; the same words have the same."""
    place = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(place.__getitem__, words), np.int32, len(words))


def lag_matches(ids: np.ndarray) -> np.ndarray:
    """How many pairs of the same words stand ``q`` apart, for each lag q up to half of the text (0 for lag 0).

    A word is frequent if its pairs are more than the steps of a transform, so
    work is at most about n ** 1.5 for n words, whatever the words are.
    """
    n = len(ids)
    total = np.zeros(n // 2 + 1, np.int64)
    if n < 2:
        return total
    count = np.bincount(ids)
    heavy = count * (count - 1) > n * np.log2(n)
    if heavy.any():
        size = 1 << (2 * n - 1).bit_length()
        power = np.zeros(size // 2 + 1)
        for w in np.flatnonzero(heavy):
            f = np.fft.rfft(ids == w, size)
            power += f.real**2 + f.imag**2
        auto = np.fft.irfft(power, size)[: len(total)]
        total += np.rint(auto).astype(np.int64)
    order = np.argsort(ids, kind="stable")
    order = order[~heavy[ids[order]] & (count[ids[order]] > 1)]
    if len(order):
        mine = ids[order]
        first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
        earlier = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
        ends = np.cumsum(earlier)
        lo = 0
        while lo < len(order):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
            k = earlier[lo:hi]
            later = np.repeat(np.arange(lo, hi), k)
            back = np.arange(len(later)) - np.repeat(np.cumsum(k) - k, k) + 1
            lags = order[later] - order[later - back]
            lags = lags[lags < len(total)]
            total += np.bincount(lags, minlength=len(total))
            lo = hi
    total[0] = 0
    return total


def _streaks(hit: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of stretches of at least ``least`` true values."""
    step = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    starts = np.flatnonzero(step == 1)
    sizes = np.flatnonzero(step == -1) - starts
    long = sizes >= least
    return starts[long], sizes[long]


def islands(ids: np.ndarray, q: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of all stretches of at least ``least`` matches of lag ``q``.

    An island covers ``least // step`` neighbouring multiples of any step. Those are looked at first; the lag is read whole only where so many match.
    """
    step = max(1, least // PROBES)
    if step > 1 and not len(_streaks(ids[: len(ids) - q : step] == ids[q::step], least // step)[0]):
        none = np.zeros(0, np.int64)
        return none, none
    return _streaks(ids[:-q] == ids[q:], least)


def find_runs(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs by their smallest period, sorted by start, then period.

    A run of period d of at least 2q words is, for each multiple q of d, the whole island of lag q. So its matches are
    taken off what lag q has left to explain, and a run that a multiple finds again is known by its place.
    """
    n = len(ids)
    left = lag_matches(ids)
    lags = np.arange(len(left))
    seen: dict[tuple[int, int], int] = {}
    for q in np.flatnonzero((left >= np.maximum(lags, least - lags)) & (lags > 0)).tolist():
        want = max(q, least - q)
        if left[q] < want or n <= q:
            continue
        for start, matches in zip(*(x.tolist() for x in islands(ids, q, want))):
            place = start, matches + q
            if place not in seen:
                seen[place] = q
                multiples = lags[2 * q : place[1] // 2 + 1 : q]
                left[multiples] -= place[1] - multiples
    return sorted((start, length, q) for (start, length), q in seen.items())


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """For each of ``n`` words, whether a run holds it after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        depth[start + q] += 1
        depth[start + length] -= 1
    return np.cumsum(depth)[:n] > 0


def _collapse(least: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, first, size = batch.column("text"), 0, 0
            counts: list[int] = []
            found: list[list[dict]] = []
            kept: list[str] = []
            for i in range(len(batch)):
                # bytes are split at 0x20 and 0x09 to 0x0D, and nowhere else
                words = (texts[i].as_py() or "").encode().split()
                runs = find_runs(word_numbers(words), least) if len(words) >= least else []
                if runs:
                    gone = dropped(len(words), runs)
                    rest = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                else:
                    rest = b" ".join(words)
                counts.append(len(words))
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                kept.append(rest.decode())
                size += len(rest)
                if size >= OUT_BYTES or i == len(batch) - 1:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").slice(first, len(counts)), pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(kept, pa.string())],
                        ["id", "n_words", "runs", "kept"],
                    )
                    counts, found, kept, first, size = [], [], [], i + 1, 0

    return collapse


def collapse_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """Per row: key, n_words, runs, kept (the words left, joined by one space).

    A run is a stretch of at least ``least`` words and two periods that no
    neighbouring word extends; words are numbered from 0, periods are the
    smallest, and runs are sorted by start, then period, so that none tie. A word
    goes if any run holds it after that run's first period. Texts are read whole:
    a task's memory is about twenty times its longest text's bytes, and work on n
    words at most about n ** 1.5. A null or empty text has no words and no runs. A
    null key stays null; repeated rows give repeated results; an empty table gives
    an empty result; other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_collapse(least), f"id {kind}, n_words bigint, runs {RUNS}, kept string").withColumnRenamed("id", key)
