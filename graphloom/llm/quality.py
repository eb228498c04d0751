"""Quality classifier: naive Bayes support vectors.

Indicators of n-grams (hashed byte trigrams and bigrams of word shapes) are
scaled by the classes' log-count ratios; on them a linear model with hinge loss
is fitted by dual coordinate descent, on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Slice, Words, find_words, part_sum, text_slices, word_hash

DIM = 1 << 14
SHAPES = 1 << 12
#: At most about this many labelled rows of each class are learned from.
SAMPLE_PER_CLASS = 3000
COST = 1.0
EPOCHS = 25
STEEPNESS = 3.0
#: Bytes and rows of text whose dense indicators are held at once.
SLICE_BYTES, SLICE_ROWS = 1 << 18, 128
#: Bytes of a longer text that are looked at at once.
LONG = 1 << 20


def _trigrams(d: np.ndarray) -> np.ndarray:
    """The bucket of each run of three bytes."""
    x = d.astype(np.uint32)
    code = ((x[:-2] * np.uint32(257) + x[1:-1]) * np.uint32(257) + x[2:]) * np.uint32(2654435761)
    return (code >> np.uint32(18)).astype(np.int64)


def _shape(size, upper, plain, digit):
    """A word's shape, told from how many of its bytes are upper-case, plain or digits."""
    marks = size - upper - plain - digit
    return (upper > 1) + 2 * (digit > 0) + 4 * np.minimum(marks, 3) + 16 * (plain > 0) + 32 * (size > 12)


def _kinds(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (d >= 65) & (d <= 90), ((d >= 97) & (d <= 122)) | (d >= 128), (d >= 48) & (d <= 57)


def _shapes(w: Words) -> np.ndarray:
    def of(kind: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kind)])
        return total[w.ends] - total[w.starts]

    return _shape(w.ends - w.starts, *map(of, _kinds(w.data)))


def _grams(shape: np.ndarray, k: int) -> np.ndarray:
    """The bucket of each run of ``k`` + 1 shapes."""
    n = len(shape) - k
    code = shape[:n].astype(np.uint32)
    for i in range(1, k + 1):
        code = code * np.uint32(131) + shape[i : n + i].astype(np.uint32)
    return ((code + np.uint32(k * 7919)) * np.uint32(2654435761) >> np.uint32(20)).astype(np.int64)


def _shares(counts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and buckets of the share of words of each shape, by eighths."""
    share = np.ceil(8 * counts / np.maximum(1, words)[:, None]).astype(np.int64)
    row, kind = np.nonzero(counts)
    code = (kind * 9 + share[row, kind] + 50021).astype(np.uint32) * np.uint32(2654435761)
    return row, (code >> np.uint32(20)).astype(np.int64)


def _indicators(s: Slice) -> np.ndarray:
    """Which hashed n-grams each row has: trigrams of bytes, and 1- to 3-grams of word shapes by share."""
    if s.rows == 1 and len(s.data) > LONG:
        return _long_indicators(s.data)
    d, n = s.data, s.rows
    mark = np.zeros((n, DIM + SHAPES), bool)
    if not len(d):
        return mark
    doc = np.repeat(np.arange(n, dtype=np.int64), s.lengths())
    if len(d) >= 3:
        same = doc[:-2] == doc[2:]
        mark[doc[:-2][same], _trigrams(d)[same]] = True
    w = find_words(s)
    if not len(w.starts):
        return mark
    h = w.hashes()
    again = np.zeros(len(h), bool)
    order = np.lexsort((h, w.doc))
    again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (w.doc[order[1:]] == w.doc[order[:-1]])
    shape = _shapes(w) + 64 * again
    for k in range(min(3, len(shape))):
        same = w.doc[: len(shape) - k] == w.doc[k:]
        mark[w.doc[: len(shape) - k][same], DIM + _grams(shape, k)[same]] = True
    row, bucket = _shares(np.bincount(w.doc * 128 + shape, minlength=n * 128).reshape(n, 128), w.counts)
    mark[row, DIM + bucket] = True
    return mark


def _pieces(d: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and shapes of a long text's words, ``LONG`` bytes at a time; a longer word is a piece of its own."""
    lo = 0
    while lo < len(d):
        hi = min(len(d), lo + LONG)
        blank = (d[lo:hi] == 32) | ((d[lo:hi] >= 9) & (d[lo:hi] <= 13))
        cut = np.flatnonzero(blank)
        if hi == len(d) or len(cut):
            hi = hi if hi == len(d) else lo + int(cut[-1]) + 1
            w = find_words(Slice(0, 1, d[lo:hi], np.array([0, hi - lo])))
            yield w.hashes(), _shapes(w)
        else:
            size, total, raw = 0, np.zeros(3, np.int64), 0
            while lo + size < len(d):
                part = d[lo + size : lo + size + LONG]
                end = np.flatnonzero((part == 32) | ((part >= 9) & (part <= 13)))
                part = part[: end[0]] if len(end) else part
                total += [int(k.sum()) for k in _kinds(part)]
                raw += part_sum(part, size)
                size += len(part)
                if len(end):
                    break
            yield np.array([word_hash(raw, size)], np.uint64), np.array([_shape(size, *total.tolist())], np.int64)
            hi = lo + size
        lo = hi


def _long_indicators(d: np.ndarray) -> np.ndarray:
    """The indicators of one long text, piece by piece: the same as of the whole, in memory of a few bytes for each of its different words."""
    mark = np.zeros((1, DIM + SHAPES), bool)
    for lo in range(0, len(d) - 2, LONG):
        mark[0, _trigrams(d[lo : lo + LONG + 2])] = True
    seen: list[np.ndarray] = []  # sorted, each at least twice as long as the next
    before = np.zeros(0, np.int64)
    counts = np.zeros((1, 128), np.int64)
    for h, shape in _pieces(d):
        if not len(h):
            continue
        new, first, place = np.unique(h, return_index=True, return_inverse=True)
        known = np.zeros(len(new), bool)
        for old in seen:
            known |= old[np.minimum(np.searchsorted(old, new), len(old) - 1)] == new
        again = np.ones(len(h), bool)
        again[first] = False
        shape = shape + 64 * (again | known[place])
        new = new[~known]
        while seen and len(new) and len(seen[-1]) < 2 * len(new):
            new = np.sort(np.concatenate([seen.pop(), new]))
        if len(new):
            seen.append(new)
        counts[0] += np.bincount(shape, minlength=128)
        run = np.concatenate([before, shape])
        for k in range(min(3, len(run))):
            mark[0, DIM + _grams(run, k)] = True
        before = run[-2:]
    mark[0, DIM + _shares(counts, counts.sum(1))[1]] = True
    return mark


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in text_slices(batch.column("text"), SLICE_BYTES, SLICE_ROWS):
            row, at = np.nonzero(_indicators(s))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(s.rows + 1)), pa.int32()), pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(s.first, s.rows), batch.column("y").slice(s.first, s.rows), lists], ["id", "y", "at"])


class QualityModel:
    """Weights over indicators and a bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias

    def score(self, mark: np.ndarray) -> np.ndarray:
        z = mark.astype(np.float32)
        norm = np.sqrt(np.maximum(1e-9, z @ self.squares))
        return 1 / (1 + np.exp(-STEEPNESS * ((z @ self.weights) / norm + self.bias)))


def fit(rows: list[np.ndarray], y: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> QualityModel:
    """Log-count ratios of the indicators, then the hinge-loss dual by coordinate descent.

    Rows are scaled to unit length; both classes have the same total cost.
    Without rows of both classes every score is the class seen, or a half.
    """
    size = DIM + SHAPES
    count = np.ones((2, size))
    for x, c in zip(rows, y):
        count[int(c), x] += 1
    has = np.bincount(y.astype(int), minlength=2)
    if not has.all():
        model = QualityModel(np.zeros(size), float(np.sign(has[1] - has[0])))
        model.squares = np.zeros(size, np.float32)
        return model
    p = count / (has[:, None] + 2)
    ratio = np.log(p[1] / p[0])
    target = np.where(y > 0, 1.0, -1.0)
    bound = cost * len(y) / (2 * has[y.astype(int)])
    w, b = np.zeros(size), 0.0
    alpha = np.zeros(len(y))
    scaled = [ratio[x] / max(1e-9, float(np.sqrt((ratio[x] ** 2).sum()))) for x in rows]
    rng = np.random.Generator(np.random.PCG64(11))
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            x, v = rows[i], scaled[i]
            gradient = target[i] * (w[x] @ v + b) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), bound[i])
            step = (new - alpha[i]) * target[i]
            if step:
                alpha[i] = new
                w[x] += step * v
                b += step
    model = QualityModel(w * ratio, b)
    model.squares = (ratio**2).astype(np.float32)
    return model


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> QualityModel:
    """Fit on a sample by the key's hash of about ``per_class`` labelled rows of each class."""
    return train_joined(labelled.select(key, text), labelled.select(key, label), key, text, label, per_class)


def train_joined(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> QualityModel:
    """As :func:`train`, with texts and labels (one row for each key) in two tables."""
    labels = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    counts = {r[0]: r[1] for r in labels.groupBy("y").count().collect()}
    share = F.when(F.col("y") == 1, per_class / max(1, counts.get(1, 0))).otherwise(per_class / max(1, counts.get(0, 0)))
    chosen = labels.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) < share * (1 << 20)).dropDuplicates(["id"])
    # the sample is bounded by twice per_class, about; only its texts are read on
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "id").select("id", "text", "y")
    got = rows.mapInArrow(_features, f"id {rows.schema['id'].dataType.simpleString()}, y int, at array<int>").toArrow().sort_by("id")
    at = [np.asarray(x, np.int64) for x in got.column("at").to_numpy()] if got.num_rows else []
    return fit(at, got.column("y").to_numpy().astype(float) if got.num_rows else np.zeros(0))


def _score(model: QualityModel):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in text_slices(batch.column("text"), SLICE_BYTES, SLICE_ROWS):
                p = model.score(_indicators(s)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(s.first, s.rows), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    return score


def classify(docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, score (0 to 1) and predicted (score at least a half).

    Null and empty texts have no indicators and the score of the bias alone. A
    null key stays null. Texts are read whole, long ones a megabyte at a time; a
    task's memory grows with the different words of its longest text. An empty table gives an empty
    result; other columns are ignored; repeated rows give repeated results.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_score(model), f"id {kind}, score double, predicted int").withColumnRenamed("id", key)
