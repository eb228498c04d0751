"""Terms met in texts, and the texts that meet most terms of each question, batch by batch inside a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are looked through at once, (row, question) counts that a task holds at once, and rows whose terms are looked up at once.
BYTES, PAIRS, ROWS = 1 << 20, 1 << 21, 1000

#: (rows, terms) of a column: places of the rows and of the terms met in them, each pair once.
Finder = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all spans, one span after the other."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum()) if len(counts) else np.zeros(0, np.int64)


def words_finder(terms: pa.Array) -> Finder:
    """Finds terms that are elements of a list column of distinct words."""

    def find(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        at = pc.index_in(column.flatten(), value_set=terms)
        met = pc.is_valid(at).to_numpy(zero_copy_only=False)
        return pc.list_parent_indices(column).to_numpy(zero_copy_only=False)[met].astype(np.int64), at.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)

    return find


def names_finder(terms: pa.Array) -> Finder:
    """Finds names in a text column: those of one word as words, those of several where their first one is a word of the text and all of the name stands in it."""
    names = terms.to_pylist()
    first = [n.split(" ")[0] for n in names]
    heads = sorted({h for h in first if h})
    code = {h: i for i, h in enumerate(heads)}
    at = np.array([code.get(h, -1) for h in first], np.int64)
    which = np.argsort(at, kind="stable")
    start = np.searchsorted(at[which], np.arange(len(heads) + 1))
    several = np.array([h != n for h, n in zip(first, names)], bool)
    heads = pa.array(heads, pa.string())

    def find(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(column, "")
        words = pc.split_pattern_regex(texts, "[\\x20\\x09-\\x0D]+")
        head = pc.index_in(words.flatten(), value_set=heads)
        met = pc.is_valid(head).to_numpy(zero_copy_only=False)
        row = pc.list_parent_indices(words).to_numpy(zero_copy_only=False)[met].astype(np.int64)
        n = max(1, len(heads))
        pair = np.unique(row * n + head.drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
        row, head = pair // n, pair % n
        counts = start[head + 1] - start[head]
        row, term = np.repeat(row, counts), which[spans(start[head], counts)]
        fits = np.ones(len(term), bool)
        for i in np.flatnonzero(several[term]):
            fits[i] = names[term[i]] in texts[int(row[i])].as_py()
        return row[fits], term[fits]

    return find


def _eights(data: np.ndarray) -> np.ndarray:
    """For each place the eight bytes from there on as a number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i : i + len(data)]
    return out


def _bits(code: np.ndarray) -> np.ndarray:
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)


def substring_finder(terms: pa.Array) -> Finder:
    """Finds terms that stand anywhere in a text column.

    A term is looked up by its first eight bytes, or by all of a shorter one; of a longer
    one the other bytes are compared where those stand.
    """
    names = [t.encode() for t in terms.to_pylist()]
    length = np.array([len(n) for n in names], np.int64)
    # each name as numbers of eight bytes, the last one filled up with zeros
    whole = [np.frombuffer(n + bytes(-len(n) % 8), ">u8").astype(np.uint64) for n in names]
    first = np.cumsum([0, *map(len, whole)])[:-1]
    chain = np.concatenate(whole) if whole else np.zeros(0, np.uint64)
    tables = []
    for size in range(1, 9):
        mine = np.flatnonzero(length == size if size < 8 else length >= 8)
        if len(mine):
            code = chain[first[mine]] >> np.uint64(64 - 8 * size)
            order = np.argsort(code, kind="stable")
            seen = np.zeros(1 << 18, bool)
            seen[_bits(code)] = True
            tables.append((size, code[order], mine[order], seen))

    def within(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        eight = _eights(data)
        ends = np.repeat(bounds[1:], np.diff(bounds))
        places, met = [], []
        for size, code, name, seen in tables:
            here = eight >> np.uint64(64 - 8 * size)
            at = np.flatnonzero(seen[_bits(here)])
            lo, hi = np.searchsorted(code, here[at], "left"), np.searchsorted(code, here[at], "right")
            which, at = name[spans(lo, hi - lo)], np.repeat(at, hi - lo)
            fits = at + length[which] <= ends[at]
            which, at = which[fits], at[fits]
            for step in range(8, int(length[which].max(initial=0)), 8):
                left = length[which] - step
                rest = np.flatnonzero(left > 0)
                over = (8 * (8 - np.clip(left[rest], 1, 8))).astype(np.uint64)
                same = np.ones(len(at), bool)
                same[rest] = (eight[at[rest] + step] >> over) == (chain[first[which[rest]] + step // 8] >> over)
                which, at = which[same], at[same]
            places.append(at)
            met.append(which)
        rows = np.searchsorted(bounds, np.concatenate(places or [np.zeros(0, np.int64)]), "right") - 1
        pair = np.unique(rows * max(1, len(names)) + np.concatenate(met or [np.zeros(0, np.int64)]))
        return pair // max(1, len(names)), pair % max(1, len(names))

    def find(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        column = pc.fill_null(column.cast(pa.large_string()), "")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
        rows, met, lo = [], [], 0
        while lo < len(column):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BYTES, "right")) - 1)
            r, t = within(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            rows.append(r + lo)
            met.append(t)
            lo = hi
        return (np.concatenate(rows), np.concatenate(met)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    return find


def pairs_of(find: Finder, terms: pa.Array, key: str):
    """(key, name) of every term met in the column ``_held``."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                row, term = find(part.column("_held"))
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(row)), terms.take(pa.array(term))], [key, "name"])

    return pairs


class _Best:
    """The first ``most`` rows of each question so far, by matches, document and place."""

    def __init__(self, questions: int, most: int):
        self.most, self.questions = most, questions
        self.kept = np.zeros((5, 0), np.int64)  # question, matches, document, place, row
        self.added, self.size = [], 0
        self.least = np.zeros((3, questions), np.int64)  # matches, document and place of the last kept row of a full list

    def add(self, question, n, document, place, row):
        self.added.append(np.array([question, n, document, place, row]))
        self.size += len(question)
        if self.size > max(4 * self.questions, self.kept.shape[1]):
            self.settle()

    def settle(self):
        every = np.concatenate([self.kept, *self.added], 1)
        every = every[:, np.lexsort((every[3], every[2], -every[1], every[0]))]
        start = np.searchsorted(every[0], np.arange(self.questions))
        nth = np.arange(every.shape[1]) - start[every[0]]
        self.kept = every[:, nth < self.most]
        last = every[:, nth == self.most - 1]
        self.least[:, last[0]] = last[1:4]
        self.added, self.size = [], 0


def _counted(row, term, first, asked, n: int, rows: int, least: np.ndarray):
    """Lots of (first row, cell, matches): cells row * n + question of matches that are at least one and ``least`` of the question.

    A lot is as many rows as have ``PAIRS`` cells and are met by ``PAIRS`` terms of questions at most, or one row. ``least`` may grow meanwhile.
    """
    counts = first[term + 1] - first[term]
    start = np.searchsorted(row, np.arange(rows + 1))
    met = np.concatenate([[0], np.cumsum(counts)])[start]
    lo = 0
    while lo < rows:
        hi = max(lo + 1, min(rows, lo + PAIRS // max(1, n), int(np.searchsorted(met, met[lo] + PAIRS, "right")) - 1))
        mine = slice(start[lo], start[hi])
        cell = np.repeat((row[mine] - lo) * n, counts[mine])
        cell += asked[spans(first[term[mine]], counts[mine])]
        matches = np.bincount(cell, minlength=(hi - lo) * n)
        cell = np.flatnonzero(matches.reshape(hi - lo, n) >= np.maximum(least, 1))
        yield lo, cell, matches[cell]
        lo = hi


def best_of(find: Finder, questions: pa.Array, first: np.ndarray, asked: np.ndarray, most: int):
    """(query_id, chunk_id, doc_id, chunk_index, n_matched): a task's own ``most`` rows of each question.

    ``asked[first[t]:first[t + 1]]`` are the questions that ask for term t.
    """
    n = len(questions)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, chunks, total = _Best(n, most), [], 0
        for part in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            row, term = find(part.column("_held"))
            order = np.argsort(row, kind="stable")
            row, term = row[order], term[order]
            document = pc.fill_null(part.column("doc_id").cast(pa.int64()), np.iinfo(np.int64).min).to_numpy()
            place = pc.fill_null(part.column("chunk_index").cast(pa.int64()), np.iinfo(np.int64).min).to_numpy()
            for lo, cell, matches in _counted(row, term, first, asked, n, part.num_rows, found.least[0]):
                q, r = cell % n, cell // n + lo
                least = found.least[:, q]
                better = (matches > least[0]) | (document[r] < least[1]) | ((document[r] == least[1]) & (place[r] < least[2]))
                q, r, c = q[better], r[better], matches[better]
                if not len(q):
                    continue
                used, at = np.unique(r, return_inverse=True)
                chunks.append(part.select(["chunk_id", "doc_id", "chunk_index"]).take(pa.array(used)))
                # before the next lot is counted, so that few of its pairs are still better
                found.add(q, c, document[r], place[r], at + total)
                total += len(used)
                if total > 2 * n * most + 100_000:  # rows that no list keeps any more go
                    found.settle()
                    used, at = np.unique(found.kept[4], return_inverse=True)
                    found.kept[4], total = at, len(used)
                    chunks = pa.Table.from_batches(chunks).take(pa.array(used)).combine_chunks().to_batches()
        if total:
            found.settle()
            q, c, r = found.kept[0], found.kept[1], found.kept[4]
            rows = pa.Table.from_batches(chunks).combine_chunks().take(pa.array(r))
            out = pa.table([questions.take(pa.array(q)), *rows.columns, pa.array(c, pa.int64())], ["query_id", *rows.column_names, "n_matched"])
            yield from out.combine_chunks().to_batches(max_chunksize=10_000)

    return best
