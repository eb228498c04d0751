"""Substring deduplication on a De Bruijn graph of token k-mers.

Windows of ``k`` words are edges between their first and last ``k - 1`` words.
Only repeated windows enter the graph. A window's canonical source is its first
occurrence in the document with the least id; runs of edges with consecutive
sources and no branching node between them compact into paths, and a document
that meets a path holds a long repeated span, given by source coordinates.

Cost: windows that repeat share the least of the short word runs inside them,
so a sample of about one short run in five windows finds the regions that may
repeat at all. Only the windows of those regions are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize
from .words import find_words, sliding_min, text_slices, windows

K = 13
SEED_WORDS = 4


def _seeds(h: np.ndarray, doc: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of k words the least hash of the m-word runs in it, and whether the window counts."""
    _, valid = windows(h, doc, k)
    short, _ = windows(h, doc, m)
    return sliding_min(short, k - m + 1)[: len(valid)], valid


def _sample(k: int, m: int):
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in text_slices(batch.column("text")):
                words = find_words(s)
                if len(words.starts) < k:
                    continue
                seed, valid = _seeds(words.hashes(), words.doc, k, m)
                seed, owner = seed[valid], words.doc[: len(valid)][valid]
                if not len(seed):
                    continue
                new = np.ones(len(seed), bool)
                new[1:] = (seed[1:] != seed[:-1]) | (owner[1:] != owner[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seed[new].view(np.int64)), batch.column("id").take(pa.array(owner[new] + s.first))], ["seed", "id"]
                )

    return sample


def _candidates(k: int, m: int):
    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("seeds")
            hits = lists.flatten().to_numpy().view(np.uint64)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            for s in text_slices(batch.column("text")):
                words = find_words(s)
                if len(words.starts) < k:
                    continue
                h = words.hashes()
                seed, valid = _seeds(h, words.doc, k, m)
                node, _ = windows(h, words.doc, k - 1)
                begins = np.concatenate([[0], np.cumsum(words.counts)])
                keep = np.zeros(len(valid), bool)
                for i in range(s.rows):
                    a, b = begins[i], min(begins[i + 1], len(valid))
                    if b > a:
                        keep[a:b] = np.isin(seed[a:b], hits[ends[s.first + i] : ends[s.first + i + 1]])
                at = np.flatnonzero(keep & valid)
                owner = words.doc[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(node[at].view(np.int64)),
                        pa.array(node[at + 1].view(np.int64)),
                        batch.column("id").take(pa.array(owner + s.first)),
                        pa.array((at - begins[owner]).astype(np.int32)),
                    ],
                    ["head", "tail", "id", "pos"],
                )

    return candidates


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in text_slices(batch.column("text")):
            data = s.data.tobytes()
            digests = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(s.offsets, s.offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(s.first, s.rows), pa.array(digests, pa.binary()), pa.array(find_words(s).counts.astype(np.int32))], ["id", "digest", "n_words"]
            )


def repeated_spans(docs: DataFrame, k: int = K, seed_words: int = SEED_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, start, n_windows, source, source_start): spans of windows that start in an earlier document too.

    The span's words [start, start + n_windows + k - 1) stand in document
    ``source`` from ``source_start`` on, and ``source`` < ``id``. An edge is
    named by its two nodes, 64 bits each.
    A copy of a whole text is one span; only the first copy enters the graph.
    Several spans of one document may overlap.
    """
    kind = docs.schema[key].dataType.simpleString()
    base = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).where("id is not null and text is not null")
    digests = materialize(base.mapInArrow(_digests, f"id {kind}, digest binary, n_words int").where(F.col("n_words") >= k))
    firsts = materialize(digests.groupBy("digest").agg(F.min("id").alias("source")))
    owners = materialize(digests.join(firsts, "digest").select("id", "source", "n_words"))
    discard(digests, firsts)
    copies = owners.where("id > source").select("id", F.lit(0).alias("start"), (F.col("n_words") - (k - 1)).alias("n_windows"), "source", F.lit(0).alias("source_start"))
    seeds = materialize(base.mapInArrow(_sample(k, seed_words), f"seed bigint, id {kind}"))
    repeated = materialize(seeds.groupBy("seed").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("seed"))
    leaders = owners.where("id = source").select("id")
    hits = materialize(seeds.join(repeated, "seed", "left_semi").groupBy("id").agg(F.collect_list("seed").alias("seeds")).join(leaders, "id", "left_semi"))
    discard(seeds, repeated)
    found = base.join(hits, "id").select("id", "text", "seeds")
    occurrences = materialize(found.mapInArrow(_candidates(k, seed_words), f"head bigint, tail bigint, id {kind}, pos int"))
    discard(hits)
    edges = occurrences.groupBy("head", "tail").agg(F.min("id").alias("source"), F.max("id").alias("last"))
    edges = materialize(edges.where("source < last").drop("last"))
    # nodes at which two repeated edges begin or end: no path goes through them
    head, tail = F.col("head").alias("node"), F.col("tail").alias("node")
    ends = edges.select(head, F.lit(1).alias("begin"), F.lit(0).alias("end")).union(edges.select(tail, F.lit(0).alias("begin"), F.lit(1).alias("end")))
    branching = materialize(ends.groupBy("node").agg(F.sum("begin").alias("b"), F.sum("end").alias("e")).where("b > 1 or e > 1").select("node"))
    met = materialize(occurrences.join(edges, ["head", "tail"]).select("head", "tail", "id", "pos", "source"))
    discard(occurrences, edges)
    # an edge's coordinates in its source, where it may stand more than once: the first counts
    placed = materialize(met.where("id = source").groupBy("head", "tail", "source").agg(F.min("pos").alias("at")))
    forks = branching.select("node", F.lit(True).alias("fork"))
    placed = placed.withColumn("node", tail).join(forks, "node", "left")
    along = Window.partitionBy("source").orderBy("at")
    cut = F.lag("at").over(along).isNull() | (F.lag("at").over(along) < F.col("at") - 1) | F.coalesce(F.lag("fork").over(along), F.lit(False))
    paths = placed.withColumn("cut", cut.cast("int")).withColumn("path", F.sum("cut").over(along))
    paths = materialize(paths.select("head", "tail", "at", "path"))
    discard(branching)
    spans = (
        met.where("id > source")
        .join(paths, ["head", "tail"])
        .groupBy("id", "source", "path", (F.col("pos") - F.col("at")).alias("shift"))
        .agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count(F.lit(1)).alias("n"), F.collect_list("pos").alias("all"))
    )
    # source coordinates must agree: as many windows as the span is long, else each window on its own
    whole = F.when(F.col("n") == F.col("hi") - F.col("lo") + 1, F.array(F.struct(F.col("lo").alias("start"), F.col("n").cast("int").alias("n_windows"))))
    single = F.transform(F.array_distinct("all"), lambda p: F.struct(p.alias("start"), F.lit(1).alias("n_windows")))
    return copies.union(
        spans.withColumn("part", F.explode(F.coalesce(whole, single))).select(
            "id", F.col("part.start").alias("start"), F.col("part.n_windows").alias("n_windows"), "source", (F.col("part.start") - F.col("shift")).alias("source_start")
        )
    )


def _remove(k: int, with_text: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = {}
            for name in ("starts", "sizes"):
                column = batch.column(name)
                lists[name] = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            per_row = batch.column("starts").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(per_row)])
            for s in text_slices(batch.column("text")):
                words = find_words(s)
                begins = np.concatenate([[0], np.cumsum(words.counts)])
                change = np.zeros(len(words.starts) + 1, np.int64)
                a, b = ends[s.first], ends[s.first + s.rows]
                row = np.repeat(np.arange(s.rows), per_row[s.first : s.first + s.rows])
                lo = np.minimum(begins[row] + lists["starts"][a:b], begins[row + 1])
                hi = np.minimum(lo + lists["sizes"][a:b] + k - 1, begins[row + 1])
                np.add.at(change, lo, 1)
                np.add.at(change, hi, -1)
                kept = np.cumsum(change[:-1]) == 0
                gone = np.bincount(words.doc[~kept], minlength=s.rows)
                d = words.data.copy()
                at = np.flatnonzero(kept)
                mask = np.zeros(len(d) + 1, np.int8)
                np.add.at(mask, words.starts[at], 1)
                np.add.at(mask, words.ends[at], -1)
                mask = np.cumsum(mask[:-1], dtype=np.int8).astype(bool)
                follows = at[:-1][words.doc[at[:-1]] == words.doc[at[1:]]]
                mask[words.ends[follows]] = True
                d[words.ends[follows]] = 32
                sums = np.concatenate([[0], np.cumsum(mask)])
                bounds = sums[s.offsets]
                out = d[mask].tobytes()
                texts = [out[bounds[i] : bounds[i + 1]] for i in range(s.rows)]
                columns = [
                    batch.column("id").slice(s.first, s.rows),
                    pa.array(words.counts, pa.int64()),
                    pa.array(gone, pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                ]
                names = ["id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(columns, names)

    return remove


def remove_repeated(docs: DataFrame, k: int = K, seed_words: int = SEED_WORDS, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """Per document: key, n_words, n_removed, kept_sha256 and, if asked, kept_text.

    A word goes if a window of ``k`` words over it starts in a document with a
    smaller id too; windows are those of the input. A null text has no words; a
    text below ``k`` words keeps all. The id names a document: rows repeated
    with id and text give equal output rows. Rows without an id are compared
    with nothing and keep all words. An empty table gives an empty result;
    other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()
    # one row per id: every span of a document comes from its own words, so lists are bounded by it
    spans = repeated_spans(docs, k, seed_words, key, text).groupBy("id").agg(F.collect_set(F.struct("start", "n_windows")).alias("spans"))
    spans = materialize(spans.select("id", F.col("spans.start").alias("starts"), F.col("spans.n_windows").alias("sizes")))
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).join(spans, "id", "left").select("id", "text", "starts", "sizes")
    schema = f"id {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text
    return rows.mapInArrow(_remove(k, with_text), schema).withColumnRenamed("id", key)
