"""Near-duplicate join by n-gram Jaccard similarity: a MinHash LSH forest, then exact verification.

Each tree of the forest is a prefix trie over sequences of MinHash values. Two
texts match in a tree as far as their sequences share a prefix. Matching starts
at the whole sequence; the prefix is shortened, level by level, until two texts at
the threshold itself, the hardest ones, are met as often as the target. Texts that share
such a prefix in any tree are candidates, and are verified with their whole
shingle sets. Small families of candidates are compared whole. The members of a
large family are sorted in the order of a trie and cut into blocks, and only
blocks that meet in a leaf are compared; members so close to the family's pivot
that the triangle inequality of the Jaccard distance links any two of them are
counted without a comparison. No pair becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, materialize, numbered_in_order, row_count
from .words import find_words, list_array, shingle_sets, spans_of, text_slices

SHINGLE_WORDS = 5
THRESHOLD = 0.8
TREES = 24
DEPTH = 8
RECALL = 0.999
BLOCK = 128
#: Weight, in measured texts, of the recall that the formula gives at the threshold itself.
PRIOR = 1000.0
#: Shingles of small families that one group of a comparing task takes, about.
SHARE_SHINGLES = 100_000


def expected_recall(depth: int, threshold: float = THRESHOLD, trees: int = TREES) -> float:
    """How often two texts at the threshold share a prefix of ``depth`` values in some tree."""
    return 1 - (1 - threshold**depth) ** trees


def prefix_depth(measured: list[tuple[float, float]], threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix with the target recall.

    ``measured`` has (texts, found) for each depth from 1 on: the weight of sampled
    texts that have partners, and the sum of the shares of partners found.
    """
    for d in range(depth, 1, -1):
        n, found = measured[d - 1] if measured else (0.0, 0.0)
        if (found + PRIOR * expected_recall(d, threshold, trees)) / (n + PRIOR) >= recall:
            return d
    return 1


def _signatures(k: int, trees: int, depth: int):
    rng = np.random.Generator(np.random.PCG64(20240501))
    size = trees * depth
    multiply = (rng.integers(0, 1 << 32, size, dtype=np.uint64) | 1).astype(np.uint32)
    flip = rng.integers(0, 1 << 32, size, dtype=np.uint64).astype(np.uint32)
    piece = 1 << 15

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in text_slices(batch.column("text")):
                words = find_words(s)
                value, n = shingle_sets(words.hashes(), words.counts, k)
                has = np.flatnonzero(n)
                starts = spans_of(n)[0][has]
                x = (value >> np.uint64(32)).astype(np.uint32)
                # groups of whole documents that fit the processor's cache
                cuts = [0]
                while cuts[-1] < len(has):
                    cuts.append(max(cuts[-1] + 1, int(np.searchsorted(starts, starts[cuts[-1]] + piece))))
                least = np.empty((len(has), size), np.uint32)
                for a, b in zip(cuts, cuts[1:]):
                    lo, hi = starts[a], starts[b] if b < len(has) else len(x)
                    part, at = x[lo:hi], starts[a:b] - lo
                    for i in range(size):
                        least[a:b, i] = np.minimum.reduceat((part ^ flip[i]) * multiply[i], at)
                counts = np.zeros(s.rows, np.int64)
                counts[has] = trees * depth
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(s.first, s.rows) for c in ("id", "digest")),
                        pa.array(n, pa.int64()),
                        list_array(least.ravel().view(np.int32), counts, pa.int32()),
                    ],
                    ["id", "digest", "n_shingles", "signature"],
                )

    return signatures


def _sets(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in text_slices(batch.column("text")):
                words = find_words(s)
                value, n = shingle_sets(words.hashes(), words.counts, k)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(s.first, s.rows) for c in batch.schema.names if c != "text"), list_array(value.view(np.int64), n, pa.int64())],
                    [*(c for c in batch.schema.names if c != "text"), "shingles"],
                )

    return sets


def _common(value: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sizes of all intersections of ``n`` sets, over shingles that two of them share."""
    names, inverse, times = np.unique(value, return_inverse=True, return_counts=True)
    shared = times > 1
    column = (np.cumsum(shared) - 1)[inverse]
    take = shared[inverse]
    column, owner = column[take], owner[take]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((n, n), np.float32)
    width = max(64, (1 << 21) // n)
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((n, width), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        out += m @ m.T
    return out


def _verify(threshold: float):
    def verify(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("component")
        component = table.column("component").to_numpy()
        ids = table.column("id").to_numpy()
        side = table.column("block").to_numpy()
        low, high = table.column("low").to_numpy(), table.column("high").to_numpy()
        lists = table.column("shingles").combine_chunks()
        sizes = lists.value_lengths().to_numpy()
        value = lists.flatten().to_numpy()
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        links, peer = np.zeros(len(ids), np.int64), ids.copy()
        cuts = np.flatnonzero(np.concatenate([[True], component[1:] != component[:-1], [True]]))
        for a, b in zip(cuts, cuts[1:]):
            n = b - a
            if n < 2:
                continue
            again = np.ones(n, bool)
            again[np.unique(ids[a:b], return_index=True)[1]] = False
            common = _common(value[bounds[a] : bounds[b]], np.repeat(np.arange(n), sizes[a:b]), n)
            total = sizes[a:b][:, None] + sizes[a:b][None, :]
            like = common >= threshold * (total - common) - 1e-6
            np.fill_diagonal(like, False)
            like &= ~(again[:, None] | again[None, :])  # a row repeated with its id counts once
            if low[a] != high[a]:  # pairs within a block are met where the block meets itself
                like &= side[a:b][:, None] != side[a:b][None, :]
            links[a:b] = like.sum(1)
            label = np.arange(n)
            while True:
                best = np.where(like, label[None, :], n).min(1)
                new = np.minimum(label, best)
                new = new[new]
                if (new == label).all():
                    break
                label = new
            peer[a:b] = ids[a:b][label]
        return pa.table({"id": pa.array(ids), "links": pa.array(links), "peer": pa.array(peer)})

    return verify


def _leaf_keys(trees: int, depth: int, prefix: int) -> F.Column:
    """One key for each tree: its number and the prefix of its sequence."""
    one = lambda t: F.xxhash64(t, F.slice("signature", t * depth + 1, prefix))
    return F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), one)


def _texts(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (class_id, digest, ...) with the text of each: rows of a null id are found by the digest alone."""
    # candidates grow with the documents: the same join at every size
    b = base.select(F.col("id").alias("b_id"), F.col("digest").alias("b_digest"), "text")
    return b.join(wanted.hint("merge"), F.col("b_id").eqNullSafe(F.col("class_id")) & (F.col("b_digest") == F.col("digest"))).drop("b_id", "b_digest", "class_id", "digest")


def _compare(sets: DataFrame, threshold: float) -> DataFrame:
    """(id, links, peer) of sets (id, component, block, low, high, shingles, share), compared within share, low and high."""
    return materialize(sets.groupBy("share", "low", "high").applyInArrow(_verify(threshold), "id bigint, links bigint, peer bigint"))


def _compare_large(sets: DataFrame, leaves: DataFrame, threshold: float, block: int) -> DataFrame:
    """(id, links, peer) within large families of ``sets`` (id, component, path, shingles); may have several rows an id.

    Two members whose distances to the pivot, the family's least member, add up
    to 1 - threshold at most are linked. So all members within half of that, the
    core, are linked with each other and need no comparison. Core and rest are
    sorted by their paths in the first tree and cut into blocks, so that
    neighbours share leaves, and blocks without a common leaf are not compared.
    """
    sets = materialize(sets)
    pivots = sets.where("id = component").select(F.col("component").alias("p"), F.col("shingles").alias("pivot")).dropDuplicates(["p"])
    both = F.size(F.array_intersect("shingles", "pivot"))
    near = both >= (1 + threshold) / 2 * (F.size("shingles") + F.size("pivot") - both) - F.lit(1e-6)
    placed = sets.join(pivots, F.col("component") == F.col("p")).select("id", "component", "path", near.cast("int").alias("core")).dropDuplicates(["id"])
    placed = numbered_in_order(placed, "component", "core", "path", "id")
    placed = placed.select("id", "component", "core", (F.expr(f"nth div {block}") * 2 + F.col("core")).alias("block"))
    core = placed.where("core = 1")
    inner = core.join(core.groupBy("component").agg((F.count(F.lit(1)) - 1).alias("links")), "component").select("id", "links", F.col("component").alias("peer"))
    # one row a block, with the leaves of its members
    blocks = leaves.join(placed, "id").groupBy("component", "block", "core").agg(F.collect_set("leaf").alias("met"))
    blocks = materialize(blocks)
    upto = blocks.groupBy("component").agg(F.max("block").alias("upto"))
    pairs = blocks.join(upto, "component").withColumn("high", F.explode(F.sequence("block", "upto")))
    others = blocks.select("component", F.col("block").alias("high"), F.col("core").alias("o_core"), F.col("met").alias("o_met"))
    pairs = pairs.join(others, ["component", "high"]).where("core + o_core < 2").where(F.arrays_overlap("met", "o_met"))
    pairs = materialize(pairs.select("component", F.col("block").alias("low"), "high"))
    sides = pairs.withColumn("block", F.explode(F.array_distinct(F.array("low", "high"))))
    members = sets.select("id", "shingles").join(placed.drop("core"), "id").join(sides, ["component", "block"])
    outer = _compare(members.select("id", "component", "block", "low", "high", "shingles", (-1 - F.col("component")).alias("share")), threshold)
    out = materialize(outer.union(inner))
    discard(sets, blocks, pairs, outer)
    return out


def _classes(docs: DataFrame, key: str, text: str, shingle_words: int, threshold: float, trees: int, depth: int, recall: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(id, digest, n_shingles, cid) of all rows, and (cid, class_id, digest, n_links, component) of all distinct texts."""
    base = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    kind = base.schema["id"].dataType.simpleString()
    sig = base.mapInArrow(_signatures(shingle_words, trees, depth), f"id {kind}, digest binary, n_shingles bigint, signature array<int>")
    sig = materialize(sig.withColumn("rid", F.monotonically_increasing_id()))
    classes = materialize(sig.groupBy("digest").agg(F.min("rid").alias("cid"), F.min("id").alias("class_id")))
    members = materialize(sig.select("id", "digest", "n_shingles").join(classes.select("digest", "cid"), "digest"))
    leaders = sig.where("n_shingles > 0").select("rid", "n_shingles", "signature").join(classes, F.col("rid") == F.col("cid")).drop("rid")
    leaders = materialize(leaders)
    discard(sig)
    prefix = prefix_depth([], threshold, trees, depth, recall)  # holds for every pair, whatever the texts: nothing is sampled
    paths = leaders.select("cid", F.slice("signature", 1, depth).alias("path"))
    leaves = materialize(leaders.select(F.col("cid").alias("id"), F.explode(_leaf_keys(trees, depth, prefix)).alias("leaf")))
    buckets = materialize(leaves.groupBy("leaf").agg(F.min("id").alias("root"), F.max("id").alias("last")).where("root < last").select("leaf", "root"))
    candidates = materialize(connected_components(leaves.join(buckets, "leaf").where("id <> root").select("id", "root"), "id", "root"))
    sizes = materialize(candidates.groupBy("component").agg(F.count(F.lit(1)).alias("n")))
    candidates = candidates.join(sizes, "component").join(classes.withColumnRenamed("cid", "node"), "node")
    candidates = materialize(candidates.select("class_id", "digest", F.col("node").alias("cid"), "component", "n"))
    small, large = candidates.where(F.col("n") <= block).drop("n"), candidates.where(F.col("n") > block).drop("n")
    # small families share groups of tasks, as many as their shingles fill
    shingles = small.join(leaders.select("cid", "n_shingles"), "cid").agg(F.sum("n_shingles")).first()[0] or 0
    shares = max(1, shingles // SHARE_SHINGLES)
    schema = "id bigint, component bigint, shingles array<bigint>"
    sets = _texts(base, small).select("text", F.col("cid").alias("id"), "component").mapInArrow(_sets(shingle_words), schema)
    zero = F.lit(0).cast("bigint")
    sets = sets.select("id", "component", zero.alias("block"), zero.alias("low"), zero.alias("high"), "shingles", F.pmod(F.xxhash64("component"), F.lit(shares)).alias("share"))
    found = _compare(sets, threshold)
    if row_count(large):
        wanted = large.join(paths, "cid").select("class_id", "digest", F.col("cid").alias("id"), "component", "path")
        sets = _texts(base, wanted).select("text", "id", "component", "path").mapInArrow(_sets(shingle_words), "id bigint, component bigint, path array<int>, shingles array<bigint>")
        met = leaves.join(buckets.select("leaf"), "leaf", "left_semi").join(large.select(F.col("cid").alias("id")), "id", "left_semi")
        found = found.union(_compare_large(sets, met, threshold, block))
    links = found.groupBy("id").agg(F.sum("links").alias("n_links"))
    groups = connected_components(found.where("id <> peer").select("id", "peer"), "id", "peer")
    out = classes.join(links, F.col("cid") == F.col("id"), "left").drop("id").join(groups, F.col("cid") == F.col("node"), "left")
    out = materialize(out.select("cid", "class_id", "digest", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "cid").alias("component")))
    discard(leaders, leaves, buckets, candidates, classes)
    return members, out


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    depth: int = DEPTH,
    recall: float = RECALL,
    block: int = BLOCK,
) -> DataFrame:
    """One row per row: key, ``class_id``, ``n_links``, ``group_id``, ``n_shingles``.

    Rows of equal text (null: empty) are one class, named by its least id.
    ``n_links`` counts the other classes whose shingle sets have a Jaccard
    similarity of ``threshold`` or more with this one's; ``group_id`` names the
    set of classes connected by links, by its least id. A text of fewer words
    than a shingle is one shingle; a text without words has none and no links.
    Texts, not ids, make the classes: an id on two texts is in two classes, and
    rows without an id take part; a class or group without any id has a null
    name. The key may be of any ordered type. Repeated rows give repeated
    output. An empty table gives an empty result; other columns are ignored.
    """
    members, classes = _classes(docs, key, text, shingle_words, threshold, trees, depth, recall, block)
    groups = classes.groupBy("component").agg(F.min("class_id").alias("group_id"))
    classes = classes.join(groups, "component").select("cid", "class_id", "n_links", "group_id")
    return members.join(classes, "cid").select(F.col("id").alias(key), "class_id", "n_links", "group_id", "n_shingles")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One text of each group stays, with its columns: that of the least id, and of several of that id the least digest.

    Rows that repeat both id and text stay together. In a group without any id
    the text of the least digest stays, with all its rows.
    """
    chosen = {"shingle_words": SHINGLE_WORDS, "threshold": THRESHOLD, "trees": TREES, "depth": DEPTH, "recall": RECALL, "block": BLOCK} | options
    _, classes = _classes(docs, key, text, **chosen)
    first = F.min(F.struct(F.col("class_id").isNull().alias("last"), "class_id", "digest"))
    kept = classes.groupBy("component").agg(first.alias("first")).select(F.col("first.class_id").alias("_kept"), F.col("first.digest").alias("_digest"))
    kept = materialize(kept).hint("merge")
    own = F.unhex(F.sha2(F.coalesce(docs[text].cast("string"), F.lit("")), 256))
    return docs.join(kept, docs[key].eqNullSafe(kept["_kept"]) & (own == kept["_digest"]), "left_semi")
