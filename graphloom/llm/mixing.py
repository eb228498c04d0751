"""Mixing sources to target weights by a time-varying curriculum.

Each source has a schedule: its weight over training time from 0 to 1, linear
between a start and an end value whose mean is the source's share. Integrating
the schedule gives its cumulative demand for words, from 0 to its target;
inverting that gives the time at which a document's words are due, and the
cumulative demand of all sources at that time is their position in training.
Documents of a source are met in a fixed pseudo-random order, over and over
until its target is used up, and the mix is range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, numbered_in_order, row_count

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
#: How far a source's weight rises (or, if negative, falls) over training, in turn by source.
TILTS = (0.5, 0.0, -0.5)
#: Ranges of a source's order: as many as there are documents for, about, and at least so many.
BUCKET_ROWS, BUCKETS = 10_000, 1024
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, nth, weight, target) from (source, source_size).

    Targets share the whole size by weight; a source at ``max_repeats`` times
    its size stays there and the others share the rest, until none is above.
    Each round is one aggregate; a source that is full stays full.
    """
    s = numbered_in_order(sources, F.asc_nulls_last("source"))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod("nth", F.lit(len(weights))) + 1).cast("int")))
    s = materialize(s.withColumn("limit", F.col("source_size") * max_repeats))
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level, full = None, -1
    while True:
        closed = F.lit(False) if level is None else F.col("limit") < F.col("weight") * level
        n, taken, open_weight = s.agg(F.count_if(closed), F.sum(F.when(closed, F.col("limit"))), F.sum(F.when(~closed, F.col("weight")))).first()
        if n == full or not open_weight:
            break
        full, level = n, (total - (taken or 0)) / open_weight
    limit = F.col("limit").cast("double")
    return s.select("source", "source_size", "nth", "weight", (limit if level is None else F.least(limit, F.col("weight") * F.lit(level))).alias("target"))


def due_time(share: F.Column, tilt: F.Column) -> F.Column:
    """The time t at which a source has met ``share`` of its demand.

    Its weight at t is proportional to 1 + tilt * (2 t - 1), whose integral is
    (1 - tilt) t + tilt t**2; this inverts it in a form that holds for tilt 0.
    """
    b = F.lit(1.0) - tilt
    return F.lit(2.0) * share / (b + F.sqrt(b * b + F.lit(4.0) * tilt * share))


def _schedule(
    docs: DataFrame, columns: list[str], key: str, text: str, source: str,
    weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, tilts: tuple[float, ...] = TILTS, buckets: int | None = None,
) -> DataFrame:
    """(row, size, source_size, target, meetings): ``columns`` of each document as a struct, and its meetings.

    A source is dealt out in ``buckets`` ranges of its pseudo-random order, so
    that a large one is no single task. Their number grows with the table: a
    range has about ``BUCKET_ROWS`` documents at most.
    """
    buckets = buckets or max(BUCKETS, row_count(docs.select(key)) // BUCKET_ROWS)
    x = F.coalesce(F.col(text).cast("string"), F.lit(""))
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))  # never null, so an equi-join finds the null source too
    base = docs.select(
        F.struct(*columns).alias("row"), F.col(key).alias("id"), F.col(source).cast("string").alias("source"), name.alias("name"),
        F.regexp_count(x, F.lit(WORD)).cast("bigint").alias("size"), F.xxhash64(F.col(key), x).alias("order"),
    )
    base = base.withColumn("bucket", F.pmod(F.shiftright("order", 40), F.lit(buckets)))
    if text not in columns:
        base = materialize(base)  # counted once; whole texts are rather counted twice than written
    parts = materialize(base.groupBy("name", "source", "bucket").agg(F.sum("size").alias("part")))
    targets = materialize(source_targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")), weights, max_repeats))
    tilt = F.element_at(F.array(*map(F.lit, tilts)), (F.pmod("nth", F.lit(len(tilts))) + 1).cast("int"))
    # the demand of all sources by time t is steady * t + rising * t**2
    steady, rising = targets.agg(F.sum(F.col("target") * (1 - tilt)), F.sum(F.col("target") * tilt)).first()
    before = Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("before", F.coalesce(F.sum("part").over(before), F.lit(0)))
    goal = targets.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("name"), "source_size", "target", tilt.alias("tilt"))
    starts = materialize(starts.join(goal, "name").select("name", "bucket", "before", "source_size", "target", "tilt"))
    discard(parts)
    inside = Window.partitionBy("name", "bucket").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    met = base.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # sorted alike by the window: a merge join moves no document again
    met = met.join(starts.hint("merge"), ["name", "bucket"])
    at = F.col("before") + F.col("within")
    words = F.round("target").cast("bigint")

    def meeting(r: int) -> F.Column:
        done = F.col("source_size") * r + at
        taken = F.least(F.greatest(words - done, F.lit(0)), F.col("size"))
        due = F.when(taken > 0, due_time(done / F.greatest(F.col("target"), F.lit(1.0)), F.col("tilt")))
        position = due * F.lit(steady or 0.0) + due * due * F.lit(rising or 0.0)
        return F.struct(taken.alias("taken"), due.alias("due"), position.alias("position"))

    return met.select("row", "size", "source_size", "target", F.array(*map(meeting, range(max_repeats))).alias("meetings"))


def meetings(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """Per document: key, size, source_size, target, meetings.

    ``meetings`` has (taken, due, position) for each time the source may be met:
    the document's words taken then, the training time of the first of them and
    its position among all words of the mix (null if none is taken).
    """
    return _schedule(docs, [key], key, text, source, **options).select(F.col("row")[key].alias(key), "size", "source_size", "target", "meetings")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """Per document: key, size, source_size, target, taken, first_due, first_position.

    ``taken`` counts the document's words in the mix over all repeats; the last
    meeting within the source's target, where its demand ends, may be cut, so the
    sources' sums differ from their targets by less than a word. A null text has
    size 0, a null source is a source of its own, last in order, and a null key
    is a document like others. Rows repeated with their key are met each on
    their own. Documents equal in order, key and size take any order among
    themselves, which changes no figure but whose of the equals it is. Texts are counted whole, however
    long. An empty table gives an empty result; other columns are ignored.
    """
    first = F.col("meetings")[0]
    taken = F.aggregate("meetings", F.lit(0).cast("bigint"), lambda n, m: n + m["taken"])
    return meetings(docs, key, text, source, **options).select(
        key, "size", "source_size", "target", taken.alias("taken"), first["due"].alias("first_due"), first["position"].alias("first_position")
    )


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The documents of the mix in training order, with their columns, of whatever names.

    A document comes once for each meeting, at that meeting's own position. Only
    the last meeting of a source can be cut: it comes if half of the document or
    more is taken, or if it is the document's first. Documents without words in
    the mix go; rows without a key are met like others.
    """
    plan = _schedule(docs, docs.columns, key, text, source, **options)
    plan = plan.select("row", "size", F.posexplode("meetings").alias("nth", "met")).where("met.taken > 0 AND (nth = 0 OR 2 * met.taken >= size)")
    plan = plan.select("row", F.col("met.position").alias("position"), F.col("row")[key].alias("id"))
    ordered = plan.repartitionByRange("position", "id").sortWithinPartitions("position", "id")
    return ordered.select(*(F.col("row")[c].alias(c) for c in docs.columns))
