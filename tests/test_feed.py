"""Feed, channels and loose edges on small rows: odd payloads, restarts, repeated batches and ambiguous names."""

import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from graphloom.operators import normalize
from graphloom.streaming import feed, progress, ring


def test_names_of_messages(spark):
    rows = [
        ('{"entry":{"name":"a"},"name":"z"}', None, "a"), ('{"entry":{"name":7},"asset":{"name":"b"}}', None, "b"), ('{"entry":[],"asset":{},"name":"c"}', None, "c"),
        ("", {"entry_name": "d", "name": "z"}, "d"), (None, {"entry_name": "", "name": "e"}, "e"), ('{"name":""}', {"name": "f"}, "f"), ("{}", {}, None),
        ("not json", {"name": "g"}, None), ("[1]", {"name": "g"}, None), ('"text"', {"name": "g"}, None), ("null", {"name": "g"}, None), ('{"name":null}', None, None),
    ]
    df = spark.createDataFrame(rows, "data string, attributes map<string,string>, want string")
    got = df.select("want", feed.entry_name(F.col("data"), F.col("attributes")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def _add(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    time.sleep(1.1)  # files are read in the order of their times


def test_a_feed_lands_once_over_restarts_and_folds(spark, tmp_path):
    made = "message_id bigint, data string, second bigint"
    message = lambda i, name, s: (i, '{"name":"%s"}' % name, s)

    def run():
        source = spark.readStream.schema(made).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        source = source.select("message_id", "data", F.lit(None).cast("map<string,string>").alias("attributes"), F.timestamp_seconds("second").alias("at"))
        feed.consume(source, f"{tmp_path}/feed", f"{tmp_path}/state")

    state = lambda: sorted((r.entry_name, r.message_id) for r in feed.current(spark, f"{tmp_path}/feed").collect())
    _add(spark, [message(1, "a", 10), message(2, "b", 10), (3, "broken", 10)], made, f"{tmp_path}/in")
    _add(spark, [message(4, "a", 20), message(1, "a", 10), (5, None, 20)], made, f"{tmp_path}/in")
    run()
    assert state() == [("a", 4), ("b", 2)]
    feed.fold(spark, f"{tmp_path}/feed")
    assert state() == [("a", 4), ("b", 2)] and feed._snapshots(spark, f"{tmp_path}/feed") == [1]
    _add(spark, [message(6, "b", 5), message(7, "c", 30), message(8, "a", 20)], made, f"{tmp_path}/in")  # b's message is older than what is there
    run()
    feed.fold(spark, f"{tmp_path}/feed")
    feed.fold(spark, f"{tmp_path}/feed")
    assert state() == [("a", 8), ("b", 2), ("c", 7)]
    assert sorted(r.message_id for r in feed.dead_letters(spark, f"{tmp_path}/feed").collect()) == [3, 5]
    assert sorted(map(tuple, feed.counts(spark, f"{tmp_path}/feed").collect())) == [(0, 3, 2, 1), (1, 3, 2, 1), (2, 3, 3, 0)]
    # a batch that is repeated, as after a failure, takes the place of itself
    again = feed.log(spark, f"{tmp_path}/feed").where("batch = 2").drop("entry_name", "batch", "outcome").collect()
    feed.named(spark.createDataFrame(again, feed.MESSAGE)).write.mode("overwrite").partitionBy("outcome").parquet(f"{tmp_path}/feed/log/batch=2")
    assert state() == [("a", 8), ("b", 2), ("c", 7)]


def _stream(spark, path):
    s = spark.readStream.schema("job_id string, event_id bigint, minute int, event_type string").option("maxFilesPerTrigger", 1).parquet(path)
    return s.selectExpr("job_id", "event_id", "event_type", "timestamp_seconds(1700000000 + minute * 60) AS ts")


@pytest.mark.parametrize("keep", [2, 500])
def test_channels_are_numbered_over_restarts_and_open_anew(spark, tmp_path, keep):
    made = "job_id string, event_id bigint, minute int, event_type string"
    files = [
        [("a", 2, 1, "run"), ("a", 1, 0, "run"), ("b", 1, 0, "run"), (None, 9, 0, "run"), ("a", 3, None, "run")],
        [("a", 4, 2, "error"), ("a", 5, 3, "run"), ("b", 2, 3, None)],
        [("b", 3, 100, "run")], [("b", 4, 101, "run")], [("a", 6, 102, "run"), ("a", 7, 102, "run")],
    ]
    for i, rows in enumerate(files):
        _add(spark, rows, made, f"{tmp_path}/in")
        if i in (0, 2, 4):  # the stream stops and starts again
            progress.replay(_stream(spark, f"{tmp_path}/in"), ring.arrivals, f"{tmp_path}/out", f"{tmp_path}/state")
    log = spark.read.parquet(f"{tmp_path}/out")
    got = sorted((r.job_id, r.opened, r.seq, r.event_id) for r in log.selectExpr("*", "int((unix_seconds(opened_at) - 1700000000) / 60) AS opened").collect())
    assert got == [("a", 0, 1, 1), ("a", 0, 2, 2), ("a", 0, 3, 4), ("a", 0, 4, 5), ("a", 102, 1, 6), ("a", 102, 2, 7)] + [("b", 0, i, i) for i in (1, 2, 3, 4)]
    held = sorted((r.job_id, r.seq, r.event_id) for r in ring.held(log, keep).collect())
    assert held == [("a", 1, 6), ("a", 2, 7)] + [("b", i, i) for i in (1, 2, 3, 4) if i > 4 - keep]


def test_a_stream_tails_what_was_not_replayed(spark, tmp_path):
    made = "job_id string, seq bigint, ts timestamp"
    rows = [("a", i, i) for i in range(1, 7)]
    at = lambda r: (r[0], r[1], datetime(2024, 1, 1, 0, r[2]))
    history = spark.createDataFrame([at(r) for r in rows[:4]], made)
    _add(spark, [at(r) for r in rows[2:] + rows[4:]], made, f"{tmp_path}/in")
    live = spark.readStream.schema(made).parquet(f"{tmp_path}/in")
    progress.replay(live, lambda s: ring.tail(ring.held(history), s), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted(r.seq for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [5, 6]
    assert sorted(r.seq for r in ring.replay_then_tail(history, spark.read.parquet(f"{tmp_path}/in"), 2).collect()) == [3, 4, 5, 6]
    assert ring.held(history.limit(0)).count() == 0


def test_strict_edges(spark):
    rows = [
        ("A:x->Flow->B:y", ("A", "x", "Flow", "EXTRACTED", "B", "y")), ("A:x:z->Flow[q, INFERRED ]->B:", ("A", "x:z", "Flow", "INFERRED", "B", "")),
        (" A:x->F[a[LOW, b]->B:y ", (" A", "x", "F[a", "LOW", "B", "y ")), ("A:x->Flow[inferred]->B:y", ("A", "x", "Flow", "EXTRACTED", "B", "y")),
        ("A:x->F[b] ->B:y", ("A", "x", "F[b] ", "EXTRACTED", "B", "y")), ("A:x->Flow->B:y->C:z", None), ("A->Flow->B:y", None), ("A:x", None), (None, None), ("", None),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, line string")
    got = {r.i: r.e for r in df.select("i", normalize.strict_edge(F.col("line")).alias("e")).collect()}
    assert [None if got[i] is None else tuple(got[i]) for i in range(len(rows))] == [r[1] for r in rows]


def test_loose_edges_find_their_nodes(spark):
    nodes = [(1, 2, "Role:x:y", "x:y"), (1, 1, "Goal:y", "y"), (1, 3, "Goal:to->from", "to->from"), (1, 4, "Data:Goal:y", "Goal:y"), (2, 1, "Role:y", "y"), (2, 2, None, None), (2, 3, "odd", None), (2, 3, "Role:", "")]
    lines = [
        (1, 1, "y->[uses]->x:y", ("Goal:y", "Serving", "Role:x:y")), (1, 2, "Goal:y->zaps->to->from", ("Goal:y", "Association", "Goal:to->from")),
        (1, 3, "\tRole:x:y -> Flow -> y ", ("Role:x:y", "Flow", "Goal:y")), (1, 4, "Y->uses->y", None), (1, 5, "y->uses", None), (1, 6, None, None),
        (2, 1, "y->flow->odd", ("Role:y", "Flow", "odd")), (2, 2, "y->flow->x:y", None), (2, 3, "->flow->y", ("Role:", "Flow", "Role:y")), (3, 1, "y->flow->y", None),
    ]
    n = spark.createDataFrame(nodes, "doc_id int, seq int, key string, name string")
    df = spark.createDataFrame([x[:3] for x in lines], "doc_id int, seq int, line string")
    got = {(r.doc_id, r.seq): (r.source_key, r.rel_type, r.target_key) for r in normalize.normalized_edges(df, n).collect()}
    assert got == {x[:2]: x[3] for x in lines if x[3]}
    assert normalize.normalized_edges(df, n.limit(0)).count() == 0
