"""Numbers, percentiles and sessions of keys that span many blocks; pairs in tiles."""

import datetime
import random

import numpy as np
import pytest

from graphloom.functions import vectors
from graphloom.operators import metrics, rules
from graphloom.operators.ordered import in_blocks
from graphloom.streaming import progress as stream

START = datetime.datetime(2024, 1, 1)


@pytest.fixture
def many_blocks(spark):
    """Small tables keep all their ranges."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def _events(spark, n=600):
    """Nine of ten events are one job's; times repeat, and some jobs or times are null."""
    rng = random.Random(7)
    rows = []
    for i in range(n):
        job = rng.choice([1] * 18 + [2, None])
        rows.append((job, i, START + datetime.timedelta(minutes=30 * rng.randrange(4 * n)) if rng.random() < 0.98 else None))
    return rows, spark.createDataFrame(rows, "job_id long, event_id long, ts timestamp")


def test_numbers_of_a_hot_job(spark, many_blocks):
    rows, df = _events(spark)
    assert in_blocks(df, "job_id", "ts").where("job_id = 1").select("block").distinct().count() > 1
    want = {}
    for job in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == job), key=lambda r: (r[2] is not None, r[2] or START, r[1]))
        want |= {(job, r[1]): i for i, r in enumerate(mine, 1)}
    assert {(r.job_id, r.event_id): r.seq for r in stream.numbered(df).collect()} == want
    assert stream.numbered(df.limit(0)).count() == 0


def test_sessions_of_a_hot_job(spark, many_blocks):
    rows, df = _events(spark)
    want = []
    for job in {r[0] for r in rows}:
        last = None
        for ts in sorted(r[2] for r in rows if r[0] == job and r[2] is not None):
            if last is None or ts - last >= datetime.timedelta(hours=2):
                want.append([job, ts, 0])
            want[-1][2] += 1
            last = ts
    got = [tuple(r) for r in stream.sessions(df).select("job_id", "start", "n_events").collect()]
    assert sorted(got, key=repr) == sorted(map(tuple, want), key=repr)


def test_percentiles_of_a_hot_group(spark, many_blocks):
    rng = random.Random(3)
    rows = [(rng.choice(["a"] * 20 + ["b", None]), rng.choice([None, round(rng.gauss(0, 9), 1)])) for _ in range(800)] + [("c", None), ("d", 2.5)]
    got = {r["by_type"]: tuple(r)[1:] for r in metrics.percentiles(spark.createDataFrame(rows, "by_type string, v double"), "by_type", "v").collect()}
    for key in {r[0] for r in rows}:
        x = [v for k, v in rows if k == key and v is not None]
        want = (min(x), np.percentile(x, 50), np.percentile(x, 90), max(x)) if x else (None,) * 4
        assert got[key] == (pytest.approx(want, abs=1e-6) if x else want)


def test_tiles_hold_every_pair_once(spark):
    a = spark.range(57).selectExpr("id AS x", "id % 3 AS kind")
    b = spark.range(41).selectExpr("id AS y", "if(id < 38, 0, id % 3) AS kind")
    got = sorted((r.x, r.y) for r in vectors.tiled_pairs(a, b, "x", "y", ("kind",), rows=10).collect())
    assert got == sorted((x, y) for x in range(57) for y in range(41) if x % 3 == (0 if y < 38 else y % 3))
    assert vectors.tiled_pairs(a, b.limit(0), "x", "y", rows=10).count() == 0


def test_nearest_in_tiles_equals_the_broadcast_form(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = v.where("vec_id % 10 = 0").selectExpr("vec_id AS query_id", "embedding AS query")
    few, many = (sorted(map(tuple, vectors.nearest(asked, v, 3, ("label",), small=n).collect()), key=repr) for n in (10_000, 0))
    assert few == many and few


def test_degree_table_counts_loops_at_both_ends(spark):
    rows = [("a", "T", "a", "T", "r", "AMBIGUOUS"), ("a", "T", "b", "U", "r", None), ("c", "T", "b", "U", "s", "AMBIGUOUS")]
    e = spark.createDataFrame(rows, "source_id string, source_type string, target_id string, target_type string, rel_type string, confidence string")
    d = rules.degree_table(e)
    assert {tuple(r) for r in d.collect()} == {("a", "T", "r", "outgoing", 2, 1), ("a", "T", "r", "incoming", 1, 1), ("b", "U", "r", "incoming", 1, 0), ("c", "T", "s", "outgoing", 1, 1), ("b", "U", "s", "incoming", 1, 1)}
    assert [r[0] for r in rules.ambiguous_only(d).collect()] == ["c"]
    assert [tuple(r) for r in rules.high_fan_in(d, "U", "r", 0).collect()] == [("b", 1)]


def test_queries_are_placed_as_in_the_fit(spark, sf_dir):
    from graphloom.plans import search

    every = {r.vec_id: tuple(r) for r in search.pca_projection(spark, sf_dir).collect()}
    asked = search.query_projection(spark, sf_dir).collect()
    assert asked and all(tuple(r) == every[r.vec_id] for r in asked)


def test_scaled_points(spark):
    df = spark.createDataFrame([(1, 2.0, -4.0), (2, 1.0, None)], "id int, x double, y double")
    assert sorted(map(tuple, vectors.scaled(df, "x", "y").collect())) == [(1, 0.5, -1.0, 4.0), (2, 0.25, None, 4.0)]
    assert vectors.scaled(df.limit(0), "x", "y").count() == 0


def test_closed_jobs_leave_a_stream_when_their_time_is_over(spark, tmp_path):
    """A job closed at minute 1 goes after minute 31; late events count; an open job stays in state."""
    import time

    from graphloom.streaming import progress

    batches = [
        [("a", 0, "run"), ("a", 1, "error"), (None, 1, "error"), ("b", None, "error")], [("a", 5, "run"), ("a", 6, "error"), ("b", 6, None)],
        [("b", 60, "run")], [("c", 61, "error"), ("b", 62, "run")],
    ]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "job_id string, minute int, event_type string")
        df = df.selectExpr("job_id", "timestamp_seconds(1700000000 + minute * 60) AS ts", "event_type")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files are read in the order of their times
    stream = spark.readStream.schema("job_id string, ts timestamp, event_type string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    progress.replay(stream, progress.closed_jobs, f"{tmp_path}/out", f"{tmp_path}/state")
    got = spark.read.parquet(f"{tmp_path}/out").selectExpr("job_id", "(unix_seconds(closed_at) - 1700000000) / 60 AS minute", "n_events", "n_late").collect()
    assert [tuple(r) for r in got] == [("a", 1.0, 4, 2)]
