"""Functions that SQL can't mirror, against plain Python; streams against their batch forms."""

import uuid

import numpy as np
from pyspark.sql import functions as F

from graphloom.functions import text, vectors
from graphloom.operators import graph, tables
from graphloom.sources.tables import progress
from graphloom.streaming import progress as stream


def plain_chunks(t, size, overlap):
    parts = []
    for block in (b.strip() for b in t.split("\n\n")):
        if block:
            parts += [x.strip() for x in block.split("\n") if x.strip()] if len(block) > size else [block]
    out, cur = [], ""
    for p in parts or [x.strip() for x in t.split(". ") if x.strip()]:
        if len(cur) + len(p) + 1 <= size:
            cur = cur + "\n\n" + p if cur else p
            continue
        if cur:
            out.append(cur)
        cur = cur[-overlap:] + "\n\n" + p if cur and overlap else p
    return out + [cur] if cur else out


def test_semantic_chunks(spark):
    cases = ["", "one", "a\n\nb\n\nc", "x" * 30 + "\n" + "y" * 30 + "\n\nz", "ab. cd", " \n\n ", "word " * 20 + "\n\n" + "w\n" * 9]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string").select("i", text.semantic_chunks(F.col("t"), 40, 5).alias("c"))
    for r in df.collect():
        assert list(r["c"]) == plain_chunks(cases[r["i"]], 40, 5)


def test_uuid5(spark):
    names = ["a", "Übung", "x/y z", "", "42"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.uuid5(uuid.NAMESPACE_URL, F.col("n")).alias("u"))
    assert {r["n"]: r["u"] for r in df.collect()} == {n: str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names}


def test_string_forms(spark):
    df = spark.createDataFrame([("Node:a b->Serving[Read,inferred]->Goal:x:y",), ("nothing",), (None,)], "s string")
    a, b, c = [r["e"] for r in df.select(text.parse_edge(F.col("s")).alias("e")).collect()]
    assert tuple(a) == ("Node", "a b", "Serving", "Read", "INFERRED", "Goal", "x:y") and b is None and c is None
    got = spark.createDataFrame([("Goal: win",), ("the mysql box",), ("Ada Lovelace",), ("plain thing",)], "s string").select(text.normalize_node(F.col("s")).alias("n")).collect()
    assert [tuple(r["n"]) for r in got] == [("Goal", "win"), ("SystemSoftware", "the mysql box"), ("BusinessActor", "Ada Lovelace"), ("BusinessObject", "plain thing")]
    verbs = spark.createDataFrame([("depends on",), ("FLOW",), ("zaps",)], "s string").select(text.classify_verb(F.col("s"))).collect()
    assert [r[0] for r in verbs] == ["Serving", "Flow", "Association"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0, 0.0]
    odd = spark.createDataFrame([([1.0, float("nan")],), ([1.0],)], "a array<double>").select(vectors.sanitized(F.col("a"), 2)).collect()
    assert [list(r[0]) for r in odd] == [[1.0, 0.0], [0.0, 0.0]]
    x = np.random.default_rng(1).normal(size=(50, 5)) * [5, 3, 1, 0.1, 0.1]
    got = vectors.principal_axes(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id int, embedding array<double>"), 2).orderBy("vec_id").toPandas()
    _, _, axes = np.linalg.svd(x - x.mean(0))
    want = (x - x.mean(0)) @ axes[:2].T
    for i in range(2):
        have = got[f"axis_{i + 1}"].to_numpy()
        assert np.allclose(have, want[:, i], atol=1e-3) or np.allclose(have, -want[:, i], atol=1e-3)


def test_impact_of_small_graph(spark):
    rows = [("a", "A", "b", "B", "R", "INFERRED"), ("b", "B", "c", "C", "R", None), ("a", "A", "d", "D", "R", "AMBIGUOUS"), ("c", "C", "a", "A", "R", "EXTRACTED")]
    e = spark.createDataFrame(rows, "source_id string, source_type string, target_id string, target_type string, rel_type string, confidence string")
    assert {tuple(r) for r in graph.impact(e, "a").collect()} == {("a", 1.0, 0), ("c", 1.0, 1), ("b", 1.0, 2)}
    assert graph.impact(e.limit(0), "a").count() == 1
    merged = graph.merge_subgraph(e, e.limit(2))
    assert merged.count() == 4


def test_upsert_keeps_one_row_per_key(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = tables.last_per_key(spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, at int"), ["k"], "at").drop("at")
    assert sorted(map(tuple, tables.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "d"), (3, "e")]


def test_streams_equal_their_batch_forms(spark, sf_dir, tmp_path):
    batch = progress(spark, sf_dir)
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    stream.replay(source, stream.distinct_events, str(tmp_path / "out"), str(tmp_path / "c1"))
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("event_id").collect()) == sorted(r[0] for r in batch.select("event_id").collect())
    query = stream.latest_state(source).writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True)
    query.option("checkpointLocation", str(tmp_path / "c2")).start().awaitTermination()
    got = {tuple(r)[:4] for r in spark.table("latest").collect()}
    assert got == {tuple(r)[:4] for r in stream.latest_state(batch).collect()}
    stream.follow(source, ["event_id"], str(tmp_path / "feed"), str(tmp_path / "c3")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "feed")).count() == batch.count()


def test_entry_without_the_training_data_operators(monkeypatch):
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert "god_nodes" in entry.queries() and not any(n.startswith("op") for n in entry.queries())
