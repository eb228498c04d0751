"""Batches in tiers: orphans are refused and named, a repeated batch changes nothing, a later one replaces its keys."""

import pytest

from graphloom.operators import tiers
from graphloom.operators.tiers import Tier

DOCS, CHUNKS = Tier("documents", ("doc_id",)), Tier("chunks", ("chunk_id",), {"doc_id": "documents"})
MENTIONS = Tier("mentions", ("chunk_id", "name"), {"chunk_id": "chunks"})
ALL = [DOCS, CHUNKS, MENTIONS]


def test_batches_in_tiers(spark, tmp_path):
    doc, chunk, mention = "doc_id int, title string", "chunk_id string, doc_id int", "chunk_id string, name string"
    frame, path = spark.createDataFrame, str(tmp_path)
    rows = lambda t, kind: sorted(map(tuple, tiers.current(spark, path, t, frame([], kind).schema).collect()))
    assert rows(DOCS, doc) == []
    first = {"documents": frame([(1, "a"), (2, "b")], doc), "chunks": frame([("1:0", 1), ("2:0", 2)], chunk), "mentions": frame([("1:0", "x")], mention)}
    for _ in range(2):
        tiers.write(first, path, ALL, 1)
        assert rows(DOCS, doc) == [(1, "a"), (2, "b")] and rows(CHUNKS, chunk) == [("1:0", 1), ("2:0", 2)]
    # parents may be there already; a batch with orphans changes no table
    tiers.write({"documents": frame([(2, "new")], doc), "chunks": frame([("1:1", 1)], chunk)}, path, ALL, 2)
    bad = {"documents": frame([(3, "c")], doc), "chunks": frame([("3:0", 3), ("9:0", 9), ("8:0", 8), ("n", None)], chunk), "mentions": frame([("3:0", "y"), ("zz", "y")], mention)}
    with pytest.raises(tiers.OrphanRows, match="3 rows of chunks have no parent by doc_id, such as 8; 1 rows of mentions .* such as zz"):
        tiers.write(bad, path, ALL, 3)
    with pytest.raises(tiers.OrphanRows, match="such as 7:7"):
        tiers.write({"mentions": frame([("1:1", "z"), ("7:7", "z")], mention)}, path, ALL, 3)
    assert rows(DOCS, doc) == [(1, "a"), (2, "new")] and rows(CHUNKS, chunk) == [("1:0", 1), ("1:1", 1), ("2:0", 2)]
    kept = tiers.admitted(bad, ALL)
    assert kept["chunks"].collect() == [("3:0", 3)] and kept["mentions"].collect() == [("3:0", "y")]
    tiers.write(kept, path, ALL, 3)
    assert rows(MENTIONS, mention) == [("1:0", "x"), ("3:0", "y")]
