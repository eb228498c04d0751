"""Plans whose tasks must not grow with the input, and the usual line beside the odd one."""

import sys
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[1])]

from compare import rows_of_frame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from graphloom.functions import text  # noqa: E402
from graphloom.operators import graph  # noqa: E402
from graphloom.plans import catalogue  # noqa: E402
from graphloom.sources import tables  # noqa: E402


def test_usual_lines_are_cut_like_odd_ones(spark):
    """An arrow in the target's name sends a line the long way, but for that name the results are the same."""
    labels = ["", "[]", "[x]", "[inferred]", "[x,INFERRED]", "[ambiguous , y]", "[,x]", "[x,]", "[inferred,extracted]", "[x,y]", "[x,y,inferred]", "[x", "]", "[x]]", " [x]", "[a[b,c]"]
    rows = [f"{s}->{r}{b}->{t}" for s in ("A:a", "A:a:b", "A:", ":a", "A1:a", "A") for r in ("Flow", "", "Fl0w") for b in labels for t in ("B:b", "B:", "", "b")]
    df = spark.createDataFrame([(r,) for r in rows], "line string")
    odd = F.concat("line", F.lit("->x"))
    got = df.select(text.parse_edge(F.col("line")).alias("a"), text.parse_edge(odd).alias("b"), "line").collect()
    known = 0
    for r in got:
        a, b = (x and x.asDict() for x in (r.a, r.b))
        if r.line.endswith("B:"):
            assert a is None  # the odd line's target has a name
        elif a is None:
            assert b is None, r.line
        else:
            assert a | {"target_name": a["target_name"] + "->x"} == b, r.line
            known += 1
    assert known > 20
    plan = text.parse_edge(F.col("line"))
    assert df.where(plan.isNotNull()).count() == known
    first = df.select(plan.alias("e"))._jdf.queryExecution().optimizedPlan().toString()
    assert first.index("CASE WHEN") < first.index("lambda")  # the long way is a branch


def test_edges_are_grouped_in_tasks_of_bounded_rows(spark, sf_dir, monkeypatch):
    before = rows_of_frame(tables.edges(spark, sf_dir))
    monkeypatch.setattr(tables, "GROUP_ROWS", 100)
    after = tables.edges(spark, sf_dir)
    assert rows_of_frame(after) == before
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert after.rdd.getNumPartitions() >= 2 * (items // 100)


def test_typed_chains_write_the_edges_once(spark, sf_dir, monkeypatch):
    from graphloom.plans import evaluation

    written = []
    for module in (graph, evaluation):
        real = getattr(module, "materialize", None)
        monkeypatch.setattr(module, "materialize", lambda df, real=real: written.append(df.columns) or real(df), raising=False)
    catalogue.queries()["typed_chains"](spark, sf_dir)
    assert sum("rel_type" in c for c in written) == 1


def test_within_makes_no_row_of_a_pair(spark):
    """Of 300 by 300 vectors in one narrow cone, small tiles hand on a few rows of each left one; unreachable and missing labels, and vectors of one direction, are right too."""
    import numpy as np

    from graphloom.operators import index

    rng = np.random.default_rng(8)
    cone = np.ones(6) + 0.2 * rng.normal(size=(600, 6))
    rows = [(i, 1, x.tolist()) for i, x in enumerate(cone)] + [(1000 + i, 2, [float(1 + i), 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(40)]
    rows += [(2000, 2, [0.0, -1.0, 0.0, 0.0, 0.0, 0.0]), (2001, 9, [1.0] * 6), (2002, None, [1.0] * 6), (2003, None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").repartition(3)
    v = {i: (g, np.array(x, np.float32).astype(float)) for i, g, x in rows}
    want = {}
    for i, (g, x) in v.items():
        near = [(round(1 - float(x @ y) / float(np.linalg.norm(x) * np.linalg.norm(y)), 6), j) for j, (h, y) in v.items() if i % 2 and not j % 2 and g is not None and g == h]
        if near and min(near)[0] < 0.15:
            want[i] = min(near)
    for tile in (10_000, 50):
        found = index.within(df.where("vec_id % 2 = 1"), df.where("vec_id % 2 = 0"), 0.15, "label", rows=tile)
        got = {r.left_id: (r.distance, r.right_id) for r in found.collect()}
        assert got.keys() == want.keys() and len(want) > 300
        assert all(abs(got[i][0] - want[i][0]) < 2e-6 and (got[i][1] == want[i][1] or abs(got[i][0] - want[i][0]) > 0) for i in want)
        assert all(got[i] == (0.0, 1000) for i in range(1001, 1040, 2))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "MapInArrow _" not in plan
