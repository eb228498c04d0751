"""Cases that the comparison with SQL alone once let pass."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import code, metrics, tables, writes


@pytest.mark.parametrize("order", [["a", "z"], ["z", "a"]])
def test_the_first_of_equal_arms_wins_and_references_do_not_compete(spark, order):
    df = spark.createDataFrame([(0.4, 0.4, 1.0, None), (0.6, 0.6, 1.0, None)], "a double, z double, oracle double, none double")
    got = {r.arm: (r.score, r.is_reference, r.winner) for r in metrics.arm_winner(df, [*order, "none"], ["oracle"]).collect()}
    assert got == {order[0]: (0.5, False, True), order[1]: (0.5, False, False), "none": (None, False, False), "oracle": (1.0, True, False)}


def test_attrition_of_a_pool(spark):
    rows = [
        (False, False, False, 50, "none_expected"), (True, True, True, 50, "hit"), (True, False, True, 50, "below_top_k"), (True, False, True, 5, "below_top_k"),
        (True, False, False, 50, "capped"), (True, False, False, 20, "capped"), (True, False, False, 19, "never_in_pool"),
    ]
    df = spark.createDataFrame(rows, "expected boolean, top boolean, pool boolean, size int, want string")
    found = metrics.attrition(*map(F.col, ("expected", "top", "pool", "size")), 20)
    assert df.where(found != F.col("want")).count() == 0
    cut = metrics.attrition(F.lit(True), F.lit(False), F.lit(False), F.lit(3), 20, F.lit(True))
    assert spark.range(1).select(cut.alias("x")).first().x == "capped"


@pytest.mark.parametrize(
    "name, kind",
    [("billing.war", "Artifact"), ("app.jar", "Artifact"), ("backup.tar", "Artifact"), (".zip bundle", "BusinessObject"), ("éa.ear", "Artifact"),
     ("billing", "BusinessProcess"), ("my app", "ApplicationComponent"), ("hostname", "BusinessObject"), ("mail host", "Node"), ("éhost", "BusinessObject")],
)
def test_names_of_files(spark, name, kind):
    assert spark.range(1).select(text.classify_name(F.lit(name)).alias("x")).first().x == kind


def test_prices_of_calls(spark):
    c = [F.lit(x) for x in (1_000_000, 1_000_000, 400_000, 200_000)]
    got = spark.range(1).select(
        tables.price(*c).alias("a"), tables.price(*c, F.lit("flex")).alias("b"), tables.price(F.lit(5), F.lit(0), F.lit(9)).alias("c"),
        tables.embed_price(F.lit(3), F.lit(False)).alias("d"), tables.embed_price(F.lit(4_000_000), F.lit(True)).alias("e"),
    ).first()
    assert [round(x, 9) for x in got] == [round(0.6 * 0.3 + 1.2 * 2.5, 9), round(0.6 * 0.15 + 1.2 * 1.25, 9), 0, 2e-7, 0.45]


def test_code_graph_of_a_module(spark):
    source = '''
import os
from helpers.db import x
class Box(Base):
    def put(self): pass
    def _drop(self): pass
    def __init__(self): pass
    @router.get("/box")
    def show(self): pass
def make(): pass
@app.post("/x")
def _hidden(): pass
'''
    files = spark.createDataFrame([("src/pkg/m.py", source)], "path string, text string")
    nodes, edges = writes.code_graph(code.python_modules(files))
    assert {(r.node_type, r.name) for r in nodes.collect()} == {
        ("ApplicationComponent", "pkg.m"), ("ApplicationComponent", "pkg.m.Box"), ("ApplicationComponent", "os"), ("ApplicationComponent", "helpers.db"),
        ("ApplicationService", "pkg.m.Box.put"), ("ApplicationService", "pkg.m.Box.show"), ("ApplicationService", "pkg.m.make"),
        ("ApplicationInterface", "GET /box: show"), ("ApplicationInterface", "POST /x: _hidden"),
    }
    assert {(r.source_name, r.rel_type, r.detail, r.target_name) for r in edges.collect()} == {
        ("pkg.m", "Composition", "", "pkg.m.Box"), ("pkg.m", "Composition", "placeholder", "os"), ("pkg.m", "Composition", "placeholder", "helpers.db"),
        ("pkg.m.Box", "Realization", "", "pkg.m.Box.put"), ("pkg.m.Box", "Realization", "", "pkg.m.Box.show"), ("pkg.m", "Realization", "", "pkg.m.make"),
        ("pkg.m.Box.show", "Realization", "", "GET /box: show"), ("pkg.m", "Realization", "", "POST /x: _hidden"),
    }
