"""Sources and parsers against small files and plain Python."""

import json
import math
import uuid

import pytest
from pyspark.sql import functions as F

from graphloom.operators import ingest
from graphloom.sources import files


def test_walk_and_json(spark, tmp_path):
    for name, body in {"a.py": b"x = 1", "lib/b.py": b"\xff ok", "lib/deep/c.sql": b"z", "lib/empty.py": b"", "lib/b.txt": b"no", "skip/d.py": b"y"}.items():
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_bytes(body)
    got = files.walk(spark, str(tmp_path / "tree"), ("**/*.py", "**/*.sql"), ("skip/**",)).orderBy("path").collect()
    assert [(r["path"], r["size"]) for r in got] == [("a.py", 5), ("lib/b.py", 4), ("lib/deep/c.sql", 1)]
    assert [r["text"] for r in got] == ["x = 1", "� ok", "z"]
    (tmp_path / "q.json").write_text(json.dumps([{"id": "1", "names": ["a", "b"]}, {"id": "2", "names": []}]))
    assert [tuple(r) for r in files.json_table(spark, str(tmp_path / "q.json"), "id string, names array<string>").orderBy("id").collect()] == [("1", ["a", "b"]), ("2", [])]


def test_declarations(spark):
    rows = [("src/app.rs", "pub struct No {}\nstruct Yes {}\n  export async function go() {}\nclass Yes:\n# def not_here\n"), ("e.py", ""), ("n.py", None)]
    got = ingest.declarations(spark.createDataFrame(rows, "path string, text string")).collect()
    assert [tuple(r) for r in got] == [("src/app.rs", 0, "Yes", "app.Yes"), ("src/app.rs", 1, "go", "app.go")]


def test_table_links(spark):
    script = """-- create table no (x int);
CREATE TABLE IF NOT EXISTS shop.users (id INT PRIMARY KEY);
create table orders (id int, uid int, foreign key (uid) references shop.users (id));
CREATE OR REPLACE VIEW report AS SELECT * FROM orders o JOIN users u ON o.uid = u.id; /* create view no as select 1 */
create table users (again int);"""
    got = ingest.table_links(spark.createDataFrame([("s.sql", script), ("e.sql", ""), ("n.sql", None)], "path string, text string")).collect()
    assert {tuple(r)[1:] for r in got} == {("users", None, None), ("orders", "Access", "users"), ("report", "Realization", "orders"), ("report", "Realization", "users")}


def test_data_uri(spark):
    df = spark.createDataFrame([("data:image/png;base64,aGk=",), ("nothing",), (None,)], "u string").select(ingest.parse_data_uri(F.col("u")).alias("d"))
    a, b, c = [r["d"] for r in df.collect()]
    assert (a["mime"], bytes(a["content"])) == ("image/png", b"hi") and b is None and c is None


def test_catalogue_ids(spark):
    rows = [("entries/1", "x/spanner-table", None, None, None, None), (None, "spanner-table", "q", None, None, None), ("e2", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "entry_name string, entry_type string, qualified_name string, resource string, display_name string, description string")
    got = {r["entry_name"]: (r["status"], r["node_id"]) for r in ingest.catalogue_import(df).collect()}
    assert got == {"entries/1": ("imported", str(uuid.uuid5(uuid.NAMESPACE_DNS, "entries/1"))), None: ("failed", None), "e2": ("skipped", None)}


def test_uncertainty(spark):
    cases = [[[0.0, 0.0], [0.0, -50.0]], [], [[None], []], [[-1.0, -2.0, None]]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s array<array<double>>").orderBy("i")
    got = [r[0] for r in df.select(ingest.uncertainty(F.col("s"))).collect()]
    p = 1 / (1 + math.exp(-1))
    want = [math.log(2) / 2 / math.log(5), 0.5, 0.5, -(p * math.log(p) + (1 - p) * math.log(1 - p)) / math.log(5)]
    assert got == pytest.approx(want, abs=1e-9)


def test_rules_of_a_file_run_like_the_fixed_ones(spark, tmp_path):
    from graphloom.operators import rules
    from graphloom.registry import RULES
    from graphloom.sources.files import conformance_rules

    (tmp_path / "rules.json").write_text(json.dumps(RULES))
    read = conformance_rules(spark, str(tmp_path / "rules.json"))
    assert read == sorted(RULES, key=lambda r: r["rule_id"])
    nodes = spark.createDataFrame([("a", "DataObject", "A")], "node_id string, node_type string, name string")
    edges = spark.createDataFrame([], "source_id string, source_type string, target_id string, target_type string, rel_type string, confidence string")
    docs, met = spark.createDataFrame([(1,)], "doc_id long"), spark.createDataFrame([], "doc_id long, node_id string")
    got = {r.rule_id: r.n_violations for r in rules.conformance(nodes, edges, docs, met, read).collect()}
    assert got == {r["rule_id"]: 0 for r in RULES} | {"ARCH-004": 1, "QUAL-001": 1, "COMP-001": 1, "COMP-002": 3}
    (tmp_path / "twice.json").write_text(json.dumps(RULES[:1] * 2))
    with pytest.raises(ValueError):
        conformance_rules(spark, str(tmp_path / "twice.json"))


def test_images_follow_the_text(spark):
    from graphloom.operators.ingest import image_chunks

    chunks = spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, chunk_index int")
    images = spark.createDataFrame([(1, 5, 2, "u", " a cat "), (1, 3, None, "v", ""), (2, 1, 1, None, None)], "doc_id long, position int, page int, image_uri string, caption string")
    got = sorted((r.doc_id, r.chunk_index, r.chunk_text) for r in image_chunks(chunks, images).collect())
    assert got == [(1, 2, "[Image from page ?]"), (1, 3, "[Image from page 2] a cat"), (2, 0, "[Image from page 1]")]


def test_python_modules(spark):
    from graphloom.operators.code import python_modules

    source = """'''about'''
import os, a.b
import os
from . import near
from c.d import e
LIMIT = LOW = 3
low = _NO = 1
@router.post("/x")
@app.get("/never")
async def make(): pass
class K(base.B, metaclass=M):
    \"\"\"a class\"\"\"
    @app.get(path)
    def m(self):
        def inner(): pass
if True:
    def deeper(): pass
"""
    rows = [("src/p/q.py", source), ("lib/p/__init__.PY", None), ("app\\\\r.py", "def ("), ("a.txt", "x"), (None, "x"), ("deep.py", "(" * 5000)]
    got = {r.path: r for r in python_modules(spark.createDataFrame(rows, "path string, text string")).collect()}
    one = got["src/p/q.py"]
    assert (one.module_name, one.doc, one.imports, one.constants) == ("p.q", "about", ["os", "a.b", "c.d"], ["LIMIT", "LOW"])
    assert [(c.name, c.bases, c.doc) for c in one.classes] == [("K", ["base.B"], "a class")]
    assert (one.functions, [tuple(r) for r in one.routes], one.error) == (["make", "K.m"], [("POST /x: make", "make"), ("GET : m", "K.m")], None)
    assert len(got) == 4 and got["lib/p/__init__.PY"].error is None and got["app\\\\r.py"].error == "SyntaxError" and got["deep.py"].error


def test_categories_and_layers(spark):
    df = spark.createDataFrame([("Business",), ("Physical",), (None,)], "x string").select(ingest.category_of(F.col("x")).alias("c"))
    assert [tuple(r) for r in df.select("c", ingest.layer_of_category(F.col("c"))).collect()] == [("business", "Business"), (None, None), (None, None)]


def test_markdown_titles_and_paragraphs(spark):
    from graphloom.operators.code import markdown_pages

    rows = [
        ("a.md", "# T \nright below\n\nrest"), ("b.MD", "intro\n  # Late\nmore"), ("c.markdown", "## only\n\n#hash\n\n"), ("d.md", None), ("e.txt", "# no"),
        ("f.md", "x" * 2000),
    ]
    got = [tuple(r) for r in markdown_pages(spark.createDataFrame(rows, "path string, text string")).orderBy("path").collect()]
    assert got == [("a.md", "T", "right below"), ("b.MD", "Late", "intro"), ("c.markdown", "c.markdown", ""), ("d.md", "d.md", ""), ("f.md", "f.md", "x" * 1000)]
