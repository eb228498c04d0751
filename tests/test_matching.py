"""Terms in texts and the best texts of each question against plain Python, and sizes that must not multiply."""

import random

import pytest

from graphloom.functions import matching
from graphloom.operators import expansion, retrieval


def test_names_stand_anywhere(spark, monkeypatch):
    """Names of one to over twenty bytes, blanks alone, overlaps of rows, texts longer than a lot, slices of names."""
    monkeypatch.setattr(matching, "BYTES", 300)
    rng = random.Random(3)
    letters = ["a", "b", "ñ", "Ab", " ", "\n", "日"]
    texts = {f"t{i}": "".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 40, 700]))) for i in range(60)}
    names = {"".join(rng.choice(letters) for _ in range(n)) for n in (*range(1, 9), 10, 20) for _ in range(12)} | {" ", "", "  ", "bañ" * 9}
    texts["end"] = "x" + "bañ" * 9
    df = spark.createDataFrame([*texts.items(), ("null", None)], "chunk_id string, chunk_text string").repartition(3)
    wanted = spark.createDataFrame([(n,) for n in [*names, None]], "name string")
    want = {(k, n.lower()) for k, t in texts.items() for n in names if n and n.lower() in t.lower()}
    assert len(want) > 300
    for most in (100_000, 20):
        got = [tuple(r) for r in retrieval.containing(df, wanted, most_names=most).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert retrieval.containing(df, wanted.limit(0)).count() == 0


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("questions", [10_000, 3])
def test_the_best_chunks_of_each_question(spark, monkeypatch, whole, questions):
    """More matches than are kept, ties by document and place, small lots and slices of questions, questions without keywords."""
    monkeypatch.setattr(matching, "PAIRS", 64)
    rng = random.Random(5)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(2, 4))) for _ in range(40)]
    chunks = [(f"{d}:{i}", d, i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))).title()) for d in range(150) for i in range(2)]
    asked = [(f"q{i}", rng.sample(sorted(set(words)), i % 6)) for i in range(12)]
    c = spark.createDataFrame(chunks, "chunk_id string, doc_id bigint, chunk_index int, chunk_text string").repartition(4)
    q = spark.createDataFrame(asked, "query_id string, keywords array<string>")
    want = set()
    for name, keywords in asked:
        hits = []
        for k, d, i, t in chunks:
            n = sum((w in t.lower().split()) if whole else (w in t.lower()) for w in keywords)
            hits += [(-n, d, i, k)] if n else []
        want |= {(name, k, -n, r) for r, (n, _, _, k) in enumerate(sorted(hits)[:7], 1)}
    monkeypatch.setattr(retrieval.most_matched, "__defaults__", (questions,))
    got = (retrieval.keyword_ranks if whole else retrieval.keyword_ranks_like)(q, c, 7).collect()
    assert len(got) == len(want) and {(r.query_id, r.chunk_id, r.n_matched, r.rank) for r in got} == want
    assert retrieval.keyword_ranks(q.limit(0), c).count() == 0


@pytest.mark.parametrize("shape", ["matches at once", "a word that all ask for"])
def test_a_task_holds_few_matches_at_once(monkeypatch, shape):
    """One batch that meets all questions: neither its matches nor the terms met that are asked by many are held at once."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(matching, "PAIRS", 256)
    held, real_add, real_spans = [], matching._Best.add, matching.spans
    if shape == "matches at once":
        monkeypatch.setattr(matching._Best, "add", lambda self, question, *more: held.append(self.size + len(question)) or real_add(self, question, *more))
    else:
        monkeypatch.setattr(matching, "spans", lambda starts, counts: held.append(counts.sum()) or real_spans(starts, counts))
    terms, questions, rows = [f"t{i}" for i in range(8)], [f"q{i}" for i in range(16)], 900
    texts = [" ".join(terms[: 1 + i % 8]).split() for i in range(rows)]
    batch = pa.RecordBatch.from_arrays([pa.array([f"{i}:0" for i in range(rows)]), pa.array(range(rows)), pa.array([0] * rows, pa.int32()), pa.array(texts)], ["chunk_id", "doc_id", "chunk_index", "_held"])
    find = matching.words_finder(pa.array(terms))
    out = pa.Table.from_batches(matching.best_of(find, pa.array(questions), np.arange(0, 129, 16), np.tile(np.arange(16), 8), 5)(iter([batch])))
    want = {(q, f"{i}:0", 8) for q in questions for i in range(7, 40, 8)}
    assert {(r["query_id"], r["chunk_id"], r["n_matched"]) for r in out.to_pylist()} == want and out.num_rows == 80
    assert 0 < max(held) <= 256 + 2 * 5 * 16


@pytest.mark.parametrize("finder", [matching.names_finder, matching.substring_finder])
def test_the_searches_of_a_run_hold_few_matches_at_once(monkeypatch, finder):
    """Names and keywords within texts, as an evaluation run looks them up: one batch is looked through in parts, and its matches are kept in lots."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(matching, "PAIRS", 256)
    held, looked, real = [], [], matching._Best.add
    monkeypatch.setattr(matching._Best, "add", lambda self, question, *more: held.append(len(question)) or real(self, question, *more))
    texts = [" ".join(f"name{j}" for j in range(1 + i % 3)) for i in range(2500)]
    batch = pa.RecordBatch.from_arrays([pa.array([f"{i}:0" for i in range(2500)]), pa.array(range(2500)), pa.array([0] * 2500, pa.int32()), pa.array(texts)], ["chunk_id", "doc_id", "chunk_index", "_held"])
    find = finder(pa.array([f"name{j}" for j in range(3)]))
    met = lambda column: looked.append(len(column)) or find(column)
    questions = pa.array([f"q{i}" for i in range(40)])
    out = pa.Table.from_batches(matching.best_of(met, questions, np.arange(0, 121, 40), np.tile(np.arange(40), 3), 2)(iter([batch])))
    assert {(r["query_id"], r["chunk_id"], r["n_matched"]) for r in out.to_pylist()} == {(q, f"{i}:0", 3) for q in questions.to_pylist() for i in (2, 5)}
    assert max(held) <= 256 and max(looked) <= 1000


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_matches_of_questions_and_chunks_never_become_rows(spark):
    """Neither every run of four characters nor every pair of a question and a chunk is a row of a join."""
    c = spark.createDataFrame([("1:0", 1, 0, "alpha beta")], "chunk_id string, doc_id bigint, chunk_index int, chunk_text string")
    q = spark.createDataFrame([("q", ["alpha"])], "query_id string, keywords array<string>")
    m = spark.createDataFrame([("n", 1, "1:0", 0)], "node_id string, doc_id bigint, chunk_id string, chunk_index int")
    e = spark.createDataFrame([("q", "n")], "query_id string, node_id string")
    for df in (retrieval.keyword_ranks(q, c), retrieval.keyword_ranks_like(q, c), expansion.expanded_chunks(e, m), retrieval.containing(c, q.selectExpr("'alpha' AS name"))):
        assert "Join" not in _plan(df) and df.count() == 1


def test_a_task_hands_on_its_own_nearest_only(monkeypatch):
    """Small lots of rows, as many queries make them: what leaves a task does not grow with its lots, and equals are all there."""
    import numpy as np
    import pyarrow as pa

    from graphloom.functions import vectors

    monkeypatch.setattr(vectors, "PAIRS", 64)
    rng = np.random.default_rng(2)
    x, asked = rng.normal(size=(2000, 4)), rng.normal(size=(16, 4))
    x[500:520] = asked[3]
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    for within, group in (((), np.zeros(2000, int)), (("label",), np.arange(2000) % 3)):
        batches = [pa.RecordBatch.from_arrays([pa.array(range(a, a + 250)), pa.array(group[a : a + 250]), pa.array(x[a : a + 250].tolist())], ["vec_id", "label", "embedding"]) for a in range(0, 2000, 250)]
        out = pa.Table.from_batches(vectors._near(unit(asked), pa.array(range(16)), 5, within)(iter(batches)))
        far, got = 1 - unit(x) @ unit(asked).T, set(zip(out["query_id"].to_pylist(), out["vec_id"].to_pylist()))
        for q in range(16):
            for g in set(group):
                mine = np.flatnonzero(group == g)
                assert {(q, int(i)) for i in mine[far[mine, q] <= np.sort(far[mine, q])[4] + 1e-9]} <= got
        assert out.num_rows <= 16 * 5 * len(set(group)) * 3


def test_entities_named_in_chunks_are_counted_inside_tasks(spark):
    """Names of several words, in any case, two nodes of one name, blanks at both ends: as by mentions that are rows, without any."""
    rng = random.Random(11)
    words = ["alpha", "Beta", "gamma", "alphabet", "delta"]
    texts = [(f"{d}:0", d, 0, rng.choice(["", " ", "\n"]) + rng.choice([" ", "\t", "  "]).join(rng.choice(words) for _ in range(rng.randint(0, 6)))) for d in range(120)]
    c = spark.createDataFrame([*texts, ("900:0", 900, 0, None)], "chunk_id string, doc_id bigint, chunk_index int, chunk_text string").repartition(3)
    names = ["Alpha", "alpha", "beta gamma", "gamma", "alpha beta delta", "pha", "delta ", "", None, " beta", "del\tta"]
    nodes = spark.createDataFrame([(f"n{i}", n) for i, n in enumerate(names)], "node_id string, name string")
    asked = spark.createDataFrame([(f"q{q}", f"n{i}") for q in range(9) for i in rng.sample(range(len(names)), 5)] * 2, "query_id string, node_id string")
    met = retrieval.mentions(c, nodes).join(c.select("chunk_id", "chunk_index"), "chunk_id")
    want = {tuple(r) for r in expansion.expanded_chunks(asked, met).collect()}
    found = expansion.naming_chunks(asked, nodes, c)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 60
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    assert expansion.naming_chunks(asked.limit(0), nodes, c).count() == 0


def test_edges_of_other_sources_go_before_they_are_grouped(spark, sf_dir):
    from graphloom.plans import hybrid

    some = spark.createDataFrame([("b:1",), ("b:7",), ("b:1",)], "source_id string")
    links = hybrid._links(spark, sf_dir, some)
    whole = hybrid._links(spark, sf_dir).where("source_id IN ('b:1', 'b:7')")
    assert sorted(map(tuple, links.collect())) == sorted(map(tuple, whole.collect())) != []
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [s#") < plan.index("LeftSemi")  # the join is below, so before, the grouping
    graph = hybrid.graph_expansion(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in graph and "doc_id = doc_id" not in graph


@pytest.mark.parametrize("rows", [1_000, 2])
def test_only_listed_chunks_leave_their_table(spark, rows):
    c = spark.createDataFrame([(f"{i}:0", f"text {i}") for i in range(40)], "chunk_id string, chunk_text string").repartition(3)
    lists = {k: spark.createDataFrame([(f"q{i}", f"{i * step % 40}:0", 1) for i in range(9)], "query_id string, chunk_id string, rank int") for k, step in (("vector", 3), ("graph", 7))}
    ids = {f"{i * step % 40}:0" for i in range(9) for step in (3, 7)}
    assert sorted(map(tuple, retrieval.listed(lists, c, rows).collect())) == sorted((i, f"text {i[:-2]}") for i in ids)


def test_a_search_writes_its_chunks_once_and_moves_no_text(spark, sf_dir, monkeypatch):
    from graphloom.plans import hybrid

    written = []
    real = hybrid.materialize
    monkeypatch.setattr(hybrid, "materialize", lambda df: written.append(df) or real(df))
    texts, lists, _, _ = hybrid.search_lists(spark, sf_dir)
    whole = [df for df in written if "chunk_text" in df.columns]
    assert [sorted({"stored", "embedded"} & set(df.columns)) for df in whole] == [[], []]  # all chunks, and those of the lists
    assert all("Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString() for df in whole)
    assert texts.count() == retrieval.candidates(lists).select("chunk_id").distinct().count()


def test_query_variants_ask_all_conversations(spark, sf_dir):
    """Conversations whose number isn't divisible by 100 have their chunks too."""
    from graphloom.plans import catalogue

    asked = {str(r.conv_id) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user' AND text IS NOT NULL").select("conv_id").distinct().collect()}
    found = catalogue.queries()["query_variants"](spark, sf_dir)
    assert {r.conv_id for r in found.select("conv_id").distinct().collect()} == asked and len(asked) > 10
    assert "% 100" not in catalogue.oracle_sql()["query_variants"]


@pytest.mark.parametrize("within", [(), ("label",)])
def test_many_queries_meet_vectors_in_tiles(spark, monkeypatch, within):
    """Several tiles and slices, of unlike size, small lots of rows, equals, odd vectors on both sides: as with queries in every task, and no pair is a row."""
    import numpy as np

    from graphloom.functions import vectors

    rng = np.random.default_rng(6)
    rows = [(f"v{i}", int(i % 3), rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(500)]
    odd = [("null", 0, None), ("zero", 0, [0.0] * 6), ("short", 1, [1.0]), ("nan", 2, [float("nan")] * 6), ("hole", 2, [1.0, None, 1.0, 1.0, 1.0, 1.0]), ("inf", 0, [float("inf")] * 6)]
    v = spark.createDataFrame(rows + odd, "vec_id string, label int, embedding array<double>").repartition(3)
    q = v.where("vec_id LIKE '%7' OR vec_id IN ('null', 'zero', 'short')").selectExpr("vec_id AS query_id", "embedding AS query")
    want = sorted(map(tuple, vectors.nearest(q, v, 4, within).collect()))
    assert len(want) == len(rows) // 10 * 4 * (3 if within else 1)
    for name, value in {"TILE_QUERIES": 7, "SLICE_ROWS": 90, "TILE_ROWS": 60, "PAIRS": 64}.items():
        monkeypatch.setattr(vectors, name, value)
    got = vectors.nearest(q, v, 4, within, small=5)
    plan = _plan(got)
    assert "Join" not in plan and sorted(map(tuple, got.collect())) == want


def test_distances_of_whole_numbers_round_as_in_sql(spark):
    """Distances that end in a half behind the sixth digit."""
    import duckdb

    from graphloom.functions import vectors

    rows = [(i, [float(a), float(b), float(c), 1.0]) for i, (a, b, c) in enumerate((a, b, c) for a in range(-8, 9, 3) for b in range(9) for c in range(7))]
    v = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    q = spark.createDataFrame([(0, [8.0, 0.0, 0.0, 0.0]), (1, [5.0, 5.0, 3.0, 1.0])], "query_id int, query array<double>")
    got = {(r.query_id, r.vec_id): r.distance for small in (5, 0) for r in vectors.nearest(q, v, 1000, small=small).collect()}
    sql = "SELECT round(list_cosine_distance(?::DOUBLE[], ?::DOUBLE[]), 6)"
    asked = {r.query_id: r.query for r in q.collect()}
    con = duckdb.connect()
    assert all(got[k, i] == con.execute(sql, [x, asked[k]]).fetchone()[0] for k in asked for i, x in rows)


def test_copies_of_a_vector_are_not_handed_on_to_all_queries(monkeypatch):
    """Of many equal vectors a task hands on the first ones by id, as text or number, whatever the order they come in."""
    import numpy as np
    import pyarrow as pa

    from graphloom.functions import vectors

    monkeypatch.setattr(vectors, "PAIRS", 640)
    rng = np.random.default_rng(3)
    asked = rng.normal(size=(20, 4))
    x = np.concatenate([np.repeat(asked[:2] + 0.1, 1500, 0), rng.normal(size=(300, 4))])
    for ids in (rng.permutation(len(x)), np.array([f"v{i}" for i in rng.permutation(len(x))])):
        batches = [pa.RecordBatch.from_arrays([pa.array(ids[a : a + 500]), pa.array(x[a : a + 500].tolist())], ["vec_id", "embedding"]) for a in range(0, len(x), 500)]
        out = pa.Table.from_batches(vectors._near(asked, pa.array(range(20)), 3, (), False)(iter(batches)))
        unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
        far = np.round(1 - unit(x) @ unit(asked).T, 9)
        got = {}
        for q, i, d in zip(*(out.column(c).to_pylist() for c in ("query_id", "vec_id", "distance"))):
            got.setdefault(q, []).append((round(d, 9), i))
        assert {q: sorted(r)[:3] for q, r in got.items()} == {q: sorted(zip(far[:, q].tolist(), ids.tolist()))[:3] for q in range(20)}
        assert out.num_rows <= 20 * 3 * 2
