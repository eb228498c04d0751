"""Periodic runs, ball k-means and personal data against brute force and SQL, on the smallest tables and on odd rows."""

import hashlib
import re

import numpy as np
import pytest
from compare import difference
from pyspark.sql import functions as F

from graphloom.llm import ball_kmeans, periodic, queries, weak_pii

ODD = "doc_id bigint, text string, id int, runs int, kept string, base int, candidates int, spans string, n_words int"


def odd_rows(texts):
    return [(i if i != 3 else None, t, 0, 0, "k", 0, 0, "s", 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ODD)


def plain_runs(words, least=12):
    """All maximal runs, place by place."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def plain_kept(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]


def test_runs_of_random_and_periodic_words():
    rng = np.random.default_rng(3)
    found = 0
    for trial in range(300):
        words = rng.integers(0, rng.integers(1, 6), rng.integers(0, 120)).tolist()
        if trial % 3 == 0:
            p = int(rng.integers(1, 30))
            words += (words[:p] or [0]) * 4 + words[: p // 2]
        want = plain_runs(words)
        got = periodic.find_runs(periodic.word_numbers(words))
        assert got == want, words
        assert np.flatnonzero(~periodic.dropped(len(words), got)).tolist() == [i for i in range(len(words)) if not any(s + q <= i < s + n for s, n, q in want)]
        found += len(want)
    assert found > 150


@pytest.mark.parametrize("kinds", [1, 2, 40, 1500])
def test_lags_are_counted_alike_by_both_ways(kinds, monkeypatch):
    """Frequent words by transforms, rare ones by differences, in small and large lots: the count is that of all pairs."""
    rng = np.random.default_rng(kinds)
    ids = periodic.word_numbers((rng.zipf(1.3, 3000) % kinds).tolist())
    want = [0] + [int((ids[:-q] == ids[q:]).sum()) for q in range(1, 1501)]
    assert periodic.lag_matches(ids).tolist() == want
    monkeypatch.setattr(periodic, "PAIRS", 7)
    assert periodic.lag_matches(ids).tolist() == want


def test_long_islands_are_found_by_probes():
    rng = np.random.default_rng(0)
    block = rng.integers(0, 9, 700).tolist()
    words = rng.integers(0, 9, 5000).tolist() + block * 3 + rng.integers(0, 9, 3000).tolist() + [1] * 4000
    ids = periodic.word_numbers(words)
    got = periodic.find_runs(ids)
    want = {}
    for q in range(1, len(ids) // 2 + 1):
        step = np.diff(np.concatenate([[0], (ids[:-q] == ids[q:]).astype(int), [0]]))
        for start, end in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()):
            if end - start >= max(q, 12 - q):
                want.setdefault((start, end + q), q)
    assert got == sorted((s, e - s, q) for (s, e), q in want.items())
    assert any(q == 700 and n >= 2100 for _, n, q in got) and any(q == 1 and n >= 4000 for _, n, q in got)


def test_a_text_of_one_word_a_million_times():
    assert periodic.find_runs(np.zeros(1_000_000, np.int32)) == [(0, 1_000_000, 1)]


def test_collapse_of_odd_rows(spark, empty):
    texts = [None, "", " \n\t ", "a b " * 10, "a b " * 10, "x y " * 13, "ä " * 12 + "z", "a " * 11, "one two three four five six " * 2 + "end", "w " * 50_000]
    rows = periodic.collapse_runs(spark.createDataFrame(odd_rows(texts), ODD).repartition(3)).collect()
    assert len(rows) == len(texts) and sum(r.doc_id is None for r in rows) == 1
    want = sorted((len(w), plain_runs(w) if len(w) < 1000 else [(0, len(w), 1)], w) for w in ((t or "").encode().split() for t in texts))
    for r, (n, runs, words) in zip(sorted(rows, key=lambda r: (r.n_words, [tuple(x) for x in r.runs])), want):
        assert (r.n_words, [tuple(x) for x in r.runs]) == (n, runs)
        if n < 1000:
            assert r.kept.encode() == b" ".join(plain_kept(words, runs))
        else:
            assert r.kept == "w"
    assert periodic.collapse_runs(empty).count() == 0


def test_op11_equals_its_sql(spark, sf_dir):
    assert difference(queries.op11_periodic_runs(spark, sf_dir), queries.OP11_SQL, sf_dir) == ""


def plain_means(v, starts, rounds):
    c = [list(map(int, s)) for s in starts]
    for _ in range(rounds):
        a = [min(range(len(c)), key=lambda j: (sum((int(x) - y) ** 2 for x, y in zip(p, c[j])), j)) for p in v]
        for j in range(len(c)):
            mine = [p for p, k in zip(v, a) if k == j]
            if mine:
                c[j] = [int(sum(int(p[d]) for p in mine)) // len(mine) for d in range(len(c[j]))]
    d = [[sum((int(x) - y) ** 2 for x, y in zip(p, w)) for w in c] for p in v]
    return [min(range(len(c)), key=lambda j: (r[j], j)) for r in d], [min(r) for r in d], c


@pytest.mark.parametrize("spread", [2, 40, 3000])
def test_balls_compare_less_and_give_the_same(spread):
    """Rounds by balls equal the full comparison, ties on small grids too, and separate clusters need few comparisons."""
    rng = np.random.default_rng(spread)
    k = 6
    v = np.concatenate([rng.integers(-20, 21, (60, 3)) + rng.integers(-spread, spread + 1, 3) for _ in range(k)])
    balls = ball_kmeans.Balls([x.tolist() for x in v[rng.permutation(len(v))[:k]]])
    cluster, far = ball_kmeans.nearest(v, balls)
    total = 0
    for _ in range(8):
        means = [(v[cluster == c].sum(0) // (cluster == c).sum()).tolist() if (cluster == c).any() else balls.centroids[c] for c in range(k)]
        balls = balls.moved(means, [int(far[cluster == c].max(initial=0)) for c in range(k)])
        cluster, far, compared = ball_kmeans.reassign(v, cluster, balls)
        want = ball_kmeans.nearest(v, balls)
        assert cluster.tolist() == want[0].tolist() and far.tolist() == want[1].tolist()
        assert all((far[cluster == c] <= ((v[cluster == c] - balls.centroids[c]) ** 2).sum(1).max(initial=0)).all() for c in range(k))
        total += compared
    assert total < 8 * len(v) * (k - 1) * (0.5 if spread > 100 else 1)


def test_clusters_of_odd_rows(spark):
    bad = [None, [1.0] * 3, [1.0, None, 0.0, 0.0], [float("nan"), 1.0, 0.0, 0.0], [float("inf"), 1.0, 0.0, 0.0], [1e30, 0.0, 0.0, 0.0], []]
    rng = np.random.default_rng(1)
    good = [(i // 2 if i % 7 else None, rng.normal(size=4).round(1).tolist()) for i in range(60)] + [(100 + i, [0.5, -0.5, 0.25, 0.0]) for i in range(200)]
    rows = [(i, x, 0, 0, 0) for i, x in good + list(enumerate(bad))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, id int, v int, cluster int").repartition(5)
    order = F.sha2(F.concat(F.lit("3:"), F.col("id").cast("string")), 256)
    got = ball_kmeans.clusters(df, 4, order, k=5, rounds=4).collect()
    v = [(i, [int(np.floor(1024 * x)) for x in e]) for i, e in good]
    named = sorted(v, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cluster, far, centroids = plain_means([x for _, x in v], [x for _, x in named[:5]], 4)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    inertia = [sum(d for d, k in zip(far, cluster) if k == c) for c in range(5)]
    want = sorted((repr(i), c, d, inertia[c], sum(far), digest[c]) for (i, _), c, d in zip(v, cluster, far))
    assert sorted((repr(r.vec_id), *r[1:]) for r in got) == want
    assert ball_kmeans.clusters(df.limit(0), 4, order).count() == 0
    few = ball_kmeans.clusters(df.where("vec_id = 100"), 4, order).collect()
    assert len(few) == 1 + sum(i == 100 for i, _ in good) - 1 and few[0].distance == 0 and few[0].cluster == 0


def test_op12_equals_its_sql(spark, sf_dir):
    assert difference(queries.op12_ball_kmeans(spark, sf_dir), queries.op12_sql(), sf_dir) == ""


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 // 10 + int(c) * 2 % 10 for i, c in enumerate(digits[::-1])) % 10 == 0


def plain_base(text):
    out = []
    for nth, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip":
                good = all(int(p) <= 255 for p in m[0].split("."))
            else:
                good = kind == "email" or (kind == "card" and 12 <= len(digits) <= 19 and plain_luhn(digits)) or (kind == "phone" and 9 <= len(digits) <= 15)
            if good:
                out.append((m.start(), nth, m.end(), kind))
    return sorted(out)


def digest_of(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


def test_base_spans_of_random_texts():
    rng = np.random.default_rng(5)
    bits = ["a", "b@", "@", ".", "-", "+", "1", "22", "255", "256", "4111 1111 1111 1111", "x.y", "(", ")", " ", "  ", "7", "000", "\n", "é", "_", "%", "4", ".1.2.3", "+1 (", "555-", "0000000"]
    for _ in range(10_000):
        text = "".join(rng.choice(bits, rng.integers(1, 25)))
        base, found = weak_pii.spans_in(text)
        assert [(b["start"], b["kind"], b["end"], weak_pii.KINDS[b["kind"]]) for b in base] == plain_base(text), text
        assert all(not (f["start"] < b["end"] and b["start"] < f["end"]) for f in found if f["kind"] >= 4 for b in base)


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1 " * 200_000, "@" * 300_000, "a@b" * 100_000, "+1(" * 100_000, "1." * 100_000, "Aa " * 100_000])
def test_long_texts_take_linear_time(text):
    base, found = weak_pii.spans_in(text)
    assert len(base) + len(found) <= 60_000


def test_op13_against_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op13_personal_data(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 0
    for r in rows:
        want = plain_base(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for *_, x in want) for k in BASE]
        assert r.base_sha256 == hashlib.sha256(digest_of(want).encode()).hexdigest()
        spans = [x for x in r.spans.split(",") if x]
        assert ",".join(x for x in spans if x.split(":")[0] in BASE) == digest_of(want)
        if not re.search("[0-9@]", texts[r.doc_id]):
            assert not spans


def planted(rng, n):
    """Texts with one candidate each and whether it is personal data."""
    given, last = ["Maria", "Peter", "Sarah"], ["Kovacs", "Okafor", "Lindt"]
    digit = lambda k: "".join(map(str, rng.integers(1, 10, k)))
    makers = [
        (lambda: f"please call ({digit(3)}) {digit(3)}-{digit(4)} today", True), (lambda: f"order {digit(3)} {digit(3)} {digit(4)}7x shipped", False),
        (lambda: f"release 000-{digit(2)}-{digit(4)} is out", False), (lambda: f"her ssn {digit(3)}-{digit(2)}-{digit(4)} is on file", True),
        (lambda: f"name: {rng.choice(given)} {rng.choice(last)} signed", True), (lambda: f"at {rng.choice(given)} University campus", False),
        (lambda: f"contact joe{digit(2)} [at] gmail [dot] com now", True), (lambda: f"token {digit(16)} was hashed", False),
        (lambda: f"write to a{digit(3)}@gmail.com please", True), (lambda: f"host {digit(2)}.{digit(2)}.{digit(2)}.{digit(2)} is up", True),
    ]
    picks = [makers[i] for i in rng.integers(0, len(makers), n)]
    return [(f"lorem ipsum {make()} dolor sit", truth) for make, truth in picks]


def test_votes_classifier_and_reliabilities(spark):
    rng = np.random.default_rng(11)
    known, held = planted(rng, 1500), planted(rng, 500)
    df = lambda rows: spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id bigint, text string").repartition(4)
    found = weak_pii.find(df(known))
    model = weak_pii.train(found)
    reliability = dict(zip(weak_pii.LABELERS, model.labels.reliability))
    assert reliability["check"] > 0.9 and reliability["cue"] > 0.8 and reliability["counter_cue"] > 0.7
    assert np.allclose(weak_pii.train(found).weights, model.weights)
    bounded = weak_pii.train(found, sample=200)
    for m in (model, bounded):
        rows = {r.id: r.spans for r in weak_pii.decide(weak_pii.find(df(held)), m).collect()}
        right = sum(bool(rows[i]) == truth for i, (_, truth) in enumerate(held))
        assert right / len(held) > (0.95 if m is model else 0.9)
    assert {s.kind for spans in rows.values() for s in spans} >= {"phone_local", "national_id", "person", "email_spelled", "email", "ip"}


def test_estimation_finds_planted_reliabilities():
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.4
    real = np.array([0.95, 0.9, 0.85, 0.75, 0.65, 0.9, 0.8])
    votes = np.where(rng.random((20_000, 7)) < real, 1, -1) * np.where(truth, 1, -1)[:, None] * (rng.random((20_000, 7)) < 0.7)
    pattern, count = np.unique(votes, axis=0, return_counts=True)
    model = weak_pii.estimate(np.zeros(len(pattern), int), pattern, count)
    assert np.abs(model.reliability - real).max() < 0.03 and abs(model.prior[0] - 0.4) < 0.02
    for p in pattern[:50]:
        assert weak_pii.votes_of(weak_pii.pattern_of(p.tolist())) == p.tolist()


def test_personal_data_of_odd_rows(spark, empty):
    texts = [None, "", "nothing here", "a@b.co", "a@b.co", "tel 555-123-4567, +49 (89) 1234567 1234567890123456", "é" * 1000 + " 10.0.0.1", "Dr. Smith Jones", "x" * 3_000_000 + "@y.z"]
    rows = weak_pii.personal_data(spark.createDataFrame(odd_rows(texts), ODD).repartition(2)).collect()
    assert len(rows) == len(texts) and sum(r.doc_id is None for r in rows) == 1
    for r in rows:
        text = texts[3 if r.doc_id is None else r.doc_id] or ""
        assert [(s.start, s.nth, s.end, s.kind) for s in r.spans if not s.added] == plain_base(text if len(text) < 10**6 else "") or len(text) > 10**6
        assert len(text) < 10**6 or [(s.start, s.end) for s in r.spans] == [(0, len(text))]
        assert [(s.start, s.nth) for s in r.spans] == sorted((s.start, s.nth) for s in r.spans)
    assert weak_pii.personal_data(empty).count() == 0
