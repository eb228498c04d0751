"""An evaluation run on small lists, against plain Python over each limit."""

import random

from graphloom.operators import runs


def _plain(want, chunks, vector, texts, limit, top):
    def recall(ids):
        text = "\n".join(texts[c].lower() for c in ids)
        return sum(e.lower() in text for e in want) / len(want) if want else 1.0

    shown, pool = recall(chunks[:limit][:top]), recall(chunks[:limit])
    bucket = "none_expected" if not want else "hit" if shown == 1 else "below_top_k" if pool == 1 else "capped" if len(chunks) >= limit else "never_in_pool"
    graph, base = (int(1000 * x + 0.5 + 1e-9) for x in (shown, recall(vector[:top])))
    return limit, len(want), len(chunks), graph, base, graph - base, bucket


def test_all_limits_follow_from_first_ranks(spark):
    rng = random.Random(7)
    names = ["Ada", "bo", "ceph", "d'Eon", "zz"]
    texts = {f"c{i}": " ".join(rng.choice([*names, "x", "ADA", "nothing"]) for _ in range(rng.choice([0, 1, 3]))) for i in range(30)}
    made, expected, pool, vector = {}, [], [], []
    for q in (f"q{i}" for i in range(25)):
        want, chunks, near = set(rng.sample(names, rng.randrange(4))), rng.sample(sorted(texts), rng.randrange(12)), rng.sample(sorted(texts), rng.randrange(6))
        made[q] = want, chunks, near
        expected += [(q, e) for e in want] * 2  # rows may repeat
        pool += [(q, c, i) for i, c in enumerate(chunks, 1)]
        vector += [(q, c, i) for i, c in enumerate(near, 1)]
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    listed = "query_id string, chunk_id string, rank int"
    e, t = frame(expected, "query_id string, entity string"), frame(list(texts.items()) + [("odd", None)], "chunk_id string, chunk_text string")
    records = runs.recorded(frame([(q,) for q in made], "query_id string"), e, frame(pool, listed), frame(vector, listed), t, 3)
    rows = runs.at_limits(records, (1, 3, 5, 20), 3)
    got = {(r.query_id, r.cap): tuple(r)[1:] for r in rows.collect()}
    want = {(q, n): _plain(*m, texts, n, 3) for q, m in made.items() for n in (1, 3, 5, 20)}
    assert got == want and len({x[-1] for x in want.values()}) == 5
    table = {r.cap: r for r in runs.sweep(rows).collect()}
    for n in (1, 3, 5, 20):
        mine = [x for (_, cap), x in want.items() if cap == n]
        assert table[n].n_hit == sum(x[-1] == "hit" for x in mine) and table[n].n_helped == sum(x[5] > 0 for x in mine)
        assert abs(table[n].uplift - sum(x[5] for x in mine) / 25) <= 0.5 and sum(table[n][c] for c in ("n_hit", "n_capped", "n_below", "n_never", "n_none")) == 25
    arms = {r.arm: r for r in runs.arms(rows.where("cap = 5"), e).collect()}
    assert [a for a in arms if arms[a].winner] == ["constant"] and arms["oracle"].score == 1.0  # all five names are shown to every question
    assert runs.sweep(runs.at_limits(records.limit(0))).count() == 0
