from graphloom.llm import near_dup


def test_the_prefix_does_not_depend_on_a_sample(spark, monkeypatch):
    """Many texts with partners that are all the same: nothing of them is measured, the formula at the threshold holds."""
    seen, real = [], near_dup.prefix_depth
    monkeypatch.setattr(near_dup, "prefix_depth", lambda measured, *a: seen.append((measured, real(measured, *a))) or seen[-1][1])
    words = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(i, f"{words} x{i}") for i in range(300)], "doc_id bigint, text string")
    got = near_dup.near_duplicates(df).collect()
    assert seen == [([], 6)]
    assert {(r.group_id, r.n_links) for r in got} == {(0, 299)}
