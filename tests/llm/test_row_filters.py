"""The filter stages judge rows: a null or repeated doc_id takes no other row with it."""

import duckdb
import pyarrow as pa

from provlake.llm import decontaminate, near_dup, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string"
A, B, C = (" ".join(f"{w}{i}" for i in range(40)) for w in ("alpha", "beta", "gamma"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_drop_toxic_by_row(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 60)
    texts = [t for (t,) in duckdb.sql(f"select text from '{SF}/documents.parquet' order by doc_id limit 60").fetchall()]
    docs = [(i, t, "a") for i, t in enumerate(texts)] + [(1000 + i, f"zorg{i} is zorg{i} {texts[i][:400]}", "a") for i in range(30)]
    labels = spark.createDataFrame([(d, int(d >= 1000)) for d, *_ in docs], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(spark.createDataFrame(docs, SCHEMA), labels)
    score, *_ = toxicity.score_texts(model, pa.array([t for _, t, _ in docs]))
    assert score.max() > score.min()
    # the most toxic text and the cleanest one, under no doc_id and under one
    extra = [(d, docs[i][1], "x") for d in (None, 7000) for i in (score.argmin(), score.argmax())]
    want = [r for r, s in zip(docs, score, strict=True) if s < score.max()] + [extra[0], extra[2]]
    got = toxicity.drop_toxic(spark.createDataFrame(docs + extra, SCHEMA), labels, threshold=float(score.max()) - 1e-9)
    assert rows(got) == sorted((r for r in want if r[1] != extra[1][1]), key=str)


def test_drop_contaminated_by_row(spark):
    bench = spark.createDataFrame([(1, A)], "item_id long, text string")
    docs = [(None, A, "a"), (None, B, "a"), (5, A, "a"), (5, B, "a"), (6, C, "a"), (6, None, "a")]
    assert rows(decontaminate.drop_contaminated(spark.createDataFrame(docs, SCHEMA), bench)) == sorted((r for r in docs if r[1] != A), key=str)


def test_keep_one_by_row(spark):
    docs = [(1, A, "a"), (9, A, "a"), (9, B, "a"), (20, B, "a"), (30, C, "b"), (30, C, "a"), (40, "", "a"), (41, None, "a"), (None, A, "a"), (None, A, "b")]
    want = [(1, A, "a"), (9, B, "a"), (30, C, "a"), (40, "", "a"), (41, None, "a"), (None, A, "a"), (None, A, "b")]
    assert rows(near_dup.keep_one(spark.createDataFrame(docs, SCHEMA))) == sorted(want, key=str)


def test_components_with_a_hub(spark):
    """A centre of 20,000 edges, chains and pairs, against a plain union."""
    import random

    from provlake.llm.components import connected_components
    from provlake.llm.workspace import Workspace

    rng = random.Random(2)
    edges = [(0, i) for i in range(1, 20001)] + [(30000 + i, 30001 + i) for i in range(300)] + [(40000 + rng.randrange(400), 40000 + rng.randrange(400)) for _ in range(250)] + [(5, 5)]
    rng.shuffle(edges)
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "hub")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "hub")).count() == 0


def test_join_hot_is_a_join(spark):
    from provlake.llm.workspace import join_hot

    left = spark.createDataFrame([(i % 7 if i % 3 else 1, i) for i in range(3000)] + [(None, -1)], "k long, x long")
    right = left.groupBy("k").count().filter("k <> 3").selectExpr("k", "count as c", "k * 10 as y")
    want = rows(left.join(right.drop("c"), "k"))
    assert rows(join_hot(left, right, "k", "c", 3001)) == want and rows(join_hot(left, right, "k", "c", 10**9)) == want


def test_components_of_stars_take_no_round(spark, monkeypatch):
    """Edges that are stars already are the result; others take as many rounds as bring them there, and none to see it."""
    from provlake.llm import components
    from provlake.llm.workspace import Workspace

    rounds, step = [], components._large_star
    monkeypatch.setattr(components, "_large_star", lambda *a: rounds.append(1) or step(*a))
    for edges, most in (([(2, 1), (3, 1), (9, 7)], 0), ([(3, 1), (3, 2)], 1), ([(2, 1), (3, 2), (4, 3), (5, 5)], 2)):
        rounds.clear()
        found = components.connected_components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "stars")).collect()
        assert {r.node: r.component for r in found} == {n: 7 if n in (7, 9) else 1 for e in edges for n in e if n != 5}
        assert len(rounds) <= most
