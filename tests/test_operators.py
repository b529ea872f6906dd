"""Unit tables of the operators, and properties that hold for any input."""

import pytest
from pyspark.sql import functions as F

from provlake.functions import refs as R
from provlake.functions import text as T
from provlake.operators import chunking as C
from provlake.operators import labels as L
from provlake.operators import retrieval as V
from provlake.operators import scoring as S

#: expected references, citations in order, (measure, k, value)
PRECISION = [
    (["article 9"], ["recital 1", "recital 2", "recital 3", "recital 4", "recital 5"], [("recall", 5, 0), ("precision", 5, 0)]),
    (["article 9"], ["article 9", "recital 2", "recital 3", "recital 4", "recital 5"], [("recall", 1, 1), ("precision", 1, 1), ("precision", 5, 0.2)]),
    (["article 9"], ["recital 1", "recital 2", "recital 3", "article 9", "recital 5"], [("recall", 1, 0), ("recall", 3, 0), ("recall", 5, 1), ("precision", 5, 0.2)]),
    (["annex 3", "article 9"], ["article 9", "recital 2", "recital 3", "recital 4", "recital 5"], [("recall", 5, 0.5), ("precision", 5, 0.2)]),
    (["article 9"], ["article 9", "article 9", "article 9", "recital 4", "recital 5"], [("recall", 5, 1), ("precision", 5, 0.6), ("precision", 3, 1)]),
    (["article 9"], ["article 9", "recital 2"], [("precision", 5, 0.5), ("recall", 5, 1)]),
]


def test_precision_recall_table(spark):
    ranked = [(i, r, r, ref) for i, (_, got, _) in enumerate(PRECISION) for r, ref in enumerate(got, 1)]
    wanted = [(i, ref) for i, (exp, _, _) in enumerate(PRECISION) for ref in exp] + [(99, "article 1")]
    out = S.precision_recall(spark.createDataFrame(ranked, "query_id int, rank int, id int, ref string"), spark.createDataFrame(wanted, "query_id int, ref string"))
    got = {(r.query_id, r.k): r for r in out.collect()}
    for i, (_, _, checks) in enumerate(PRECISION):
        for what, k, value in checks:
            assert got[i, k][what] == pytest.approx(value, abs=1e-9)
        recalls = [got[i, k].recall for k in S.KS]
        assert recalls == sorted(recalls)
    assert got[99, 5].precision == got[99, 5].recall == 0


def test_judge_rule_table(spark):
    rows = [("x", None, None, None), (None, True, "no", "a"), (None, True, "yes", "a"), (None, False, "no", "a"), (None, False, "yes", ""), (None, False, "yes", "set")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, error string, refused boolean, should string, reference string")
    j = L.judge_rules(F.col("error"), F.coalesce("refused", F.lit(False)), F.col("should"), F.col("reference"), F.lit(True))
    got = [tuple((r.j[k].score, r.j[k].needs_judge) for k in ("groundedness", "relevance", "correctness")) for r in df.select("i", j.alias("j")).orderBy("i").collect()]
    none, ask = (None, False), (None, True)
    assert got == [(none, none, none), ((1, False), (1, False), (1, False)), ((1, False), (0, False), (0, False)), (ask, ask, (0, False)), (ask, ask, none), (ask, ask, ask)]


def test_label_merge_is_idempotent(spark):
    labels = spark.createDataFrame([(1, "l", 0, 1, "r"), (2, "m", 1, 0, "r")], "id int, lesson string, judge_score int, human_score int, judge_reasoning string")
    sheet = spark.createDataFrame([(1, 0, 1, "n"), (2, 1, 1, "n"), (3, 1, 0, "n"), (4, 1, None, "n"), (5, None, None, "n")], "id int, judge int, human int, reasoning string")
    once = L.merge_labels(labels, sheet, ["id"])
    assert {r.id: r.action for r in once.collect()} == {1: "update", 2: "delete", 3: "insert"}
    again = L.merge_labels(once.filter("action <> 'delete'").drop("action"), sheet, ["id"])
    key = lambda d: sorted((r.id, r.lesson, r.judge_score, r.human_score) for r in d.filter("action <> 'delete'").collect())
    assert key(once) == key(again)


def test_packing_keeps_budget_and_roots(spark):
    units = [(1, i, "ab"[i // 5], t, f"u{i}") for i, t in enumerate([10, 20, 30, 5, 5, 60, 1, 1, 100, 2])]
    df = spark.createDataFrame(units, "doc_id int, unit_ord int, root string, n_tokens int, text string")
    out = C.pack_size(df, 50).collect()
    groups: dict = {}
    for r in out:
        groups.setdefault((r.root, r.grp), []).append(r)
    assert sum(map(len, groups.values())) == 10
    for g in groups.values():
        assert len(g) == 1 or sum(r.n_tokens for r in g) + len(g) - 1 <= 50


def test_fusion_does_not_depend_on_row_order(spark):
    rows = [(1, i, r, d) for i in range(3) for r, d in enumerate([(i * 7 + k) % 11 for k in range(8)], 1)]
    a = V.rrf(spark.createDataFrame(rows, "query_id int, list_idx int, rank int, id int"))
    b = V.rrf(spark.createDataFrame(rows[::-1], "query_id int, list_idx int, rank int, id int").repartition(3))
    assert sorted(a.collect()) == sorted(b.collect())


def test_topk_handles_nulls_blocks_and_empty(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8]), (4, None)], "vec_id long, embedding array<float>")
    q = v.filter("vec_id in (1, 2)").withColumnRenamed("vec_id", "query_id")
    whole = sorted(V.cosine_topk(q, v, 2).collect())
    assert [(r.query_id, r.id) for r in whole] == [(1, 2), (1, 3), (2, 1), (2, 3)]
    assert V.cosine_topk(q.limit(0), v, 2).count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("a-\nb\r\n\r\n\r\n\r\nEN 3 EN\n12\nc",)], "t string")
    assert df.select(T.clean_text(F.col("t"))).first()[0] == "ab\n\nc"
    got = spark.createDataFrame([([" a ", "", "b"],)], "x array<string>").select(T.capped_strings(F.col("x"), 1)).first()[0]
    assert got == ["a"]
    assert spark.sql("select 'MCMXCIV' as r").select(R.roman_to_int(F.col("r"))).first()[0] == 1994
    assert spark.sql("select 'IIII' as r").select(R.roman_to_int(F.col("r"))).first()[0] is None
