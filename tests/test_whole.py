"""Whole rankings against plain versions."""

import duckdb
import numpy as np

from pyspark.sql import functions as F

from provlake.functions.plugins import hashed_embedding
from provlake.operators import retrieval as V
from provlake.queries import QUERIES

SF = "/root/testdata/sf0.001"


def ranking():
    """query_id -> (q_label, [(id, label, sim)] of all other vectors, best first)"""
    rows = duckdb.sql(f"select vec_id, embedding, label from '{SF}/embeddings.parquet' order by vec_id").fetchall()
    e = np.array([r[1] for r in rows], np.float64)
    out = {}
    for i, (q, _, label) in enumerate(rows):
        if q % 100 == 0:
            sim = np.round(e @ e[i], 6)
            out[q] = (label, sorted(((r[0], r[2], s) for r, s in zip(rows, sim, strict=True) if r[0] != q), key=lambda x: (-x[2], x[0])))
    return out


def test_rank_of_ref_beyond_the_first_eight(spark):
    want = {q: next((k for k, x in enumerate(rows, 1) if x[1] == label), None) for q, (label, rows) in ranking().items()}
    assert max(want.values()) > 8
    assert {r.query_id: r.first_rank for r in QUERIES["rank_of_ref"](spark, SF).collect()} == want


def test_follow_refs_takes_from_all_rows_named(spark):
    want = {q: [x[0] for x in rows if x[1] in (1, 3)][:4] for q, (_, rows) in ranking().items()}
    got: dict = {q: [] for q in want}
    for r in sorted(QUERIES["follow_refs"](spark, SF).collect(), key=lambda r: r.rank):
        got[r.query_id].append(r.id)
    assert got == want


def plain_hybrid(spark, queries, documents, k=8):
    """Whole rankings of every document, built in full, by the definition."""
    scores = {(r.query_id, r.doc_id): round(r.score, 9) for r in V.bm25_scores(queries, documents).collect()}
    vectors = lambda df: {r[0]: np.array(r[1], np.float64) for r in df.select(df.columns[0], hashed_embedding(F.col("text"))).collect() if r[1] is not None}
    e, qe, ids = vectors(documents), vectors(queries), [r[0] for r in documents.select("doc_id").collect()]
    out = {}
    for (q,) in queries.select("query_id").collect():
        lexical = sorted(ids, key=lambda i: (-scores.get((q, i), 0.0), i))
        dense = sorted(e, key=lambda i: (-np.round(qe[q] @ e[i], 6), i)) if q in qe else []
        places = [{i: r for r, i in enumerate(x, 1)} for x in (lexical, dense)]
        total = {i: sum(round(1e12 / (60 + p[i])) for p in places if i in p) for i in ids}
        seen = lambda i: min((n, p[i]) for n, p in enumerate(places) if i in p)  # noqa: E731, B023
        out[q] = [(i, total[i] / 1e12) for i in sorted(ids, key=lambda i: (-total[i], seen(i), i))[:k]]
    return out


def as_lists(df):
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.id, r.score))
    return out


def test_hybrid_topk_fuses_whole_rankings(spark):
    queries = spark.read.parquet(f"{SF}/benchmark.parquet").selectExpr("item_id as query_id", "text")
    assert as_lists(QUERIES["hybrid_topk"](spark, SF)) == plain_hybrid(spark, queries, spark.read.parquet(f"{SF}/documents.parquet"))


def test_hybrid_ranks_documents_without_a_term_too(spark):
    docs = [(i, f"w{i % 7} x{i} common" if i % 3 else f"y{i}") for i in range(200)] + [(500, None), (501, "")]
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    queries = spark.createDataFrame([(3, "w1 w2 x4"), (4, "x100"), (5, "absent"), (6, "common"), (7, None)], "query_id long, text string")
    assert as_lists(V.hybrid(queries, documents, hashed_embedding)) == plain_hybrid(spark, queries, documents)
