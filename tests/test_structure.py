"""A small regulation, parsed and cut to chunks, against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from provlake.config import Config
from provlake.functions import text as T
from provlake.operators import chunking as C
from provlake.operators import structure as X
from provlake.plans.ingest import chunk_documents

TEXT = """REGULATION (EU) 2024/1 OF THE PARLIAMENT
of 13 June 2024 laying down harmonised rules on tests and their plain versions
THE EUROPEAN PARLIAMENT AND THE COUNCIL OF THE EUROPEAN UNION,
Having regard to the Treaty,
Whereas:
(1) First recital
goes on.
(2) OJ C 517, 22.12.2021, p. 56.
(2) Second.
(4) Out of turn.
(3)
(3) Judgment of the Court.
(3) Third.
HAVE ADOPTED THIS REGULATION:
CHAPTER I
GENERAL - PART
Article 1
Subject
1. One.
2. Two's Article 10(2), point (a),
more   spaced.
SECTION 1
Sec
Article 2
Only a body
here.
CHAPTER II
OTHER
Article 47a
Defs
(1) alpha
(2) beta
ANNEX I
List
1. item
ANNEX II
"""
PREAMBLE = TEXT.split("\n(1)")[0]


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_units(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "no structure"), (3, None), (4, "(1) only\nHAVE ADOPTED THIS REGULATION")], "doc_id long, text string")
    got = rows(X.parse_units(docs).orderBy("doc_id", "unit_ord"), "doc_id", "unit_ord", "type", "number", "paragraph", "title", "chapter", "section", "citation", "breadcrumb", "text")
    head = PREAMBLE.split("\n")
    title = "Title and recitations"
    want = [(1, i, "Preamble", "0", None, title, "", "", "Preamble", "", t) for i, t in enumerate(["\n".join(head[:2]), *head[2:]])]
    want += [(1, 4 + i, "Recital", str(i), None, None, "", "", f"Recital {i}", "", t) for i, t in ((1, "(1) First recital\ngoes on."), (2, "(2) Second."), (3, "(3) Third."))]
    want = [(d, k, *r[2:]) for k, (d, _, *r) in enumerate((w[0], w[1], None, *w[2:]) for w in want) for r in [(None, None, *r[1:])]]
    ch1, ch2 = "I - GENERAL - PART", "II - OTHER"
    one = "Chapter I: GENERAL - PART\nArticle 1: Subject"
    defs = "Chapter II: OTHER\nArticle 47a: Defs"
    rest = [
        ("Article", "1", "1", "Subject", ch1, "", "Article 1(1)", one, "1. One."),
        ("Article", "1", "2", "Subject", ch1, "", "Article 1(2)", one, "2. Two's Article 10(2), point (a),\nmore   spaced."),
        ("Article", "2", None, "Only a body", ch1, "1 - Sec", "Article 2", "Chapter I: GENERAL - PART\nSection 1: Sec\nArticle 2: Only a body", "Only a body\nhere."),
        ("Article", "47a", "1", "Defs", ch2, "", "Article 47a(1)", defs, "1. alpha"),
        ("Article", "47a", "2", "Defs", ch2, "", "Article 47a(2)", defs, "2. beta"),
        ("Annex", "I", "1", "List", "", "", "Annex I(1)", "Annex I: List", "1. item"),
    ]
    want += [(1, len(want) + i, *r) for i, r in enumerate(rest)]
    want.append((4, 0, "Recital", "1", None, None, "", "", "Recital 1", "", "(1) only"))
    assert got == want


def test_chunks_merge_ranges(spark):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    got = rows(chunk_documents(docs, Config(window=200, overlap=20)).orderBy("chunk_ord"), "chunk_id", "citation", "text")
    assert [c for _, c, _ in got] == ["Preamble", "Recitals 1-3", "Article 1(1-2)", "Article 2", "Article 47a(1-2)", "Annex I(1)"]
    assert [i for i, _, _ in got] == ["preamble-0", "recital-1-3", "article-1-1-2", "article-2", "article-47a-1-2", "annex-I-1"]
    assert got[0][2] == PREAMBLE
    assert got[1][2] == "(1) First recital\ngoes on.\n\n(2) Second.\n\n(3) Third."
    assert got[2][2] == "Chapter I: GENERAL - PART\nArticle 1: Subject\n1. One.\n\n2. Two's Article 10(2), point (a),\nmore   spaced."
    none = chunk_documents(docs, Config(window=200, overlap=20, packing="none"))
    assert none.count() == 13 and none.filter("type = 'Preamble'").count() == 4
    semantic = {r.citation for r in chunk_documents(docs, Config(window=200, overlap=20, packing="semantic")).collect()}
    assert "Annex I(1)" in semantic and len(semantic) >= 6


TOKEN = re.compile(r"[A-Za-z0-9]+|[^ \t\n\x0b\f\rA-Za-z0-9]")


def plain_windows(text, budget):
    spans = [m.span() for m in TOKEN.finditer(text)]
    if len(spans) <= budget:
        return [text]
    return [text[spans[i][0] : spans[min(i + budget, len(spans)) - 1][1]] for i in range(0, len(spans), budget)]


def plain_tail(text, n):
    spans = [m.span() for m in TOKEN.finditer(text)]
    return text[spans[max(0, len(spans) - n)][0] : spans[-1][1]]


def test_windows_and_tails_are_slices(spark):
    rng = random.Random(5)
    texts = ["Article 10(2), point (a): it's \n\n fine", "x", "a " * 30] + ["".join(rng.choice(["ab", "C3", " ", "  ", "\n", ",", "(", "é", "中", "'", "\t"]) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    texts = [t for t in texts if TOKEN.search(t)]
    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id int, unit_ord int, text string")
    got: dict = {}
    for r in sorted(C.token_windows(df, 7).collect(), key=lambda r: (r.doc_id, r.part or 0)):
        got.setdefault(r.doc_id, []).append(r.body)
    assert got == {i: plain_windows(t, 7) for i, t in enumerate(texts)}
    tails = {r.doc_id: r.t for r in df.select("doc_id", T.tail(F.col("text"), 5).alias("t")).collect()}
    assert tails == {i: plain_tail(t, 5) for i, t in enumerate(texts)}


@pytest.mark.parametrize("n,share", [(1, 0.5), (2, 0.5), (5, 0.25), (1000, 0.5), (999, 0.9)])
def test_share_threshold_is_the_exact_percentile(spark, n, share):
    import numpy as np

    rng = random.Random(n)
    values = [rng.choice([rng.uniform(-1, 1), 0.25, 0.2500001]) for _ in range(n)]
    got, count = C.share_threshold(spark.createDataFrame([(v,) for v in [*values, None]], "sim double"), "sim", share)
    assert count == n and got == pytest.approx(float(np.percentile(values, 100 * share)), abs=1e-15)
    assert C.share_threshold(spark.createDataFrame([], "sim double"), "sim", share) == (None, 0)
