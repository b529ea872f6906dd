"""Both grammars on their unit tables: fixed texts and what they name. The grammars differ on purpose."""

import pytest
from pyspark.sql import functions as F

from provlake.functions import refs as R
from provlake.functions import text as T

#: Questions and their references in the strict grammar.
STRICT = [
    ("what does article 97 talk about?", "article 97"), ("summarize Article 112", "article 112"), ("what does Annex 11 talk about?:", "annex XI"),
    ("explain annex III and annex iv", "annex III, annex IV"), ("recitals 24, 25 and article 2", "article 2, recital 24, recital 25"),
    ("articles 9 to 12", "article 10, article 11, article 12, article 9"), ("article 10(2) on bias", "article 10"), ("art. 5 prohibitions", "article 5"),
    ("Chapter III Section 4", "chapter III, section 4"), ("what does the preamble say", "preamble 0"), ("how many annexes do we have?", ""),
    ("what article talks about AI literacy?", ""), ("which section talks about notifying everyone?", ""), ("annex civil liability", ""), ("what is an AI system", ""),
    ("annexes III and IV", "annex III, annex IV"),
]
#: Citations and their references in the loose grammar.
LOOSE = [
    ("article 13", "article 13"), ("Article 13(a)", "article 13"), ("article 10(2), 10(5)", "article 10"), ("Recital 24, 25, article 2", "article 2, recital 24, recital 25"),
    ("annex 3, Article 9-15, 16", "annex 3, article 9, article 10, article 11, article 12, article 13, article 14, article 15, article 16"),
    ("Section 4, article 28", "article 28"), ("artcile 97", "article 97"), ("Annex III(2)", "annex 3"), ("Annex VIII", "annex 8"), ("Article 71, Annex 8", "annex 8, article 71"),
    ("preamble 0", "preamble 0"), ("Preamble", "preamble 0"), ("", ""), ("annex civil liability", "annex 143"), ("articles 9 to 12", "article 9, article 12"),
]
CITATIONS = [("Article 70(1-5)", ("article", 70, ["1", "2", "3", "4", "5"])), ("Annex III(2)", ("annex", 3, ["2"])), ("Recitals 1-2", ("recital", 1, [])), ("Article 47a", None), ("see Article 5", None), (" Article 5 ", ("article", 5, [])), (None, None)]


@pytest.mark.parametrize("parse,cases", [(R.parse_question, STRICT), (R.parse_refs, LOOSE)])
def test_grammar(spark, parse, cases):
    named = F.array_join(F.transform(parse(F.col("text")), lambda r: F.concat_ws(" ", r["kind"], r["num"].cast("string"))), ", ")
    rows = spark.createDataFrame([(t,) for t, _ in cases], "text string").select("text", named.alias("refs")).collect()
    assert {r.text: r.refs for r in rows} == dict(cases)


def test_citation_detail(spark):
    rows = spark.createDataFrame([(t,) for t, _ in CITATIONS], "text string").select("text", R.citation_detail(F.col("text")).alias("c")).collect()
    assert {r.text: r.c and (r.c.kind, r.c.num, sorted(r.c.labels)) for r in rows} == dict(CITATIONS)


#: Rows and the ids that a question names, in the order of the rows.
PROVISIONS = [("a3", "Article", "3", "I - x", ""), ("a30", "Article", "30", "III - x", "4 - y"), ("a36", "Article", "36", "III - x", "4 - y"), ("a50", "Article", "50", "V - x", "4 - y"), ("r24", "Recital", "22-25", "", ""), ("x11", "Annex", "XI", "", ""), ("p0", "Preamble", "0", "", "")]
NAMED = [("recital 24", ["r24"]), ("section 4", ["a30", "a36", "a50"]), ("chapter III section 4", ["a30", "a36"]), ("chapter 3", ["a30", "a36"]), ("annex 11 and the preamble", ["p0", "x11"]), ("article 3", ["a3"]), ("nothing", [])]


def test_metadata_match(spark):
    chunks = spark.createDataFrame(PROVISIONS, "chunk_id string, type string, number string, chapter string, section string")
    asked = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NAMED)], "query_id int, text string")
    refs = asked.select("query_id", F.explode(R.parse_question(F.col("text"))).alias("r")).select("query_id", "r.*")
    found = R.match_provisions(chunks, refs)
    got: dict = {i: [] for i in range(len(NAMED))}
    for r in found.collect():
        got[r.query_id].append(r.chunk_id)
    assert [sorted(got[i]) for i in range(len(NAMED))] == [want for _, want in NAMED]
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_model_answers(spark):
    said = ['```json\n{"score": 1}\n``` and {"score": 0}', 'x {"score": "0"} y', '{"score": 7}', "no object", '{"score": null}', '{"score": 0.9}', '{"score": "high"}', None]
    rows = spark.createDataFrame(list(enumerate(said)), "i int, text string").withColumn("s", F.get_json_object(T.json_object(F.col("text")), "$.score"))
    none = F.lit(None).cast("string")
    got = [(r.v, r.r) for r in rows.select("i", T.verdict(F.col("s"), none).alias("v"), T.verdict_reason(F.col("s"), none).alias("r")).orderBy("i").collect()]
    assert got == [(1, None), (0, None), (None, "score out of range: 7"), (None, "no score"), (None, "no score"), (0, None), (None, "score is not a number: high"), (None, "no score")]
    assert spark.range(1).select(T.verdict_reason(F.lit("1"), F.lit("down"))).first()[0] == "error: down"
