"""Ingest, index, streams and sources end to end on small inputs."""

import pytest
from pyspark.sql import functions as F

from provlake.functions.plugins import hashed_embedding, only_where
from provlake.functions.text import budget_tokens
from provlake.operators import retrieval as V
from provlake.plans.answer import context, evidence, fall_back, pinned_rows, reflect
from provlake.plans.ingest import ChunkConfig, chunk_lines
from provlake.sources import io
from provlake.streaming.ingest import index_stream, stream_documents

SF = "/root/testdata/sf0.001"


def test_chunks_keep_budget_ids_and_overlap(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    config = ChunkConfig(window=120, overlap=20, slack=4)
    chunks = chunk_lines(docs, config).withColumn("n", F.size(budget_tokens(F.col("body")))).cache()
    assert chunks.agg(F.max("n")).first()[0] <= config.budget
    assert chunks.groupBy("doc_id", "chunk_id").count().filter("count > 1").count() == 0
    assert chunks.filter("part is null or part = 1").filter("text <> body").count() == 0
    assert chunks.filter("part >= 2 and not startswith(text, '… ')").count() == 0


def test_index_upsert_and_stream(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").filter("doc_id < 40")
    source, index = f"file://{tmp_path}/in", f"file://{tmp_path}/index"
    docs.repartition(4).write.parquet(source)
    index_stream(stream_documents(spark, source, files_a_batch=1), index, f"file://{tmp_path}/cp").awaitTermination()
    first = io.read_index(spark, index)
    assert first.select("doc_id").distinct().count() == docs.count()
    n = first.count()
    io.upsert_index(first.limit(3).withColumn("text", F.lit("new")), index)
    again = io.read_index(spark, index)
    assert again.count() == n and again.filter("text = 'new'").count() == 3
    io.upsert_index(first.limit(2), index, reset=True)
    assert io.read_index(spark, index).count() == 2


def test_index_pointer_and_parts(spark, tmp_path):
    index = f"file://{tmp_path}/index"
    rows = lambda ids, text: spark.createDataFrame([(f"c{i}", text, None) for i in ids], "chunk_id string, text string, title string")
    io.upsert_index(rows(range(300), "old"), index)
    before = io._pointer(spark, index)
    io.upsert_index(rows([3], "new"), index)
    after = io._pointer(spark, index)
    assert sum(before[p] != after[p] for p in before) == 1  # only the part of the row that changed
    assert {r.text: r["count"] for r in io.read_index(spark, index).groupBy("text").count().collect()} == {"old": 299, "new": 1}
    assert not [f for f in (tmp_path / "index").iterdir() if f.name.startswith(".") and not f.name.endswith(".crc")]


def test_files_and_sheets(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one\x0ctwo")
    pages = io.scan_files(spark, f"file://{tmp_path}/a.bin", lambda data: data.decode().split("\x0c"))
    assert [r.text for r in io.join_pages(pages).collect()] == ["one\ntwo"]
    with pytest.raises(FileNotFoundError):
        io.scan_files(spark, f"file://{tmp_path}/none", lambda data: [])
    (tmp_path / "s.csv").write_text('a,b\n1,x\n ,y\n,z\n')
    assert [r.b for r in io.read_sheet(spark, f"file://{tmp_path}/s.csv").collect()] == ["x"]
    table = spark.createDataFrame([(1, "x")], "a int, b string")
    io.write_report(table, spark.createDataFrame([("m", 1.0, 1)], "metric string, score double, n int"), f"file://{tmp_path}/r")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/r/summary").first().metric == "m"
    (tmp_path / "bad.json").write_text("no json")
    assert io.read_labels(spark, f"file://{tmp_path}/bad.json").count() == 0
    labels = spark.createDataFrame([("e", "q", "k", "l", 1, 0, "r", "keep"), ("e", "p", "k", "l", 1, 1, "r", "delete")], io.LABEL_SCHEMA + ", action string")
    io.write_labels(labels, f"file://{tmp_path}/labels")
    assert [r.question for r in spark.read.schema(io.LABEL_SCHEMA).json(f"file://{tmp_path}/labels").collect()] == ["q"]


def test_answers_fall_back(spark):
    cols = "query_id int, answer string, error string"
    first = spark.createDataFrame([(1, "a", None), (2, None, "down")], cols)
    second = spark.createDataFrame([(1, "b", None), (2, "c", None)], cols)
    assert sorted(map(tuple, fall_back(first, second).collect())) == [(1, "a", None, False), (2, "c", None, True)]


def test_golden_and_labels(spark, tmp_path):
    (tmp_path / "g.csv").write_text('question , should_answer,dataset_split\n" a ""b""\nc ",,"[""base""]"\n,yes,\n')
    (row,) = io.read_golden(spark, f"file://{tmp_path}/g.csv").collect()
    assert (row.question, row.should_answer, row.dataset_split) == ('a "b"\nc', "yes", ["base"])
    assert io.read_labels(spark, f"file://{tmp_path}/none.json").count() == 0
    (tmp_path / "l.json").write_text('[{"experiment": "e", "question": "q", "key": "k", "judge_score": 1}]')
    assert io.read_labels(spark, f"file://{tmp_path}/l.json").first().judge_score == 1


def test_answering(spark):
    chunks = spark.createDataFrame([(i, "Article", str(i), "I - T", "1 - S", f"Article {i}", f"text about word{i}") for i in range(1, 9)], "chunk_id long, type string, number string, chapter string, section string, citation string, text string")
    questions = spark.createDataFrame([(1, "article 3 and word5"), (2, "word7 please")], "query_id long, text string")
    vec = chunks.select(F.col("chunk_id").alias("vec_id"), hashed_embedding(F.col("text")).alias("embedding"))
    asked = questions.select((F.col("query_id") + 1000).alias("query_id"), hashed_embedding(F.col("text")).alias("embedding"))
    found = V.cosine_topk(asked, vec, 8).withColumn("query_id", F.col("query_id") - 1000).withColumn("list_idx", F.lit(0))
    pins = pinned_rows(questions, chunks, found, 6)
    assert [(r.query_id, r.id) for r in pins.collect()] == [(1, 3)]
    verdicts = spark.createDataFrame([(1, 1, "word2")], "round int, query_id long, text string")
    pool = reflect(found, lambda q, r: found.join(q, "query_id", "left_semi").withColumn("list_idx", F.lit(r)), verdicts)
    assert pool.count() == found.count() + 8
    rows = evidence(found, pool.filter("list_idx > 0"), pins, 5)
    text = {r.query_id: r.context for r in context(rows, chunks).collect()}
    assert text[1].startswith("[Article 3]\n") and text[1].count("---") == 4
    gate = {r.query_id: r.refuse for r in V.similarity_gate(questions, rows.withColumn("sim", F.lit(0.1))).collect()}
    assert gate == {1: False, 2: True}
    split = only_where(questions, F.col("query_id") == 1, lambda d: d.withColumn("score", F.lit(1)))
    assert {r.query_id: r.score for r in split.collect()} == {1: 1, 2: None}
