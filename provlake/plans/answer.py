"""From questions to evidence, for many questions at once: pinned rows, rewrites, fusion, gate, picks, context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.refs import match_provisions, parse_question
from ..functions.text import ordered_block
from ..operators import retrieval as V


def pinned_rows(questions: DataFrame, chunks: DataFrame, similar: DataFrame, most: int) -> DataFrame:
    """Rows of the provisions that questions name, best first. similar: query_id, id, sim over all chunks asked for."""
    refs = questions.select("query_id", F.explode(parse_question(F.col("text"))).alias("r")).select("query_id", "r.*")
    named = match_provisions(chunks, refs).select("query_id", F.col("chunk_id").alias("id"))
    return V.top_ranked(similar.join(named, ["query_id", "id"], "left_semi"), most, score="sim", id_col="id")


def evidence(original: DataFrame, rewrites: DataFrame, pinned: DataFrame, cap: int = 10) -> DataFrame:
    """Original and rewritten searches (query_id, list_idx, rank, id, sim) fused, after the pinned rows, capped."""
    fused = V.rrf(original.select("query_id", "list_idx", "rank", "id").unionByName(rewrites.select("query_id", "list_idx", "rank", "id"))).withColumnRenamed("score", "sim")
    return V.priority_union(pinned, fused, cap, "metadata", "similarity")


def reflect(pool: DataFrame, search, verdicts: DataFrame, rounds: int = 2) -> DataFrame:
    """Grow the pool of lists by the searches that verdicts (round, query_id, text) ask for; a round without any ends it."""
    for r in range(1, rounds + 1):
        asked = verdicts.filter(F.col("round") == r).select("query_id", "text")
        if asked.isEmpty():
            break
        pool = pool.unionByName(search(asked, r).select(*pool.columns))
    return pool


def context(evidence_rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, context: the chunks' texts under their citations, in order."""
    rows = evidence_rows.join(chunks.select(F.col("chunk_id").alias("id"), "citation", "text"), "id")
    return rows.groupBy("query_id").agg(ordered_block(F.col("rank"), F.concat(F.lit("["), F.col("citation"), F.lit("]")), F.col("text")).alias("context"))


def answer(questions: DataFrame, evidence_rows: DataFrame, generated: DataFrame, threshold: float = 0.45) -> DataFrame:
    """query_id, answer, refused, error, citations, n_excerpts: what a question gets.

    evidence_rows: query_id, rank, sim, retrieved_by, citation; generated: query_id, answer, error, what the model
    said of questions that pass the gate (others are not asked). Citations are those retrieved, also of refusals and
    errors. A question without an answer from the model is an error, as is one that the model failed on.
    """
    from ..functions.text import is_refusal

    gate = V.similarity_gate(questions, evidence_rows, threshold)
    cited = evidence_rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "citation"))).alias("r"))
    said = generated.select("query_id", F.col("answer").alias("_answer"), F.col("error").alias("_error"))
    rows = gate.join(cited, "query_id", "left").join(said, "query_id", "left")
    failed = ~F.col("refuse") & (F.col("_error").isNotNull() | F.col("_answer").isNull())
    return rows.select(
        "query_id",
        F.when(~F.col("refuse") & ~failed, F.col("_answer")).alias("answer"),
        (F.col("refuse") | (~failed & is_refusal(F.col("_answer")))).alias("refused"),
        F.when(failed, F.coalesce("_error", F.lit("no answer"))).alias("error"),
        F.coalesce(F.transform("r", lambda x: x["citation"]), F.expr("cast(array() as array<string>)")).alias("citations"),
        F.coalesce(F.size("r"), F.lit(0)).alias("n_excerpts"),
    )


def fall_back(first: DataFrame, second: DataFrame) -> DataFrame:
    """Answers of the first pipeline; of questions that it failed on those of the second, with fell_back set."""
    failed = first.filter(F.col("error").isNotNull()).select("query_id")
    return first.join(failed, "query_id", "left_anti").withColumn("fell_back", F.lit(False)).unionByName(second.join(failed, "query_id", "left_semi").withColumn("fell_back", F.lit(True)))
