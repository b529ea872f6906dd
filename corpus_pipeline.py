"""Corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Every stage works on all rows that the one before kept, and returns the columns of documents; the last
returns what was written: doc_id, start, n_tokens, ids_crc32 and n_symbols.

Cases: a row is judged by itself, so that a null or repeated doc_id takes no other row with it; null and empty texts
are neither toxic, nor copies, nor contaminated, take part in the mix with no words and end as their end id; extra
columns go with their rows up to the last stage; an empty table goes through empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from provlake.llm.decontaminate import drop_contaminated
from provlake.llm.mixing import mix_documents
from provlake.llm.near_dup import keep_one
from provlake.llm.queries import tokenizer_path
from provlake.llm.token_output import token_output
from provlake.llm.toxicity import drop_toxic
from provlake.llm.workspace import Workspace


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network rejects go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: the least doc_id. Shingles of five words, 0.8."""
    return keep_one(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix_documents(docs, percent=150, weights=(5, 2, 1), most=2)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, read back."""
    return token_output(docs, tokenizer_path(), end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", tokens),
]
#: No SQL says what the stages do; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return docs
