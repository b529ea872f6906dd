"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sql import SQL as SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_output import token_output

    return token_output(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op2_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_personal_data, span_digest

    return span_digest(find_personal_data(_table(spark, sf_dir, "documents")))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination_digest, find_contamination

    return contamination_digest(find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import POLICIES, apply_policy, rule_ledger

    ledger = apply_policy(rule_ledger(_table(spark, sf_dir, "documents")), POLICIES["full-1"])
    base = F.col("fail_mask").bitwiseAND(F.lit(POLICIES["base-1"].mask)) != 0
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("kept")).alias("kept"), "n_lines", "n_letters", "n_upper", "n_marks", "fail_mask")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import find_repeats, repeat_digest

    return repeat_digest(find_repeats(_table(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, score_toxicity

    docs = _table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_windows", "top_word")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import fit_quality, score_quality

    docs = _table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in under two tokenizers; the first's counts are then revised to include an end id for each
    document; later copies of a text are deleted; the last batch is delivered twice."""
    from .token_counts import TokenLedger, events, later_copies, row_events
    from .workspace import Workspace

    ws = Workspace(spark, "token-counts")
    one, two = tokenizer_path(), tokenizer_path("byte_bpe_multi_50k.tiktoken")
    rows = ws.save(row_events(_table(spark, sf_dir, "documents"), [one, two]), "counted")
    ledger = TokenLedger(spark, ws.file("ledger"))
    with_end = F.col("n0") + F.col("n_docs")
    ledger.apply("load", events(rows, "insert", one, F.col("n0")).unionByName(events(rows, "insert", two, F.col("n1"))))
    ledger.apply("end-ids", events(rows, "revise", one, with_end))
    copies = ws.save(later_copies(rows), "copies")
    deletes = events(copies, "delete", one, with_end).unionByName(events(copies, "delete", two, F.col("n1")))
    ledger.apply("drop-copies", deletes)
    ledger.apply("drop-copies", deletes)
    return ledger.totals()


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_plan

    plan = mix_plan(_table(spark, sf_dir, "documents"), percent=150, weights=(5, 2, 1), most=2)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


QUERIES = {f.__name__: f for f in (op1_token_output, op2_pii_weak_supervision, op3_benchmark_decontamination, op4_quality_rules, op5_suffix_array_dedup, op6_toxicity, op7_minhash_near_dedup, op8_quality_classifier, op9_token_counts, op10_mixing)}
