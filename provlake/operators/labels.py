"""Runs, feedback and human labels: pivots, the latest experiment, overrides, merges and judge rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feedback_pivot(feedback: DataFrame, keys: list[str]) -> DataFrame:
    """run_id and a column for each key: the last score by seq; feedback: run_id, key, score, seq."""
    return feedback.groupBy("run_id").pivot("key", keys).agg(F.max_by("score", "seq"))


def latest_experiment(runs: DataFrame, dataset: str, experiment: str, start: str) -> DataFrame:
    """Of each dataset the experiment that started last (ties: the larger name), with its start."""
    return runs.groupBy(dataset).agg(F.max(F.struct(F.col(start).alias("s"), F.col(experiment).alias("e"))).alias("x")).select(dataset, F.col("x.e").alias("experiment"), F.col("x.s").alias("start"))


def with_overrides(results: DataFrame, labels: DataFrame, key: list[str]) -> DataFrame:
    """results (judge_score) with score and overridden; labels: key and human_score."""
    both = results.join(labels.select(*key, "human_score"), key, "left")
    return both.withColumn("score", F.coalesce("human_score", "judge_score")).withColumn("overridden", F.col("human_score").isNotNull()).drop("human_score")


def merge_labels(labels: DataFrame, sheet: DataFrame, key: list[str]) -> DataFrame:
    """The label table after an edited sheet, with action keep, delete, insert or update.

    sheet: key, judge, human, reasoning; labels: key, lesson, judge_score, human_score, judge_reasoning. Equal
    scores (also two nulls) delete the label, a blank human score changes nothing, others insert or update
    and keep the lesson. Labels outside the sheet stay.
    """
    old, new = labels.alias("l").withColumn("_l", F.lit(True)), sheet.withColumn("_s", F.lit(True))
    both = old.join(new, key, "full")
    equal = F.col("judge").eqNullSafe(F.col("human"))
    has, edited = F.col("_l").isNotNull(), F.col("_s").isNotNull()
    action = F.when(edited & equal & has, "delete").when(edited & ~equal & F.col("human").isNotNull(), F.when(has, "update").otherwise("insert")).when(has, "keep")
    changed = F.col("action").isin("insert", "update")
    return both.withColumn("action", action).filter("action is not null").select(
        *key,
        F.coalesce("lesson", F.lit("")).alias("lesson"),
        F.when(changed, F.col("judge")).otherwise(F.col("judge_score")).alias("judge_score"),
        F.when(changed, F.col("human")).otherwise(F.col("human_score")).alias("human_score"),
        F.when(changed, F.col("reasoning")).otherwise(F.col("judge_reasoning")).alias("judge_reasoning"),
        "action",
    )


def judge_rules(error: Column, refused: Column, should_answer: Column, reference: Column, has_contexts: Column) -> Column:
    """A struct of groundedness, relevance, correctness, each (score, needs_judge): what is decided before any model is asked."""
    one = lambda s, j: F.struct(s.cast("int").alias("score"), j.alias("needs_judge"))
    no, null = F.lit(False), F.lit(None)
    failed = error.isNotNull()
    out = should_answer == "no"
    groundedness = F.when(failed, one(null, no)).when(refused, one(F.lit(1), no)).when(~has_contexts, one(null, no)).otherwise(one(null, F.lit(True)))
    relevance = F.when(failed, one(null, no)).when(refused, one(F.when(out, 1).otherwise(0), no)).otherwise(one(null, F.lit(True)))
    empty = F.coalesce(reference, F.lit("")) == ""
    correctness = F.when(failed, one(null, no)).when(out, one(F.when(refused, 1).otherwise(0), no)).when(refused, one(F.lit(0), no)).when(empty, one(null, no)).otherwise(one(null, F.lit(True)))
    return F.struct(groundedness.alias("groundedness"), relevance.alias("relevance"), correctness.alias("correctness"))


def fetch_experiment(runs: DataFrame, examples: DataFrame, name: str | None = None) -> DataFrame:
    """Root runs of one experiment, the one named or that which started last, in order (place), with their examples.

    runs: run_id, experiment, example_id, is_root, start_time, ...; examples: example_id, ... Runs without an example
    id are left out, an unknown example gives nulls.
    """
    if name is None:
        chosen = runs.agg(F.max(F.struct("start_time", "experiment"))["experiment"].alias("experiment"))
        own = runs.join(F.broadcast(chosen), "experiment", "left_semi")  # one row
    else:
        own = runs.filter(F.col("experiment") == name)
    own = own.filter(F.col("is_root") & F.col("example_id").isNotNull())
    return own.join(examples, "example_id", "left")


def with_feedback(runs: DataFrame, feedback: DataFrame, keys: list[str]) -> DataFrame:
    """runs with a column for each key of feedback (run_id, key, score, seq); null where there is none."""
    return runs.join(feedback_pivot(feedback, keys), "run_id", "left")


def with_costs(rows: DataFrame, costs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with cost by run_id, one row with how many have none)."""
    out = rows.join(costs.select("run_id", "cost"), "run_id", "left")
    return out, out.agg(F.count_if(F.col("cost").isNull()).alias("n_missing"))


def answerable(examples: DataFrame, refs: Column) -> DataFrame:
    """Examples that should be answered and name a reference."""
    return examples.filter((F.col("should_answer") == "yes") & (F.size(refs) > 0))


def first_rows(rows: DataFrame, order: list, n: int | None) -> DataFrame:
    """The first n rows in an order, all without n."""
    return rows if n is None else rows.orderBy(*order).limit(n)
