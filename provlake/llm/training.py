"""Fitting on a bounded sample of labelled documents, in one task on an executor.

The driver sees the ids of the sample and the fitted model, of fixed table sizes; texts go from the scan to the
task that trains, and a lost executor only repeats it.

Cases: null labels and null ids are left out; a document with several label rows takes the highest; of rows that
repeat a doc_id the largest text counts; without labels or without texts the sample is empty; extra columns are
not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textprims import give_back, kept

#: (text, label) rows and the share of class 1 among all training labels -> the model.
Trainer = Callable[[list[tuple[str, int]], float], object]


def training_row(folds: int, held: int) -> Column:
    """Rows whose crc32 of doc_id as text does not leave the held-out remainder."""
    return F.crc32(F.col("doc_id").cast("string")) % folds != held


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, keep: Column, sample: int, longest: int) -> tuple[DataFrame | None, float]:
    """(doc_id, text, y of at most ``sample`` documents of each class, in order of a hash of doc_id, none longer than
    ``longest``; the share of class 1 of all training labels). No sample: None."""
    spark = documents.sparkSession
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & keep)
    lab = lab.groupBy("doc_id").agg(F.max("y").alias("y"))
    share = lab.agg(F.avg("y")).first()[0]
    # lengths first, so that only the sample's texts travel
    size = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.length("text").alias("n")).filter(F.col("n").between(1, longest))
    known = lab.join(size.select("doc_id"), "doc_id", "left_semi")
    picked = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect() for y in (0, 1)]
    rows = [(r.doc_id, r.y) for p in picked for r in p]
    if not rows:
        return None, float(share or 0)
    ids = spark.createDataFrame(rows, "doc_id long, y int")  # at most 2 x sample rows
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").filter(F.length("text").between(1, longest))
    return texts.groupBy("doc_id").agg(F.max("text").alias("text"), F.first("y").alias("y")), float(share or 0)


def _task(train: Trainer, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept()
        rows: list[tuple] = []
        for batch in batches:
            rows += zip(*(c.to_pylist() for c in batch.columns), strict=True)
        if rows:
            model = train([(text, y) for _, text, y in sorted(rows)], share)
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    return run


def fit_apart(sample: DataFrame | None, share: float, train: Trainer):
    """train's model of the sample, fitted in one task."""
    found = [] if sample is None else sample.select("doc_id", "text", "y").repartition(1).mapInArrow(_task(train, share), "model binary").collect()
    return pickle.loads(found[0].model) if found else train([], share)
