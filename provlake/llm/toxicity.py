"""Toxicity by a bidirectional gated recurrent network with attention over character and word inputs.

The network (``recurrent``) is trained in numpy in one task (``training``), on a bounded sample of labelled
documents: ``SAMPLE`` of each class, in order of a hash of doc_id, none longer than ``LONGEST`` characters, and
``WINDOWS_A_DOC`` windows of each. One dimension of the word and part vectors starts at their evidence: log odds of
the classes of the documents that have them. Labels are of documents, so windows start with their document's label,
those of toxic documents only if they have its strongest words; after the first passes windows of toxic documents
that look clean are left out, but for the best one. A fifth of the sample is kept from training and calibrates the
score on the highest window, where a toxic document that is missed weighs as much as ``COST`` false alarms.

Scoring takes windows of 32 words at every 16th word of every whole text; the score is the calibrated highest one.

Cases: null and empty texts, and texts without words, have no window and score the calibrated floor; a
document with several label rows is toxic if one says so; null labels are left out; without labels of both
classes every score is the share of toxic labels (0 without any); rows that repeat are scored each for
itself; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .recurrent import SLOTS, WORD_DIM, Adam, Words, best_windows, new_model, run, train_epoch, window_index, windows_of, word_inputs
from .textprims import kept
from .training import fit_apart, labelled_sample, training_row

SAMPLE, LONGEST, WINDOWS_A_DOC = 1500, 40_000, 8
#: Passes over the sample: so many that there are STEPS batches, but between the two bounds.
STEPS, EPOCHS, BATCH = 450, (5, 15), 256
RATE, SEED = 0.01, 5
FLOOR = -6.0
#: Documents' worth of doubt in the evidence of a slot.
DRAW = 6.0
COST = 2.0


def evidence(slot: np.ndarray, owner: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log odds of each slot from the classes of the documents that have it, drawn to 0 where they are few."""
    pair = np.unique(owner.astype(np.int64) * SLOTS + slot)
    slot, toxic = pair % SLOTS, y[pair // SLOTS] > 0.5
    n, n1 = np.bincount(slot, minlength=SLOTS), np.bincount(slot[toxic], minlength=SLOTS)
    base = y.mean()
    p = (n1 + DRAW * base) / (n + DRAW)
    odds = np.log(p / (1 - p)) - np.log(base / (1 - base))
    return np.clip(np.where(n >= 3, odds, 0), -2, 2).astype(np.float32)


def warm_start(m: dict, words: Words, y: np.ndarray) -> np.ndarray:
    """Put the evidence of words and of their parts into the first dimension of their vectors; returns it by word."""
    n = np.diff(words.begin)
    owner = np.repeat(np.arange(len(n)), n)
    pair = np.unique(owner * len(words.slot) + words.number) if len(words.slot) else np.zeros(0, np.int64)
    doc, word = (pair // len(words.slot), pair % len(words.slot)) if len(pair) else (pair, pair)
    m["Ew"][:, 0] = evidence(words.slot[word], doc, y)
    size = words.size[word]
    at = np.cumsum(size) - size
    gram = words.gram[np.repeat(words.at[word] - at, size) + np.arange(size.sum())]
    m["Ec"][:, 0] = evidence(gram, np.repeat(doc, size), y)
    x = word_inputs(m, words)
    return x[:, 0] + x[:, WORD_DIM]


def train(sample: list[tuple[str, int]], share: float, seed: int = SEED) -> dict:
    """The model: network weights and the calibration (slope, size slope, offset)."""
    y = np.array([label for _, label in sample], np.float32)
    if not len(y) or y.min() == y.max():
        return {"share": share}
    rng = np.random.default_rng(seed)
    held = np.zeros(len(y), bool)
    held[rng.permutation(len(y))[: len(y) // 5]] = True
    if y[~held].min() == y[~held].max() or y[held].min() == y[held].max():
        held[:] = False
    texts = pa.array([t for t, _ in sample])
    own = texts.filter(pa.array(~held))
    words = Words.of(own)
    m, opt = new_model(seed), Adam(RATE)
    odds = warm_start(m, words, y[~held])
    owner, start, length = windows_of(words.begin)
    # a few windows of each document: half of them those whose strongest word has most evidence, half drawn
    most = np.empty(len(start))
    for part in np.array_split(np.arange(len(start)), max(1, len(start) // 4096)):
        index = window_index(words, start[part], length[part])
        most[part] = np.where(index >= 0, odds[index], -np.inf).max(1)
    rank = _rank(owner, -most)
    top = rank < WINDOWS_A_DOC // 2
    drawn = _rank(owner, np.where(top, 2, rng.random(len(owner)))) < WINDOWS_A_DOC - WINDOWS_A_DOC // 2
    pick = np.flatnonzero(top | drawn)
    owner, index = owner[pick], window_index(words, start[pick], length[pick])
    target = y[~held][owner]
    weight = np.where(target > 0.5, 0.5 / max(target.mean(), 1e-6), 0.5 / max(1 - target.mean(), 1e-6)).astype(np.float32)
    use = (target < 0.5) | top[pick]
    epochs = int(np.clip(STEPS * BATCH // max(1, len(index)), *EPOCHS))
    for epoch in range(epochs):
        if epoch >= epochs * 2 // 5:
            logit = np.concatenate([_logits(m, words, part) for part in np.array_split(index, max(1, -(-len(index) // 1024)))])
            best = np.full(int(owner.max()) + 1, -np.inf)
            np.maximum.at(best, owner, logit)
            use = (target < 0.5) | (logit > 0) | (logit >= best[owner])
        if epoch == epochs - 1:
            opt.rate *= 0.3
        train_epoch(m, opt, words, index[use], target[use], weight[use], rng, BATCH)
    cal = held if held.any() else ~held
    best, count, _ = best_windows(m, texts.filter(pa.array(cal)))
    return {"net": m, "share": share, "calibration": calibrate(best, count, y[cal], share)}


def _rank(owner: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of each window among its document's, by key; owner is ascending."""
    order = np.lexsort((key, owner))
    out = np.empty(len(owner), np.int64)
    out[order] = np.arange(len(owner)) - np.searchsorted(owner, owner)
    return out


def _logits(m: dict, words: Words, index: np.ndarray) -> np.ndarray:
    used, local = np.unique(index, return_inverse=True)
    local = local.reshape(index.shape) - (used[0] == -1)
    return run(m, word_inputs(m, words, used[used >= 0]), local)


def calibrate(best: np.ndarray, count: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Logistic weights of (highest logit, log of windows, 1), classes weighted as among all labels, class 1 by COST."""
    x = np.stack([np.maximum(best, FLOOR), np.log1p(count), np.ones(len(y))], 1)
    w = np.where(y > 0.5, COST * share / max(y.mean(), 1e-6), (1 - share) / max(1 - y.mean(), 1e-6))
    theta = np.array([1.0, 0.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (w * (y - p)) - 0.05 * theta * len(y) * np.array([0.01, 1, 0.01])
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag([0.05, 5.0, 0.05]) * len(y) / 50 + 1e-6 * np.eye(3)
        theta = theta + np.clip(np.linalg.solve(hess, grad), -1, 1)
    theta[0] = max(theta[0], 1e-3)
    return theta


def score_texts(model: dict, column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, number of windows, first word of the highest window) of each text."""
    if "net" not in model:
        n = len(column)
        return np.full(n, model["share"]), np.zeros(n, np.int64), np.zeros(n, np.int64)
    best, count, place = best_windows(model["net"], column)
    slope, size, offset = model["calibration"]
    z = slope * np.maximum(best, FLOOR) + size * np.log1p(count) + offset
    return 1 / (1 + np.exp(-np.clip(z, -30, 30))), count, place


def _scorer(shared):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept()
        model = shared.value
        for batch in batches:
            score, count, place = score_texts(model, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(count, pa.int64()), pa.array(place, pa.int64())], ["doc_id", "score", "n_windows", "top_word"])

    return go


def fit_toxicity(documents: DataFrame, labels: DataFrame, keep: Column | None = None) -> dict:
    return fit_apart(*labelled_sample(documents, labels, "toxic", training_row(5, 0) if keep is None else keep, SAMPLE, LONGEST), train)


def score_toxicity(documents: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, n_windows, top_word: one row for each row of documents."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(model)  # fixed table sizes: about 1 MB
    return docs.mapInArrow(_scorer(shared), "doc_id long, score double, n_windows long, top_word long")


def _dropper(shared, column: int, threshold: float):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept()
        for batch in batches:
            yield batch.filter(pa.array(score_texts(shared.value, batch.column(column))[0] < threshold))

    return go


def drop_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of documents that the model does not reject, with all their columns. Rows are judged where they stand."""
    shared = documents.sparkSession.sparkContext.broadcast(fit_toxicity(documents, labels))
    return documents.mapInArrow(_dropper(shared, documents.columns.index("text"), threshold), documents.schema)
