"""Quality by random indexing: word vectors from the whole corpus, pooled by document, a two-layer network.

Every token slot has a sparse ternary index vector. A slot's context vector is the sum of the index vectors
of its neighbours, up to two tokens away, over all documents. The sums are taken in each task over a table
of fixed size (``SLOTS`` x ``DIM``) and added up a tree in chunks, ``FAN`` tasks at a time, so that neither
a task nor the driver sees more than a fixed number of tables. Tokens are runs of letters and digits (in
lower case) and runs of marks; each word also gives a shape token (case, length, repeat of the word before).

A document is the mean of its tokens' vectors and the mean of its shapes' vectors. The network of two layers
is trained in numpy, in one task (``training``), on a bounded sample of labelled documents (``SAMPLE`` of each
class, no longer than ``LONGEST`` characters); a fifth of it is kept for the temperature of the probabilities.

Cases: null and empty texts and texts without tokens pool to zeros and are scored like others; a document
with several label rows takes the highest; null labels are left out; without labels of both classes every
score is the share of class 1; rows that repeat count and are scored each for itself; an empty table gives
zero vectors and an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .recurrent import Adam
from .textprims import LOWER, SPACE, doc_of, pieces, prefix_hash, span_hash
from .training import fit_apart, labelled_sample, training_row
from .workspace import Workspace

SLOTS, DIM, NONZERO, REACH = 1 << 13, 32, 4, 2
SHAPES = 32
CHUNK, FAN = 1 << 15, 16
SAMPLE, LONGEST, SEED = 1500, 60_000, 11
HIDDEN, EPOCHS, RATE = 24, 60, 0.01

_rng = np.random.default_rng(3)
_AT = np.stack([_rng.permutation(DIM)[:NONZERO] for _ in range(SLOTS + SHAPES)])
_SIGN = _rng.choice(np.array([-1.0, 1.0]), (SLOTS + SHAPES, NONZERO))
#: Kinds of bytes: 0 white space, 1 letters, digits and bytes beyond ASCII, 2 marks.
_KIND = np.full(256, 2, np.uint8)
_KIND[SPACE] = 0
_KIND[0x30:0x3A] = _KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 1
_KIND[0x80:] = 1
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def tokens(buf: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(slot of each token, first token of each text and the end, shape of each word, first word of each text and the end)."""
    kind = _KIND[buf]
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    edge = np.concatenate(([0], edge, [len(buf)]))
    starts, ends = edge[:-1], edge[1:]
    some = kind[starts] > 0
    starts, ends = starts[some], ends[some]
    h = span_hash(prefix_hash(LOWER[buf]), starts, ends)
    slot = (h % np.uint64(SLOTS)).astype(np.int64)
    at = np.searchsorted(doc_of(starts, docs), np.arange(len(docs)))
    word = kind[starts] == 1
    ws, we, wh = starts[word], ends[word], h[word]
    owner = doc_of(ws, docs)
    upper = np.concatenate(([0], np.cumsum(_UPPER[buf])))
    caps = upper[we] - upper[ws]
    case = np.where(caps == 0, 0, np.where(caps == we - ws, 3, np.where(_UPPER[buf[ws]] & (caps == 1), 1, 2))) if len(ws) else np.zeros(0, np.int64)
    same = np.zeros(len(ws), np.int64)
    same[1:] = (wh[1:] == wh[:-1]) & (owner[1:] == owner[:-1])
    size = np.digitize(we - ws, (3, 7, 13))
    return slot, at, case * 8 + same * 4 + size, np.searchsorted(owner, np.arange(len(docs)))


def context_sums(column) -> np.ndarray:
    """Context vectors, SLOTS x DIM, of some texts."""
    out = np.zeros(SLOTS * DIM)
    for _, _, buf, docs in pieces(column):
        slot, at, _, _ = tokens(buf, docs)
        owner = np.repeat(np.arange(len(docs) - 1), np.diff(at))
        for o in range(1, REACH + 1):
            a = np.flatnonzero(owner[o:] == owner[:-o])
            for left, right in ((slot[a], slot[a + o]), (slot[a + o], slot[a])):
                for k in range(NONZERO):
                    out += np.bincount(left * DIM + _AT[right, k], weights=_SIGN[right, k], minlength=SLOTS * DIM)
    return out


def _summer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    total = np.zeros(SLOTS * DIM)
    for batch in batches:
        total += context_sums(batch.column(0))
    node = TaskContext.get().partitionId()
    n = SLOTS * DIM // CHUNK
    data = [total[i * CHUNK : (i + 1) * CHUNK].astype("<i8").tobytes() for i in range(n)]
    yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([node] * n, pa.int64()), pa.array(data, pa.binary())], ["chunk", "node", "sums"])


def _adder(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(CHUNK, np.int64)
    for x in pdf["sums"]:
        total += np.frombuffer(x, "<i8")
    return pd.DataFrame({"chunk": [key[0]], "node": [key[1]], "sums": [total.tobytes()]})


def word_vectors(documents: DataFrame) -> np.ndarray:
    """Unit vectors of all slots and shapes, from the context of every token of documents."""
    spark = documents.sparkSession
    ws = Workspace(spark, "random-index")
    schema = "chunk int, node long, sums binary"
    # the tasks' own tables go through a shuffle and are not written; sums of FAN of them are
    level, width = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(_summer, schema), 2
    while width > 1:
        level = level.withColumn("node", F.floor(F.col("node") / FAN).cast("long")).groupBy("chunk", "node").applyInPandas(_adder, schema)
        level = ws.save(level, "sums")
        width = (level.agg(F.max("node")).first()[0] or 0) + 1
    sums = np.zeros((SLOTS, DIM))
    for r in level.toLocalIterator():
        sums.ravel()[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.sums, "<i8")
    ws.drop()
    return vectors_of(sums)


def vectors_of(sums: np.ndarray) -> np.ndarray:
    own = np.zeros((SLOTS + SHAPES, DIM))
    np.put_along_axis(own, _AT, _SIGN, 1)
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    out = own / NONZERO**0.5
    out[:SLOTS] += np.where(norm > 0, sums / np.maximum(norm, 1e-9), 0)
    return (out / np.linalg.norm(out, axis=1, keepdims=True)).astype(np.float32)


def pool(vectors: np.ndarray, column) -> np.ndarray:
    """One row for each text: mean token vector, mean shape vector, and the log of the number of tokens."""
    rows = []
    for lo, hi, buf, docs in pieces(column):
        slot, at, shape, wat = tokens(buf, docs)
        out = np.zeros((hi - lo, 2 * DIM + 1), np.float32)
        for values, begin, c in ((slot, at, 0), (shape + SLOTS, wat, DIM)):
            n = np.diff(begin)
            full = np.flatnonzero(n)
            if len(full):
                out[full, c : c + DIM] = np.add.reduceat(vectors[values], begin[:-1][full], axis=0) / n[full, None]
        out[:, -1] = np.log1p(np.diff(at)) / 4
        rows.append(out)
    return np.concatenate(rows) if rows else np.zeros((0, 2 * DIM + 1), np.float32)


def _forward(net: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh(((x - net["mean"]) / net["std"]) @ net["W1"] + net["b1"])
    return h, h @ net["w2"] + net["b2"][0]


def train_network(x: np.ndarray, y: np.ndarray, share: float, seed: int = SEED) -> dict:
    """The two layers and the temperature."""
    if not len(y) or y.min() == y.max():
        return {"share": share}
    rng = np.random.default_rng(seed)
    held = np.zeros(len(y), bool)
    held[rng.permutation(len(y))[: len(y) // 5]] = True
    d = x.shape[1]
    net = {"mean": x[~held].mean(0), "std": x[~held].std(0) + 1e-3, "W1": (rng.standard_normal((d, HIDDEN)) * d**-0.5).astype(np.float32), "b1": np.zeros(HIDDEN, np.float32), "w2": (rng.standard_normal(HIDDEN) * HIDDEN**-0.5).astype(np.float32), "b2": np.zeros(1, np.float32)}
    w = np.where(y > 0.5, share / max(y.mean(), 1e-6), (1 - share) / max(1 - y.mean(), 1e-6))
    opt = Adam(RATE)
    tx, ty, tw = x[~held], y[~held], w[~held]
    for _ in range(EPOCHS):
        for pick in np.array_split(rng.permutation(len(ty)), max(1, len(ty) // 64)):
            h, z = _forward(net, tx[pick])
            g = (tw[pick] * (1 / (1 + np.exp(-z)) - ty[pick]) / len(pick)).astype(np.float32)
            dh = g[:, None] * net["w2"] * (1 - h * h)
            opt.step(net, {"w2": h.T @ g + 1e-3 * net["w2"], "b2": np.array([g.sum()], np.float32), "W1": ((tx[pick] - net["mean"]) / net["std"]).T @ dh + 1e-3 * net["W1"], "b1": dh.sum(0)})
    _, z = _forward(net, x[held] if held.any() else x)
    net["temperature"] = temperature(z, y[held] if held.any() else y, w[held] if held.any() else w)
    net["share"] = share
    return net


def temperature(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The temperature of least weighted log loss, over a fine grid."""
    grid = np.exp(np.linspace(np.log(0.2), np.log(10), 200))
    loss = [float((w * np.logaddexp(0, np.where(y > 0.5, -z, z) / t)).sum()) for t in grid]
    return float(grid[int(np.argmin(loss))])


def score_texts(vectors: np.ndarray, net: dict, column) -> np.ndarray:
    x = pool(vectors, column)
    if "W1" not in net:
        return np.full(len(x), net["share"])
    return 1 / (1 + np.exp(-np.clip(_forward(net, x)[1].astype(float) / net["temperature"], -30, 30)))


def _scorer(shared):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(vectors, net, batch.column(1)), pa.float64())], ["doc_id", "score"])

    return go


def fit_quality(documents: DataFrame, labels: DataFrame, keep: Column | None = None) -> tuple[np.ndarray, dict]:
    """(word vectors, network)."""
    vectors = word_vectors(documents)
    shared = documents.sparkSession.sparkContext.broadcast(vectors)

    def train(sample: list[tuple[str, int]], share: float) -> dict:
        return train_network(pool(shared.value, pa.array([t for t, _ in sample], pa.string())), np.array([y for _, y in sample], np.float32), share)

    sample, share = labelled_sample(documents, labels, "quality", training_row(3, 1) if keep is None else keep, SAMPLE, LONGEST)
    return vectors, fit_apart(sample, share, train)


def score_quality(documents: DataFrame, model: tuple[np.ndarray, dict]) -> DataFrame:
    """doc_id, score: one row for each row of documents."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_scorer(spark.sparkContext.broadcast(model)), "doc_id long, score double")  # about 1 MB, whatever the corpus
