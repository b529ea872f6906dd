"""Near-duplicate documents by SetSketch registers: banded, estimated jointly, verified on full sets.

A document's set has its distinct word shingles, A-Z in lower case. A sketch has ``REGISTERS`` registers;
register i is ``floor(1 - log_b E_i)`` cut to 0..Q+1, E_i the least of the exponentials that hash i gives
to the elements, so sketches of unions are the maxima of registers. Registers agree in bands of four with
chance near J^4 each: over 32 bands, a pair at the limit of 0.8 meets but for a chance of 5e-8.

Documents with equal sets collapse to their least doc_id. Representatives that share a band form candidate
groups (the least one of a band is linked to each other one: no pairs of a band are emitted). Within a
group, pairs whose joint maximum-likelihood estimate of J reaches 0.62 (five deviations below the limit)
are verified on the full sets, unless they are linked already through others. A group of many documents is
cut into blocks, and a task takes each pair of blocks, so that no link is lost and no task holds a group.
Components of the verified links give the classes.

Cases: a null or empty text, or one without words, has an empty set and is linked with nothing; fewer words
than a shingle make one element; elements are hashes of the words, of 61 bits modulo a prime; a null doc_id is linked with nothing and has a null component; rows that
repeat a doc_id belong to one class; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .textprims import LOWER, NONSPACE, doc_of, kept, mix64, pieces, prefix_hash, span_hash, word_spans
from .workspace import Workspace, join_hot, row_key

REGISTERS, ROWS = 128, 4
BASE, Q = 1.02, 4000
#: Estimates from here on are verified.
ESTIMATE = 0.62
#: A block of a candidate group: most documents, and most elements of their sets.
BLOCK_DOCS, BLOCK_ELEMENTS = 1024, 1_000_000

_U = np.uint64
_MULT = np.random.default_rng(7).integers(1, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_K = np.random.default_rng(8).integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)


def shingle_sets(column: pa.Array, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, sorted distinct elements of each row's set, start of each row's and the end)."""
    for lo, hi, buf, docs in pieces(column):
        n = hi - lo
        buf = LOWER[buf]
        starts, ends = word_spans(buf, NONSPACE)
        words = span_hash(prefix_hash(buf), starts, ends)
        owner = doc_of(starts, docs)
        count = np.bincount(owner, minlength=n)
        first = np.flatnonzero(owner[: max(0, len(owner) - shingle + 1)] == owner[shingle - 1 :]) if len(owner) >= shingle else np.zeros(0, np.int64)
        h = np.zeros(len(first), _U)
        for k in range(shingle):
            h += words[first + k] * _K[k]
        mix64(h)
        who = owner[first]
        short = np.flatnonzero((count > 0) & (count < shingle))
        if len(short):
            at = np.concatenate(([0], np.cumsum(count)))
            few = np.array([(words[at[d] : at[d + 1]] * _K[: count[d]]).sum(dtype=_U) ^ _K[32 + count[d]] for d in short], _U)
            who = np.concatenate((who, short))
            h = np.concatenate((h, mix64(few)))
            order = np.argsort(who, kind="stable")
            who, h = who[order], h[order]
        at = np.searchsorted(who, np.arange(n + 1))
        for d in range(n):
            h[at[d] : at[d + 1]].sort()
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
        yield lo, hi, h[new], np.searchsorted(who[new], np.arange(n + 1))


def sketches(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SetSketch registers of each row's elements; an empty set has registers of 0."""
    n = len(at) - 1
    least = np.full((n, REGISTERS), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(at[1:] > at[:-1])
    x = (h >> _U(32)).astype(np.uint32)
    step = 1 << 15
    k = 0
    while k < len(full):  # as many rows at once as stay in the cache
        e = k + 1
        while e < len(full) and at[full[e] + 1] - at[full[k]] <= step:
            e += 1
        rows = full[k:e]
        part, begin = x[at[rows[0]] : at[rows[-1] + 1]], at[rows] - at[rows[0]]
        tmp = np.empty(len(part), np.uint32)
        for i in range(REGISTERS):
            np.multiply(part, _MULT[i], out=tmp)
            least[rows, i] = np.minimum.reduceat(tmp, begin)
        k = e
    e = -np.log1p(-(least.astype(np.float64) + 0.5) / 4294967296.0)
    reg = np.clip(np.floor(1 - np.log(e) / np.log(BASE)) + 200, 0, Q + 1).astype(np.uint16)
    reg[at[1:] == at[:-1]] = 0
    return reg


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of a union."""
    return np.maximum(a, b)


def bands(reg: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of registers."""
    n = REGISTERS // ROWS
    r = reg.astype(_U).reshape(len(reg), n, ROWS)
    key = np.broadcast_to(np.arange(1, n + 1, dtype=_U), (len(reg), n)).copy()
    for i in range(ROWS):
        key = key * _U(0x9FB21C651E98DF25) + r[:, :, i]
    return mix64(key).view(np.int64)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log(np.maximum(1 - x * (BASE - 1) / BASE, 1e-12)) / np.log(BASE)


def estimate_at_least(one: np.ndarray, n_one: int, others: np.ndarray, n_others: np.ndarray, j: float = ESTIMATE) -> np.ndarray:
    """Whether the maximum-likelihood estimate of J from registers and sizes is j or more (the likelihood is concave)."""
    more = (one > others).sum(1)
    less = (one < others).sum(1)
    same = REGISTERS - more - less
    u = n_one / (n_one + n_others)
    v = 1 - u

    def score(x: float) -> np.ndarray:
        a, b = np.maximum(_p(np.maximum(u - v * x, 1e-9)), 1e-12), np.maximum(_p(np.maximum(v - u * x, 1e-9)), 1e-12)
        return more * np.log(a) + less * np.log(b) + same * np.log(np.maximum(1 - a - b, 1e-12))

    return score(j + 1e-3) >= score(j - 1e-3)


def _sums(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, _U)
    np.cumsum(x, out=out[1:])
    return out


def _signer(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept()
        for batch in batches:
            for lo, hi, h, at in shingle_sets(batch.column(1), shingle):
                n = np.diff(at)
                keys = [_sums(mix64(h ^ c)) for c in (_U(0x1234567), _U(0xABCDEF01234))]
                k1, k2 = ((k[at[1:]] - k[at[:-1]]).view(np.int64) for k in keys)
                b = bands(sketches(h, at))
                width = b.shape[1]
                empty = n == 0
                offsets = np.concatenate(([0], np.cumsum(np.where(empty, 0, width)))).astype(np.int32)
                arr = pa.ListArray.from_arrays(pa.array(offsets), pa.array(b[~empty].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(k1), pa.array(k2), arr], ["doc_id", "n_shingles", "k1", "k2", "bands"])

    return run


def _setter(shingle: int):
    """Sets and sketches of documents whose set has the keys asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept()
        for batch in batches:
            ids, comp, parts = (batch.column(i).to_pylist() for i in (0, 2, 3))
            want = batch.column(4).to_numpy(zero_copy_only=False)
            for lo, _, h, at in shingle_sets(batch.column(1), shingle):
                reg = sketches(h, at)
                key = _sums(mix64(h ^ _U(0x1234567)))
                k1 = (key[at[1:]] - key[at[:-1]]).view(np.int64)
                rows = []
                for d in np.flatnonzero(k1 == want[lo : lo + len(k1)]):
                    i, g = lo + d, parts[lo + d]
                    mine = (ids[i] * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 33
                    blk = mine % g
                    row = (ids[i], comp[i], blk, reg[d].tobytes(), h[at[d] : at[d + 1]].tobytes())
                    rows += [(*row, min(blk, x), max(blk, x)) for x in range(g)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["rep", "grp", "blk", "sketch", "elements", "bi", "bj"])

    return run


def links_within(ids: list[int], blk: np.ndarray, reg: np.ndarray, sets: list[np.ndarray], cross: bool, percent: int = 80) -> list[tuple[int, int]]:
    """Verified links that connect what all verified links of these documents would; cross: only between two blocks."""
    m = len(ids)
    n = np.array([len(s) for s in sets], np.int64)
    label = np.arange(m)
    bits = None
    if m > 24:
        values, back, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        place = np.cumsum(counts > 1) - 1
        wide = int((counts > 1).sum())
        bits = np.zeros((m, -(-max(wide, 1) // 64)), np.uint64)
        at = np.concatenate(([0], np.cumsum(n)))
        for i in range(m):
            own = back[at[i] : at[i + 1]]
            own = place[own[counts[own] > 1]]
            np.bitwise_or.at(bits[i], own >> 6, np.left_shift(_U(1), (own & 63).astype(_U)))
    out = []
    for i in range(m - 1):
        c = np.arange(i + 1, m)
        c = c[(label[c] != label[i]) & (100 * np.minimum(n[c], n[i]) >= percent * np.maximum(n[c], n[i]))]
        if cross:
            c = c[blk[c] != blk[i]]
        if len(c):
            c = c[estimate_at_least(reg[i], n[i], reg[c], n[c])]
        if not len(c):
            continue
        if bits is None:
            both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in c])
        else:
            both = np.concatenate([np.bitwise_count(bits[part] & bits[i]).sum(1, dtype=np.int64) for part in np.array_split(c, -(-len(c) // 256))])
        for j in c[100 * both >= percent * (n[i] + n[c] - both)]:
            if label[j] != label[i]:
                out.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
                label[label == label[j]] = label[i]
    return out


def _linker(percent: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kept()
        pdf = pdf.drop_duplicates(["rep", "elements"]).sort_values("rep")
        reg = np.frombuffer(b"".join(pdf["sketch"]), np.uint16).reshape(len(pdf), REGISTERS)
        sets = [np.frombuffer(x, np.uint64) for x in pdf["elements"]]
        out = links_within(pdf["rep"].tolist(), pdf["blk"].to_numpy(), reg, sets, key[1] != key[2], percent)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(documents: DataFrame, shingle: int = 5, percent: int = 80, block_docs: int = BLOCK_DOCS, block_elements: int = BLOCK_ELEMENTS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of documents."""
    spark = documents.sparkSession
    ws = Workspace(spark, "near-dup")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = ws.save(docs.mapInArrow(_signer(shingle), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"), "signed")
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    reps = ws.save(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "reps")
    banded = reps.select("rep", F.explode("bands").alias("band"))
    leaders = banded.groupBy("band").agg(F.min("rep").alias("leader"), F.count("*").alias("c")).filter("c > 1")
    near = join_hot(banded, leaders, "band", "c", reps.count() * (REGISTERS // ROWS)).filter("rep != leader").select(F.col("rep").alias("a"), F.col("leader").alias("b"))
    groups = ws.save(connected_components(near, ws), "groups")
    members = groups.join(reps.select(F.col("rep").alias("node"), "n", "k1"), "node")
    sizes = groups.join(reps.select(F.col("rep").alias("node"), "n"), "node").groupBy("component").agg(F.count("*").alias("c"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("c") / block_docs), F.ceil(F.col("total") / block_elements)).cast("long")
    members = members.join(sizes.select("component", blocks.alias("g")), "component").select(F.col("node").alias("doc_id"), "component", "g", "k1")
    asked = docs.join(members, "doc_id").select("doc_id", "text", "component", "g", "k1")
    sets = asked.mapInArrow(_setter(shingle), "rep long, grp long, blk long, sketch binary, elements binary, bi long, bj long")
    links = ws.save(sets.groupBy("grp", "bi", "bj").applyInPandas(_linker(percent), "a long, b long"), "links")
    classes = ws.save(connected_components(links, ws), "classes")
    classed = reps.join(classes, reps["rep"] == classes["node"], "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    out = signed.join(classed, ["k1", "k2"], "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id")).alias("component_id"),
    )
    out = ws.save(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "result")
    return out


def keep_one(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of each class, with all its columns: of the least doc_id, then of the least row key.

    Classes are of rows here, not of doc_ids: rows that repeat a doc_id with different texts are linked each
    by its own text, and of rows equal in doc_id and text one stays. Rows without a doc_id all stay.
    """
    key = row_key(documents)
    ws = Workspace(documents.sparkSession, "keep-one")
    named = documents.filter(documents["doc_id"].isNotNull())
    found = near_duplicates(named.select(key.alias("doc_id"), named["text"]), shingle, percent).select(F.col("doc_id").alias("_key"), F.col("component_id").alias("_class"))
    rows = ws.save(found.groupBy("_key").agg(F.first("_class").alias("_class"), F.count("*").alias("_n")), "rows")
    ids = named.select(key.alias("_key"), documents["doc_id"].cast("long").alias("_id")).distinct()
    best = rows.join(ids, "_key").groupBy("_class").agg(F.min(F.struct("_id", "_key"))["_key"].alias("_best"))
    gone = ws.save(rows.join(best, rows["_key"] == best["_best"], "left_anti").select(F.col("_key").alias("_gone")), "gone")
    again = rows.filter("_n > 1").select(F.col("_key").alias("_again"))
    kept = documents.join(gone, key == gone["_gone"], "left_anti")
    once = kept.join(again, key == again["_again"], "left_anti")
    # of a row that repeats, which of its copies stays is settled by the other columns
    order = [F.col(f"_row.`{c}`") for c, kind in documents.dtypes if "map<" not in kind and "variant" not in kind]
    copies = kept.join(again, key == again["_again"], "left_semi").select(F.struct(*[documents[c] for c in documents.columns]).alias("_row"), key.alias("_key"))
    first = copies.withColumn("_r", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).filter("_r = 1").select("_row.*")
    return once.unionByName(first)
