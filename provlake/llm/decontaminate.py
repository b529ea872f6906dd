"""Benchmark decontamination: one Aho-Corasick automaton over normalised test texts, each text scanned once.

Normal form: A-Z in lower case, words are runs of digits, letters and characters beyond ASCII. A window is
``window`` consecutive words of an item; an item of fewer words, but not none, is one window.

The automaton's symbols are words, each as a pair of digits, so that no node has many children. Its patterns are the short items whole and, for each window of the others, the
rarest of the runs of ``GRAM`` words in it (neighbouring windows mostly share one, so that there is about a node
for each benchmark word, not ten). Where such an anchor ends in a text, the windows around it are compared, word
by word, with the table of windows; hits keep word and original offsets.

The benchmark goes to the workers in blocks of at most ``block_bytes``, whose size is summed before anything is
collected. A block of 16 MB takes under 1 GB in a worker; a benchmark of one block takes one scan. A larger one
takes a scan for each block, and a row carries its hits from one to the next; nothing is joined or shuffled.

Cases: a null text has no words and no hits; items that are null or without words have no window; items with equal
text are all reported; rows of ``documents`` that repeat are scanned each for itself; an empty benchmark leaves
every document clean; an empty table gives an empty result; null item ids mark words as hit but are not listed.
find_contamination reads the named columns only; drop_contaminated keeps all columns, of any name.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textprims import kept, mix64
from .workspace import Workspace

WINDOW, GRAM = 10, 4
BLOCK_BYTES = 16 << 20
#: Documents that are turned into Python texts at once.
ROWS = 1024

_WORD = np.ones(256, bool)
_WORD[0x00:0x30] = _WORD[0x3A:0x61] = _WORD[0x7B:0x80] = False
_RAW = _WORD.copy()
_RAW[0x41:0x5B] = True  # in the original, before lower-casing
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if _WORD[c] else 32 for c in range(256))
_U = np.uint64

SCAN_SCHEMA = "doc_id long, n_words long, hits array<struct<s:long,e:long,cs:long,ce:long>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_NORMAL).split()


def _row_hash(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), _U)
    for c in range(rows.shape[1]):
        h = mix64(h * _U(0x9FB21C651E98DF25) + rows[:, c].astype(_U))
    return h


class Matcher:
    """The automaton and the table of windows of some items (id or None, text or None)."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window, self.gram = window, min(GRAM, window)
        self.number: dict[bytes, int] = {}
        flat, ends, self.ids = array("i"), [0], []
        for item, text in items:
            words = words_of(text)
            if words:
                flat.extend([self.number.setdefault(w, len(self.number) + 1) for w in words])
                ends.append(len(flat))
                self.ids.append(item)
        self.flat = np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)
        at = np.array(ends)
        n = np.diff(at)
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        self.digits = int(np.ceil(np.sqrt(len(self.number) + 1)))
        self._windows(at, n)
        rows = np.lib.stride_tricks.sliding_window_view(self.flat, self.gram) if len(self.places) else []
        for value, p in enumerate(self.places.tolist()):
            self.auto.add_word(self._symbols(rows[p]), value)
        #: values below are of anchors; value -> (words, items) of a short item
        self.n_anchors, patterns = len(self.places), len(self.places)
        del self.places
        self.short: dict[int, tuple[int, list[int]]] = {}
        for i in np.flatnonzero(n < window).tolist():
            key = self._symbols(self.flat[at[i] : at[i + 1]])
            if not self.auto.exists(key):
                self.auto.add_word(key, patterns)
                patterns += 1
            self.short.setdefault(self.auto.get(key), (int(n[i]), []))[1].append(i)
        self.some = patterns > 0
        self.least = min([self.gram] * (self.n_anchors > 0) + [size for size, _ in self.short.values()], default=0)
        if self.some:
            self.auto.make_automaton()

    def _symbols(self, words: np.ndarray) -> tuple:
        """Two symbols a word: high digits and low ones, told apart."""
        return tuple(np.stack([words // self.digits, self.digits + words % self.digits], 1).ravel().tolist())

    def _windows(self, at: np.ndarray, n: np.ndarray) -> None:
        """The distinct windows (hash, place of one, items that have it) and the places of their anchors."""
        count = np.where(n >= self.window, n - self.window + 1, 0)
        owner = np.repeat(np.arange(len(n), dtype=np.int32), count)
        start = (np.repeat(at[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())).astype(np.int64)
        rows = np.lib.stride_tricks.sliding_window_view(self.flat, self.window) if len(self.flat) >= self.window else np.zeros((0, self.window), np.int32)
        h = np.concatenate([_row_hash(rows[part]) for part in np.array_split(start, max(1, len(start) >> 18))])
        order = np.lexsort((owner, h))
        h, start, owner = h[order], start[order], owner[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
        same = all((rows[start[part]] == rows[start[first[group[part]]]]).all() for part in np.array_split(np.arange(len(h)), max(1, len(h) >> 18)))
        assert same, "windows of equal hash differ"  # 64 bits over one block
        self.keys, self.place, self.owner, self.owner_at = h[first], start[first], owner, np.append(first, len(h))
        # the rarest run of each distinct window, of equals that of least hash
        grams = np.lib.stride_tricks.sliding_window_view(self.flat, self.gram) if len(self.flat) >= self.gram else np.zeros((0, self.gram), np.int32)
        g = np.concatenate([_row_hash(part) for part in np.array_split(grams, max(1, len(grams) >> 18))])
        _, back, often = np.unique(g, return_inverse=True, return_counts=True)
        key = np.minimum(often[back], (1 << 23) - 1).astype(_U) << _U(40) | g >> _U(24)
        best = self.place.copy()
        for k in range(1, self.window - self.gram + 1):
            less = key[self.place + k] < key[best]
            best[less] = self.place[less] + k
        self.places = best[np.unique(g[best], return_index=True)[1]] if len(best) else best
        # runs of one hash have the same words, or else each of them is a pattern
        if len(best) and not (grams[best] == grams[self.places[np.searchsorted(g[self.places], g[best])]]).all():
            self.places = best[np.unique(grams[best], axis=0, return_index=True)[1]]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
        """(number of words, merged hit word ranges, ids of the items found)."""
        words = words_of(text)
        if not self.some or not words:
            return len(words), [], set()
        seq = np.fromiter(map(self.number.get, words, repeat(0)), np.int32, len(words))
        # no pattern crosses a word that no item has: runs of known words that are long enough are read, with what ends them
        gaps = np.concatenate(([-1], np.flatnonzero(seq == 0), [len(seq)]))
        size = np.diff(gaps)
        long = np.flatnonzero(size > self.least)
        if not len(long):
            return len(words), [], set()
        places = np.repeat(gaps[long] + 1 - (np.cumsum(size[long]) - size[long]), size[long]) + np.arange(size[long].sum())
        ranges, starts, owners = [], set(), set()
        for last, k in self.auto.iter(self._symbols(np.append(seq, 0)[places])):
            end = int(places[last // 2])
            if k in self.short:
                size, own = self.short[k]
                ranges.append((end - size + 1, end + 1))
                owners.update(own)
            if k < self.n_anchors:
                p = end - self.gram + 1
                starts.update(range(max(0, p - self.window + self.gram), min(p, len(seq) - self.window) + 1))
        if starts:
            s = np.array(sorted(starts))
            rows = seq[s[:, None] + np.arange(self.window)]
            h = _row_hash(rows)
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            ok = (self.keys[at] == h) & (self.flat[self.place[at][:, None] + np.arange(self.window)] == rows).all(1)
            ranges += [(a, a + self.window) for a in s[ok].tolist()]
            for w in np.unique(at[ok]).tolist():
                owners.update(self.owner[self.owner_at[w] : self.owner_at[w + 1]].tolist())
        return len(words), merged(ranges), {self.ids[i] for i in owners if self.ids[i] is not None}


def merged(ranges: list[tuple]) -> list[tuple]:
    """The union of ranges (start, end, ...), in order; what follows start and end goes on by start and end too."""
    out: list[tuple] = []
    for r in sorted(ranges):
        if out and r[0] <= out[-1][1]:
            out[-1] = tuple(x for i in range(0, len(r), 2) for x in (out[-1][i], max(out[-1][i + 1], r[i + 1])))
        else:
            out.append(tuple(r))
    return out


def original_offsets(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point offsets in the original text of word ranges."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    word = np.where(points < 256, _RAW[np.minimum(points, 255)], True)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    return [(int(starts[s]), int(ends[e - 1])) for s, e in ranges]


def _matcher(shared, key: str, window: int) -> Matcher:
    return kept(("matcher", key), lambda: Matcher(shared.value, window))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            yield batch.slice(lo, ROWS)


def _scanner(shared, key: str, window: int, text_too: bool):
    """Rows (doc_id, text, hits, items) to rows with the hits and items of this block added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared, key, window)
        for batch in _slices(batches):
            counts, all_hits, all_items = [], [], []
            for text, hits, items in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                n, ranges, found = matcher.scan(text)
                counts.append(n)
                at = original_offsets(text, ranges) if ranges else []
                known = [(h["s"], h["e"], h["cs"], h["ce"]) for h in hits or ()]
                all_hits.append([dict(zip(("s", "e", "cs", "ce"), h, strict=True)) for h in merged(known + [(*r, *c) for r, c in zip(ranges, at, strict=True)])])
                all_items.append(sorted(found.union(items or ())))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(all_hits, _HIT), pa.array(all_items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns + [batch.column(1)] * text_too, ["doc_id", "n_words", "hits", "items", "text"][: 4 + text_too])

    return run


_HIT = pa.list_(pa.struct([(k, pa.int64()) for k in ("s", "e", "cs", "ce")]))


def _blocks(benchmark: DataFrame, block_bytes: int, window: int) -> Iterator[tuple]:
    """(broadcast items, key) of each block of the benchmark; none for a benchmark without words."""
    spark = benchmark.sparkSession
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.length("text") > 0)
    total = bench.agg(F.sum(F.octet_length("text") + F.lit(32))).first()[0] or 0
    n = -(-total // block_bytes)
    # the block is drawn by a hash of the text, so equal items meet in one block
    for b in range(n):
        items = sorted((tuple(r) for r in bench.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == b).collect()), key=str)
        if items:
            yield spark.sparkContext.broadcast(items), hashlib.sha256(repr((window, items)).encode()).hexdigest()


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, hits (word range s:e and code point range cs:ce in the original), items: one row for each row of documents."""
    spark = documents.sparkSession
    empty = [F.lit(None).cast("array<struct<s:long,e:long,cs:long,ce:long>>").alias("hits"), F.lit(None).cast("array<string>").alias("items")]
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *empty)
    blocks = list(_blocks(benchmark, block_bytes, window)) or [(spark.sparkContext.broadcast([]), f"none-{window}")]
    ws = Workspace(spark, "decontaminate")
    for i, (shared, key) in enumerate(blocks):
        last = i == len(blocks) - 1
        scanned = rows.select("doc_id", "text", "hits", "items").mapInArrow(_scanner(shared, key, window, not last), SCAN_SCHEMA + ("" if last else ", text string"))
        # written between blocks, so that no two automata are in one task
        rows = scanned if last else ws.save(scanned, f"block{i}")
    return rows


def contamination_digest(found: DataFrame) -> DataFrame:
    """The digest columns of find_contamination's rows."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def _dropper(shared, key: str, window: int, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared, key, window)
        for batch in _slices(batches):
            yield batch.filter(pa.array([not matcher.scan(text)[1] for text in batch.column(column).to_pylist()], pa.bool_()))

    return run


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of documents without any hit word, with all their columns. Rows are judged where they stand."""
    ws = Workspace(documents.sparkSession, "decontaminate")
    column, schema = documents.columns.index("text"), documents.schema
    for i, (shared, key) in enumerate(_blocks(benchmark, block_bytes, window)):
        documents = (documents if i == 0 else ws.save(documents, f"block{i}")).mapInArrow(_dropper(shared, key, window, column), schema)
    return documents
