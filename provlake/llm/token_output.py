"""Token ids as binary shards, compressed by Re-Pair grammars with random access.

Documents in ascending doc_id order (nulls first, ties by text) are encoded whole with a public tokenizer
and end with ``end_id``. Runs of documents become shards of about ``shard_tokens`` ids. In a shard, Re-Pair
repeatedly replaces the most frequent pairs of neighbouring ids by new symbols (many disjoint pairs in a
round, never across documents), until no pair occurs ``LEAST`` times or the 16 bits of symbols are used up.

File format: a Parquet table with one row a shard, so that writing, retrying and reading back work in any
store Spark knows. Columns: ``part`` (doc_id range), ``shard`` (order within it), ``start`` (ids before it in its part), ``n_docs``, ``n_tokens``,
``doc_ids`` (int64 LE; ``null_ids`` flags nulls), ``doc_tokens`` (uint32 LE: ids of each document),
``doc_symbols`` (uint32 LE: symbols of each document), ``n_base`` (first symbol that is a rule), ``rules``
(uint16 LE pairs), ``lengths`` (uint32 LE: ids each rule expands to) and ``symbols`` (uint16 LE; uint32 if
``wide``). ``expand`` decodes any range of symbols; ``token_range`` any range of ids, by expansion lengths.

Cases: a null or empty text has just the end id; documents with equal doc_id stand one after the other in
order of text; an empty table writes no shard; a document longer than a shard has a shard to itself; extra
columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textprims import heads, kept, pieces
from .workspace import Workspace, shuffle_parts

SHARD_TOKENS = 1 << 20
#: A pair is replaced if it occurs so often; most pairs of a round; bits of the slots that count them.
LEAST, PAIRS_A_ROUND, SLOT_BITS = 4, 8192, 18
#: Chunks that are encoded as one text.
JOINT = 512
#: Bytes of a chunk that the table of known chunks can hold, its slots, and ids that it refers to at most before it starts anew.
SHORT, CACHE_SLOTS, CACHE_IDS = 15, 1 << 21, 1 << 24
#: Longer chunks that are kept, by their bytes: most chunks, and most bytes of one.
LONG_KEPT, LONG_BYTES = 1 << 15, 256

SHARD_SCHEMA = "first_id long, first_null boolean, part int, shard int, start long, n_docs long, n_tokens long, doc_ids binary, null_ids binary, doc_tokens binary, doc_symbols binary, n_base int, wide boolean, rules binary, lengths binary, symbols binary"

#: Classes of bytes: 0 unsure, 1 letter, 2 digit, 3 mark, 4 apostrophe, 5 space, 6 other white space.
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = 3
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[0x27], _CLASS[0x20] = 4, 5
_CLASS[[9, 10, 13]] = 6
#: Whether a text may be cut between two classes (before, after); a cut never parts white space from what follows.
_CUT = np.zeros((8, 8), bool)
for _a in (1, 2, 3):
    for _b in (1, 2, 3):
        _CUT[_a, _b] = _a != _b
    _CUT[_a, 5] = _CUT[_a, 6] = True
_CUT[4, 5] = _CUT[4, 6] = _CUT[1, 4] = _CUT[2, 4] = True
#: Masks that keep the first k of 16 bytes.
_KEEP = np.array([[(1 << 8 * min(k, 8)) - 1, (1 << 8 * max(0, k - 8)) - 1] for k in range(16)], np.uint64)


def cuts(buf: np.ndarray) -> np.ndarray:
    """Positions before which byte-level BPE always splits, whatever stands further away.

    The split pattern takes maximal runs of letters, of digits and of other marks, each with one space before
    it; so ASCII runs end where the class changes, and before white space. U+00C0 to U+024F are letters but
    for two; next to other characters beyond ASCII nothing is cut, nor after an apostrophe.
    """
    cls = _CLASS[buf]
    lead = np.flatnonzero((buf >= 0xC3) & (buf <= 0xC9))
    cls[lead] = cls[lead + 1] = np.where((buf[lead] == 0xC3) & ((buf[lead + 1] == 0x97) | (buf[lead + 1] == 0xB7)), 0, 1)
    return np.flatnonzero(_CUT.ravel()[cls[:-1] * np.uint8(8) + cls[1:]]) + 1


class Encoder:
    """Whole-text encoding through the tokenizers library, each chunk between cuts once while it stays known.

    Known chunks of up to 15 bytes are in a two-way table of fixed size that holds the bytes themselves; a chunk
    that finds both of its places taken replaces the second. Longer ones are in a bounded dictionary, by bytes.
    """

    def __init__(self, path: str):
        if path.endswith(".tiktoken"):
            self._tiktoken(path)
        else:
            self._tokenizers(path)
        self.reset()

    def _tokenizers(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.vocab = self.tok.get_vocab_size()
        self.marks = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        # a byte-level token has one character a byte
        self.width = np.zeros(max(self.tok.get_vocab().values()) + 1, np.int64)
        for token, i in self.tok.get_vocab().items():
            self.width[i] = len(token)
        self.ids_of = lambda texts: [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _tiktoken(self, path: str) -> None:
        """A file of ranks; it has no special tokens, so that nothing in a text matches across cuts."""
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tok = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.vocab, self.marks = len(ranks), []
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.width[i] = len(token)
        self.ids_of = lambda texts: [self.tok.encode_ordinary(t) for t in texts]

    def reset(self) -> None:
        #: the bytes and, in the last one, how many they are; first id << 24 | ids of each
        self.table, self.place = np.zeros((CACHE_SLOTS, 2), np.uint64), np.zeros(CACHE_SLOTS, np.int64)
        self.long: dict[bytes, tuple[int, int]] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encode new chunks; where their ids start and how many they are.

        Chunks that start with white space and end with a letter or number go many to a text: they are cut apart
        there too, for nothing reaches from a letter or number over white space, and the widths of the ids tell
        which ids are whose.
        """
        joint = np.array([c[0] in " \n\r\t" and c[-1].isalnum() for c in chunks], bool)
        many, alone = np.flatnonzero(joint), np.flatnonzero(~joint)
        size = np.zeros(len(chunks), np.int64)
        got = self.ids_of([chunks[i] for i in alone.tolist()])
        size[alone] = np.fromiter(map(len, got), np.int64, len(got))
        flat_alone = np.fromiter(chain.from_iterable(got), np.uint32, int(size[alone].sum()))
        blocks = ["".join([chunks[i] for i in part.tolist()]) for part in np.array_split(many, max(1, -(-len(many) // JOINT)))]
        got = self.ids_of(blocks)
        flat_many = np.fromiter(chain.from_iterable(got), np.uint32, sum(map(len, got)))
        ends = np.searchsorted(np.cumsum(self.width[flat_many]), np.cumsum(np.fromiter((len(chunks[i].encode()) for i in many.tolist()), np.int64, len(many)))) + 1
        size[many] = np.diff(np.concatenate(([0], ends)))
        total = len(flat_alone) + len(flat_many)
        start = np.zeros(len(chunks), np.int64)
        start[alone] = np.cumsum(size[alone]) - size[alone] + self.used
        start[many] = np.cumsum(size[many]) - size[many] + self.used + len(flat_alone)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used : self.used + total] = np.concatenate((flat_alone, flat_many))
        self.used += total
        return start, size

    def _known(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of chunks start, and how many they are; new ones are encoded."""
        n = ends - starts
        run, size = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        short = np.flatnonzero(n <= SHORT)
        k = n[short]
        key = heads(buf, starts[short], 16)
        key &= _KEEP[k]
        key[:, 1] |= k.astype(np.uint64) << np.uint64(56)
        h = key[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ key[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        first, second = (h >> np.uint64(43)).astype(np.int64), (h >> np.uint64(22) & np.uint64(CACHE_SLOTS - 1)).astype(np.int64)
        got = self.place[first]
        miss = np.flatnonzero(self._differ(first, key))
        other = second[miss]
        got[miss] = self.place[other]
        miss = miss[self._differ(other, key[miss])]
        run[short], size[short] = got >> 24, got & 0xFFFFFF
        data = buf.tobytes() if len(miss) or len(short) < len(n) else b""
        if len(miss):
            _, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
            if not (key[miss] == key[miss[one]][back]).all():  # equal hashes of different chunks
                _, one, back = np.unique(key[miss], axis=0, return_index=True, return_inverse=True)
                back = back.ravel()
            new = miss[one]
            at = starts[short[new]].tolist()
            new_start, new_size = self._learn([data[s:e].decode("utf-8", "replace") for s, e in zip(at, ends[short[new]].tolist(), strict=True)])
            run[short[miss]], size[short[miss]] = new_start[back], new_size[back]
            at = np.where(self.table[first[new], 1] == 0, first[new], second[new])
            self.table[at], self.place[at] = key[new], new_start << 24 | new_size
        rest = np.flatnonzero(n > SHORT)
        if len(rest):
            texts = [data[s:e] for s, e in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
            new_texts = list(dict.fromkeys(t for t in texts if t not in self.long))
            if len(self.long) + len(new_texts) > LONG_KEPT:
                self.long, new_texts = {}, list(dict.fromkeys(texts))
            new_start, new_size = self._learn([t.decode("utf-8", "replace") for t in new_texts])
            own = dict(zip(new_texts, zip(new_start.tolist(), new_size.tolist(), strict=True), strict=True))
            found = np.array([own.get(t) or self.long[t] for t in texts], np.int64)
            run[rest], size[rest] = found[:, 0], found[:, 1]
            self.long.update({t: x for t, x in own.items() if len(t) <= LONG_BYTES})
        return run, size

    def _differ(self, at: np.ndarray, key: np.ndarray) -> np.ndarray:
        known = np.take(self.table, at, axis=0)
        return (known[:, 0] != key[:, 0]) | (known[:, 1] != key[:, 1])

    def _parts(self, column: pa.Array) -> Iterator[tuple]:
        """Of consecutive rows (first chunk of each row and the end, where a chunk's ids start, how many they are, None), or
        (None, None, None, ids of each row) where an added token is in a text."""
        for _, _, buf, docs in pieces(column):
            data = buf.tobytes() if self.marks else b""
            if any(m in data for m in self.marks):  # added tokens match across any cut
                yield None, None, None, self.ids_of([data[docs[i] : docs[i + 1] - 1].decode("utf-8", "replace") for i in range(len(docs) - 1)])
                continue
            # each document starts a chunk; the \n after it belongs to none
            new_chunk = np.zeros(len(buf) + 1, bool)
            new_chunk[cuts(buf)] = True
            new_chunk[docs] = True
            starts = np.flatnonzero(new_chunk)
            new_doc = np.zeros(len(buf) + 1, bool)
            new_doc[docs] = True
            starts, ends = starts[:-1], starts[1:] - new_doc[starts[1:]]
            keep = ends > starts
            starts, ends = starts[keep], ends[keep]
            if self.used > CACHE_IDS:
                self.reset()
            yield np.searchsorted(starts, docs), *self._known(buf, starts, ends), None

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, ids of each document) of consecutive rows."""
        for first, run, size, got in self._parts(column):
            if got is not None:
                yield np.fromiter(chain.from_iterable(got), np.uint32), np.array([len(g) for g in got], np.int64)
                continue
            total = np.concatenate(([0], np.cumsum(size)))
            ids = self.ids[np.repeat(run - total[:-1], size) + np.arange(total[-1])]
            yield ids, np.diff(total[first])

    def counts(self, column: pa.Array) -> np.ndarray:
        """How many ids each row has."""
        out = []
        for first, _, size, got in self._parts(column):
            out.append(np.array([len(g) for g in got], np.int64) if got is not None else np.diff(np.concatenate(([0], np.cumsum(size)))[first]))
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def _pair_slot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D) >> np.uint32(32 - SLOT_BITS)


def repair(ids: np.ndarray, doc_tokens: np.ndarray, n_base: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, symbols of each document, rules). Rule i, of two symbols below it, has symbol n_base + i.

    A round takes the pairs that occur most, at least ``least`` times, and replaces their occurrences from left
    to right; rounds go on until no pair does or there is no room for rules.
    """
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq), bool)  # the last symbol of a document pairs with nothing
    last[np.cumsum(doc_tokens)[doc_tokens > 0] - 1] = True
    rules: list[np.ndarray] = []
    n_rules, room = 0, max(0, min(65536 - n_base, 1 << 15)) if n_base <= 65536 else 1 << 15
    while len(seq) > 1 and n_rules < room:
        open_ = ~last[:-1]
        # counts by hash first: only pairs in full slots are counted exactly
        slot = _pair_slot(seq[:-1], seq[1:])
        full = np.bincount(slot[open_], minlength=1 << SLOT_BITS) >= least
        at = np.flatnonzero(full[slot] & open_)
        pair = seq[at].astype(np.uint64) << np.uint64(32) | seq[at + 1]
        order = np.sort(pair)
        cut = np.flatnonzero(np.concatenate(([True], order[1:] != order[:-1]))) if len(order) else np.zeros(0, np.int64)
        keys, counts = order[cut], np.diff(np.append(cut, len(order)))
        often = counts >= least
        keys, counts = keys[often], counts[often]
        if not len(keys):
            break
        take = np.argsort(-counts, kind="stable")[: min(PAIRS_A_ROUND, room - n_rules)]
        keys = np.sort(keys[take])
        key_slot = _pair_slot((keys >> np.uint64(32)).astype(np.uint32), keys.astype(np.uint32))
        place = np.full(1 << SLOT_BITS, -1, np.int32)
        place[key_slot] = np.arange(len(keys))
        found = place[slot[at]]
        # of keys that share a slot one is there; the others are searched for
        shared = np.zeros(1 << SLOT_BITS, bool)
        shared[key_slot[place[key_slot] != np.arange(len(keys))]] = True
        again = np.flatnonzero(shared[slot[at]])
        found[again] = np.minimum(np.searchsorted(keys, pair[again]), len(keys) - 1)
        hit = (found >= 0) & (keys[found] == pair)
        at, found = at[hit], found[hit]
        # overlapping occurrences come in runs of neighbours: every other one, from the left
        head = np.ones(len(at), bool)
        head[1:] = at[1:] != at[:-1] + 1
        run_start = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
        every = (np.arange(len(at)) - run_start) % 2 == 0
        at, found = at[every], found[every]
        seq[at] = found + (n_base + n_rules)
        last[at] |= last[at + 1]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq, last = seq[stay], last[stay]
        rules.append(np.stack([keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        n_rules += len(keys)
    ends = np.flatnonzero(last) + 1
    doc_symbols = np.zeros(len(doc_tokens), np.int64)
    doc_symbols[doc_tokens > 0] = np.diff(np.concatenate(([0], ends)))
    return seq, doc_symbols, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def expansion_lengths(rules: np.ndarray, n_base: int) -> np.ndarray:
    """Ids that each rule expands to; a rule's symbols stand below it."""
    out = np.ones(len(rules), np.uint32)
    left = rules.astype(np.int64) - n_base
    done = 0
    while done < len(rules):  # a round's rules use only rules of earlier rounds
        end = done + int(np.argmax(np.append(left[done:].max(1) >= done, True)))
        for side in (0, 1):
            x = left[done:end, side]
            part = np.ones(end - done, np.uint32)
            part[x >= 0] = out[x[x >= 0]]
            out[done:end] = part if side == 0 else out[done:end] + part
        done = end
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, n_base: int) -> np.ndarray:
    """The ids of symbols: rules are replaced by their pairs, level by level."""
    seq = symbols.astype(np.uint32)
    while (big := seq >= n_base).any():
        to = np.arange(len(seq)) + np.cumsum(big) - big
        pair = rules[seq[big] - n_base]
        out = np.empty(len(seq) + len(pair), np.uint32)
        out[to] = seq
        to = to[big]
        out[to], out[to + 1] = pair[:, 0], pair[:, 1]
        seq = out
    return seq


def token_range(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, n_base: int, start: int, end: int) -> np.ndarray:
    """Ids start:end of a shard or document, expanding only the symbols that cover them."""
    size = np.ones(len(symbols), np.int64)
    big = symbols >= n_base
    size[big] = lengths[symbols[big] - n_base]
    at = np.concatenate(([0], np.cumsum(size)))
    start, end = max(0, start), min(end, int(at[-1]))
    if start >= end:
        return np.zeros(0, np.uint32)
    lo, hi = int(np.searchsorted(at, start, "right")) - 1, int(np.searchsorted(at, end))
    return expand(symbols[lo:hi], rules, n_base)[start - at[lo] : end - at[lo]]


def _shard_row(part: int, shard: int, start: int, ids: list, doc_ids: list, sizes: list, n_base: int) -> dict:
    tokens = np.concatenate(ids)
    size = np.array(sizes, np.int64)
    symbols, doc_symbols, rules = repair(tokens, size, n_base)
    wide = n_base + len(rules) > 65536
    kind = "<u4" if wide else "<u2"
    return {
        "first_id": doc_ids[0], "first_null": doc_ids[0] is None, "part": part, "shard": shard, "start": start, "n_docs": len(size), "n_tokens": len(tokens),
        "doc_ids": np.array([x or 0 for x in doc_ids], "<i8").tobytes(), "null_ids": np.array([x is None for x in doc_ids], np.uint8).tobytes(),
        "doc_tokens": size.astype("<u4").tobytes(), "doc_symbols": doc_symbols.astype("<u4").tobytes(), "n_base": n_base, "wide": wide,
        "rules": rules.astype(kind).tobytes(), "lengths": expansion_lengths(rules, n_base).astype("<u4").tobytes(), "symbols": symbols.astype(kind).tobytes(),
    }


_SHARD_ARROW = pa.schema([("first_id", pa.int64()), ("first_null", pa.bool_()), ("part", pa.int32()), ("shard", pa.int32()), ("start", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), *((n, pa.binary()) for n in ("doc_ids", "null_ids", "doc_tokens", "doc_symbols")), ("n_base", pa.int32()), ("wide", pa.bool_()), *((n, pa.binary()) for n in ("rules", "lengths", "symbols"))])


def _writer(path: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc: Encoder = kept(("encoder", path), lambda: Encoder(path))
        part, shard, start = TaskContext.get().partitionId(), 0, 0
        n_base = max(enc.vocab, end_id + 1)
        ids: list = []
        doc_ids: list = []
        sizes: list = []
        held = 0
        for batch in batches:
            keys, row = batch.column(0).to_pylist(), 0
            for tokens, count in enc.encode(batch.column(1)):
                ends = np.cumsum(count)
                lo = 0  # documents of this piece that are in a shard already
                for d in range(len(count)):
                    held += int(count[d]) + 1
                    doc_ids.append(keys[row])
                    sizes.append(int(count[d]) + 1)
                    row += 1
                    if held >= shard_tokens or d == len(count) - 1:
                        begin = int(ends[lo - 1]) if lo else 0
                        ids.append(np.insert(tokens[begin : int(ends[d])], ends[lo : d + 1] - begin, np.uint32(end_id)))
                        lo = d + 1
                    if held >= shard_tokens:
                        yield pa.RecordBatch.from_pylist([_shard_row(part, shard, start, ids, doc_ids, sizes, n_base)], _SHARD_ARROW)
                        ids, doc_ids, sizes, held, shard, start = [], [], [], 0, shard + 1, start + held
        if doc_ids:
            yield pa.RecordBatch.from_pylist([_shard_row(part, shard, start, ids, doc_ids, sizes, n_base)], _SHARD_ARROW)

    return run


def write_token_shards(documents: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode and write every document to the shards at path, in ascending doc_id order."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    sorted_docs = docs.repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions("doc_id", F.xxhash64("text"))
    sorted_docs.mapInArrow(_writer(tokenizer, end_id, shard_tokens), SHARD_SCHEMA).write.mode("overwrite").option("compression", "zstd").parquet(path)


def shard_arrays(row: dict) -> dict:
    """The arrays of a shard's row, as read from its file."""
    kind = "<u4" if row["wide"] else "<u2"
    return {
        "doc_ids": np.frombuffer(row["doc_ids"], "<i8"), "null_ids": np.frombuffer(row["null_ids"], np.uint8).astype(bool),
        "doc_tokens": np.frombuffer(row["doc_tokens"], "<u4").astype(np.int64), "doc_symbols": np.frombuffer(row["doc_symbols"], "<u4").astype(np.int64),
        "rules": np.frombuffer(row["rules"], kind).reshape(-1, 2).astype(np.uint32), "lengths": np.frombuffer(row["lengths"], "<u4"), "symbols": np.frombuffer(row["symbols"], kind).astype(np.uint32),
    }


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            a = shard_arrays(row)
            ids = expand(a["symbols"], a["rules"], row["n_base"]).astype("<u4")
            at = np.concatenate(([0], np.cumsum(a["doc_tokens"])))
            data = memoryview(ids).cast("B")
            crc = [zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a["doc_ids"], mask=a["null_ids"]), pa.array(at[:-1] + row["start"]), pa.array(a["doc_tokens"]), pa.array(crc, pa.int64()), pa.array(a["doc_symbols"])],
                ["doc_id", "start", "n_tokens", "ids_crc32", "n_symbols"],
            )


def read_token_shards(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and n_symbols of every document, decoded from the shards at path."""
    shards = spark.read.parquet(path)
    # ids before each doc_id range: one row a range, of which there are as many as shuffle partitions
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = shards.join(F.broadcast(before), "part").withColumn("start", F.col("start") + F.col("before")).drop("before")
    return placed.mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long, n_symbols long")


def token_output(documents: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write documents to token shards (at path, or a folder of this run) and read them back."""
    spark = documents.sparkSession
    path = path or Workspace(spark, "token-shards").file("shards")
    write_token_shards(documents, path, tokenizer, end_id)
    return read_token_shards(spark, path)
