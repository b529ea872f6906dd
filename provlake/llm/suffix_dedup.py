"""Repeated passages by prefix-free parsing: phrases from rolling-hash triggers, a dictionary, suffix order.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts in a document of smaller doc_id.

Parsing. The trigger of a window of LENGTH bytes is its least rolling hash of ``GRAM`` bytes (leftmost of
equals), so equal windows have equal triggers at equal places. A phrase is a maximal run of windows with one
trigger: every window starts in exactly one phrase, and neighbours overlap by LENGTH - 1 bytes, which makes
the set of phrases prefix-free for the purpose: a window never has to be read across phrases. A document's
parse is its sequence of phrases.

Dictionary and parse. Occurrences go by trigger to buckets, as one packed row for each task and bucket with
each phrase once (its least doc_id there). A bucket orders them by trigger, phrase and document: the parse
order within a phrase gives the first document, and later documents have the whole phrase covered. Phrases are
named by 93 bits: 61 of the phrase's hash modulo a prime and 32 of its trigger's, of another kind. Only
where different phrases share a trigger can windows still match in part; those phrases' texts, once each,
form the dictionary whose suffixes of LENGTH bytes or more are put in suffix order, bucket by bucket. Equal
neighbours in that order are the same string, decided on the bytes themselves.

``suffix_order`` combines the suffix arrays of dictionary and parse into the order of all suffixes of some texts;
to remove repeats, whose order does not matter, the query needs the dictionary's order and the parse's phrases only.

Skew: a phrase that is everywhere costs one entry a task. A trigger with more than ``HOT`` different phrases
is hot: its windows, not its phrases, are then ordered, dealt out by their content, each once a batch (its least
doc_id there), so that no bucket holds such a trigger. Buckets are as many as the bytes of all texts ask for.

Cases: null, empty and short texts (under LENGTH bytes) lose nothing; a null doc_id neither removes nor
loses; rows with equal doc_id do not remove each other's bytes; an empty table gives an empty result; a
text of any length is parsed in segments; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textprims import doc_of, identities, mix64, pieces, prefix_hash, span_hash
from .workspace import Workspace, shuffle_parts

LENGTH, GRAM = 50, 20
HOT, HOT_LOCAL = 4096, 64
#: Phrases that a task packs together; bytes of a text parsed at once.
PACK, SEGMENT = 2_000_000, 8 << 20
#: Bytes of text for each bucket, and buckets for each task.
BUCKET_BYTES, BUCKETS_A_TASK = 16 << 20, 4
_U = np.uint64
_LOW = _U(0xFFFFFF)

ENTRIES, COVERED, ASKED, ASKED_HOT, PHRASES, WINDOWS, MATCHED, HOT_TRIGGERS = range(8)
ROW_SCHEMA = "bucket long, kind int, doc_id long, data binary"
_ARROW = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("data", pa.binary())])


_BASE = _U(0x9E3779B97F4A7C15)


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A rolling hash of the GRAM bytes from each position: it only chooses where phrases are cut."""
    up = np.cumprod(np.full(GRAM, _BASE, _U), dtype=_U)
    h = np.zeros(len(buf) - GRAM + 1, _U)
    # the sum over GRAM bytes, by halves: as many doublings as the bits of GRAM
    power, width, part, at = _U(1), 1, buf.astype(_U) + _U(1), 0
    left, rest = _U(1), GRAM
    while rest:
        if rest & 1:
            h += part[at : at + len(h)] * left
            at += width
            left = up[at - 1]
        rest >>= 1
        if rest:
            power = up[width - 1]
            part = part[:-width] + part[width:] * power
            width *= 2
    return mix64(h)


def parse(buf: np.ndarray, docs: np.ndarray, prefix: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of the texts in buf: first window, window past the last, trigger hash, phrase hash, text number."""
    prefix = prefix_hash(buf) if prefix is None else prefix
    out = []
    for lo in range(0, max(0, len(buf) - LENGTH), SEGMENT):  # a text's bytes end before buf's last
        n = min(SEGMENT, len(buf) - LENGTH - lo)  # windows of this segment
        h = gram_hashes(buf[lo : lo + n + LENGTH - 1])
        low = (h & ~_LOW) | np.arange(len(h), dtype=_U)
        width, span = LENGTH - GRAM + 1, 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        place = (low & _LOW).astype(np.int64)
        owner = np.repeat(np.arange(len(docs) - 1), np.diff(docs))[lo : lo + n + LENGTH]
        inside = owner[:n] == owner[LENGTH : LENGTH + n]  # the window and the \n after it: the text has the whole window
        cut = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (inside[1:] != inside[:-1]) | (owner[1:n] != owner[: n - 1]))))
        end = np.append(cut[1:], n)
        ok = inside[cut]
        cut, end = cut[ok], end[ok]
        out.append((cut + lo, end + lo, h[place[cut]], owner[cut]))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(_U), z.astype(_U), z
    start, end, trigger, owner = (np.concatenate(x) for x in zip(*out, strict=True))
    return start, end, trigger, span_hash(prefix, start, end + LENGTH - 1), owner


def _binary(offsets: np.ndarray, data: bytes) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data)])


def _rows(bucket: np.ndarray, kind: int, doc_id: np.ndarray, offsets: np.ndarray, data: bytes) -> pa.RecordBatch:
    n = len(offsets) - 1
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(np.full(n, kind, np.int32)), pa.array(doc_id, pa.int64()), _binary(offsets, data)], schema=_ARROW)


def _by_doc(docs: np.ndarray, kind: int, values: np.ndarray, buckets: int, extra: np.ndarray | None = None) -> pa.RecordBatch:
    """One row a document with its values (and, after them, extra)."""
    order = np.argsort(docs, kind="stable")
    docs, values = docs[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1]))) if len(docs) else np.zeros(0, np.int64)
    at = np.append(first, len(docs))
    if extra is None:
        return _rows((docs[first] & 0x7FFFFFFF) % buckets, kind, docs[first], at * 8, values.astype("<u8").tobytes())
    packed = np.zeros(len(docs), np.dtype([("p", "<u8"), ("o", "<u4")]))
    packed["p"], packed["o"] = values, extra[order]
    return _rows((docs[first] & 0x7FFFFFFF) % buckets, kind, docs[first], at * 12, packed.tobytes())


def _pack_entries(bucket: np.ndarray, doc: np.ndarray, trigger: np.ndarray, phrase: np.ndarray) -> pa.RecordBatch:
    """ENTRIES rows: for each bucket number of documents, their ids and counts, then 12 bytes a phrase."""
    order = np.lexsort((doc, bucket))
    bucket, doc, trigger, phrase = (x[order] for x in (bucket, doc, trigger, phrase))
    at = np.append(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), len(bucket))
    parts, sizes = [], []
    t32, p64 = (trigger >> _U(32)).astype("<u4"), phrase.astype("<u8")
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        ids, count = np.unique(doc[s:e], return_counts=True)
        part = b"".join((np.array([len(ids), e - s], "<u4").tobytes(), ids.astype("<i8").tobytes(), count.astype("<u4").tobytes(), t32[s:e].tobytes(), p64[s:e].tobytes()))
        parts.append(part)
        sizes.append(len(part))
    return _rows(bucket[at[:-1]], ENTRIES, np.zeros(len(sizes), np.int64), np.concatenate(([0], np.cumsum(sizes))), b"".join(parts))


def _unpack_entries(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    d, n = np.frombuffer(data, "<u4", 2)
    d, n = int(d), int(n)
    ids, count = np.frombuffer(data, "<i8", d, 8), np.frombuffer(data, "<u4", d, 8 + 8 * d)
    at = 8 + 12 * d
    return np.repeat(ids, count), np.frombuffer(data, "<u4", n, at), np.frombuffer(data, "<u8", n, at + 4 * n)


_WIN = np.dtype([("doc", "<i8"), ("p", "<u8"), ("o", "<u4"), ("w", f"V{LENGTH}")])


def _pack_windows(buf: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, phrase: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Of the windows of some phrases those of the least document with the same content as WINDOWS rows, by content; the others are MATCHED."""
    size = end - start
    which = np.repeat(np.arange(len(start)), size)
    off = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    at = start[which] + off
    prefix = prefix_hash(buf)
    number, _ = identities(buf, at, at + LENGTH, prefix)
    least = np.full(int(number.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, number, doc[which])
    later = doc[which] > least[number]
    if later.any():
        yield _by_doc(doc[which[later]], MATCHED, phrase[which[later]], buckets, off[later])
    which, off, at = which[~later], off[~later], at[~later]
    rows = np.zeros(len(at), _WIN)
    rows["doc"], rows["p"], rows["o"] = doc[which], phrase[which], off
    rows["w"] = buf[at[:, None] + np.arange(LENGTH)].view(f"V{LENGTH}").ravel()
    bucket = (span_hash(prefix, at, at + LENGTH) % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    cut = np.append(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), len(bucket))
    yield _rows(bucket[cut[:-1]], WINDOWS, np.zeros(len(cut) - 1, np.int64), cut * _WIN.itemsize, rows.tobytes())


def _parser(buckets: int, hot_local: int):
    """Texts to ENTRIES, COVERED (repeats within this pack) and, for triggers hot in it, WINDOWS and HOT_TRIGGERS."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        trigger, phrase, doc = (np.concatenate([h[i] for h in held]) for i in range(3))
        order = np.lexsort((doc, phrase, trigger))
        trigger, phrase, doc = trigger[order], phrase[order], doc[order]
        new = np.ones(len(doc), bool)
        new[1:] = (trigger[1:] != trigger[:-1]) | (phrase[1:] != phrase[:-1])
        first = np.flatnonzero(new)
        later = doc > doc[first][np.cumsum(new) - 1]
        if later.any():
            pair = np.unique(np.stack([doc[later].view(_U), phrase[later]], 1), axis=0)
            yield _by_doc(pair[:, 0].view(np.int64), COVERED, pair[:, 1], buckets)
        trigger, phrase, doc = trigger[first], phrase[first], doc[first]
        _, back, count = np.unique(trigger, return_inverse=True, return_counts=True)
        hot = (count > hot_local)[back]
        if hot.any():
            names = np.unique(trigger[hot])
            b = (names % _U(buckets)).astype(np.int64)
            yield _rows(b, HOT_TRIGGERS, np.zeros(len(names), np.int64), np.arange(len(names) + 1) * 4, (names >> _U(32)).astype("<u4").tobytes())
        yield _pack_entries((trigger % _U(buckets)).astype(np.int64), doc, trigger, phrase)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        n = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, buf, docs in pieces(batch.column(1)):
                _, _, trigger, phrase, owner = parse(buf, docs)
                held.append((trigger, phrase, ids[lo + owner]))
                n += len(trigger)
            if n >= PACK:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return run


def _settle(buckets: int, hot_size: int):
    """A bucket's entries to COVERED and to ASKED or ASKED_HOT; other rows pass."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        out = [table.filter(pa.array((kind != ENTRIES) & (kind != HOT_TRIGGERS))).combine_chunks()]
        data = table.column("data")
        hot = [np.frombuffer(data[int(i)].as_py(), "<u4") for i in np.flatnonzero(kind == HOT_TRIGGERS)]
        rows = [_unpack_entries(data[int(i)].as_py()) for i in np.flatnonzero(kind == ENTRIES)]
        if rows:
            doc, trigger, phrase = (np.concatenate([r[i] for r in rows]) for i in range(3))
            order = np.lexsort((doc, phrase, trigger))
            doc, trigger, phrase = doc[order], trigger[order], phrase[order]
            new = np.ones(len(doc), bool)
            new[1:] = (trigger[1:] != trigger[:-1]) | (phrase[1:] != phrase[:-1])
            first = np.flatnonzero(new)
            later = doc > doc[first][np.cumsum(new) - 1]
            batches = []
            if later.any():
                batches.append(_by_doc(doc[later], COVERED, phrase[later], buckets))
            doc, trigger, phrase = doc[first], trigger[first], phrase[first]
            head = np.flatnonzero(np.concatenate(([True], trigger[1:] != trigger[:-1])))
            size = np.diff(np.append(head, len(trigger)))
            several = np.minimum.reduceat(doc, head) != np.maximum.reduceat(doc, head)
            many = size > hot_size
            if hot:
                many |= np.isin(trigger[head], np.concatenate(hot))
            for kind_, mask in ((ASKED, several & ~many), (ASKED_HOT, several & many)):
                pick = np.repeat(mask, size)
                if pick.any():
                    batches.append(_by_doc(doc[pick], kind_, phrase[pick], buckets))
            if batches:
                out.append(pa.Table.from_batches(batches))
        return pa.concat_tables([t.cast(_ARROW) for t in out])

    return run


def _values(cell, dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, dtype) for x in cell]) if cell else np.zeros(0, dtype)


def _asker(buckets: int):
    """The phrases asked for, as PHRASES rows by trigger, or as WINDOWS rows by content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            plain, hot = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for lo, _, buf, docs in pieces(batch.column(1)):
                start, end, trigger, phrase, owner = parse(buf, docs)
                at = np.searchsorted(owner, np.arange(len(docs)))
                picks: tuple[list, list] = ([], [])
                for d in range(len(docs) - 1):
                    own, once = np.unique(phrase[at[d] : at[d + 1]], return_index=True)
                    for k, asked in enumerate((plain[lo + d], hot[lo + d])):
                        if asked:
                            picks[k].append(at[d] + once[np.isin(own, _values(asked, "<u8"))])
                if picks[0]:
                    p = np.concatenate(picks[0])
                    bucket = (trigger[p] % _U(buckets)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    p, bucket = p[order], bucket[order]
                    cut = np.append(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), len(p))
                    parts = []
                    for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                        q = p[s:e]
                        size = end[q] + LENGTH - 1 - start[q]
                        text = buf[np.repeat(start[q] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                        parts.append(b"".join((np.array([len(q)], "<u4").tobytes(), ids[lo + owner[q]].astype("<i8").tobytes(), phrase[q].astype("<u8").tobytes(), size.astype("<u4").tobytes(), text.tobytes())))
                    sizes = np.array([len(x) for x in parts])
                    yield _rows(bucket[cut[:-1]], PHRASES, np.zeros(len(parts), np.int64), np.concatenate(([0], np.cumsum(sizes))), b"".join(parts))
                if picks[1]:
                    p = np.concatenate(picks[1])
                    for q in np.array_split(p, max(1, len(p) // 4096)):
                        if len(q):
                            yield from _pack_windows(buf, start[q], end[q], ids[lo + owner[q]], phrase[q], buckets)

    return run


def dictionary_suffixes(text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order of the phrases in text (sizes given), for suffixes of LENGTH bytes or more, by their first LENGTH bytes.

    Returns the order, the phrase and offset of each suffix before ordering, and the class of each place in
    the order (equal strings have equal classes).
    """
    n = np.maximum(size - LENGTH + 1, 0)
    which = np.repeat(np.arange(len(size)), n)
    off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = (np.cumsum(size) - size)[which] + off
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    keys = [words[at + k].copy().view(">u8").ravel() for k in range(0, LENGTH - 7, 8)]
    keys.append(words[at + LENGTH - 8].copy().view(">u8").ravel())
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for key in keys:
            k = key[order]
            new[1:] |= k[1:] != k[:-1]
    return order, which, off, np.cumsum(new) - 1


def _first_docs(doc: np.ndarray, order: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Whether each suffix also starts in a smaller document."""
    least = np.full(int(cls[-1]) + 1 if len(cls) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, cls, doc[order])
    out = np.zeros(len(order), bool)
    out[order] = doc[order] > least[cls]
    return out


def _matcher(buckets: int):
    """A bucket's phrases or windows to MATCHED rows: windows that also start in a smaller document."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        data = table.column("data")
        batches = table.filter(pa.array(kind == MATCHED)).cast(_ARROW).to_batches()
        ids, names, sizes, texts = [], [], [], []
        for i in np.flatnonzero(kind == PHRASES):
            raw = data[int(i)].as_py()
            n = int(np.frombuffer(raw, "<u4", 1)[0])
            ids.append(np.frombuffer(raw, "<i8", n, 4))
            names.append(np.frombuffer(raw, "<u8", n, 4 + 8 * n))
            sizes.append(np.frombuffer(raw, "<u4", n, 4 + 16 * n).astype(np.int64))
            texts.append(np.frombuffer(raw, np.uint8, -1, 4 + 20 * n))
        if ids:
            doc, name = np.concatenate(ids), np.concatenate(names)
            order, which, off, cls = dictionary_suffixes(np.concatenate(texts), np.concatenate(sizes))
            hit = _first_docs(doc[which], order, cls)
            if hit.any():
                batches.append(_by_doc(doc[which[hit]], MATCHED, name[which[hit]], buckets, off[hit]))
        wins = [np.frombuffer(data[int(i)].as_py(), _WIN) for i in np.flatnonzero(kind == WINDOWS)]
        if wins:
            rows = np.concatenate(wins)
            order, which, _, cls = dictionary_suffixes(np.ascontiguousarray(rows["w"]).view(np.uint8), np.full(len(rows), LENGTH))
            hit = _first_docs(rows["doc"][which], order, cls)
            if hit.any():
                batches.append(_by_doc(rows["doc"][hit], MATCHED, rows["p"][hit], buckets, rows["o"][hit].astype(np.int64)))
        return pa.Table.from_batches(batches, _ARROW)

    return run


_MATCH = np.dtype([("p", "<u8"), ("o", "<u4")])
FOUND_SCHEMA = "doc_id long, n_bytes long, removed array<struct<s:long,e:long>>, kept_sha256 string"


def _remover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with what is covered and matched in them to removed spans."""
    for batch in batches:
        covered, matched = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for lo, hi, buf, docs in pieces(batch.column(1)):
            touched = [d for d in range(hi - lo) if covered[lo + d] or matched[lo + d]]
            gone = np.zeros(len(buf) + 1, np.int32)
            if touched:
                start, end, _, phrase, owner = parse(buf, docs)
                at = np.searchsorted(owner, np.arange(len(docs)))
                for d in touched:
                    s, e, p = (x[at[d] : at[d + 1]] for x in (start, end, phrase))
                    if covered[lo + d]:
                        hit = np.isin(p, _values(covered[lo + d], "<u8"))
                        np.add.at(gone, s[hit], 1)
                        np.add.at(gone, e[hit] + LENGTH - 1, -1)
                    if matched[lo + d]:
                        m = _values(matched[lo + d], _MATCH)
                        m = m[np.argsort(m["p"], kind="stable")]
                        a, b = np.searchsorted(m["p"], p), np.searchsorted(m["p"], p, "right")
                        which = np.repeat(np.arange(len(p)), b - a)
                        j = np.arange((b - a).sum()) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[which]
                        w = s[which] + m["o"][j].astype(np.int64)
                        w = w[w < e[which]]
                        np.add.at(gone, w, 1)
                        np.add.at(gone, w + LENGTH, -1)
            removed = np.cumsum(gone[:-1]) > 0
            spans, shas, sizes = [], [], []
            hard = set(touched)
            for d in range(hi - lo):
                a, b = int(docs[d]), int(docs[d + 1]) - 1
                sizes.append(b - a)
                if d not in hard:
                    spans.append([])
                    shas.append(hashlib.sha256(buf[a:b]).hexdigest())
                    continue
                r = removed[a:b]
                edge = np.flatnonzero(np.diff(np.concatenate(([0], r.astype(np.int8), [0]))))
                spans.append([{"s": s, "e": e} for s, e in edge.reshape(-1, 2).tolist()])
                shas.append(hashlib.sha256(buf[a:b][~r]).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array(shas)],
                ["doc_id", "n_bytes", "removed", "kept_sha256"],
            )


def find_repeats(documents: DataFrame, hot: int = HOT, hot_local: int = HOT_LOCAL) -> DataFrame:
    """doc_id, n_bytes, removed (byte spans s:e), kept_sha256: one row for each row of documents."""
    spark = documents.sparkSession
    ws = Workspace(spark, "suffix-dedup")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = docs.filter("doc_id is not null and text is not null")
    n_bytes = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(BUCKETS_A_TASK * shuffle_parts(spark), -(-n_bytes // BUCKET_BYTES))
    tasks = -(-buckets // BUCKETS_A_TASK)
    # one pass deals entries out by trigger; what is settled within a task rides along to be kept once
    parsed = known.mapInArrow(_parser(buckets, hot_local), ROW_SCHEMA).repartition(tasks, "bucket")
    settled = ws.save(parsed.groupBy("bucket").applyInArrow(_settle(buckets, hot), ROW_SCHEMA), "settled")
    asked = settled.filter(F.col("kind").isin(ASKED, ASKED_HOT)).groupBy("doc_id").agg(F.collect_list(F.when(F.col("kind") == ASKED, F.col("data"))).alias("plain"), F.collect_list(F.when(F.col("kind") == ASKED_HOT, F.col("data"))).alias("hot"))
    phrases = known.join(asked, "doc_id").select("doc_id", "text", "plain", "hot").mapInArrow(_asker(buckets), ROW_SCHEMA)
    matched = ws.save(phrases.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_matcher(buckets), ROW_SCHEMA), "matched")
    answers = settled.filter(F.col("kind") == COVERED).unionByName(matched).groupBy("doc_id").agg(F.collect_list(F.when(F.col("kind") == COVERED, F.col("data"))).alias("covered"), F.collect_list(F.when(F.col("kind") == MATCHED, F.col("data"))).alias("matched"))
    return docs.join(answers, "doc_id", "left").select("doc_id", "text", "covered", "matched").mapInArrow(_remover, FOUND_SCHEMA)


def repeat_digest(found: DataFrame) -> DataFrame:
    n = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return found.select("doc_id", "n_bytes", n.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


def _ranks(keys: list) -> list[int]:
    """The place of each key among the distinct ones."""
    place = {k: i for i, k in enumerate(sorted(set(keys)))}
    return [place[k] for k in keys]


def parse_suffix_array(parse: np.ndarray) -> np.ndarray:
    """The rank of each suffix of a parse, up to the end of its text (-1), by prefix doubling; equal suffixes share a rank."""
    n, width = len(parse), 1
    rank = np.unique(parse, return_inverse=True)[1].astype(np.int64)
    ends = np.flatnonzero(parse < 0)
    end = ends[np.searchsorted(ends, np.arange(n))]
    while width < n:
        at = np.arange(n) + width
        key = (rank + 1) * (n + 2)
        inside = at <= end
        key[inside] += rank[at[inside]] + 1
        rank = np.unique(key, return_inverse=True)[1]
        width *= 2
    return rank


def suffix_order(texts: list[bytes]) -> list[tuple[int, int]]:
    """(text, offset) of every suffix of LENGTH bytes or more, in order of suffix and then text, by prefix-free parsing.

    A phrase is taken with the byte that ends it: that makes its suffixes prefix-free, for where one ended, another
    that goes on with the same bytes would have ended too. So suffixes of the corpus are ordered by the suffix of
    their phrase, from the dictionary, and where those are equal by the rank of the parse after it.
    """
    column = pa.array([t.decode("utf-8", "replace") for t in texts])
    phrases, parse_, docs_of, starts = [], [], [], []
    for lo, _, buf, docs in pieces(column):
        start, end, _, _, owner = parse(buf, docs)
        data = buf.tobytes()
        for s, e, d in zip(start.tolist(), end.tolist(), owner.tolist(), strict=True):
            stop = int(docs[d + 1]) - 1
            # the byte past the phrase's last window, or the end of the text, which sorts first
            phrases.append((data[s : min(e + LENGTH, stop)], e + LENGTH > stop))
            docs_of.append(lo + d)
            starts.append(s - int(docs[d]))
    name = _ranks(phrases)
    dictionary = dict(zip(name, phrases, strict=True))
    # suffixes of the dictionary that hold a whole window; a text's end is below any byte
    suffixes = {(i, o): tuple(text[o:]) + ((-1,) if last else ()) for i, (text, last) in dictionary.items() for o in range(len(text) - LENGTH + int(last))}
    keys = list(suffixes)
    order = dict(zip(keys, _ranks([suffixes[k] for k in keys]), strict=True))
    # the parse, with an end after each text
    for i, n in enumerate(name):
        parse_.append(n)
        if i + 1 == len(name) or docs_of[i + 1] != docs_of[i]:
            parse_.append(-1)
    rank = parse_suffix_array(np.array(parse_, np.int64))
    out, at = [], 0
    for i, n in enumerate(name):
        rest = int(rank[at + 1])
        text, last = dictionary[n]
        out += [((order[n, o], 0 if last else rest), docs_of[i], starts[i] + o) for o in range(len(text) - LENGTH + int(last))]
        at += 1 if i + 1 < len(name) and docs_of[i + 1] == docs_of[i] else 2
    return [(d, o) for _, d, o in sorted(out)]
