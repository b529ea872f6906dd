"""Vectorised text primitives: whole Arrow batches become byte arrays, words become spans and 64-bit hashes.

Every helper works on pieces of bounded bytes, so a batch of long documents never needs more than a few
arrays of a piece's length; one document longer than a piece makes a piece of its own.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
_U = np.uint64
#: Hashes are polynomials of the bytes modulo the prime 2^61 - 1, at a base drawn once for this code.
_P = _U((1 << 61) - 1)
_PRIME, _BASE = (1 << 61) - 1, 0x1C3A5D9B47E2F681
#: Bytes of a span that one difference of running sums can hold without overflow.
_RUN = 1 << 22
_POWERS: dict[str, np.ndarray] = {}
#: What a Python worker keeps from task to task, by its key: one thing at most.
_KEPT: dict = {}

#: Bytes of white space \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
NONSPACE = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def give_back() -> None:
    """Hand memory that was freed back to the system, where the C library can; a worker that idles holds only what it keeps."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def kept(key: object = None, make: Callable[[], object] = lambda: None) -> object:
    """make()'s result, made once in a worker while its tasks ask for the same key.

    Workers serve all operators of a session in turn, so what another operator kept goes first; an operator that keeps
    nothing asks for None.
    """
    if _KEPT.get("key") != key:
        _KEPT.clear()
        _POWERS.clear()
        gc.collect()  # an encoder refers to itself
        give_back()
        _KEPT.update(key=key, value=make())
    return _KEPT.get("value")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes, in place."""
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def _reduce(x: np.ndarray) -> np.ndarray:
    """x modulo 2^61 - 1, up to one multiple."""
    return (x & _P) + (x >> _U(61))


def mul61(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1, for factors below 2^61."""
    a1, a0, b1, b0 = a >> _U(31), a & _U(0x7FFFFFFF), b >> _U(31), b & _U(0x7FFFFFFF)
    mid = a1 * b0 + a0 * b1
    x = _reduce(a1 * b1 * _U(2) + (mid >> _U(30)) + ((mid & _U(0x3FFFFFFF)) << _U(31)) + a0 * b0)
    return np.where(x >= _P, x - _P, x)


def _power_table(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = mul61(out[:more], np.full(more, pow(base, done, _PRIME), np.uint64))
        done += more
    return out


def _powers(n: int) -> dict[str, np.ndarray]:
    """Powers of the base (high and low part) and of its inverse; tables for one overlong text are not kept."""
    if len(_POWERS.get("down", ())) >= n:
        return _POWERS
    size = max(n, PIECE_BYTES * 2)
    up = _power_table(_BASE, size)
    out = {"high": (up >> _U(32)).astype(np.uint32), "low": up.astype(np.uint32), "down": _power_table(pow(_BASE, -1, _PRIME), size)}
    if size <= PIECE_BYTES * 4:
        _POWERS.update(out)
    return out


class Sums:
    """Running sums of a buffer's bytes times powers of the base, in two parts."""

    def __init__(self, buf: np.ndarray):
        powers = _powers(len(buf) + 1)
        byte = buf.astype(np.uint64) + _U(1)
        self.down = powers["down"]
        self.high, self.low = (np.zeros(len(buf) + 1, np.uint64) for _ in range(2))
        np.cumsum(byte * powers["high"][: len(buf)], out=self.high[1:])
        np.cumsum(byte * powers["low"][: len(buf)], out=self.low[1:])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        high, low = _reduce(self.high[end] - self.high[start]), _reduce(self.low[end] - self.low[start])
        x = _reduce(((high & _U(0x1FFFFFFF)) << _U(32)) + (high >> _U(29)) + low)
        return np.where(x >= _P, x - _P, x)


def prefix_hash(buf: np.ndarray) -> Sums:
    """What span_hash needs of a buffer."""
    return Sums(buf)


def span_hash(prefix: Sums, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end], the same for equal bytes wherever they stand (61 bits tell spans apart)."""
    start, end = np.asarray(start), np.asarray(end)
    total = prefix.between(start, np.minimum(end, start + _RUN))
    for i in np.flatnonzero(end - start > _RUN):  # a span of many MB, by runs
        for at in range(int(start[i]) + _RUN, int(end[i]), _RUN):
            total[i] = (int(total[i]) + int(prefix.between(np.array([at]), np.array([min(at + _RUN, int(end[i]))]))[0])) % _PRIME
    return mix64(mul61(total, prefix.down[start]))


def identities(buf: np.ndarray, start: np.ndarray, end: np.ndarray, prefix: Sums | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(a number for each span, the first span of each number): equal numbers exactly where the bytes are equal."""
    h = span_hash(prefix_hash(buf) if prefix is None else prefix, start, end)
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    size, rep = end - start, first[number]
    same = bool((size == size[rep]).all())
    check = np.flatnonzero(rep != np.arange(len(rep)))
    total = np.cumsum(size[check])
    for part in np.split(check, np.searchsorted(total, np.arange(PIECE_BYTES, int(total[-1]) if len(total) else 0, PIECE_BYTES))):
        if same and len(part):
            n = size[part]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            same = bool((buf[np.repeat(start[part], n) + k] == buf[np.repeat(start[rep[part]], n) + k]).all())
    if same:
        return number, first
    # hashes of different bytes were equal: by the bytes themselves
    data, known = buf.tobytes(), {}
    number = np.array([known.setdefault(data[s:e], len(known)) for s, e in zip(start.tolist(), end.tolist(), strict=True)], np.int64)
    return number, np.unique(number, return_index=True)[1]


def heads(buf: np.ndarray, start: np.ndarray, width: int = 16) -> np.ndarray:
    """The ``width`` bytes (a multiple of 8) from each position as little-endian numbers, a row each; zeros past the end."""
    padded = np.concatenate((buf, np.zeros(width, np.uint8)))
    return np.ndarray((len(buf) + 1,), f"V{width}", padded, strides=(1,))[start].view("<u8").reshape(-1, width // 8)


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes with a \\n after each document, start of each document and the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        at = offsets[lo : hi + 1] - offsets[lo]
        buf = np.insert(data[offsets[lo] : offsets[hi]], at[1:], np.uint8(10))
        yield lo, hi, buf, at + np.arange(hi - lo + 1)
        lo = hi
    give_back()


def word_spans(buf: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes; buf ends with a non-word byte."""
    w = is_word[buf]
    edge = np.flatnonzero(w[1:] != w[:-1]) + 1
    if len(w) and w[0]:
        edge = np.concatenate(([0], edge))
    return edge[::2], edge[1::2]


def doc_of(starts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The document each position is in; docs: starts of documents, and the end."""
    return np.searchsorted(docs, starts, "right") - 1
