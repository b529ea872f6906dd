"""A bidirectional gated recurrent network with attention pooling, in numpy: forward, backward, training.

A step's input joins a hashed word vector and the mean of hashed vectors of the word's parts (byte 4-grams, and
3 and 6 bytes at either edge), so that unseen words still show their parts. Windows are rows of word numbers, -1 past the
end; steps past the end leave the state as it is and get no attention.
"""

from __future__ import annotations

import numpy as np

from .textprims import LOWER, doc_of, mix64, pieces, prefix_hash, span_hash, word_spans

SLOTS, WORD_DIM, CHAR_DIM, HIDDEN = 1 << 13, 8, 16, 16
WINDOW, STRIDE = 32, 16
GRAM, EDGES = 4, (3, 6)
_U = np.uint64

#: Words are runs of ASCII letters and digits and of bytes beyond ASCII, in lower case.
IS_WORD = np.ones(256, bool)
IS_WORD[0x00:0x30] = IS_WORD[0x3A:0x61] = IS_WORD[0x7B:0x80] = False


class Words:
    """Distinct words of some texts: word slots, and gram slots of each (CSR); and the texts as word numbers."""

    def __init__(self, buf: np.ndarray, docs: np.ndarray):
        buf = LOWER[buf]
        starts, ends = word_spans(buf, IS_WORD)
        prefix = prefix_hash(buf)
        h = span_hash(prefix, starts, ends)
        keys, first, self.number = np.unique(h, return_index=True, return_inverse=True)
        self.keys = keys
        self.slot = (keys % _U(SLOTS)).astype(np.int64)
        s, e = starts[first], ends[first]
        ends_of = 2 * len(EDGES)
        size = np.maximum(e - s - GRAM + 1, 0) + ends_of  # the grams inside, and those at either edge
        self.at = np.concatenate(([0], np.cumsum(size)))
        word = np.repeat(np.arange(len(s)), size)
        k = np.arange(self.at[-1]) - self.at[word]
        a = s[word] + np.maximum(k - ends_of, 0)
        b = a + GRAM
        for i, n in enumerate(EDGES):
            front, back = self.at[:-1] + 2 * i, self.at[:-1] + 2 * i + 1
            a[front], b[front] = s, np.minimum(s + n, e)
            a[back], b[back] = np.maximum(e - n, s), e
        kind = np.minimum(k, ends_of).astype(_U)
        self.gram = (mix64(span_hash(prefix, a, b) + kind * _U(0x9E3779B97F4A7C15)) % _U(SLOTS)).astype(np.int64)
        self.size = size
        self.begin = np.searchsorted(doc_of(starts, docs), np.arange(len(docs)))  # first word of each text, and the end

    @classmethod
    def of(cls, column) -> "Words":
        """The words of many texts, put together from pieces of bounded size."""
        parts = [cls(buf, docs) for _, _, buf, docs in pieces(column)]
        out = cls.__new__(cls)
        keys = np.concatenate([p.keys for p in parts])
        out.keys, first, back = np.unique(keys, return_index=True, return_inverse=True)
        size = np.concatenate([p.size for p in parts])
        start = np.cumsum(size) - size
        gram = np.concatenate([p.gram for p in parts])
        out.slot = np.concatenate([p.slot for p in parts])[first]
        out.size = size[first]
        out.at = np.concatenate(([0], np.cumsum(out.size)))
        out.gram = gram[np.repeat(start[first] - out.at[:-1], out.size) + np.arange(out.at[-1])]
        shift = np.cumsum([0] + [len(p.keys) for p in parts])
        out.number = back[np.concatenate([p.number + k for p, k in zip(parts, shift, strict=False)])]
        base = np.cumsum([0] + [len(p.number) for p in parts])
        out.begin = np.concatenate([*(p.begin[:-1] + k for p, k in zip(parts, base, strict=False)), base[-1:]])
        return out


def windows_of(begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, start, length) of the overlapping windows of texts of words begin[i]:begin[i+1]; a text without words has none."""
    n = np.diff(begin)
    count = np.where(n > 0, np.maximum(-(-(n - WINDOW) // STRIDE), 0) + 1, 0)
    owner = np.repeat(np.arange(len(n)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = begin[owner] + k * STRIDE
    return owner, start, np.minimum(WINDOW, begin[owner + 1] - start)


def new_model(seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    f = lambda *s, k=1.0: (r.standard_normal(s) * k).astype(np.float32)
    d, h = WORD_DIM + CHAR_DIM, HIDDEN
    m = {"Ew": f(SLOTS, WORD_DIM, k=0.1), "Ec": f(SLOTS, CHAR_DIM, k=0.3), "a": f(2 * h, k=0.3), "w": f(2 * h, k=0.3), "b": np.zeros(1, np.float32)}
    for s in "fb":
        m |= {f"W{s}": f(d, 3 * h, k=d**-0.5), f"U{s}": f(h, 3 * h, k=h**-0.5), f"c{s}": np.zeros(3 * h, np.float32)}
    return m


def word_inputs(m: dict, words: Words, pick: np.ndarray | None = None) -> np.ndarray:
    """Input vectors of all words, or of those picked."""
    if pick is None:
        at, gram, size, slot = words.at[:-1], words.gram, words.size, words.slot
    else:
        size, slot = words.size[pick], words.slot[pick]
        at = np.cumsum(size) - size
        gram = words.gram[np.repeat(words.at[pick] - at, size) + np.arange(size.sum())]
    if not len(slot):
        return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
    chars = np.add.reduceat(m["Ec"][gram], at, axis=0) / size[:, None].astype(np.float32)
    return np.concatenate([m["Ew"][slot], chars], 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def run(m: dict, inputs: np.ndarray, index: np.ndarray, keep: bool = False):
    """Logits of windows (index: windows x WINDOW of input rows, -1 past the end); with keep, what backward needs."""
    n, steps = index.shape
    h = HIDDEN
    # one row more, of zeros, stands for steps past the end
    proj = {s: np.concatenate([inputs @ m[f"W{s}"] + m[f"c{s}"], np.zeros((1, 3 * h), np.float32)]) for s in "fb"}
    out = np.empty((steps, n, 2 * h), np.float32)
    tape: dict = {"f": {}, "b": {}}
    full = bool((index >= 0).all())
    for s, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        state = np.zeros((n, h), np.float32)
        u, lo = m[f"U{s}"], 0 if s == "f" else h
        for t in order:
            x = proj[s][index[:, t]]
            hu = state @ u
            zr = _sigmoid(x[:, : 2 * h] + hu[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(x[:, 2 * h :] + r * hu[:, 2 * h :])
            new = c + z * (state - c)
            if not full:
                on = (index[:, t] >= 0)[:, None]
                new = np.where(on, new, state)
            if keep:
                tape[s][t] = (state, z, r, c, hu[:, 2 * h :])
            state = new
            out[t, :, lo : lo + h] = new
    e = out @ m["a"]
    e[index.T < 0] = -1e9
    e = np.exp(e - e.max(0))
    alpha = e / e.sum(0)
    pooled = np.einsum("tn,tnh->nh", alpha, out)
    logit = pooled @ m["w"] + m["b"][0]
    return (logit, out, alpha, pooled, tape) if keep else logit


def gradients(m: dict, inputs: np.ndarray, index: np.ndarray, dlogit: np.ndarray, kept: tuple) -> tuple[dict, np.ndarray]:
    """Gradients of the dense weights and of the inputs."""
    _, out, alpha, pooled, tape = kept
    h, (steps, n) = HIDDEN, alpha.shape
    g = {"w": pooled.T @ dlogit, "b": np.array([dlogit.sum()], np.float32)}
    dpool = dlogit[:, None] * m["w"]
    da = np.einsum("tnh,nh->tn", out, dpool)
    de = alpha * (da - (alpha * da).sum(0))
    g["a"] = np.einsum("tn,tnh->h", de, out)
    dout = alpha[:, :, None] * dpool + de[:, :, None] * m["a"]
    dx = np.zeros_like(inputs)
    flat = index.T.ravel()
    on_flat = np.flatnonzero(flat >= 0)
    order = on_flat[np.argsort(flat[on_flat], kind="stable")]
    rows, begin = np.unique(flat[order], return_index=True)
    for s, back in (("f", range(steps - 1, -1, -1)), ("b", range(steps))):
        u, lo = m[f"U{s}"], 0 if s == "f" else h
        dproj = np.zeros((steps, n, 3 * h), np.float32)
        gu = np.zeros_like(u)
        carry = np.zeros((n, h), np.float32)
        for t in back:
            state, z, r, c, hn = tape[s][t]
            d = dout[t, :, lo : lo + h] + carry
            on = (index[:, t] >= 0)[:, None]
            dn = np.where(on, d, 0)
            dc = dn * (1 - z) * (1 - c * c)
            dz = dn * (state - c) * z * (1 - z)
            dr = dc * hn * r * (1 - r)
            dproj[t] = np.concatenate([dz, dr, dc], 1)
            du = np.concatenate([dz, dr, dc * r], 1)
            gu += state.T @ du
            carry = np.where(on, dn * z, d) + du @ u.T
        gp = np.add.reduceat(dproj.reshape(-1, 3 * h)[order], begin, axis=0)
        g[f"U{s}"], g[f"c{s}"] = gu, gp.sum(0)
        g[f"W{s}"] = inputs[rows].T @ gp
        dx[rows] += gp @ m[f"W{s}"].T
    return g, dx


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.s = rate, 0, {}

    def step(self, m: dict, g: dict) -> None:
        self.t += 1
        for k, x in g.items():
            a, b = self.s.setdefault(k, (np.zeros_like(m[k]), np.zeros_like(m[k])))
            a += 0.1 * (x - a)
            b += 0.01 * (x * x - b)
            m[k] -= self.rate * (a / (1 - 0.9**self.t)) / (np.sqrt(b / (1 - 0.99**self.t)) + 1e-6)


def _scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, values.shape[1]), np.float32)
    order = np.argsort(rows, kind="stable")
    at, begin = np.unique(rows[order], return_index=True)
    out[at] = np.add.reduceat(values[order], begin, axis=0)
    return out


def train_epoch(m: dict, opt: Adam, words: Words, index: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator, batch: int = 256) -> float:
    """One pass over windows (index of word numbers) with targets y."""
    loss = 0.0
    for pick in np.array_split(rng.permutation(len(index)), max(1, -(-len(index) // batch))):
        used, local = np.unique(index[pick], return_inverse=True)
        local = local.reshape(len(pick), WINDOW)
        if used[0] == -1:
            used, local = used[1:], local - 1
        x = word_inputs(m, words, used)
        drop = (rng.random((len(used), 1)) < 0.5).astype(np.float32)
        x[:, :WORD_DIM] *= drop
        kept = run(m, x, local, keep=True)
        p = _sigmoid(kept[0])
        loss += float(-(weight[pick] * np.where(y[pick] > 0.5, np.log(p + 1e-7), np.log(1 - p + 1e-7))).sum())
        g, dx = gradients(m, x, local, ((p - y[pick]) * weight[pick] / len(pick)).astype(np.float32), kept)
        size = words.size[used]
        at = np.cumsum(size) - size
        gram = words.gram[np.repeat(words.at[used] - at, size) + np.arange(size.sum())]
        g["Ew"] = _scatter(words.slot[used], dx[:, :WORD_DIM] * drop, SLOTS) + 1e-5 * m["Ew"]
        g["Ec"] = _scatter(gram, np.repeat(dx[:, WORD_DIM:] / size[:, None].astype(np.float32), size, axis=0), SLOTS) + 1e-5 * m["Ec"]
        opt.step(m, g)
    return loss / max(1, len(index))


def window_index(words: Words, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    k = np.arange(WINDOW)
    at = start[:, None] + k
    inside = k < length[:, None]
    return np.where(inside, words.number[np.where(inside, at, 0)] if len(words.number) else -1, -1)


def best_windows(m: dict, column, most: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: the highest window logit (-inf without words), the number of windows, the first word of that window."""
    tops, counts, places = [], [], []
    for lo, hi, buf, docs in pieces(column):
        words = Words(buf, docs)
        owner, start, length = windows_of(words.begin)
        inputs = word_inputs(m, words)
        logit = np.empty(len(start), np.float32)
        # full windows run apart from short ones: they need no masks
        for part in (np.flatnonzero(length == WINDOW), np.flatnonzero(length < WINDOW)):
            for i in range(0, len(part), most):
                pick = part[i : i + most]
                logit[pick] = run(m, inputs, window_index(words, start[pick], length[pick]))
        n = hi - lo
        top = np.full(n, -np.inf, np.float32)
        np.maximum.at(top, owner, logit)
        place = np.zeros(n, np.int64)
        hit = np.flatnonzero(logit == top[owner])[::-1]
        place[owner[hit]] = start[hit] - words.begin[owner[hit]]
        tops.append(top)
        counts.append(np.bincount(owner, minlength=n))
        places.append(place)
    if not tops:
        return np.zeros(0, np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(tops), np.concatenate(counts), np.concatenate(places)
