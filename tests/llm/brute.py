"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import re

SPACES = r"[^\x20\x09-\x0D]+"


def lower(t):
    return re.sub("[A-Z]", lambda x: x[0].lower(), t or "")


def near_dup(docs, shingle, percent=80):
    def of(t):
        w = re.findall(SPACES, lower(t))
        return frozenset(zip(*(w[i:] for i in range(shingle)))) if len(w) >= shingle else frozenset([tuple(w)]) if w else frozenset()

    sets = {d: of(t) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    inverted = collections.defaultdict(list)
    for d in ids:
        for s in sets[d]:
            inverted[s].append(d)
    for d in ids:
        for e, n in collections.Counter(e for s in sets[d] for e in inverted[s] if e < d).items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[e]) - n):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def repeats(docs, length=50):
    rows = [(d, (t or "").encode()) for d, t in docs]
    first = {}
    for d, b in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], d)
    out = []
    for d, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if d is not None and first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def contamination(docs, items, window=10):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = re.findall(WORD, lower(t))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[k : k + window])].add(i)
    out = []
    for d, t in docs:
        w = re.findall(WORD, lower(t))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= x
        names = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _valid(kind, m):
    digits = [int(c) for c in re.sub("[^0-9]", "", m)]
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 if x > 4 else 2 * x for i, x in enumerate(digits[::-1])) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def personal(text):
    return [(k, m.start(), m.end()) for k, p in KINDS.items() for m in re.finditer(p, text or "") if _valid(k, m[0])]


def measures(t):
    w = re.findall(SPACES, t or "")
    c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(SPACES, line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered)]
