"""Plain-Python versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

UPPER = {i: i + 32 for i in range(65, 91)}


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def shingles(text, n=5):
    w = blank_words((text or "").translate(UPPER))
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard_components(rows):
    """rows: (id, text); ids may repeat.  {id: component}, sizes in the order of rows."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return {i: root(i) for i in parent}, [len(s) for _, s in sets]


def contamination(rows, items, window=10):
    """(id, n_words, n_hit, sorted items) of each row."""
    windows = defaultdict(set)
    for item, text in items:
        w = alnum_words(text)
        if item is not None and w:
            for i in range(max(1, len(w) - window + 1)):
                windows[tuple(w[i:i + window])].add(str(item))
    out = []
    for ident, text in rows:
        w, hit, found = alnum_words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i:i + n]))):
                    hit |= set(range(i, i + n))
                    found |= own
        out.append((ident, len(w), len(hit), sorted(found)))
    return out


def earlier_bytes(rows, length=50):
    """(id, n_bytes, n_removed, n_spans, kept) of each row; a null id is the largest."""
    key = lambda i: float("inf") if i is None else i
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            first[w] = min(first.get(w, float("inf")), key(i))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < key(i):
                gone[p:p + length] = b"\1" * length
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def repeated_words(rows, length=35):
    """(id, n_words, n_removed, kept) of each row."""
    words = [(i, blank_words(t)) for i, t in rows]
    seen = Counter(tuple(w[p:p + length]) for _, w in words for p in range(len(w) - length + 1))
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - length + 1):
            if seen[tuple(w[p:p + length])] > 1:
                gone |= set(range(p, p + length))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()
