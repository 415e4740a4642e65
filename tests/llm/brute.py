"""Plain versions of the corpus operators' contracts, over {row: text} in memory."""

import re
from collections import Counter

SPACED = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def kept_words(texts, width):
    words = [SPACED.findall(t or "") for t in texts]
    count = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def kept_bytes(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(c for c, g in zip(b, gone) if not g)))
    return out


def shingles(text, n):
    w = SPACED.findall(fold(text))
    if len(w) >= n:
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def components(docs, n, threshold):
    """docs: [(id, text)] -> [(size, least id reachable, number of links)]."""
    links = [0] * len(docs)
    sets = [shingles(t, n) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                root[find(i)] = find(j)
                links[i] += 1
                links[j] += 1
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return [(len(s), least.get(find(i)), links[i]) for i, s in enumerate(sets)]


def hits(text, items, width):
    w, gone, found = ALNUM.findall(fold(text)), None, set()
    gone = [False] * len(w)
    for item, t in items:
        v = ALNUM.findall(fold(t))
        k = min(width, len(v))
        windows = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in windows:
                gone[i : i + k] = [True] * k
                if item is not None:
                    found.add(str(item))
    return len(w), sum(gone), sorted(found)
