"""Plain versions of the operators' contracts, for small tables."""

import hashlib
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(0x41, 0x5B)}


def low(text):
    return (text or "").translate(UPPER)


def shingles(text, k=5):
    w = WORD.findall(low(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(rows):
    """{doc_id: (n, component)} of (doc_id, text) rows with distinct ids."""
    sets = [(d, shingles(t)) for d, t in rows]
    up = {d: d for d, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return {d: (len(x), root(d)) for d, x in sets}


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def policy_fails(text):
    """Whether any rule of the current policy rejects a text."""
    n, chars, symbols, lines, _, failed = quality(text)
    return failed or 10 * symbols > 4 * n or 3 * lines > n or chars < 2 * n or chars > 20 * n


def contamination(text, items):
    w = ALNUM.findall(low(text))
    hit, names = set(), set()
    for item, t in items:
        x = ALNUM.findall(low(t))
        n = min(13, len(x))
        if not n:
            continue
        windows = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                names.add(str(item))
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(w), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(w)


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n
