"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile("[^" + re.escape(SPACE) + "]+")


def words(text):
    return WORD.findall(text or "")


def substring_dedup(docs, length=13):
    """{row number: (doc_id, n_words, n_removed, sha256)}; docs: (doc_id, text)."""
    least = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            least[k] = min(least.get(k, float("inf")), float("inf") if d is None else d)
    out = []
    for d, t in docs:
        w = words(t)
        gone = set()
        for i in range(len(w) - length + 1):
            if least[tuple(w[i : i + length])] < (float("inf") if d is None else d):
                gone.update(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def near_duplicates(docs, k=5, percent=80):
    """[(doc_id, n_shingles, component_id, kept)] of rows with distinct ids."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t in docs:
        w = words((t or "").translate(lower))
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(d, len(sets[d]), find(d), find(d) == d) for d in ids]


def repeat_words(w, n=8):
    seen = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    hit = set()
    for i in range(len(w) - n + 1):
        if seen[tuple(w[i : i + n])] > 1:
            hit.update(range(i, i + n))
    return len(hit)


def quality(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    rep = repeat_words(w)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), rep, len(w) < 20 or 100 * rep > 30 * len(w)


def patience(a, b):
    """Pairs of equal lines that patience diff matches, by recursion."""

    def solve(i, j, k, m):
        out = []
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        ca, cb = Counter(a[i:j]), Counter(b[k:m])
        both = [(x, b.index(a[x], k, m)) for x in range(i, j) if ca[a[x]] == 1 and cb[a[x]] == 1]
        best = [[] for _ in both]
        for n, (_, y) in enumerate(both):
            best[n] = max((best[p] for p in range(n) if both[p][1] < y), key=len, default=[]) + [both[n]]
        chain = max(best, key=len, default=[])
        if chain:
            edges = [(i - 1, k - 1), *chain, (j, m)]
            out += chain
            for (x, y), (u, v) in zip(edges, edges[1:], strict=False):
                out += solve(x + 1, u, y + 1, v)
        return out

    return sorted(solve(0, len(a), 0, len(b)))


def runs_left(docs, min_chars=50):
    """{doc_id: text without the lines in a run of min_chars that an earlier document holds}, each run tried with each document."""
    lines = {d: (t or "").split("\n") for d, t in docs.items()}
    size = lambda x: len(x) if words(x) else 0
    out = {}
    for d, b in lines.items():
        gone = set()
        for e in lines:
            a = lines[e] if e < d else []
            for x in range(len(a)):
                for y in range(len(b)):
                    n = 0
                    while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                        n += 1
                    if sum(map(size, b[y : y + n])) >= min_chars:
                        gone.update(range(y, y + n))
        out[d] = "\n".join(x for i, x in enumerate(b) if i not in gone) if gone else docs[d]
    return out
