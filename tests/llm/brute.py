"""Slow, plain versions that the operators are held against."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[a-z0-9_\x80-\U0010ffff]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingle_list(text):
    w = words(text)
    q = min(5, len(w))
    return [tuple(w[i : i + q]) for i in range(len(w) - q + 1)] if w else []


def near_classes(docs):
    """doc_id -> smallest doc_id of its component of Jaccard links at 0.8 or more."""
    sets = {d: frozenset(shingle_list(t)) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 10 * shared >= 8 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def leaks(docs, items):
    out = {}
    for d, text in docs:
        own = words(text)
        for i, item in items:
            w = words(item)
            if not w:
                continue
            q = min(5, len(w))
            bag = Counter(tuple(w[k : k + q]) for k in range(len(w) - q + 1))
            grams = [tuple(own[k : k + q]) for k in range(len(own) - q + 1)]
            size = len(w) - q + 1
            best = 0
            for s in range(max(1, len(grams) - size + 1)) if grams else ():
                mine = Counter(grams[s : s + size])
                best = max(best, sum((mine & bag).values()) / sum((mine | bag).values()))
            if best >= 0.8:
                out[d, i] = round(best, 6)
    return out


def removed(docs, length=200):
    """doc_id -> (bytes, marks) with marks true where a repeated string covers the byte; docs may repeat ids in order."""
    bodies = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[i : i + length] for _, b in bodies for i in range(len(b) - length + 1))
    out = []
    for d, b in bodies:
        marks = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                marks[i : i + length] = [True] * length
        out.append((d, b, marks))
    return out


def kneser_ney(docs):
    """doc_id -> (held out, tokens, known, base, score), and the number of training tokens."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOWER)) + [None]
    texts = {d: split(t) for d, t in docs}
    out_of = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    uni, pairs = Counter(), Counter()
    for d, x in texts.items():
        if not out_of[d]:
            uni.update(x)
            pairs.update(zip(["<s>", *x[:-1]], x))
    total, size = sum(uni.values()), len(uni)

    def discounts(values):
        n = Counter(values)
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
        d = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] and n[k + 1] else 0.5 * k for k in (1, 2, 3)]
        return [0, *(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d))]

    cont = Counter(w for _, w in pairs)
    big, small = discounts(pairs.values()), discounts(cont.values())
    contexts = defaultdict(lambda: [0, 0, 0, 0])
    for (v, _), k in pairs.items():
        contexts[v][0] += k
        contexts[v][min(k, 3)] += 1
    types = len(pairs)
    spare = sum(small[min(k, 3)] for k in cont.values()) / types if types else 1

    def p(v, w):
        low = (max(cont[w] - small[min(cont[w], 3)], 0) / types if types else 0) + spare / (size + 1)
        if v not in contexts:
            return low
        c, *n = contexts[v]
        k = pairs[v, w]
        return max(k - big[min(k, 3)], 0) / c + sum(big[i + 1] * n[i] for i in range(3)) / c * low

    return {d: (out_of[d], len(x), sum(uni[w] > 0 for w in x), sum(math.log10((uni[w] + 1) / (total + size + 1)) for w in x), sum(math.log10(p(v, w)) for v, w in zip(["<s>", *x[:-1]], x))) for d, x in texts.items()}, total
