"""Plain versions of the operators, written apart from them."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def exact(rows):
    groups = defaultdict(list)
    for k, (doc_id, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, k, doc_id))
    out = []
    for norm, members in groups.items():
        keep = min(members)
        out += [(m[4], keep[4], len(members), m is keep, hashlib.sha256(norm.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


def quality(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count, cover = Counter(windows), set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            cover |= {i, i + 1, i + 2}
    n, repeated = len(w), len(cover)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeated, n < 50 or 100 * repeated > 50 * n


def shingles(text):
    w = [x.translate(LOWER) for x in words(text)]
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def components(rows):
    """(doc_id, shingles, component) of rows with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                    x, y = top(a), top(b)
                    up[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), top(i)) for i in ids)


def repeats(rows, length=50):
    """(doc_id, n_bytes, n_removed, n_spans, sha)."""
    order = lambda i: (1 << 63) - 1 if i is None else i
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, t in data:
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            first[s] = min(first.get(s, order(i)), order(i))
    out = []
    for i, t in data:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < order(i):
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def base_scores(rows):
    tokens = {i: [w.translate(LOWER) for w in words(t)] + [None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c = Counter(w for i in tokens if not held[i] for w in tokens[i])
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for i, t in tokens.items()}


def kneser_ney(texts, order):
    """Interpolated modified Kneser-Ney over bytes: a function of (context bytes, byte), plain dictionaries."""
    raw = Counter()
    for t in texts:
        b = bytes(order - 1) + t.encode()
        raw.update(b[k : k + order] for k in range(len(b) - order + 1))
    levels = {order: raw}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def discount(k):
        n = Counter(levels[k].values())
        if not all(n[j] for j in (1, 2, 3, 4)):
            return [0, 0.5, 1.0, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        d = [0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
        return [0, *(min(max(x, 0.05), m) for x, m in zip(d[1:], (1, 2, 3), strict=True))]

    d = {k: discount(k) for k in levels}

    def p(context, byte):
        k = len(context) + 1
        lower = p(context[1:], byte) if k > 1 else 1 / 256
        mine = {g[-1]: c for g, c in levels[k].items() if g[:-1] == context}
        if not mine:
            return lower
        total = sum(mine.values())
        gamma = sum(d[k][min(c, 3)] for c in mine.values()) / total
        c = mine.get(byte, 0)
        return max(c - d[k][min(c, 3)], 0) / total + gamma * lower

    return p
