"""The contracts, row by row and without Spark."""

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash
import zstandard

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def words(t):
    return WORD.findall((t or "").translate(ASCII))


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def pii(t):
    """Base spans as (kind, start, end)."""
    t, out = t or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ]
    for kind, pattern, ok in rules:
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, t) if ok(m[0])]
    return out


def licenses(t):
    w = words(t)
    phrases = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
    hits = [(i, k) for k, p in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({k for _, k in hits}))


def targets(rows):
    """source -> target of rows (source, size)."""
    size = Counter()
    for s, n in rows:
        size[s] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, rest, out = set(order), sum(size.values()), {}
    while left:
        level = rest / sum(weight[s] for s in left)
        over = [s for s in left if level * weight[s] > 3 * size[s]]
        if not over:
            return out | {s: level * weight[s] for s in left}
        for s in over:
            out[s] = 3 * size[s]
            rest -= out[s]
            left.discard(s)
    return out


def repeats(texts, length=400):
    """For each text (bytes): flags of the bytes that repeated strings cover."""
    n = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if n[t[i : i + length]] > 1:
                cover[i : i + length] = True
        out.append(cover)
    return out


def contaminated(t, items):
    """(n_words, n_hit, n_items, items_sha256, contaminated); items: (item_id, text)."""
    w, hit, found = words(t), set(), set()
    for i, text in items:
        x = words(text)
        k = min(10, len(x))
        for s in range(len(x) - k + 1) if x else ():
            for p in range(len(w) - k + 1):
                if w[p : p + k] == x[s : s + k]:
                    hit.update(range(p, p + k))
                    found.add(str(i))
    return len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


def fingerprint(t):
    w = TOKEN.findall((t or "").translate(ASCII))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], dtype=np.uint64)
    return sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(shingles))


def components(ids, fps, radius=4):
    """The least id that each can reach."""
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    arr = np.array(fps, dtype=np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= radius):
            up[find(int(j))] = find(i)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def line_key(x):
    return x.strip(" \t\n\x0b\x0c\r").translate(ASCII)


def hot_lines(rows, least=10):
    """Keys in as many documents, of rows (doc_id, text); a row without an id is one."""
    where = {}
    for n, (d, t) in enumerate(rows):
        for x in (t or "").split("\n"):
            if line_key(x):
                where.setdefault(line_key(x), set()).add(("row", n) if d is None else d)
    return {k for k, v in where.items() if len(v) >= least}


def quality(t):
    t = t or ""
    w = TOKEN.findall(t)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if TOKEN.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def in_band(raw, limits, level):
    """Whether bytes compress as their length asks; True below the first length."""
    of = [x for x in limits if x[0] <= len(raw)]
    if not of:
        return True
    _, low, low_large, high = max(of)
    share = 3 * sum(0xE3 <= b <= 0xEF for b in raw) / len(raw)
    least = 1 / ((1 - share) / low + share / low_large) if low else 0
    return least <= len(raw) / len(zstandard.ZstdCompressor(level=level).compress(raw)) <= high


def kept(t, bands):
    """The verdict on a text: words, the whole text, then its chunks by the bytes that they hold."""
    raw = (t or "").encode()
    if quality(t)[-1] or not in_band(raw, bands.limits, bands.level):
        return False
    if len(raw) < max(bands.chunk, bands.limits[0][0]):
        return True
    parts = [raw[i : i + bands.chunk] for i in range(0, len(raw), bands.chunk)]
    return sum(len(x) for x in parts if not in_band(x, bands.limits, bands.level)) <= bands.bad_share * len(raw)
