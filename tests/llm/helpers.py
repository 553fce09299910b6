"""Brute-force twins of the corpus operators, over plain lists."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def quality(text):
    w = WORDS.findall(text or "")
    n = Counter(zip(w, w[1:], w[2:], strict=False))
    marked = {j for i in range(len(w) - 2) if n[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    failed = len(w) < 50 or 100 * len(marked) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked), failed


def substring(rows, k=35):
    words = [WORDS.findall(t or "") for _, t in rows]
    n = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - k + 1) if n[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone).encode())))
    return out


def suffix(rows, k=200):
    data = [(t or "").encode() for _, t in rows]
    n = Counter(b[i : i + k] for b in data for i in range(len(b) - k + 1))
    out = []
    for (doc, _), b in zip(rows, data, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - k + 1):
            if n[b[i : i + k]] > 1:
                gone[i : i + k] = b"\1" * k
        out.append((doc, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def shingle_set(text, k=5):
    w = WORDS.findall(lower(text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def groups(rows):
    """doc_id, n_shingles, component_id; rows are nodes, a null doc_id links with nothing."""
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 80 * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [(doc, len(s), None if doc is None else least[root(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))]


def decontam(rows, items, k=10):
    where = defaultdict(set)
    for item, text in items:
        w = ITEM_WORDS.findall(lower(text or "")) if item is not None else []
        for i in range(max(len(w) - k + 1, bool(w))):
            where[tuple(w[i : i + k])].add(str(item))
    sizes = {len(x) for x in where}
    out = []
    for doc, text in rows:
        w, hit, own = ITEM_WORDS.findall(lower(text or "")), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := where.get(tuple(w[i : i + n])):
                    own |= found
                    hit |= set(range(i, i + n))
        out.append((doc, len(w), len(hit), len(own), sha(",".join(sorted(own)).encode()), bool(hit)))
    return out


def lm_base(rows):
    toks = [[*WORDS.findall(lower(t or "")), None] for _, t in rows]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in rows]
    c = Counter(x for t, h in zip(toks, held, strict=True) if not h for x in t)
    n, v = sum(c.values()), len(c)
    return [(d, h, len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)) for (d, _), h, t in zip(rows, held, toks, strict=True)]


def warc(rows):
    by = defaultdict(list)
    for page, html in rows:
        if page is not None:
            by[html or ""].append(page)
    out = []
    for page, html in rows:
        b, last = (html or "").encode(), max(by[html or ""], default=None)
        revisit = page is not None and page < last
        out.append((page, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", last if revisit else None))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))
