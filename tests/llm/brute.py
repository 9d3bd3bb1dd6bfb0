"""Plain definitions of the operators' results."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fingerprint(text):
    w = words(lower(text))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, prints):
    """Smallest id (None last) reachable by links of at most four bits."""
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        r = root(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [least.get(root(i)) for i in range(len(ids))]


def contamination(docs, items):
    wins = {}
    for item, text in items:
        w = ALNUM.findall(lower(text))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    lens, out = {len(x) for x in wins}, []
    for doc, text in docs:
        w = ALNUM.findall(lower(text))
        hit, names = [False] * len(w), set()
        for n in lens:
            for k in range(len(w) - n + 1):
                if x := wins.get(tuple(w[k : k + n])):
                    names |= x
                    hit[k : k + n] = [True] * n
        out.append((doc, len(w), sum(hit), len(names), sha(",".join(sorted(names))), any(hit)))
    return out


def spans(docs, n=20):
    seen, out = set(), []
    for doc, text in docs:  # in order
        w = words(text)
        cut = [False] * len(w)
        for k in range(len(w) - n + 1):
            x = tuple(w[k : k + n])
            if x in seen:
                cut[k : k + n] = [True] * n
            seen.add(x)
        out.append((doc, len(w), sum(cut), sha(" ".join(a for a, c in zip(w, cut, strict=True) if not c))))
    return out


def base_counts(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    twice, inside = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2)), set()
    for i in range(len(w) - 2):
        if twice[tuple(w[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def shards(docs, n=8):
    """docs in order of id."""
    sizes = [len((t or "").encode()) + 1 for _, t in docs]
    total, before, slots, out = sum(sizes), 0, Counter(), []
    for (doc, t), z in zip(docs, sizes, strict=True):
        s = (2 * before + z) * n // (2 * total)
        before += z
        out.append((doc, z, zlib.crc32((t or "").encode()), "bytes", s, slots[s], None))
        slots[s] += 1
    return out


def lines(docs, least=2):
    """docs in order of id."""
    parts = []
    for doc, text in docs:
        ls = (text or "").split("\n")
        parts.append((doc, ls, [k for k, x in enumerate(ls) if WORD.search(x)]))
    longest = max([len(x) for _, _, x in parts] + [0])
    often = {}
    for n in range(1, longest + 1):
        c = Counter(tuple(ls[k] for k in idx[a : a + n]) for _, ls, idx in parts for a in range(len(idx) - n + 1))
        often[n] = {k for k, v in c.items() if v > 1}
    seen, out = set(), []
    for doc, ls, idx in parts:
        cut, run = set(), 0
        for a in range(len(idx)):
            x = tuple(ls[k] for k in idx[a : a + least])
            if len(x) == least:
                if x in seen:
                    cut |= set(idx[a : a + least])
                seen.add(x)
            n = 1
            while a + n <= len(idx) and tuple(ls[k] for k in idx[a : a + n]) in often[n]:
                run, n = max(run, n), n + 1
        out.append((doc, len(idx), len(cut), run, sha("\n".join(x for k, x in enumerate(ls) if k not in cut))))
    return out
