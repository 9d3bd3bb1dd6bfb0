"""Vectorised word splitting and rolling hashes over Arrow string columns.

A slice of texts is one byte array; words are byte ranges found with table lookups.  A word's hash takes in its bytes by
eights, one mixing step after the other, and a window's hash joins those of its halves likewise, so that no arithmetic
pattern of the text (as in polynomials modulo 2**64) makes different words or windows equal.  Everything works on whole
texts, in slices of about ``SLICE`` bytes (a longer text is a slice of its own), so that memory stays bounded by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE = 1 << 20
U = np.uint64
_ODD, _ODD2 = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
#: Words of more bytes are hashed one by one.
LONG = 256

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words [^\x20\x09-\x0D]+
SPACED = ~BLANK
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (digits, a-z and everything outside ASCII)
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all bits."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the pairs of ``a`` and ``b``, in this order."""
    h = a * _ODD
    h += b
    h ^= h >> U(29)
    h *= _ODD2
    h ^= h >> U(32)
    return h


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets of the rows in bytes); null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


class Words:
    """Words of a slice: ``start``/``end`` byte ranges, ``first`` (word number at which each text begins, plus the end)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, inside: np.ndarray = SPACED, cut: np.ndarray | None = None) -> None:
        self.data, self.offs = data, offs
        w = inside[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offs] = True
        begin, stop = w.copy(), w.copy()
        if len(w):
            begin[1:] &= ~w[:-1] | edge[1:-1]
            stop[:-1] &= ~w[1:] | edge[1:-1]
        if cut is not None:  # bytes at which a word begins in any case
            cut = np.flatnonzero(cut & w)
            cut = cut[~edge[cut]]
            begin[cut], stop[cut - 1] = True, w[cut - 1]
        self.inside = w
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offs)
        self.count = np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def eights(self) -> np.ndarray:
        """The 8 bytes from each byte of the slice on as one number (zeros behind its end)."""
        return np.ndarray(len(self.data) + 1, "<u8", np.append(self.data, np.zeros(8, np.uint8)), strides=(1,))

    def piece(self, eights: np.ndarray, k: int, words: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The k-th 8 bytes of those words, which have more than 8 * k; zeros behind a word's end."""
        left = np.minimum(self.end[words] - self.start[words] - 8 * k, 8).astype(U)
        return eights[self.start[words] + 8 * k] & (~U(0) >> ((U(8) - left) * U(8)))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word; words of up to 8 bytes and one length never share one."""
        if not len(self.start):
            return np.zeros(0, U)
        size, eights = self.end - self.start, self.eights()
        h = mix(self.piece(eights, 0) + size.astype(U) * _ODD)
        more, k = np.flatnonzero((size > 8) & (size <= LONG)), 1
        while len(more):
            h[more] = join(h[more], self.piece(eights, k, more))
            k += 1
            more = more[size[more] > 8 * k]
        for w in np.flatnonzero(size > LONG).tolist():
            h[w] = xxhash.xxh3_64_intdigest(self.data[self.start[w] : self.end[w]].tobytes())
        return h

    def spaced(self) -> tuple[np.ndarray, np.ndarray]:
        """The words with one space after each, and the place at which each word begins (one more at the end)."""
        size = self.end - self.start
        place = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size + 1, out=place[1:])
        out = np.full(place[-1], 0x20, np.uint8)
        source = np.flatnonzero(self.inside)
        out[source + np.repeat(place[:-1] - self.start, size)] = self.data[source]
        return out, place


def windows(h: np.ndarray, first: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers at which a window of ``n`` words of one text starts, and the windows' 64-bit hashes."""
    count = np.diff(first)
    valid = np.ones(len(h), bool)
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, U)
    ends = first[1:][count > 0]
    for k in range(1, n):
        valid[np.maximum(ends - k, first[:-1][count > 0])] = False
    start = np.flatnonzero(valid)
    # windows of 1, 2, 4, ... words, and from their ends those that add up to n
    g, wide, out, done = mix(h + U((seed * 0x9E3779B97F4A7C15 + n) & (2**64 - 1))), 1, None, 0
    while True:
        if n & wide:
            out = g if out is None else join(out[: len(g) - done], g[done:])
            done += wide
        if done == n:
            return start, out[start]
        g = join(g[:-wide], g[wide:])
        wide *= 2


def covered(start: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which of ``length`` words lie in one of the windows of ``n`` words at ``start``."""
    delta = np.zeros(length + 1, np.int32)
    np.add.at(delta, start, 1) if len(start) < 16 else delta.__iadd__(np.bincount(start, minlength=length + 1).astype(np.int32))
    end = np.bincount(start + n, minlength=length + 1)[: length + 1].astype(np.int32) if len(start) else 0
    return np.cumsum(delta - end)[:length] > 0


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one per word) over each text."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def repeated(key: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    s = np.sort(key)
    again = s[1:][s[1:] == s[:-1]]
    return member(key, again[np.append(True, again[1:] != again[:-1])] if len(again) else again)


def member(key: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are among the sorted ``known``; a bit table sets most others aside first."""
    out = np.zeros(len(key), bool)
    if not len(known) or not len(key):
        return out
    bits = max(12, int(len(known)).bit_length() + 4)
    if bits <= 24:
        table = np.zeros(1 << bits, bool)
        table[known >> U(64 - bits)] = True
        maybe = np.flatnonzero(table[key >> U(64 - bits)])
    else:
        maybe = np.arange(len(key))
    at = np.searchsorted(known, key[maybe])
    at[at == len(known)] = 0
    out[maybe] = known[at] == key[maybe]
    return out


def later(key: np.ndarray) -> np.ndarray:
    """Which elements equal an earlier element."""
    out = np.zeros(len(key), bool)
    where = np.flatnonzero(repeated(key))
    if len(where):
        order = np.argsort(key[where], kind="stable")
        k = key[where][order]
        out[where[order[1:][k[1:] == k[:-1]]]] = True
    return out


def in_doc(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys that are equal only for equal hashes in the same text."""
    return mix(h + mix(doc.astype(U) + U(1)))
