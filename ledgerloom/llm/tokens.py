"""Token ids in a grammar-compressed binary format with random access.

Encoding: each different word of a slice goes through the tokenizer once (split at white space, which the tokenizer
drops, and between letters and signs or digits, which it parts), and the texts are put together from the words' ids in numpy.

Compression is Re-Pair per segment: in rounds, frequent pairs of neighbouring symbols become nonterminals.  A round counts
all pairs by sorting, ranks those that occur often enough, and replaces every occurrence that outranks its overlapping
neighbours; rounds go on while they shorten the segment.  The mark that ends a
document is never paired, so each document is a run of symbols
of its own, and its offset with the stored expansion lengths finds any id in it without decoding what comes before.

Segment layout (little-endian): b"RPT1"; u32 documents, terminals, rules; u64 symbols, ids; u8 bytes per symbol; then the
arrays: i64 document ids, u8 whether the id is null, u64 first symbol of each document, u64 first id of each document,
u32 terminals (ascending token ids, then the end id once more as the mark that ends a document), rules (left and right symbol), u32 expansion lengths of the rules, symbols.
A symbol below the number of terminals stands for that terminal, others for rules.
"""

from __future__ import annotations

import codecs
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import words as W
from ledgerloom.llm.store import map_batches, materialise

_HEAD = struct.Struct("<4sIIIQQB")
#: Bytes of text in a segment, about; a longer text is a segment of its own.
SEGMENT = 4 << 20
#: Words (of up to ``words.LONG`` bytes) that a worker remembers the ids of before it starts anew, and bytes of them and of their ids.
KNOWN, KNOWN_BYTES = 3 << 18, 32 << 20
_ENCODERS: dict[str, "Encoder"] = {}


# Bytes by what the tokenizer does with them: 1 letters, 2 signs and digits, 3 the apostrophe, which may begin a part that ends in
# letters, 4 the bar of special tokens, 5 bytes of letters and others outside ASCII, 0 the rest.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F], _KIND[0x80:] = 2, 5
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]], _KIND[0x27], _KIND[0x7C] = 1, 3, 4
#: Two kinds of neighbouring bytes (the first times 8) that the tokenizer always parts.
_PARTED = np.zeros(64, bool)
_PARTED[[1 << 3 | 2, 1 << 3 | 3, 2 << 3 | 1]] = True


def _cuts(data: np.ndarray) -> np.ndarray:
    """Bytes at which the tokenizer surely begins a new part, beside white space: between letters and signs or digits.  Of letters
    outside ASCII only those of two bytes up to U+017F are told (without U+0130, which is lowered to a letter and a mark)."""
    kind, out = _KIND[data], np.zeros(len(data), bool)
    pair = kind[:-1] << 3 | kind[1:]
    out[1:] = _PARTED[pair]
    at = np.flatnonzero((pair == (5 << 3 | 2)) | (pair == (5 << 3 | 3)))
    at = at[at > 0]
    lead, last = data[at - 1], data[at]
    letter = (lead >= 0xC3) & (lead <= 0xC5) & ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7))) & ~((lead == 0xC4) & (last == 0xB0))
    out[at[letter] + 1] = True
    return out


def _words(data: np.ndarray, offs: np.ndarray) -> W.Words:
    """The slice's words, parted at ``_cuts`` too, with A-Z in lower case, as the tokenizer lowers them in any case; but not where
    its other steps come first (before a byte outside ASCII) or could take a word for a special token (with a bar)."""
    low = np.frombuffer(bytearray(data).lower(), np.uint8)
    wide = data >= 0x80
    at = np.flatnonzero(wide[1:] > wide[:-1])
    low[at] = data[at]
    v = W.Words(low, offs, cut=_cuts(data))
    bar = np.flatnonzero(data == 0x7C)
    if len(bar):
        barred = np.zeros(len(v.start), bool)
        barred[np.searchsorted(v.start, bar, "right") - 1] = True
        for start, end in zip(v.start[barred].tolist(), v.end[barred].tolist(), strict=True):
            low[start:end] = data[start:end]
    return v


# what ByteLevel writes for each byte; the space stays, as it parts words
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_HIDDEN = {b: 256 + n for n, b in enumerate(sorted({*range(256)} - {*_SHOWN}))}
_BYTES = "".join(chr(0x20 if b == 0x20 else _HIDDEN.get(b, b)) for b in range(256))


def _run(word: bytes) -> bytes | None:
    """The word as the tokenizer would lower it, if it is surely one run of letters, else None."""
    if word.isascii():
        return word if word.isalpha() and word.islower() else None
    text = word.decode()
    if not text.isalpha() or not unicodedata.is_normalized("NFC", text) or "Σ" in text:  # a final sigma is lowered by its place
        return None
    low = text.lower()
    return low.encode() if low.isalpha() else None


class _Table:
    """Numbers of words by a 64-bit hash and their first 8 bytes: open addressing in numpy, at most three quarters full: it grows."""

    def __init__(self, bits: int = 18) -> None:
        self.bits, self.n = bits, 0
        # a word's hash, first bytes and number lie side by side
        self.rows = np.zeros((1 << bits, 4), W.U)
        self.first, self.second, self.number = self.rows[:, 0], self.rows[:, 1], self.rows[:, 2].view(np.int64)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> W.U(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The number of each word, or -1."""
        slot = self._slots(h)
        row = self.rows.take(slot, axis=0, mode="clip")
        key = row[:, 0]
        hit = (key == h) & (row[:, 1] == other)
        out = np.where(hit, row[:, 2].view(np.int64), -1)
        todo = np.flatnonzero(~hit & (key != 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            key = self.first[slot]
            hit = (key == h[todo]) & (self.second[slot] == other[todo])
            out[todo[hit]] = self.number[slot[hit]]
            on = ~hit & (key != 0)
            todo, slot = todo[on], slot[on]
        return out

    def add(self, h: np.ndarray, other: np.ndarray, number: np.ndarray) -> None:
        """Different words that aren't in it yet."""
        while 4 * (self.n + len(h)) > 3 << self.bits:
            held = self.first != 0
            old = self.first[held], self.second[held], self.number[held]
            self.__init__(self.bits + 1)
            self.add(*old)
        slot, todo = self._slots(h), np.arange(len(h))
        self.n += len(h)
        while len(todo):
            free = self.first[slot] == 0
            put = todo[free]
            self.first[slot[free]] = h[put]  # of several for one slot, the last stays
            won = free & (self.first[slot] == h[todo])
            self.second[slot[won]], self.number[slot[won]] = other[todo[won]], number[todo[won]]
            # two words with one first hash would both take the slot as won: the one whose second hash isn't there goes on
            won &= self.second[slot] == other[todo]
            todo, slot = todo[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)


class _Row:
    """An array that grows at its end; what is behind its end is zero."""

    def __init__(self, kind: type, *wide: int) -> None:
        self.data, self.n = np.zeros((1 << 12, *wide), kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) + 8 > len(self.data):
            held = self.data[: self.n]
            self.data = np.zeros((2 * (self.n + len(more)) + 8, *held.shape[1:]), held.dtype)
            self.data[: self.n] = held
        self.data[self.n : self.n + len(more)] = more
        self.n += len(more)


class Encoder:
    """Ids of texts by a tokenizers file that, as word_bpe_49k.json does, lowers letters, drops white space, parts runs of
    letters from signs and digits and ends each run's ids with one of a ``</w>`` string."""

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.model, self.runs = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # runs of lower-case letters, their bytes written as ByteLevel does, need no more than the model
        self.runs.normalizer = None
        bare = self.runs.model
        if hasattr(bare, "_resize_cache"):  # words come once, so the model's own cache only costs
            bare._resize_cache(0)
            self.runs.model = bare
        self.runs.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        specials = {t.content: i for i, t in self.model.get_added_tokens_decoder().items() if t.special}
        self.mark, self.mark_id = max(specials.items(), key=lambda x: x[1])
        self.specials = [s.encode() for s in specials]
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known = _Table()
        # of each word's number: where its ids begin and how many they are, and where its bytes begin and how many they are
        self.ids, self.text, self.about = _Row(np.uint32), _Row(np.uint8), _Row(np.int64, 4)
        # number 0 is the mark behind a text, which no bytes stand for
        self.ids.add(np.zeros(1, np.uint32))
        self.about.add(np.array([[0, 1, 0, 0]]))

    def _learn(self, plain: list[bytes]) -> np.ndarray:
        """Encode words that are new; returns their numbers."""
        number = np.empty(len(plain), np.int64)
        runs = [_run(w) for w in plain]
        run = np.fromiter((r is not None for r in runs), bool, len(plain))
        for kind, words, encode in ((run, runs, self.encode_runs), (~run, plain, self.encode)):
            if kind.any():
                which = np.flatnonzero(kind).tolist()
                ids, size = encode([words[i] for i in which])
                number[kind] = np.arange(self.about.n, self.about.n + len(size))
                held = [plain[i] for i in which]
                length = np.fromiter(map(len, held), np.int64, len(held))
                self.about.add(np.stack([self.ids.n + np.cumsum(size) - size, size, self.text.n + np.cumsum(length) - length, length], axis=1))
                self.ids.add(ids)
                self.text.add(np.frombuffer(b"".join(held), np.uint8))
        return number

    def _same(self, v: W.Words, eights: np.ndarray, words: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Which of the ``words`` (of up to ``LONG`` bytes) are, byte by byte, those of the numbers, given that their first 8 bytes are."""
        size, about = v.end[words] - v.start[words], self.about.data.take(number, axis=0, mode="clip")
        same, at = about[:, 3] == size, about[:, 2]
        held = np.ndarray(len(self.text.data) - 7, "<u8", self.text.data, strides=(1,))
        more, k = np.flatnonzero(same & (size > 8)), 1
        while len(more):
            left = np.minimum(size[more] - 8 * k, 8).astype(W.U)
            theirs = held[at[more] + 8 * k] & (~W.U(0) >> ((W.U(8) - left) * W.U(8)))
            same[more] = theirs == v.piece(eights, k, words[more])
            k += 1
            more = more[same[more] & (size[more] > 8 * k)]
        return same

    def encode_runs(self, plain: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, for words that are one run: spaces part them, and the last id of each is one that ends a run."""
        step = 256
        batch = [codecs.charmap_decode(b" ".join(plain[a : a + step]), "strict", _BYTES)[0] for a in range(0, len(plain), step)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.runs.encode_batch_fast(batch, add_special_tokens=False)])
        ends = np.flatnonzero(self.ends[ids])
        return (ids, np.diff(ends, prepend=-1)) if len(ends) == len(plain) else self.encode(plain)

    def encode(self, plain: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words and the number of each word's ids.  A special token's text marks the words' ends."""
        odd = [i for i, w in enumerate(plain) if b"|" in w and any(s in w for s in self.specials)]
        texts = [w.decode() for w in plain]
        own = {i: np.array(self.model.encode(texts[i], add_special_tokens=False).ids, np.uint32) for i in odd}
        for i in odd:
            texts[i] = ""
        step = 256
        batch = [self.mark.join(texts[a : a + step]) + self.mark for a in range(0, len(texts), step)]
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast(batch, add_special_tokens=False))])
        ends = np.flatnonzero(ids == self.mark_id)
        sizes = np.diff(ends, prepend=-1) - 1
        ids = ids[ids != self.mark_id]
        if odd:
            pieces = np.split(ids, np.cumsum(sizes)[:-1])
            for i in odd:
                pieces[i] = own[i]
            ids, sizes = np.concatenate(pieces), np.array([len(p) for p in pieces])
        return ids, sizes

    def column(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each followed by ``end``, and the number of each text's ids."""
        flats, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for _, _, data, offs in W.slices(column):
            if self.known.n > KNOWN or self.text.n + 4 * self.ids.n > KNOWN_BYTES:
                self.forget()
            self.ids.data[0] = end
            v = _words(data, offs)
            eights, raw = v.eights(), None
            h, first = v.hashes() | W.U(1), v.piece(eights, 0)
            word = self.known.find(h, first)
            new, long = word < 0, v.end - v.start > W.LONG
            held = np.flatnonzero(~new & ~long)
            word[held[~self._same(v, eights, held, word[held])]] = -1  # a hash that different words share
            missing = np.flatnonzero((word < 0) & ~long)
            if len(missing) or long.any():
                raw = v.data.tobytes()
                bytes_of = lambda at: [raw[s:e] for s, e in zip(v.start[at].tolist(), v.end[at].tolist(), strict=True)]  # noqa: B023, E731
            if len(missing):
                shown, group = _different(h[missing], first[missing])
                at = missing[shown]
                number = self._learn(bytes_of(at))
                word[missing] = number[group]
                self.known.add(h[at][new[at]], first[at][new[at]], number[new[at]])
                other = missing[~self._same(v, eights, missing, word[missing])]
                if len(other):
                    word[other] = self._learn(bytes_of(other))
            if long.any():
                word[long] = self._learn(bytes_of(long))
            stop = v.first[1:] + np.arange(len(v.count))  # of the marks among the words
            about = self.about.data.take(np.insert(word, v.first[1:], 0), axis=0, mode="clip")
            size = about[:, 1]
            upto = np.cumsum(size)
            place = np.repeat(about[:, 0] - upto + size, size)
            place += np.arange(len(place))
            out, per_text = self.ids.data.take(place, mode="clip"), np.diff(upto[stop], prepend=0)
            flats.append(out)
            counts.append(per_text)
        return np.concatenate(flats), np.concatenate(counts)


def _different(h: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each different pair of hashes, and for each place the number of its pair."""
    order = np.lexsort((other, h))
    new = np.append(True, (h[order][1:] != h[order][:-1]) | (other[order][1:] != other[order][:-1]))
    group = np.empty(len(h), np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], group


def repair(symbols: np.ndarray, terminals: int, barrier: int, rounds: int = 24, least: int = 8, most: int = 16384, gain: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Re-Pair: the shortened sequence and the rules (left, right), numbered from ``terminals``; ``barrier`` stays alone."""
    s, rules, alphabet = symbols.astype(np.uint32), [np.zeros((0, 2), np.uint32)], terminals
    for _ in range(rounds):
        if len(s) < 2 * least:
            break
        wide = alphabet > 1 << 16
        key = (s[:-1].astype(W.U) << W.U(32)) | s[1:] if wide else (s[:-1] << np.uint32(16)) | s[1:]
        k = np.sort(key)
        cut = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        times = np.diff(np.append(cut, len(k)))
        often = np.flatnonzero(times >= least)
        pairs = k[cut[often]]
        half = pairs.dtype.type(pairs.dtype.itemsize * 4)
        free = (pairs >> half != barrier) & (pairs & ((pairs.dtype.type(1) << half) - pairs.dtype.type(1)) != barrier)
        often, pairs = often[free], pairs[free]
        if not len(often):
            break
        rank = np.argsort(-times[often], kind="stable")[:most]
        pairs = pairs[rank]
        slot = lambda x: ((x * x.dtype.type(0x9E3779B97F4A7C15 & np.iinfo(x.dtype).max | 1)) >> x.dtype.type(x.dtype.itemsize * 8 - 20)).astype(np.intp)
        table = np.zeros(1 << 20, np.uint16 if len(pairs) <= 1 << 16 else np.int32)
        table[slot(pairs)[::-1]] = np.arange(len(pairs), dtype=table.dtype)[::-1]  # a pair whose slot a better one has waits
        maybe = table.take(slot(key), mode="clip")
        place = np.flatnonzero(pairs.take(maybe, mode="clip") == key)
        order = maybe.take(place, mode="clip")
        near, less = place[1:] == place[:-1] + 1, order[1:] < order[:-1]
        take = np.ones(len(place), bool)
        take[1:] &= ~near | less
        take[:-1] &= ~(near & less)
        take = np.flatnonzero(take)
        place, order = place.take(take, mode="clip"), order.take(take, mode="clip")
        if len(place) < gain * len(s):
            break
        taken = np.bincount(order, minlength=len(pairs)) > 0
        used, number = np.flatnonzero(taken), (np.cumsum(taken) - 1)[order]
        left, right = (pairs[used] >> W.U(32), pairs[used] & W.U(0xFFFFFFFF)) if wide else (pairs[used] >> np.uint32(16), pairs[used] & np.uint32(0xFFFF))
        rules.append(np.stack([left, right], axis=1).astype(np.uint32))
        s[place] = alphabet + number
        stay = np.ones(len(s), bool)
        stay[place + 1] = False
        s = s[stay]
        alphabet += len(used)
    return s, np.concatenate(rules)


def expand(symbols: np.ndarray, rules: np.ndarray, terminals: int) -> np.ndarray:
    """The terminals that the symbols stand for."""
    s = symbols.astype(np.int64)
    while True:
        deep = s >= terminals
        if not deep.any():
            return s
        at = np.arange(len(s)) + np.cumsum(deep) - deep
        out = np.empty(len(s) + int(deep.sum()), np.int64)
        out[at[~deep]] = s[~deep]
        pair = rules[s[deep] - terminals]
        out[at[deep]], out[at[deep] + 1] = pair[:, 0], pair[:, 1]
        s = out


def lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """Expansion lengths of the rules; a rule only uses earlier ones."""
    out = np.ones(terminals + len(rules), np.int64)
    a = 0
    while a < len(rules):
        ready = rules.max(axis=1)[a:] < terminals + a
        b = len(rules) if ready.all() else a + int(np.argmin(ready))
        b = max(b, a + 1)
        out[terminals + a : terminals + b] = out[rules[a:b, 0]] + out[rules[a:b, 1]]
        a = b
    return out[terminals:]


def write_segment(doc_ids: np.ndarray, is_null: np.ndarray, ids: np.ndarray, sizes: np.ndarray, end: int) -> bytes:
    """One segment: documents with their ids one after the other, each ended by ``end``."""
    seen = np.zeros(int(ids.max(initial=0)) + 1, bool)
    seen[ids] = True
    first_id = np.cumsum(sizes) - sizes
    terminals = np.append(np.flatnonzero(seen), end).astype(np.uint32)  # the last terminal ends documents, even if texts hold its id too
    symbols = (np.cumsum(seen) - 1)[ids].astype(np.uint32)
    symbols[first_id + sizes - 1] = barrier = len(terminals) - 1
    symbols, rules = repair(symbols, len(terminals), barrier)
    first_symbol = np.append(0, np.flatnonzero(symbols == barrier) + 1)[: len(sizes)]
    width = 2 if len(terminals) + len(rules) <= 1 << 16 else 4
    head = _HEAD.pack(b"RPT1", len(sizes), len(terminals), len(rules), len(symbols), len(ids), width)
    arrays = [doc_ids.astype("<i8"), is_null.astype("u1"), first_symbol.astype("<u8"), first_id.astype("<u8"), terminals.astype("<u4"), rules.astype(f"<u{width}"), lengths(rules, len(terminals)).astype("<u4"), symbols.astype(f"<u{width}")]
    return head + b"".join(a.tobytes() for a in arrays)


class Segment:
    """A segment read from its bytes."""

    def __init__(self, raw: bytes) -> None:
        magic, docs, terminals, rules, symbols, self.n_ids, width = _HEAD.unpack_from(raw)
        if magic != b"RPT1":
            raise ValueError("not a token segment")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(raw, kind, n, at)
            at += got.nbytes
            return got

        self.doc_ids, self.is_null = take("<i8", docs), take("u1", docs).astype(bool)
        self.first_symbol, self.first_id = take("<u8", docs).astype(np.int64), take("<u8", docs).astype(np.int64)
        self.terminals, self.rules = take("<u4", terminals), take(f"<u{width}", 2 * rules).reshape(-1, 2)
        self.lengths, self.symbols = take("<u4", rules).astype(np.int64), take(f"<u{width}", symbols)

    def ids(self) -> np.ndarray:
        t, n = len(self.terminals), len(self.lengths)
        pool = np.append(np.arange(t), expand(np.arange(t, t + n), self.rules, t))  # each rule written out once
        size = np.append(np.ones(t, np.int64), self.lengths)
        begin = np.cumsum(size) - size
        each = size[self.symbols]
        at = np.repeat(begin[self.symbols] - np.cumsum(each) + each, each)
        at += np.arange(len(at))
        return self.terminals[pool].take(at)

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the k-th document, from only the symbols that hold them."""
        last = self.first_symbol[k + 1] if k + 1 < len(self.first_symbol) else len(self.symbols)
        symbols = self.symbols[self.first_symbol[k] : last].astype(np.int64)
        size = np.ones(len(symbols), np.int64)
        deep = symbols >= len(self.terminals)
        size[deep] = self.lengths[symbols[deep] - len(self.terminals)]
        begin = np.cumsum(size) - size
        stop = int(size.sum()) if stop is None else min(stop, int(size.sum()))
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = int(np.searchsorted(begin, start, "right")) - 1, int(np.searchsorted(begin, stop))
        got = self.terminals[expand(symbols[a:b], self.rules, len(self.terminals))]
        return got[start - begin[a] : stop - begin[a]]


def write_tokens(docs: DataFrame, path: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts in ascending order of their ids and write the segments; returns the files as read back:
    (part, number, n_docs, n_ids, segment binary), in order of part and number.

    A null text is empty.  Ids are whole numbers.  Rows without an id come last, rows of one id are ordered by text; an empty table gives no files' rows.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = [F.col("id").asc_nulls_last(), F.xxhash64("text")]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:  # a worker keeps it for its next tasks
            _ENCODERS[path] = Encoder(path)
        encoder, number = _ENCODERS[path], 0
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for lo, hi, _, _ in W.slices(texts, SEGMENT):
                flat, sizes = encoder.column(texts.slice(lo, hi - lo), end)
                keys = ids.slice(lo, hi - lo)
                raw = write_segment(keys.fill_null(0).to_numpy(), keys.is_null().to_numpy(zero_copy_only=False), flat, sizes, end)
                yield pa.RecordBatch.from_arrays([pa.array([b.column(2)[0].as_py()], pa.int32()), pa.array([number], pa.int64()), pa.array([hi - lo], pa.int64()), pa.array([len(flat)], pa.int64()), pa.array([raw], pa.binary())], ["part", "number", "n_docs", "n_ids", "segment"])
                number += 1

    return materialise(map_batches(rows, run, "part int, number long, n_docs long, n_ids long, segment binary"), "tokens")


def digest(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document in the files; start counts the ids of all documents before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, number, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                s = Segment(raw.as_py())
                flat, n = s.ids().astype("<u4").tobytes(), len(s.doc_ids)
                stops = np.append(s.first_id[1:], s.n_ids)
                crcs = [zlib.crc32(flat[4 * a : 4 * z]) for a, z in zip(s.first_id.tolist(), stops.tolist(), strict=True)]
                ids = pa.array(s.doc_ids, mask=s.is_null)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, number)), ids, pa.array(s.first_id), pa.array(stops - s.first_id), pa.array(crcs, pa.int64())], ["part", "number", "id", "first", "n_tokens", "ids_crc32"])

    found = map_batches(files.select("part", "number", "segment"), run, "part int, number long, id long, first long, n_tokens long, ids_crc32 long")
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("number")) - F.col("n_ids")
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("sum")).selectExpr("part", "sum(sum) over (order by part) - sum as before")
    starts = files.select("part", "number", "n_ids").withColumn("inside", inside).join(totals, "part").select("part", "number", (F.col("before") + F.col("inside")).alias("before"))
    return found.join(starts, ["part", "number"]).select(F.col("id").alias(id_col), (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
