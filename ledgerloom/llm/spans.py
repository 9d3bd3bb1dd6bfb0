"""Removing repeated word spans, with count-min sketches ahead of an exact grouping.

A window is ``n`` consecutive words of one text.  Texts are dealt by id into chunks of a few MB, once; the same shuffle
serves three passes over them:

1. Each chunk counts its distinct windows in a count-min sketch of two rows, held as sorted, gap-coded cells, cut into
   blocks.  The sketches are merged block by block, and each chunk gets back those of its cells that the merged counts
   put at two chunks or more.  The sketch is as wide as the corpus needs and lies spread over the blocks; none of it is
   broadcast.
2. Windows whose cells all came back may be repeated (counts are never too low, so none is lost).  Only these are
   grouped exactly, by 96 bits of hash, to find the chunk with the first occurrence of each.
3. Each chunk, told which of its windows occur earlier elsewhere, removes their words, and those of windows that occur
   earlier in the chunk itself.

A chunk sends each window once, however often it holds it, so a passage that all documents share gives one row per
chunk.  Windows are compared by 64-bit hashes within a chunk and by 96 bits across chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import words as W

#: Order keys of rows without an id lie above this, by the hash of the text.
_NO_ID = 1 << 62
#: Cells of a sketch row for each expected window.
_WIDE = 8
#: Windows that a task merges, about.
_BLOCK = 1 << 21


def pack(values: np.ndarray) -> bytes:
    """Sorted distinct values as compressed byte planes of their gaps."""
    if not len(values):
        return b""
    gaps = np.diff(values.astype(W.U), prepend=W.U(0))
    width = next(w for w in (2, 4, 8) if w == 8 or int(gaps.max()) < 1 << 8 * w)
    planes = np.ascontiguousarray(gaps.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, W.U)
    width, n = raw[0], int.from_bytes(raw[1:9], "little")
    planes = np.frombuffer(pa.decompress(raw[9:], width * n, "zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(f"<u{width}")[:, 0].astype(W.U), dtype=W.U)


class Chunk:
    """The words and windows of a chunk's texts, in order of their keys (then of their texts)."""

    def __init__(self, order_key: np.ndarray, texts: pa.Array, n: int, second: bool = False) -> None:
        self.by = np.lexsort((np.arange(len(order_key)), order_key))
        if len(order_key) > 1 and (np.diff(order_key[self.by]) == 0).any():  # repeated ids: a defined order
            plain = texts.to_pylist()
            self.by = np.array(sorted(range(len(plain)), key=lambda i: (order_key[i], plain[i] or "")))
        self.key, self.n = order_key[self.by], n
        self.texts = texts.take(pa.array(self.by))
        counts, starts, owners, hashes, seconds, base = [], [], [], [], [], 0
        for a, _, data, offs in W.slices(self.texts):
            v = W.Words(data, offs)
            h = v.hashes()
            at, g = W.windows(h, v.first, n)
            counts.append(v.count)
            starts.append(at + base)
            owners.append(v.doc()[at] + a)
            hashes.append(g)
            if second:
                seconds.append((W.windows(h, v.first, n, 1)[1] >> W.U(32)).astype(np.uint32))
            base += len(h)
        join = lambda x, kind: np.concatenate(x).astype(kind, copy=False) if x else np.zeros(0, kind)
        self.count = join(counts, np.int64)
        self.start, self.owner, self.hash = join(starts, np.int64), join(owners, np.int32), join(hashes, W.U)
        self.second = join(seconds, np.uint32)

    def firsts(self) -> np.ndarray:
        """Indices of the windows that no earlier window of the chunk equals."""
        return np.flatnonzero(~W.later(self.hash))


def _cells(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [h >> W.U(64 - bits), W.mix(h ^ W.U(0xA0761D6478BD642F)) >> W.U(64 - bits)]


def _table(columns: dict[str, list], kinds: dict[str, pa.DataType]) -> pa.Table:
    return pa.table({k: pa.array(columns[k], kinds[k]) for k in kinds})


def _by_block(values: np.ndarray, shift: int) -> Iterator[tuple[int, int, int]]:
    """(block, from, to) of sorted values, a block being their bits above ``shift``."""
    if len(values):
        block = values >> W.U(shift) if shift < 64 else np.zeros(len(values), W.U)
        cut = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        for a, b in zip(cut, np.append(cut[1:], len(values)), strict=True):
            yield int(block[a]), int(a), int(b)


def remove_repeats(docs: DataFrame, n: int = 20, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) per row, and with ``texts`` the kept words as ``kept_text``.

    A word goes if a window of ``n`` words over it starts earlier too: in a row with a smaller id, or earlier in the
    same text.  Windows are those of the input.  A null, blank or short text keeps all its words (the hash of no words
    is that of the empty string).  Ids are whole numbers below 2**62.  Rows without an id come after all ids, in an order that their texts fix; rows of one
    id are ordered by text, and of equal rows one counts as the first.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    expected = max(total // 6, 1 << 12)
    bits = min(56, max(16, (_WIDE * expected - 1).bit_length()))
    blocks = max(0, (expected // _BLOCK).bit_length())  # as a power of two
    chunks = max(2 * parts, total >> 23)
    key = F.coalesce(F.col(id_col).cast("long"), F.expr(f"{_NO_ID} + (xxhash64(`{text_col}`) & {_NO_ID - 1})"))
    dealt = docs.select(F.col(id_col).cast("long").alias("id"), key.alias("key"), F.col(text_col).alias("text"))
    dealt = dealt.withColumn("chunk", F.expr(f"cast(pmod(xxhash64(key), {chunks}) as int)")).repartition(parts, "chunk")

    def sketch(t: pa.Table) -> pa.Table:
        c = Chunk(t.column("key").to_numpy(), t.column("text").combine_chunks(), n)
        out = {"row": [], "block": [], "chunk": [], "cells": []}
        for row, cells in enumerate(_cells(c.hash, bits)):
            cells = np.sort(cells)
            cells = cells[np.append(True, cells[1:] != cells[:-1])] if len(cells) else cells
            for block, a, b in _by_block(cells, bits - blocks):
                for k, v in (("row", row), ("block", block), ("chunk", t.column("chunk")[0].as_py()), ("cells", pack(cells[a:b] & W.U((1 << bits - blocks) - 1)))):
                    out[k].append(v)
        return _table(out, {"row": pa.int32(), "block": pa.int64(), "chunk": pa.int32(), "cells": pa.binary()})

    def merge(t: pa.Table) -> pa.Table:
        seen, twice = (np.zeros(1 << bits - blocks, bool) for _ in range(2))
        for raw in t.column("cells"):
            cells = unpack(raw.as_py())
            twice[cells[seen[cells]]] = True
            seen[cells] = True
        back = [pack(cells[twice[cells]]) for raw in t.column("cells") for cells in [unpack(raw.as_py())]]
        return pa.table({"chunk": t.column("chunk"), "row": t.column("row"), "block": t.column("block"), "cells": pa.array(back, pa.binary())})

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"block": [], "chunk": [], "entries": []}
        kinds = {"block": pa.int64(), "chunk": pa.int32(), "entries": pa.binary()}
        if not len(left):
            return _table(out, kinds)
        c = Chunk(left.column("key").to_numpy(), left.column("text").combine_chunks(), n, second=True)
        found = np.ones(len(c.hash), bool)
        rows, where, raw = right.column("row").to_numpy(), right.column("block").to_numpy(), right.column("cells")
        for row, cells in enumerate(_cells(c.hash, bits)):
            lists = [unpack(raw[int(i)].as_py()) + (W.U(where[i]) << W.U(bits - blocks)) for i in np.flatnonzero(rows == row)]
            known = np.sort(np.concatenate([*lists, np.zeros(0, W.U)]))
            table = np.zeros(1 << 20, bool)
            table[known & W.U((1 << 20) - 1)] = True
            maybe = np.flatnonzero(found & table[cells & W.U((1 << 20) - 1)])
            at = np.minimum(np.searchsorted(known, cells[maybe]), max(len(known) - 1, 0))
            found[:] = False
            if len(known):
                found[maybe] = known[at] == cells[maybe]
        at = np.flatnonzero(found)
        at = at[~W.later(c.hash[at])]
        at = at[np.argsort(c.hash[at], kind="stable")]
        h = c.hash[at]
        for block, a, b in _by_block(h, 64 - blocks):
            part = at[a:b]
            owner = c.key[c.owner[part]]
            base = int(owner.min())
            width = 4 if int(owner.max()) - base < 1 << 32 else 8
            head = base.to_bytes(8, "little", signed=True) + bytes([width]) + (b - a).to_bytes(8, "little")
            entries = h[a:b].tobytes() + c.second[part].tobytes() + (owner - base).astype(f"<u{width}").tobytes()
            for k, v in (("block", block), ("chunk", left.column("chunk")[0].as_py()), ("entries", head + entries)):
                out[k].append(v)
        return _table(out, kinds)

    def group(t: pa.Table) -> pa.Table:
        hs, seconds, owners, source = [], [], [], []
        for k, raw in enumerate(t.column("entries")):
            raw = raw.as_py()
            base, width, m = int.from_bytes(raw[:8], "little", signed=True), raw[8], int.from_bytes(raw[9:17], "little")
            hs.append(np.frombuffer(raw, "<u8", m, 17))
            seconds.append(np.frombuffer(raw, "<u4", m, 17 + 8 * m))
            owners.append(np.frombuffer(raw, f"<u{width}", m, 17 + 12 * m).astype(np.int64) + base)
            source.append(np.full(m, k, np.int32))
        h, second, owner, source = (np.concatenate(x) for x in (hs, seconds, owners, source))
        again = W.repeated(h)  # the others were overestimates
        h, second, owner, source = h[again], second[again], owner[again], source[again]
        order = np.lexsort((owner, second, h))
        same = np.append(False, (h[order][1:] == h[order][:-1]) & (second[order][1:] == second[order][:-1]))
        out = {"chunk": [], "hashes": []}
        chunk = t.column("chunk").to_numpy()
        gone, at = h[order][same], source[order][same]
        for k in np.unique(at):
            out["chunk"].append(int(chunk[k]))
            out["hashes"].append(np.sort(gone[at == k]).tobytes())
        return _table(out, {"chunk": pa.int32(), "hashes": pa.binary()})

    schema = "id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if texts else "")

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        c = Chunk(left.column("key").to_numpy(), left.column("text").combine_chunks(), n)
        earlier = np.sort(np.concatenate([np.zeros(0, W.U), *(np.frombuffer(x.as_py(), "<u8") for x in right.column("hashes"))]))
        gone = W.later(c.hash) | W.member(c.hash, earlier)
        cut = W.covered(c.start[gone], n, int(c.count.sum()))
        removed, shas, kept_texts, base = [], [], [], 0
        for _, _, data, offs in W.slices(c.texts):
            v = W.Words(data, offs)
            text, place = v.spaced()
            stay = ~cut[base : base + len(v.start)]
            base += len(v.start)
            removed.append(v.count - W.per_doc(stay, v.first))
            size = np.diff(place)
            length = W.per_doc(np.where(stay, size, 0), v.first)
            raw, end = text[np.repeat(stay, size)].tobytes(), np.cumsum(length)
            for b, m in zip(end.tolist(), length.tolist(), strict=True):
                kept = raw[b - m : max(b - 1, b - m)]
                shas.append(hashlib.sha256(kept).hexdigest())
                if texts:
                    kept_texts.append(kept.decode())
        ids = left.column("id").combine_chunks().take(pa.array(c.by))
        columns = [ids, pa.array(c.count), pa.array(np.concatenate([np.zeros(0, np.int64), *removed]).astype(np.int64)), pa.array(shas, pa.string())]
        return pa.table([*columns, *([pa.array(kept_texts, pa.string())] if texts else [])], names=["id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if texts else [])])

    sketches = dealt.groupBy("chunk").applyInArrow(sketch, "row int, block long, chunk int, cells binary")
    back = sketches.groupBy("row", "block").applyInArrow(merge, "chunk int, row int, block long, cells binary")
    entries = dealt.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(candidates, "block long, chunk int, entries binary")
    gone = entries.groupBy("block").applyInArrow(group, "chunk int, hashes binary")
    return dealt.groupBy("chunk").cogroup(gone.groupBy("chunk")).applyInArrow(remove, schema).withColumnRenamed("id", id_col)
