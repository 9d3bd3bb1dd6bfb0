"""SimHash near-duplicates by a binary-trie self-join.

Distinct fingerprints are sorted, so that a trie node is a range of them.  Pairs of nodes are walked down together,
adding the bits in which they differ; a pair over the Hamming budget is pruned, with everything below it.  The walk is
a few numpy operations per depth over all pairs of nodes at once.

Spreading the walk: of ``budget`` + 1 segments of the bits, two fingerprints within the budget agree in one.  Each
fingerprint is dealt once per segment, by that segment's value, and the trie there starts with the segment, whose bits
have a budget of zero.  A value with more than ``cell`` fingerprints is split in salted parts, and each pair of parts is
walked by a task of its own, so no task holds more than 2 * ``cell`` of them and no link is lost.

Dense groups: budgets 1, 2, ... are walked in turn and the links joined after each; later walks prune pairs of nodes
whose fingerprints are all in one component already.  A task gives each fingerprint at most one link (to the smallest
of its component there), never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import words as W
from ledgerloom.llm.components import components
from ledgerloom.llm.store import free, map_batches, materialise, small

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float32)


def majority(h: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """64-bit fingerprints: a bit is 1 if it is set in over half of the text's hashes.  ``doc`` ascends."""
    out = np.zeros((docs, 8), np.uint8)
    octets = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)
    for a in range(0, docs, 1024):
        b = min(docs, a + 1024)
        lo, hi = np.searchsorted(doc, (a, b))
        base = (doc[lo:hi] - a) * 256
        total = np.bincount(doc[lo:hi] - a, minlength=b - a)[:, None]
        for k in range(8):
            seen = np.bincount(base + octets[lo:hi, k], minlength=(b - a) * 256).reshape(-1, 256)
            ones = seen.astype(np.float32) @ _BITS if len(base) < 1 << 23 else seen @ _BITS.astype(np.int64)
            out[a:b, k] = np.packbits(2 * ones > total, axis=1, bitorder="little")[:, 0]
    return out.view("<u8")[:, 0]


def shingle_hashes(v: W.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of each shingle of ``n`` words, joined by one space, and its text; fewer words make one shingle."""
    text, place = v.spaced()
    short = (v.count > 0) & (v.count < n)
    valid = np.ones(len(v.start), bool)
    some = v.count > 0
    for k in range(1, n):
        valid[np.maximum(v.first[1:][some] - k, v.first[:-1][some])] = False
    valid[v.first[:-1][short]] = True
    at = np.flatnonzero(valid)
    doc = v.doc()[at]
    stop = place[np.minimum(at + n, v.first[doc + 1])] - 1
    raw, digest = text.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[s:e], 42) for s, e in zip(place[at].tolist(), stop.tolist(), strict=True)), W.U, len(at))
    return h, doc


def fingerprint_column(column: pa.Array, shingle: int = 4) -> np.ndarray:
    """The 64-bit fingerprint of each text (A-Z in lower case); zero without words."""
    out = [np.zeros(0, W.U)]
    for _, _, data, offs in W.slices(column):
        v = W.Words(W.LOWER[data], offs)
        h, doc = shingle_hashes(v, shingle)
        out.append(majority(h, doc, len(v.count)))
    return np.concatenate(out)


# The trie


def _union(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (the smallest index of a component) after adding the links i-j."""
    while True:
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            return label
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _walk(key: np.ndarray, budget: int, exact: int, label: np.ndarray, piece: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the sorted distinct ``key`` within ``budget`` differing bits and equal in the first ``exact`` ones.

    Pairs of nodes whose fingerprints all have one label are pruned.
    """
    n, label = len(key), label.copy()
    ones: list[np.ndarray] = []
    for d in range(64):
        c = np.zeros(n + 1, np.int32)
        np.cumsum((key >> W.U(63 - d)) & W.U(1), out=c[1:])
        ones.append(c)
    runs = np.zeros(n, np.int32)
    np.cumsum(label[1:] != label[:-1], out=runs[1:])
    one = np.int32
    stack = [(0, np.array([0], one), np.array([n], one), np.array([0], one), np.array([n], one), np.array([0], np.int8))]
    while stack:
        d, alo, ahi, blo, bhi, acc = stack.pop()
        if len(alo) > piece:
            half = len(alo) // 2
            stack += [(d, *(x[:half] for x in (alo, ahi, blo, bhi, acc))), (d, *(x[half:] for x in (alo, ahi, blo, bhi, acc)))]
            continue
        c, most = ones[d], 0 if d < exact else budget
        amid, bmid = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        same = alo == blo
        cross = ~same
        parts = [
            (alo, amid, blo, bmid, acc),
            (amid, ahi, bmid, bhi, acc),
            (alo, amid, bmid, bhi, acc + 1),
            (amid[cross], ahi[cross], blo[cross], bmid[cross], acc[cross] + 1),
        ]
        alo, ahi, blo, bhi, acc = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = (acc <= most) & (alo < ahi) & (blo < bhi) & ~((alo == blo) & (ahi - alo < 2))
        alo, ahi, blo, bhi, acc = (x[keep] for x in (alo, ahi, blo, bhi, acc))
        done = (runs[ahi - 1] == runs[alo]) & (runs[bhi - 1] == runs[blo]) & (label[alo] == label[blo])
        size = (ahi - alo).astype(np.int64) * (bhi - blo)
        leaf = ~done & (size <= 8 if d >= exact - 1 else size < 0)
        if leaf.any():  # few enough fingerprints below: compare them
            la, lb, lw, size = alo[leaf], blo[leaf], (bhi - blo)[leaf], size[leaf]
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            w = np.repeat(lw, size)
            i, j = np.repeat(la, size) + k // w, np.repeat(lb, size) + k % w
            near = (i < j) & (np.bitwise_count(key[i] ^ key[j]) <= budget) & (label[i] != label[j])
            i, j = i[near], j[near]
            if len(i):
                yield i, j
        rest = ~done & ~leaf
        if rest.any() and d < 63:
            stack.append((d + 1, *(x[rest] for x in (alo, ahi, blo, bhi, acc))))


def trie_links(key: np.ndarray, budget: int, exact: int = 0) -> np.ndarray:
    """Component labels (smallest index) of the sorted distinct ``key`` under links within ``budget`` bits."""
    label = np.arange(len(key))
    for b in range(1, budget + 1):
        for i, j in _walk(key, b, exact, label):
            label = _union(label, i, j)
    return label


def _rotate(key: np.ndarray, by: int) -> np.ndarray:
    return key if by == 0 else (key << W.U(by)) | (key >> W.U(64 - by))


def _segments(budget: int) -> list[tuple[int, int]]:
    """(first bit, width) of budget + 1 segments of 64 bits."""
    cuts = [64 * k // (budget + 1) for k in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def links(prints: DataFrame, budget: int = 4, cell: int = 1 << 20) -> DataFrame:
    """Links (a, b) between the nodes of ``prints`` that give its components under ``budget`` differing bits.

    ``prints`` has ``node`` long and ``prints`` array<long>: any of these fingerprints links.
    """
    spark, segs = prints.sparkSession, _segments(budget)
    rows = prints.select("node", F.posexplode("prints").alias("word", "print"))
    rows = rows.withColumn("part", F.explode(F.array(*[F.struct(F.lit(k).alias("seg"), F.expr(f"shiftrightunsigned(print, {64 - a - w}) & {(1 << w) - 1}").alias("value")) for k, (a, w) in enumerate(segs)])))
    rows = rows.select("node", "print", "word", "part.seg", "part.value")
    # Values with many fingerprints get several salted parts; at most words * segments * 2**width rows, by construction.
    hot = rows.groupBy("word", "seg", "value").count().where(f"count > {cell}").select("word", "seg", "value", F.ceil(F.col("count") / cell).cast("int").alias("parts"))
    rows = rows.join(hot, ["word", "seg", "value"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("salt", F.when(F.col("parts") > 1, F.expr("cast(pmod(xxhash64(node), parts) as int)")).otherwise(0))
    rows = rows.withColumn("other", F.explode(F.when(F.col("parts") > 1, F.expr("sequence(0, parts - 1)")).otherwise(F.array(F.lit(0)))))
    rows = rows.select("node", "print", F.expr(f"word * {len(segs)} + seg").alias("kind"), F.expr("xxhash64(word, seg, value, least(salt, other), greatest(salt, other))").alias("cell"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "cell").sortWithinPartitions("cell")

    def one(kind: int, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links among the rows of one fingerprint and segment."""
        start, width = segs[kind % len(segs)]
        key = _rotate(key, start)
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        label, near = np.arange(len(key)), np.flatnonzero(key[1:] == key[:-1])
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        label = _union(label, near, near + 1)
        for b in range(1, budget + 1):
            for i, j in _walk(key[first], b, width, label[first]):
                label = _union(label, first[i], first[j])
        linked = np.flatnonzero(node != node[label])
        return node[linked], node[label][linked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def flush(t: pa.Table) -> pa.RecordBatch:
            kind, node, key = (t.column(c).to_numpy() for c in ("kind", "node", "print"))
            got = [one(int(k), node[m], key[m].view(W.U)) for k in np.unique(kind) for m in [kind == k]]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*got, strict=True)], ["a", "b"])

        for b in batches:
            t = pa.Table.from_batches([b])
            held.append(t)
            size += len(t)
            if size >= 2 * cell:  # whole cells go; the last cell may go on in the next batch
                t = pa.concat_tables(held).combine_chunks()
                c = t.column("cell").to_numpy()
                cut = int(np.flatnonzero(np.append(True, c[1:] != c[:-1]))[-1])
                if cut:
                    yield flush(t.slice(0, cut).combine_chunks())
                held = [pa.Table.from_batches(t.slice(cut).to_batches())]
                size = len(t) - cut
        if size:
            yield flush(pa.concat_tables(held).combine_chunks())

    return map_batches(rows, run, "a long, b long")


#: Nodes of fingerprints that only rows without an id have lie above this.
_NO_ID = 1 << 62


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, print long) for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprint_column(b.column(1), shingle).view(np.int64))], [id_col, "print"])

    picked = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
    return map_batches(picked, run, f"`{id_col}` long, print long")


def near_duplicates(docs: DataFrame, shingle: int = 4, budget: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id): fingerprints link at ``budget`` or fewer differing bits.

    ``component_id`` is the smallest id reachable, the row's own included.  A null or blank text has fingerprint zero,
    which links like any other.  Rows without an id link others, but only ids name a component: it is null if no row
    of it has one (ids are whole numbers below 2**62).  Repeated rows and ids give as many rows; an empty table none.
    """
    prints = materialise(fingerprints(docs, shingle, id_col, text_col), "prints")
    nodes = prints.groupBy("print").agg(F.min(id_col).alias("node"))
    nodes = materialise(nodes.select("print", F.coalesce("node", F.expr(f"{_NO_ID} + (xxhash64(print) & {_NO_ID - 1})")).alias("node")), "nodes")
    found = components(links(nodes.select("node", F.array("print").alias("prints")), budget))
    named = nodes.join(found, "node", "left").select("print", F.coalesce("root", "node").alias("root"))
    named = named.select("print", F.when(F.col("root") < _NO_ID, F.col("root")).alias("component_id"))
    return prints.join(named, "print").select(id_col, F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies: texts that the trie links, and for the rest bands of min-hashes of their shingles; then the exact similarity


#: Bands of min-hashes per text, min-hashes of a band, and 64-bit parts of the SimHash.
BANDS, ROWS, PARTS = 24, 5, 4
_ODD = np.random.default_rng(20240301).integers(0, 1 << 64, (BANDS, ROWS, 2), dtype=W.U) | W.U(1)
#: Nodes of a bucket and shingles of their texts, at most about, that one cell holds.
CELL, CELL_SHINGLES = 1 << 10, 1 << 22


def shingle_sets(v: W.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's different shingles of ``n`` words in ascending order of their hashes, and their texts; fewer words make
    one shingle, no words the shingle zero."""
    h, doc = v.hashes(), v.doc()
    at, g = W.windows(h, v.first, n)
    sets, owner = [g], [doc[at]]
    for k in range(1, n):
        if (v.count == k).any():
            at, g = W.windows(h, v.first, k)
            whole = v.count[doc[at]] == k
            sets, owner = [*sets, g[whole]], [*owner, doc[at[whole]]]
    blank = np.flatnonzero(v.count == 0)
    g, doc = np.concatenate([*sets, np.zeros(len(blank), W.U)]), np.concatenate([*owner, blank])
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    once = np.append(True, (g[1:] != g[:-1]) | (doc[1:] != doc[:-1]))
    return g[once], doc[once]


def signature_column(column: pa.Array, shingle: int = 5) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By slices of the texts (A-Z lowered): a hash of each text's set of shingles, its ``BANDS`` bands, its SimHash of ``PARTS``
    parts, the number of its shingles, and the upper halves of their hashes, ascending in each text."""
    for _, _, data, offs in W.slices(column):
        g, doc = shingle_sets(W.Words(W.LOWER[data], offs), shingle)
        n = len(offs) - 1
        size = np.bincount(doc, minlength=n)
        start = np.cumsum(size) - size
        bands = np.zeros((n, BANDS), W.U)
        for b in range(BANDS):
            for times, plus in _ODD[b]:
                bands[:, b] = W.mix(bands[:, b] + W.U(b + 1)) + np.minimum.reduceat(g * times + plus, start)
        proof = np.stack([majority(W.mix(g + W.U((k * 0xD1B54A32D192ED03 + 1) & (2**64 - 1))), doc, n) for k in range(PARTS)], axis=1)
        yield W.mix(np.add.reduceat(W.mix(g + W.U(7)), start)), W.mix(bands), proof, size, (g >> W.U(32)).astype(np.uint32)


def _near(proof: np.ndarray, sets: list[np.ndarray], label: np.ndarray, similarity: float, most: float) -> list[tuple[int, int]]:
    """Index pairs of similar sets that join the components of ``label``: all pairs not yet joined are tested."""
    size, out, label = np.array([len(s) for s in sets]), [], label.copy()
    for i in range(len(sets) - 1):
        j = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        j = j[np.minimum(size[j], size[i]) >= similarity * np.maximum(size[j], size[i]) - 1e-9]
        j = j[np.bitwise_count(proof[j] ^ proof[i]).sum(axis=1) <= most]
        if not len(j):
            continue
        both = sets[i][np.minimum(np.searchsorted(sets[i], cat := np.concatenate([sets[x] for x in j])), size[i] - 1)] == cat
        both = np.add.reduceat(both, np.cumsum(size[j]) - size[j], dtype=np.int64)
        j = j[both >= similarity * (size[i] + size[j] - both) - 1e-9]
        for x in j.tolist():
            if label[x] != label[i]:
                out.append((i, x))
                label[label == label[x]] = label[i]
    return out


def _similar(rows: DataFrame, similarity: float, slack: float) -> DataFrame:
    """Links (a, b) within the cells of ``rows`` (cell, node, root, proof, shingles); nodes of one root are joined already."""
    overlap = 2 * similarity / (1 + similarity)
    most = (float(np.arccos(overlap) / np.pi) + slack) * 64 * PARTS

    def links_of(t: pa.Table) -> pa.RecordBatch:
        cell, node, root = (t.column(c).to_numpy() for c in ("cell", "node", "root"))
        proof = np.stack([np.frombuffer(p.as_py(), W.U) for p in t.column("proof")])
        sets = [np.frombuffer(s.as_py(), np.uint32) for s in t.column("shingles")]
        edge = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
        pairs = [(a + i, a + j) for a, b in zip(edge, edge[1:], strict=False) for i, j in _near(proof[a:b], sets[a:b], root[a:b], similarity, most)]
        i, j = np.array(pairs, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            c = b.column(b.schema.get_field_index("cell")).to_numpy()
            if not len(c):
                continue
            cut = int(np.flatnonzero(np.append(True, c[1:] != c[:-1]))[-1])
            if held and (cut or held[-1].column("cell")[-1].as_py() != c[0]):  # whole cells go; the last may go on in the next batch
                yield links_of(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            elif cut:
                yield links_of(pa.Table.from_batches([b.slice(0, cut)]))
            held.append(b.slice(cut))
        if held:
            yield links_of(pa.Table.from_batches(held))

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_batches(rows.select("cell", "node", "root", "proof", "shingles").repartition(n, "cell").sortWithinPartitions("cell"), run, "a long, b long")


def linked(signed: DataFrame, budget: int = 4) -> DataFrame:
    """(node, root) for each node of ``signed`` (node, proof) that the trie links to another: any of a proof's ``PARTS`` SimHashes within
    ``budget`` bits."""
    part = lambda k: F.conv(F.hex(F.substring("proof", 8 * k + 1, 8)), 16, -10).cast("long")
    prints = signed.select("node", "proof").dropDuplicates(["node"]).select("node", F.array(*[part(k) for k in range(PARTS)]).alias("prints"))
    found = components(links(materialise(prints, "proofs"), budget))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def banded(signed: DataFrame) -> DataFrame:
    """(node, size, bucket) for each of the ``BANDS`` of a node of ``signed`` (node, bands, size)."""
    return signed.select("node", "bands", "size").dropDuplicates(["node"]).select("node", "size", F.explode("bands").alias("bucket"))


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, slack: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, without near copies: of each group the smallest id stays.

    Texts are near copies if the Jaccard similarity of their sets of ``shingle``-word shingles is ``similarity`` or more.  Each set has
    ``PARTS`` SimHashes of 64 bits, and texts that the trie links by one of them make a bucket, in which all pairs are tested.  Four
    bits of 64 are few for a similarity of 0.8, so pairs are tested too that share one of ``BANDS`` bands of ``ROWS`` min-hashes of the
    shingles, whatever the shape of the edits: at 0.8 a pair is missed by these with (1 - 0.8**5)**24, 7 in 100,000.  The SimHashes
    together set most pairs of a bucket aside (two sets of similarity s overlap by 2s/(1+s) at least and differ in acos(overlap)/pi
    of the bits or fewer; ``slack`` is 4.5 deviations).
    What it leaves is counted shingle by shingle, on 32 bits of their hashes (n shingles err by about n / 2**32 of the similarity).
    Groups are the components of these links.

    Buckets of one set of texts are taken once.  In a bucket all pairs that aren't joined yet are tested.  One over ``CELL`` texts
    is cut in salted parts, tested each with a text of every other part; where that leaves several components, every
    pair of parts is a cell of its own.

    Ids are whole numbers.  Blank texts are copies of each other; texts of fewer words than a shingle are one shingle.  Of rows of one id, one stays.
    Rows without an id link others but always stay, since nothing tells which of them to keep.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for node, bands, proof, size, sets in signature_column(b.column(1), shingle):
                n = len(node)
                banded = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel()))
                proved = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * PARTS), n, [None, pa.py_buffer(np.ascontiguousarray(proof).tobytes())]).cast(pa.binary())
                offsets = pa.py_buffer(np.append(0, 4 * np.cumsum(size)).astype(np.int32).tobytes())
                shingles = pa.BinaryArray.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(sets.tobytes())])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), pa.array(node.view(np.int64)), banded, proved, pa.array(size.astype(np.int64)), shingles], ["id", "node", "bands", "proof", "size", "shingles"])
                at += n

    signed = map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, "id long, node long, bands array<long>, proof binary, size long, shingles binary")
    signed = materialise(signed, "signatures")
    near = materialise(linked(signed), "linked")
    near = signed.select("node", "size").dropDuplicates(["node"]).join(small(near), "node").select("node", "size", F.xxhash64(F.lit("trie"), "root").alias("bucket"))
    rows = materialise(banded(signed).unionByName(near), "buckets_of")
    held = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.bit_xor(F.xxhash64("node")).alias("who"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("n > 1")
    held = held.groupBy("n", "words", "who", "lo", "hi").agg(F.min("bucket").alias("bucket"))
    held = held.select("bucket", F.greatest(F.ceil(F.col("n") / CELL), F.ceil(F.col("words") / CELL_SHINGLES)).alias("parts"))
    held = materialise(held, "buckets")
    members = rows.join(small(held), "bucket").withColumn("salt", F.expr("pmod(xxhash64(node), parts)"))
    members = materialise(members.select("bucket", "parts", "salt", "node", F.col("node").alias("root")), "members")
    few = materialise(members.select("node").distinct().withColumnRenamed("node", "n"), "few")
    sets = signed.join(small(few), F.col("node") == F.col("n"), "left_semi").select("node", "proof", "shingles").dropDuplicates(["node"])
    sets = materialise(sets, "sets")

    def cells(rows: DataFrame, of: list) -> DataFrame:
        return rows.select("node", "root", F.xxhash64("bucket", *of).alias("cell")).join(sets, "node")

    found = _similar(cells(members, ["salt"]), similarity, slack)
    heads = members.where("parts > 1").groupBy("bucket", "salt").agg(F.min("node").alias("node")).withColumn("root", F.col("node"))
    found = materialise(found.unionByName(_similar(cells(heads, []), similarity, slack)), "found")
    large = members.where("parts > 1").drop("root")
    if not large.isEmpty():
        joined = materialise(components(found), "joined")
        large = materialise(large.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node")), "large")
        split = large.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket")
        large = large.join(split, "bucket").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        found = found.unionByName(_similar(cells(large, [F.least("salt", "other"), F.greatest("salt", "other")]), similarity, slack))
    roots = materialise(components(found), "roots")
    named = signed.where("id is not null").select("id", "node").join(small(roots), "node", "left").select("id", F.coalesce("root", "node").alias("root"))
    named = materialise(named, "named")
    kept = materialise(named.groupBy("root").agg(F.min("id").alias("keep"), F.max("id").alias("last")).where("keep < last").drop("last"), "kept")
    gone = named.join(small(kept), "root", "left").groupBy("id").agg(F.min(F.col("id") > F.coalesce("keep", "id")).alias("gone"), F.count("*").alias("rows"))
    gone = materialise(gone.where("gone or rows > 1"), "gone")
    (name,) = free(docs, "gone")
    out = docs.join(small(gone.select(F.col("id").alias(name))), docs[id_col] == F.col(name), "left_anti")
    twice = gone.where("not gone").select(F.col("id").alias(name))
    if twice.isEmpty():
        return out
    again = docs.join(twice, docs[id_col] == F.col(name), "left_semi")
    return out.unionByName(again.dropDuplicates([id_col]))
