"""Benchmark decontamination by winnowing.

A window is ``span`` consecutive words of a benchmark item.  Of each window of a text the smallest of its k-gram hashes (the
rightmost, on ties) is kept, and a run of windows with the smallest one at the same place keeps it once: these are the text's
fingerprints.  Equal windows keep the same k-gram, so every shared span of ``span`` words gives a pair of equal fingerprints.
Items shorter than ``span`` are windows of their own length, and their own only k-gram.

The items' fingerprints set bits in a table of fixed size (2 MB), which is all that is broadcast whatever the
benchmark's size.  Fingerprints of documents that have their bit set are joined with those of the items, and each hit is
extended word by word to both sides: it counts if the words that are equal make up a window.  A fingerprint carries the words
beside it that its windows may hold.  Items alike around a fingerprint are one row of the join, named at the end.

With ``k`` of 8 words a join needs 8 words in common, so that a phrase of everyday words joins nothing; a smaller ``k`` keeps fewer
fingerprints and joins more in vain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import words as W
from ledgerloom.llm.store import free, map_batches, materialise, small

#: log2 of the bits in the broadcast table.
_BITS = 24


def winnow(h: np.ndarray, first: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers at which the kept k-grams start, their hashes, and a second hash of each."""
    start, _ = W.windows(h, first, span)
    at, gram = W.windows(h, first, k)
    if not len(start):
        return start, np.zeros(0, W.U), np.zeros(0, W.U)
    place = np.searchsorted(at, start)
    best = place.copy()
    for step in range(1, span - k + 1):
        best = np.where(gram[place + step] <= gram[best], place + step, best)
    kept = best[np.append(True, best[1:] != best[:-1])]
    return at[kept], gram[kept], W.windows(h, first, k, 7)[1][kept]


def _beside(h: np.ndarray, first: np.ndarray, start: np.ndarray, doc: np.ndarray, k: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``reach`` words before and after the k-grams at ``start``, the nearest first; zero beyond the text."""
    steps = np.arange(1, reach + 1)
    before, after = start[:, None] - steps, start[:, None] + k - 1 + steps
    left = np.where(before >= first[doc][:, None], h[np.maximum(before, 0)], W.U(0))
    right = np.where(after < first[doc + 1][:, None], h[np.minimum(after, max(len(h) - 1, 0))], W.U(0))
    return left, right


def _rows(column: pa.Array, span: int, k: int, short: list[int] | None, table: np.ndarray | None) -> tuple[np.ndarray, pa.Array]:
    """Words per text, and its fingerprints as a list of structs (start, n, print, second, left, right): those that the bit table
    lets pass, or for an item (no table) those of the length that holds for it."""
    counts, rows, sides = [np.zeros(0, np.int64)], [], []
    for a, _, data, offs in W.slices(column):
        v = W.Words(W.LOWER[data], offs, W.ALNUM)
        h = v.hashes()
        for n in [span, *(range(1, span) if short is None else short)]:
            gram, reach = (k, span - k) if n == span else (n, 0)
            start, least, second = winnow(h, v.first, n, gram)
            doc = np.searchsorted(v.first, start, "right") - 1
            if table is None:
                take = (v.count[doc] >= span) if n == span else (v.count[doc] == n)
            else:
                bit = least >> W.U(64 - _BITS)
                take = (table[bit >> W.U(3)] >> (bit & W.U(7)).astype(np.uint8)) & 1 == 1
            if take.any():
                doc, start = doc[take], start[take]
                rows.append((doc + a, start - v.first[doc], np.full(len(doc), gram), np.full(len(doc), reach), least[take], second[take]))
                sides.append([x.ravel() for x in _beside(h, v.first, start, doc, gram, reach)])
        counts.append(v.count)
    count = np.concatenate(counts)
    doc, start, gram, reach, least, second = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 6
    flat = [np.concatenate(x) for x in zip(*sides, strict=True)] if sides else [np.zeros(0, W.U)] * 2
    order = np.argsort(doc, kind="stable")
    ends = np.append(0, np.cumsum(reach))
    lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x.view(np.int64))).take(pa.array(order)) for x in flat]
    offsets = np.searchsorted(doc[order], np.arange(len(count) + 1)).astype(np.int32)
    fields = [pa.array(x[order].astype(t, copy=False).view(u)) for x, t, u in ((start, np.int32, np.int32), (gram, np.int32, np.int32), (least, W.U, np.int64), (second, W.U, np.int64))]
    return count, pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([*fields, *lists], ["start", "n", "print", "second", "left", "right"]))


_PRINTS = "array<struct<start int, n int, print long, second long, left array<long>, right array<long>>>"


def _equal(side: str) -> Column:
    """How many words beside the fingerprint are equal, from the nearest on."""
    same = F.zip_with(side, f"i_{side}", lambda x, y: (x != 0) & (x == y))
    stop = F.array_position(same, F.lit(False))
    return F.when(stop == 0, F.size(side)).otherwise(stop - 1).cast("int")


def hits(docs: DataFrame, items: DataFrame, span: int = 10, k: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(uid, id, hash of the text, n_words) for each row of ``docs``, (uid, start, n, kin) for each extended hit, and (kin, item),
    the items alike around a fingerprint."""
    spark = docs.sparkSession

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _rows(b.column(1), span, k, None, None)[1]], ["item", "prints"])

    known = map_batches(items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")), of_items, f"item string, prints {_PRINTS}")
    known = materialise(known.select("item", F.explode("prints").alias("p")).select("item", "p.n", "p.print", "p.second", "p.left", "p.right").distinct(), "items")
    shape = ["n", "print", "second", "left", "right"]
    kin = materialise(known.select(*shape).distinct().withColumn("kin", F.monotonically_increasing_id()), "kin")
    named = known.join(kin, shape).select("kin", "item")
    short = sorted(r.n for r in kin.where("size(left) = 0").select("n").distinct().collect() if r.n < span)  # at most span - 1
    bit = F.expr(f"shiftrightunsigned(print, {64 - _BITS})")
    octets = kin.groupBy(F.shiftright(bit, 3).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1, cast(shiftrightunsigned(print, {64 - _BITS}) & 7 as int))")).alias("bits"))
    table = np.zeros(1 << _BITS - 3, np.uint8)
    for r in octets.toLocalIterator():  # at most 2**21 rows
        table[r["at"]] = r["bits"]
    shared = spark.sparkContext.broadcast(table)

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count, prints = _rows(b.column(1), span, k, short, shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(count.astype(np.int64)), prints], ["id", "hash", "n_words", "prints"])

    marks = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    marks = map_batches(marks, of_docs, f"id {marks.schema['id'].dataType.simpleString()}, hash long, n_words long, prints {_PRINTS}")
    marks = materialise(marks.withColumn("uid", F.monotonically_increasing_id()), "marks")
    found = marks.where("size(prints) > 0").select("uid", F.explode("prints").alias("p")).select("uid", "p.*")
    found = found.join(kin.withColumnsRenamed({"left": "i_left", "right": "i_right"}), ["n", "print", "second"])
    found = found.withColumn("l", _equal("left")).withColumn("r", _equal("right")).where(F.col("l") + F.col("r") >= F.size("left"))
    found = found.select("uid", (F.col("start") - F.col("l")).alias("start"), (F.col("n") + F.col("l") + F.col("r")).alias("n"), "kin")
    return marks.select("uid", "id", "hash", "n_words"), found, named


def contamination(docs: DataFrame, items: DataFrame, span: int = 10, k: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) per row of ``docs``.

    ``n_hit`` counts words inside any occurrence of a window of an item.  Null texts and items have no words; an item
    without an id is searched for but not named; repeated items name their id once; rows of one id, or without one, are
    told apart and give a row each; empty tables give no rows or no hits.
    """
    marks, found, named = hits(docs, items, span, k, id_col, text_col, item_col, item_text)
    found = materialise(found, "hits")
    w = Window.partitionBy("uid").orderBy("start", "n")
    reach = F.max(F.col("start") + F.col("n")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    spans = found.select("uid", "start", "n").distinct().withColumn("new", F.col("start") + F.col("n") - F.greatest(F.col("start"), F.coalesce(reach, F.col("start"))))
    spans = spans.groupBy("uid").agg(F.sum(F.greatest("new", F.lit(0))).cast("long").alias("n_hit"))
    # documents with hits in the same items are named together
    kins = found.groupBy("uid").agg(F.array_sort(F.collect_set("kin")).alias("kins"))
    kins = kins.select("uid", "kins", F.xxhash64("kins").alias("k1"), F.xxhash64(F.lit(1), "kins").alias("k2"))
    names = kins.groupBy("k1", "k2").agg(F.max("kins").alias("kins")).select("k1", "k2", F.explode("kins").alias("kin")).join(named, "kin", "left")
    names = names.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item")).alias("names"))
    names = names.select("k1", "k2", F.size("names").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "names").cast("binary"), 256).alias("items_sha256"))
    named = kins.drop("kins").join(names, ["k1", "k2"]).drop("k1", "k2")
    out = marks.join(spans.join(named, "uid"), "uid", "left")
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(b""), 256)).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, span: int = 10, k: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no window of an item; rows without an id are told by their texts."""
    marks, found, _ = hits(docs, items, span, k, id_col, text_col, item_col, item_text)
    bad_id, bad_hash = free(docs, "bad_id", "bad_hash")
    bad = marks.join(found.select("uid").distinct(), "uid", "left_semi").select(F.col("id").alias(bad_id), F.col("hash").alias(bad_hash)).distinct()
    same = docs[id_col].eqNullSafe(F.col(bad_id)) & (F.xxhash64(docs[text_col]) == F.col(bad_hash))
    return docs.join(small(materialise(bad, "contaminated")), same, "left_anti")
