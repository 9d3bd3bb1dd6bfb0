"""Removing repeated runs of lines with a suffix array over line ids.

The lines of all documents, one document after the other, are a sequence; runs don't cross documents.  Lines that occur once
can't lie in a repeated run, so only the suffixes that begin with a repeated line are sorted.

Prefix doubling: suffixes are sorted by their first ``HEAD`` lines, and then in rounds, each of two doublings, by the ranks of
the prefixes of ``size`` lines at them and at ``size``, 2 * ``size`` and 3 * ``size`` lines on.  A round sorts the distinct keys only, with
their counts, so that a passage of a third of the documents is one row.  A suffix keeps its ranks of all rounds: compared in
turn they are its order, and the first that differs tells within a factor of four how many lines two suffixes share.
A suffix takes part in a round while others have its rank and its document goes on; a document leaves when none of its
suffixes does.

Longest common prefixes of neighbours in the array: where the lines before two neighbours are equal too, the prefix is that of the
pair before, less one line.  Only the others are compared, line by line, in blocks from where their ranks part.
Intervals of prefixes of ``least`` lines or more are the repeated runs, and of each such interval all but the first place in
the corpus lose those lines.

Every round's table lies in the shared folder.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import store
from ledgerloom.llm.store import map_batches

_WORD = r"[^\x20\x09-\x0D]"
#: Lines of the first sort, and of the blocks in which neighbours are compared.
HEAD, BLOCK = 8, 64
_LAST = (1 << 63) - 1
#: Every round writes small tables.
materialise, numbered = partial(store.materialise, codec="snappy"), partial(store.numbered, codec="snappy")


def _by_rank(rows: DataFrame, keys: list[str], n: int, tag: str) -> DataFrame:
    """The distinct ``keys`` of ``rows`` with their position in order (``rank``) and the number of their rows (``alike``)."""
    return numbered(rows.groupBy(*keys).agg(F.count("*").alias("alike")), keys, tag=tag, rows=n).withColumnRenamed("row_no", "rank").drop("before")


def _head(lines: DataFrame) -> DataFrame:
    """``lines`` (doc, k, pos, left, id) with ``prior``, the id of the line before if it is repeated, and ``head``: the first
    ``HEAD`` ids; where a line comes that isn't repeated, its place, after all ids, ends them."""
    w = Window.partitionBy("doc").orderBy("k")
    at = lambda j: F.first("id").over(w.rangeBetween(j, j))
    lines = lines.select("*", at(-1).alias("prior"), *(at(j).alias(f"id{j}") for j in range(1, HEAD)))
    alone = F.coalesce(*(F.when((F.col("left") > j) & F.col(f"id{j}").isNull(), F.lit(j)) for j in range(1, HEAD)))
    ids = F.array("id", *(f"id{j}" for j in range(1, HEAD)))
    head = F.slice(ids, F.lit(1), F.least(F.lit(HEAD), F.col("left"), F.coalesce(alone, F.lit(HEAD))).cast("int"))
    head = F.when(alone.isNull(), head).otherwise(F.concat(head, F.array(F.lit(_LAST), F.col("pos") + alone)))
    return lines.select("doc", "k", "pos", "left", "id", "prior", head.alias("head"))


def _sorted(lines: DataFrame) -> DataFrame:
    """The suffix array: ``lines`` with ``ranks``, in which suffixes are ordered (then by ``pos``)."""
    first = materialise(_head(lines), "heads")
    names = _by_rank(first, ["head"], first.count(), "ranked")
    table = first.join(names, "head").select("doc", "k", "pos", "left", "id", "prior", F.array("rank").alias("ranks"), "alike")
    w, size, done = Window.partitionBy("doc").orderBy("k"), HEAD, []
    while True:
        again = (F.col("alike") > 1) & (F.col("left") >= size)
        ahead = {f"r{j}": F.first("ranks").over(w.rangeBetween(j * size, j * size)) for j in (1, 2, 3)}
        table = table.withColumn("again", again).withColumn("busy", F.max("again").over(Window.partitionBy("doc")))
        table = table.select("*", *(c.alias(n) for n, c in ahead.items()))
        for j in (1, 2, 3):
            beyond = F.when(F.col("left") <= j * size, F.array(F.lit(-1).cast("long")))
            table = table.withColumn(f"r{j}", F.when(F.col("again"), F.coalesce(beyond, F.col(f"r{j}"), F.array(F.lit(_LAST), F.col("pos") + j * size))))
        table = materialise(table.withColumn("rank0", F.element_at("ranks", -1)), "round")
        kept = ["doc", "k", "pos", "left", "id", "prior", "ranks"]
        done.append(table.where("not busy").select(*kept))
        moving, keys = table.where("again"), ["rank0", "r1", "r2", "r3"]
        n = moving.count()
        if not n:
            break
        names = _by_rank(moving, keys, n, "ranked")
        moved = moving.drop("alike").join(names, keys).select(*kept[:-1], F.concat("ranks", F.array("rank")).alias("ranks"), "alike")
        table = moved.unionByName(table.where("busy and not again").select(*kept, "alike"))
        size *= 4
    out = done[0]
    for t in done[1:]:
        out = out.unionByName(t)
    return out


def _shared(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """(pos, lcp) of ``pairs`` (pos, doc, k, left, ranks, and those of the other suffix as o_...): the lines that they share."""
    block = F.floor(F.col("k") / BLOCK).cast("long")
    spread = lines.select("doc", "k", "id", F.explode(F.array(block, block - 1)).alias("block"))
    cell = F.struct((F.col("k") - F.col("block") * BLOCK).cast("int").alias("at"), "id")
    blocks = materialise(spread.where("block >= 0").groupBy("doc", "block").agg(F.array_sort(F.collect_list(cell)).alias("cells")), "blocks")
    n = F.least(F.size("ranks"), F.size("o_ranks"))
    part = F.array_position(F.zip_with(F.slice("ranks", F.lit(1), n), F.slice("o_ranks", F.lit(1), n), lambda x, y: x == y), F.lit(False))
    pairs = pairs.withColumn("part", part).withColumn("most", F.least("left", "o_left"))
    low = F.when(F.col("part") == 0, F.col("most")).when(F.col("part") == 1, 0).otherwise((F.pow(F.lit(4.0), F.col("part") - 2) * HEAD).cast("long"))
    high = F.when(F.col("part") == 1, HEAD).otherwise(F.col("low") * 4)
    pairs = pairs.withColumn("low", low.cast("long")).withColumn("high", F.least("most", high))
    steps = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("high") - F.col("low") - 1) / BLOCK)))
    pairs = pairs.select("pos", "doc", "k", "o_doc", "o_k", "low", "high", F.explode(steps).alias("step"))
    start = F.col("low") + F.col("step") * BLOCK
    pairs = pairs.select(
        "pos", "low", "high", "step", (F.col("k") + start).alias("a"), (F.col("o_k") + start).alias("b"), F.greatest(F.lit(0), F.least(F.lit(BLOCK), F.col("high") - start)).cast("int").alias("n"),
        F.col("doc").alias("a_doc"), F.col("o_doc").alias("b_doc"),
    )
    for side in ("a", "b"):
        named = blocks.select(F.col("doc").alias(f"{side}_doc"), F.col("block").alias(f"{side}_block"), F.col("cells").alias(f"{side}_cells"))
        pairs = pairs.withColumn(f"{side}_block", F.floor(F.col(side) / BLOCK).cast("long")).join(named, [f"{side}_doc", f"{side}_block"], "left")

    def cut(side: str) -> Column:
        at = (F.col(side) - F.col(f"{side}_block") * BLOCK).cast("int")
        inside = F.filter(f"{side}_cells", lambda c: (c["at"] >= at) & (c["at"] < at + F.col("n")))
        return F.transform(inside, lambda c: F.struct((c["at"] - at).alias("at"), c["id"].alias("id")))

    pairs = pairs.select("pos", "low", "high", "step", "n", cut("a").alias("x"), cut("b").alias("y"))
    equal = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce((F.get("x", i) == F.get("y", i)) & (F.get("x", i)["at"] == i), F.lit(False)))
    here = F.when(F.col("n") == 0, 0).otherwise(F.array_position(equal, F.lit(False)) - 1)
    ends = F.when(F.col("n") == 0, F.col("low")).when(here >= 0, F.col("low") + F.col("step") * BLOCK + here)
    return pairs.groupBy("pos").agg(F.coalesce(F.min(ends), F.max("high")).alias("lcp"))


def repeated_runs(lines: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """For ``lines`` (doc, k, pos, left, id), those that occur twice or more: (doc, k) of the places at which ``least`` lines
    begin that occur earlier too, and (doc, longest_run) with the longest run of a document's lines that occurs elsewhere.

    ``pos`` numbers the lines of the corpus, ``k`` those of the document, and ``left`` counts those from this one on.
    """
    array = _sorted(lines)
    array = materialise(numbered(array, ["ranks", "pos"], tag="array", rows=lines.count()).withColumnRenamed("row_no", "place").drop("before"), "array")
    shown = ["doc", "k", "pos", "left", "id", "prior", "ranks"]
    other = array.select((F.col("place") + 1).alias("place"), *(F.col(c).alias(f"o_{c}") for c in shown))
    pairs = materialise(array.join(other, "place").where("id = o_id").drop("id", "o_id"), "neighbours")
    fresh = ~F.coalesce(F.col("prior") == F.col("o_prior"), F.lit(False))
    known = _shared(pairs.where(fresh), lines)
    # the pair before in the document, less one line for each line since
    w = Window.partitionBy("doc").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = pairs.select("pos", "o_doc", fresh.alias("fresh"))
    rows = array.select("place", "doc", "k", "pos").join(near, "pos", "left").join(known, "pos", "left")
    given = F.when(F.col("o_doc").isNull(), F.lit(0)).when(F.col("fresh"), F.col("lcp"))
    rows = rows.withColumn("given", F.when(given.isNotNull(), F.struct(given.cast("long").alias("lcp"), F.col("k").alias("k"))))
    rows = rows.withColumn("given", F.last("given", ignorenulls=True).over(w))
    rows = rows.select("place", "doc", "k", "pos", "o_doc", (F.col("given.lcp") - F.col("k") + F.col("given.k")).alias("lcp"))
    rows = materialise(rows.withColumn("starts", F.when(F.col("lcp") < least, 1).otherwise(0)), "prefixes")
    longest = rows.select("doc", "lcp").union(rows.where("o_doc is not null").select("o_doc", "lcp")).groupBy("doc").agg(F.max("lcp").alias("longest_run"))
    spans = numbered(rows, ["place"], F.col("starts"), "intervals", rows=rows.count()).withColumn("interval", F.col("before") + F.col("starts"))
    first = spans.groupBy("interval").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return spans.join(first, "interval").where("pos > first").select("doc", "k"), longest


def remove_repeats(docs: DataFrame, least: int = 2, long: int | None = None, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """(id, n_lines, n_removed, longest_run, kept_sha256) per row, and with ``texts`` the kept lines as ``kept_text``.

    Lines are parts of the text between line feeds; those without a word are neither counted nor compared, and stay.
    A line goes if it lies in a run of ``least`` lines that occurs earlier too: in a row with a smaller id, or earlier in
    the same text.  Given ``long``, a line of more words than that goes also if it occurs earlier by itself.  Lines are compared by
    128 bits of hashes.  ``longest_run`` is the longest run of the row's lines that occurs elsewhere.  A null text has no lines
    and keeps the empty text.  Ids are whole numbers.  Rows without an id come last, ordered by their texts' hashes; rows equal in id
    and text are one document and give the same result each.  An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    parts = F.expr(f"filter(split(text, '\n'), x -> x rlike '{_WORD.replace(chr(92), chr(92) * 2)}')")
    # more than ``long`` words take twice as many characters at least
    wordy = lambda x: F.lit(False) if long is None else F.when(F.length(x) > 2 * long, F.regexp_count(x, F.lit(f"{_WORD}+")) > long).otherwise(False)
    hashed = F.transform(parts, lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"), wordy(x).alias("long")))
    base = rows.select("id", "tie", hashed.alias("parts")).withColumn("n_lines", F.size("parts").cast("long"))
    order = [F.col("id").isNull().alias("unnamed"), "id", "tie"]
    base = base.select(order[0], "id", "tie", "n_lines", "parts")
    base = materialise(numbered(base, ["unnamed", "id", "tie"], F.col("n_lines"), "documents", once=True).withColumnRenamed("before", "doc").where("n_lines > 0"), "placed")
    lines = base.select("doc", "n_lines", F.posexplode_outer("parts").alias("k", "part")).where("k is not null")
    lines = lines.select("doc", F.col("k").cast("long").alias("k"), (F.col("n_lines") - F.col("k")).alias("left"), "part.*")
    twice = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    twice = materialise(twice.withColumn("id", F.monotonically_increasing_id()), "repeated")
    lines = lines.join(twice, ["h1", "h2"]).select("doc", "k", (F.col("doc") + F.col("k")).alias("pos"), "left", "id", "long")
    lines = materialise(lines, "lines")
    starts, longest = repeated_runs(lines.drop("long"), least)
    gone = starts.select("doc", F.explode(F.sequence("k", F.col("k") + least - 1)).alias("k"))
    if long is not None:
        first = lines.where("long").groupBy("id").agg(F.min("pos").alias("first"))
        gone = gone.union(lines.where("long").join(first, "id").where("pos > first").select("doc", "k"))
    marks = gone.groupBy("doc").agg(F.array_sort(F.collect_set("k")).alias("cut")).join(longest, "doc", "right")
    marks = materialise(base.select("id", "tie", "doc").join(marks, "doc").select(F.col("id").alias("i"), F.col("tie").alias("t"), "cut", "longest_run"), "marks")
    found = rows.join(marks, F.col("id").eqNullSafe(F.col("i")) & (F.col("tie") == F.col("t")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile("[^ \t-\r]")
        for b in batches:
            counts, removed, shas, kept = [], [], [], []
            for text, cut in zip(b.column(1), b.column(2), strict=True):
                parts, gone, n, stay = text.as_py().split("\n"), set(cut.as_py() or ()), 0, []
                for x in parts:
                    real = word.search(x) is not None
                    if not real or n not in gone:
                        stay.append(x)
                    n += real
                counts.append(n)
                removed.append(len(parts) - len(stay))
                kept.append("\n".join(stay))
                shas.append(hashlib.sha256(kept[-1].encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), b.column(3), pa.array(shas, pa.string()), *([pa.array(kept, pa.string())] if texts else [])],
                ["id", "n_lines", "n_removed", "longest_run", "kept_sha256", *(["kept_text"] if texts else [])],
            )

    schema = "id long, n_lines long, n_removed long, longest_run long, kept_sha256 string" + (", kept_text string" if texts else "")
    return map_batches(found.select("id", "text", "cut", F.coalesce("longest_run", F.lit(0).cast("long")).alias("longest_run")), run, schema).withColumnRenamed("id", id_col)
