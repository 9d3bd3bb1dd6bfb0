"""Mixing sources to target weights by subset-sum budget fitting.

Each source has a budget of words.  Whole passes over the source are taken while they fit; the rest is a subset of its
documents whose lengths should add up to what is left.  Documents are counted by exact length, and a bounded-knapsack
dynamic program over these counts picks how many of each length to take: an even share of every length first, then the
program for the budget that remains.  Documents of a length are picked by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.store import materialise, small

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Largest remaining budget that one dynamic program covers word by word.
PROGRAM = 1 << 16
#: Hash ranges of the documents of one length.
RANGES = 1 << 10


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Budgets of sources: ``share`` of all words by weight, none over ``most`` times its source's words.

    What a source can't take goes to the others by weight, until none is above."""
    total, out, capped = share * sum(sizes), [0.0] * len(sizes), [s == 0 for s in sizes]
    while True:
        left = total - sum(most * s for s, c in zip(sizes, capped, strict=True) if c)
        weight = sum(w for w, c in zip(weights, capped, strict=True) if not c)
        out = [most * s if c else left * w / weight for s, w, c in zip(sizes, weights, capped, strict=True)]
        over = [not c and t > most * s for t, s, c in zip(out, sizes, capped, strict=True)]
        if not any(over):
            return out
        capped = [c or o for c, o in zip(capped, over, strict=True)]


def _program(size: np.ndarray, free: np.ndarray, left: int) -> tuple[np.ndarray, int]:
    """How many of the ``free`` ones of each length to take for ``left`` words, and the words still missing (negative: too many).

    A sum's place is its words in units of one word up to ``PROGRAM`` words and as many more as the longest has; beyond, a unit
    is so many words that they fit, and each place has the exact sum that reached it first.  ``size`` ascends.
    """
    take = np.zeros(len(size), np.int64)
    use = np.flatnonzero((size > 0) & (free > 0))
    if not len(use) or left <= 0:
        return take, left
    longest = min(int(size[use[-1]]), int(size[use][size[use] >= left][0]) if (size[use] >= left).any() else left)
    unit = max(1, -(-(left + longest) // (2 * PROGRAM)))
    limit = -(-(left + longest) // unit)  # a sum above may be nearer than any below
    # reached[j]: the item that first made the place j; items are 1, 2, 4, ... of a length (bounded knapsack by halves)
    reached, words, came = np.full(limit + 1, -1, np.int64), np.zeros(limit + 1, np.int64), np.zeros(limit + 1, np.int64)
    reached[0] = -2
    items: list[tuple[int, int]] = []
    best = 0
    for k in use:
        many, step = min(int(free[k]), (left + longest) // int(size[k])), 1
        while many > 0 and words[best] != left:
            n = min(step, many)
            many, step, whole = many - n, 2 * step, n * int(size[k])
            weight = max(1, round(whole / unit))
            if weight > limit:
                continue
            new = np.flatnonzero((reached[: limit + 1 - weight] != -1) & (reached[weight:] == -1)) + weight
            if len(new):
                reached[new], came[new], words[new] = len(items), new - weight, words[new - weight] + whole
                items.append((k, n))
                nearest = int(new[np.argmin(np.abs(words[new] - left))])
                best = nearest if abs(int(words[nearest]) - left) < abs(int(words[best]) - left) else best
        if words[best] == left:
            break
    at = best
    while at:
        k, n = items[reached[at]]
        take[k] += n
        at = int(came[at])
    return take, left - int(words[best])


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that the words taken come as near ``budget`` as the program finds."""
    order = np.argsort(lengths, kind="stable")
    size, have = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    some = size > 0
    total = int((size * have).sum())
    take = np.zeros(len(size), np.int64)
    if total == 0 or budget <= 0:
        return take
    if budget >= total:
        return counts.copy()
    take[some] = np.floor(have[some] * (budget / total)).astype(np.int64)
    left = budget - int((size * take).sum())
    # Long ones bring what is left into the program's reach: of one word a unit, or if that isn't exact of ever coarser ones.
    best, off = take, left
    for reach in (PROGRAM, 2 * int(size[-1]), 16 * int(size[-1]), left):
        near, rest = take.copy(), left
        for k in np.flatnonzero(some)[::-1]:
            if rest <= reach:
                break
            more = min(int(have[k] - near[k]), (rest - reach // 2) // int(size[k]))
            if more > 0:
                near[k] += more
                rest -= more * int(size[k])
        while rest > 0:
            more, missing = _program(size, have - near, rest)
            if not more.any():
                break
            near, rest = near + more, missing
        if abs(rest) < abs(off):
            best, off = near, rest
        if off == 0:
            break
    take = best
    out = np.zeros(len(size), np.int64)
    out[order] = take
    return out


def _placed(docs: DataFrame, share: float, most: int, seed: int, id_col: str, text_col: str, source_col: str, carry: bool) -> DataFrame:
    """Rows (with all columns of ``docs`` in ``_row`` if ``carry``) with the number of times that each is taken."""
    spark = docs.sparkSession
    rows = docs.select(*(c.alias(n) for c, n in zip(_measures(docs, id_col, text_col, source_col, seed), ("id", "source", "size", "hash", "range"), strict=True)))
    rows = materialise(rows, "sizes")
    per_length = materialise(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    # Budgets: a row for each source.  Summing weights in order needs all sources in turn, not their documents.
    sources = [(r.source, r.words) for r in per_length.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()]
    sources.sort(key=lambda x: (x[0] is None, x[0] or ""))
    budget = targets([w for _, w in sources], [WEIGHTS[k % len(WEIGHTS)] for k in range(len(sources))], share, most) if sources else []
    plan = spark.createDataFrame([(s, w, float(t), int(round(t)) // w if w else 0, int(round(t)) % w if w else 0) for (s, w), t in zip(sources, budget, strict=True)], "source string, source_size long, target double, passes long, rest long")

    def pick(t: pa.Table) -> pa.Table:
        got = fit(t.column("size").to_numpy(), t.column("n").to_numpy(), t.column("rest")[0].as_py())
        return pa.table({"source": t.column("source"), "size": t.column("size"), "quota": pa.array(got)})

    budgets = per_length.join(plan.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    quotas = budgets.groupBy("source").applyInArrow(pick, "source string, size long, quota long")
    # The rows of a length in hash order: ranges before the one that the quota cuts are taken whole, and only that one is ranked.
    ranges = rows.groupBy("source", "size", "range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumn("before", before)
    q = quotas.where("quota > 0").select(F.col("source").alias("s"), F.col("size").alias("z"), "quota")
    cuts = ranges.join(q, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).where("before < quota and before + n >= quota")
    cuts = small(materialise(cuts.select(F.col("s").alias("_s"), F.col("z").alias("_z"), F.col("range").alias("_cut"), (F.col("quota") - F.col("before")).alias("_free"), F.col("n").alias("_n")), "cuts"))
    plan = plan.select(F.col("source").alias("_p"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("passes").alias("_passes"))
    full = docs.select(F.struct("*").alias("_row"), *_measures(docs, id_col, text_col, source_col, seed)) if carry else rows.select(*(F.col(c).alias(f"_{c}") for c in rows.columns))
    placed = full.join(cuts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z")), "left")
    ranked = (F.col("_range") == F.col("_cut")) & (F.col("_free") < F.col("_n"))
    others = placed.where(~F.coalesce(ranked, F.lit(False))).withColumn("_extra", F.when(F.col("_range") <= F.col("_cut"), 1).otherwise(0))
    rank = F.row_number().over(Window.partitionBy("_source", "_size", "_range").orderBy("_hash", F.col("_id").asc_nulls_last()))
    out = others.unionByName(placed.where(ranked).withColumn("_extra", F.when(rank <= F.col("_free"), 1).otherwise(0)))
    plan = F.broadcast(plan) if len(sources) <= 1 << 19 else plan
    return out.join(plan, F.col("_source").eqNullSafe(F.col("_p"))).withColumn("_times", F.col("_passes") + F.col("_extra"))


def _measures(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> list[Column]:
    size = F.coalesce(F.regexp_count(docs[text_col], F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    digest = F.xxhash64(F.lit(seed), docs[id_col], size)
    return [docs[id_col].alias("_id"), docs[source_col].cast("string").alias("_source"), size.alias("_size"), digest.alias("_hash"), F.pmod(digest, F.lit(RANGES)).cast("int").alias("_range")]


def mix(docs: DataFrame, share: float = 1.5, most: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, taken, times) per row: the words that the mix takes of it, repeats counted.

    ``size`` is the number of words of the text, 0 for null.  Sources are taken in code point order, null last as a source
    of its own; their weights repeat.  A row is taken 0 to ``most`` times.  Picks go by a hash of the id and the size,
    so reruns agree; of rows equal in both it doesn't matter which is picked.  An empty table gives no rows.
    """
    out = _placed(docs, share, most, seed, id_col, text_col, source_col, carry=False)
    columns = {"_id": id_col, "_source": source_col, "_size": "size", "_source_size": "source_size", "_target": "target"}
    return out.select(*(F.col(c).alias(n) for c, n in columns.items()), (F.col("_size") * F.col("_times")).alias("taken"), F.col("_times").alias("times"))


def mixed_rows(docs: DataFrame, share: float = 1.5, most: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as ``mix`` takes it."""
    out = _placed(docs, share, most, seed, id_col, text_col, source_col, carry=True)
    return out.where("_times > 0").withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_times").cast("int")))).select("_row.*")
