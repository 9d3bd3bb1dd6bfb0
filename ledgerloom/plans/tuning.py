"""Searching settings over tables that are made once: truncations of a wide retrieval, policies, folds."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators import decide, learn
from ledgerloom.operators import metrics as M


def truncations(names: list[str], ks: list[int], least: list[float]) -> list[tuple[dict[str, int], float]]:
    """Every choice of a limit for each pass (0 leaves it out) and of a least score."""
    return [({n: k for n, k in zip(names, choice, strict=True) if k}, low) for choice in product(ks, repeat=len(names)) if any(choice) for low in least]


def blocking_search(wide: DataFrame, truth: DataFrame, queries: DataFrame, grid: list[tuple[dict[str, int], float]]) -> DataFrame:
    """(config, candidates, found, ceiling_f05) of each truncation of one wide retrieval, in one pass over it.

    ``queries`` (q) has all queries; ``ceiling_f05`` is what a perfect matcher of those candidates would reach."""
    names = [",".join(f"{n}@{k}" for n, k in limits.items()) + f">={least:g}" for limits, least in grid]
    inside = [F.coalesce(reduce(Column.__or__, [(F.col(f"rank_{n}") <= k) & (F.col(f"score_{n}") >= least) for n, k in limits.items()]), F.lit(False)) for limits, least in grid]
    marked = wide.select("q", "p", *[c.alias(f"in{k}") for k, c in enumerate(inside)])
    each = range(len(grid))
    size = marked.agg(*[F.count_if(f"in{k}").alias(f"n{k}") for k in each])  # one row
    per = truth.select("q", "p").join(marked, ["q", "p"], "left").groupBy("q").agg(F.count("*").alias("g"), *[F.count_if(f"in{k}").alias(f"c{k}") for k in each])
    gain = lambda k: M.f_beta(F.lit(1.0), F.col(f"c{k}") / F.col("g"))
    row = per.agg(F.count("*").alias("matched"), *[F.sum(f"c{k}").alias(f"c{k}") for k in each], *[F.sum(gain(k)).alias(f"f{k}") for k in each])
    row = row.crossJoin(F.broadcast(size)).crossJoin(F.broadcast(queries.agg(F.count("*").alias("total"))))
    ceiling = lambda k: F.round((F.coalesce(f"f{k}", F.lit(0.0)) + F.col("total") - F.col("matched")) / F.col("total"), 6)
    found = F.array(*[F.struct(F.lit(names[k]).alias("config"), F.col(f"n{k}").alias("candidates"), F.coalesce(f"c{k}", F.lit(0)).alias("found"), ceiling(k).alias("ceiling_f05")) for k in each])
    return row.select(F.explode(found).alias("x")).select("x.*")


def pareto(found: DataFrame) -> DataFrame:
    """Configurations that none with as few candidates beats."""
    w = Window.orderBy("candidates", F.desc("ceiling_f05"), "config").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("_before", F.max("ceiling_f05").over(w)).where("_before is null or ceiling_f05 > _before").drop("_before")


def policy_search(pairs: DataFrame, entities: DataFrame, alphas: list[float], betas: list[float]) -> DataFrame:
    """(alpha, beta, t, macro_f05): the best threshold of each penalty on ambiguity and on conflicts, the best first."""
    rows = []
    for a, b in product(alphas, betas):
        best = M.best_threshold(M.threshold_curve(decide.penalised(pairs, a, b).withColumn("score", F.round("score", 9)), entities))
        rows.append(best.select(F.lit(a).alias("alpha"), F.lit(b).alias("beta"), "t", "macro_f05"))
    return reduce(DataFrame.unionByName, rows).orderBy(F.desc("macro_f05"), "alpha", "beta")


def out_of_fold(pairs: DataFrame, features: list[str], folds: int, kind: str = "gbt") -> DataFrame:
    """``pairs`` (with fold) with ``prob`` by a model of the other folds."""
    parts = []
    for k in range(folds):
        model = learn.fit(pairs.where(F.col("fold") != k), features, kind)
        parts.append(learn.predict(model, pairs.where(F.col("fold") == k), features))
    return reduce(DataFrame.unionByName, parts)


def admitted(base: DataFrame, new: DataFrame, rounds: int = 200, least: float = 0.001) -> DataFrame:
    """One row: mean paired difference of two runs' f05 by entity (q, f05), its 95 % interval, and whether it admits the new run."""
    paired = base.select("q", F.col("f05").alias("old")).join(new.select("q", F.col("f05").alias("now")), "q").select("q", (F.col("now") - F.col("old")).alias("f05"))
    return M.bootstrap_ci(paired, rounds).withColumn("admitted", (F.col("low") > 0) & (F.col("mean") >= least))
