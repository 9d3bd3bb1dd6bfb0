"""Reproducible splits, folds and samples: orders by md5 or hash, never by chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(seed: str, key: Column) -> Column:
    """A reproducible order of keys."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def stratified(rows: DataFrame, key: str, strata: list, cuts: dict[str, float], seed: str = "42") -> DataFrame:
    """``rows`` with ``split``: in each stratum, by cumulative share of the md5 order."""
    w = Window.partitionBy(*strata)
    place = (F.row_number().over(w.orderBy(seeded(seed, F.col(key)), key)) - 0.5) / F.count("*").over(w)
    names = list(cuts)
    split, total = None, 0.0
    for name in names[:-1]:
        total += cuts[name]
        split = F.when(place < total, name) if split is None else split.when(place < total, name)
    return rows.withColumn("split", split.otherwise(names[-1]) if split is not None else F.lit(names[-1]))


def folds(rows: DataFrame, key: str, strata: list, k: int = 5, seed: str = "42") -> DataFrame:
    """``rows`` with ``fold``, dealt round robin within each stratum."""
    return rows.withColumn("fold", (F.row_number().over(Window.partitionBy(*strata).orderBy(seeded(seed, F.col(key)), key)) - 1) % k)


def negatives(ranked: DataFrame, hard: int = 8, easy: int = 2, seed: str = "42") -> DataFrame:
    """Training pairs of (q, p, label, rank): all positives, the first ``hard`` negatives by rank, ``easy`` of the rest by md5; the
    rows of a query weigh one together."""
    negative = F.row_number().over(Window.partitionBy("q", "label").orderBy("rank", "p"))
    out = ranked.withColumn("_n", negative).withColumn("_far", (F.col("label") == 0) & (F.col("_n") > hard))
    draw = F.row_number().over(Window.partitionBy("q", "_far").orderBy(seeded(seed, F.concat_ws(":", "q", "p")), "p"))
    kind = F.when(F.col("label") == 1, "positive").when(~F.col("_far"), "hard").when(draw <= easy, "easy")
    out = out.withColumn("kind", kind).where("kind is not null").drop("_n", "_far")
    return out.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("q")))


def roles(rows: DataFrame, key: str, shares: dict[str, float], seed: str = "0") -> DataFrame:
    """``rows`` with ``role``, by where the md5 of seed and key falls: independent of the other rows, so no shuffle."""
    at = F.conv(F.substring(seeded(seed, F.col(key)), 1, 8), 16, 10).cast("double") / 4294967296.0
    names, total, role = list(shares), 0.0, None
    for name in names[:-1]:
        total += shares[name]
        role = F.when(at < total, name) if role is None else role.when(at < total, name)
    return rows.withColumn("role", role.otherwise(names[-1]) if role is not None else F.lit(names[-1]))


def training_rows(pairs: DataFrame, kind: str = "E0", entities: DataFrame | None = None, hard: int = 8, random: int = 4, weight: float = 3.0, seed: str = "0") -> DataFrame:
    """Pairs (q, p, label, and for E1 score_rank and n_cand_ctx) to train on, with ``weight``: all (E0); positives, negatives of the first
    ``hard`` ranks and about ``random`` of the others of a query by md5 (E1); all, negatives of queries without a match weighing ``weight`` (E2,
    by ``entities`` q, g)."""
    if kind == "E1":
        draw = F.conv(F.substring(seeded(seed, F.concat_ws(":", "q", "p")), 1, 8), 16, 10).cast("double") / 4294967296.0
        rest = F.greatest(F.col("n_cand_ctx") - hard, F.lit(1))
        return pairs.where((F.col("label") == 1) | (F.col("score_rank") <= hard) | (draw < F.lit(float(random)) / rest)).withColumn("weight", F.lit(1.0))
    if kind == "E2":
        single = entities.where("g = 0").select("q", F.lit(True).alias("_single"))
        out = pairs.join(single, "q", "left")
        return out.withColumn("weight", F.when(F.col("_single") & (F.col("label") == 0), F.lit(weight)).otherwise(1.0)).drop("_single")
    if kind != "E0":
        raise ValueError(f"no negatives of kind {kind}")
    return pairs.withColumn("weight", F.lit(1.0))
