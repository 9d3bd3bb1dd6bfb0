"""From scores to links: policies, one-to-one assignment, match lists."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators import metrics as M
from ledgerloom.operators.ranks import running


def unique_assignment(links: DataFrame) -> DataFrame:
    """Of the links to one pool record, the one with the best score; ties go to the smaller q."""
    w = Window.partitionBy("p").orderBy(F.desc("score"), "q")
    return links.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def collisions(links: DataFrame) -> DataFrame:
    """(claims, n): how many pool records are claimed by how many queries."""
    return links.groupBy("p").agg(F.count("*").alias("claims")).groupBy("claims").agg(F.count("*").alias("n"))


def second_best(pairs: DataFrame, score: str = "score") -> DataFrame:
    """``pairs`` with ``second`` (the second score of its query, or 0) and ``ambiguity`` (second over best)."""
    w = Window.partitionBy("q")
    rank = F.row_number().over(w.orderBy(F.desc(score), "p"))
    out = pairs.withColumn("_r", rank).withColumn("second", F.coalesce(F.max(F.when(F.col("_r") == 2, F.col(score))).over(w), F.lit(0.0)))
    return out.withColumn("ambiguity", F.coalesce(F.try_divide("second", F.max(score).over(w)), F.lit(0.0))).drop("_r")


def penalised(pairs: DataFrame, alpha: float, beta: float) -> DataFrame:
    """Scores less what ambiguity and conflicts cost; no conflict count is none."""
    return second_best(pairs).withColumn("score", F.col("score") - alpha * F.col("ambiguity") - beta * F.coalesce("conflict_count", F.lit(0)))


def gate_curve(pairs: DataFrame, entities: DataFrame, gates: list[float]) -> DataFrame:
    """(tau, t, macro_f05): the best threshold after entities whose probability of any match is under tau lose all links.

    ``entities`` has q, g and any_match.  A pair counts for the gates up to its entity's probability: steps of F0.5 are summed by
    score, with a column for each gate, and one running sum over the scores serves all gates."""
    gates = sorted(set(gates))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = pairs.join(entities.select("q", "g", "any_match"), "q").withColumn("k", F.count("*").over(w)).withColumn("tp", F.sum("label").over(w))
    p = p.withColumn("step", M.f05(F.col("g"), F.col("k"), F.col("tp")) - M.f05(F.col("g"), F.col("k") - 1, F.col("tp") - F.col("label")))
    names = [f"s{k}" for k in range(len(gates))]
    steps = p.groupBy(F.col("score").alias("t")).agg(*[F.sum(F.when(F.col("any_match") >= g, F.col("step")).otherwise(0.0)).alias(n) for n, g in zip(names, gates, strict=True)], *[F.max(F.col("any_match") >= g).alias(f"open_{n}") for n, g in zip(names, gates, strict=True)])
    base = entities.agg(F.count("*").alias("n"), F.sum((F.col("g") == 0).cast("double")).alias("start"))  # one row
    curve = running(steps, "t", names, descending=True).crossJoin(F.broadcast(base))
    value = lambda n: F.round((F.col("start") + F.col(f"run_{n}")) / F.col("n"), 9)
    best = curve.agg(*[F.max(F.when(F.col(f"open_{n}"), F.struct(value(n).alias("v"), F.col("t").alias("t")))).alias(n) for n in names])  # one row
    none = F.struct(F.round(F.col("start") / F.col("n"), 9).alias("v"), F.lit(float("inf")).alias("t"))
    each = F.explode(F.array(*[F.struct(F.lit(float(g)).alias("tau"), F.greatest(none, F.coalesce(F.col(f"b.{n}"), none)).alias("b")) for n, g in zip(names, gates, strict=True)]))
    both = best.select(F.struct(*names).alias("b")).crossJoin(F.broadcast(base))
    return both.select(each.alias("x")).select("x.tau", F.col("x.b.t").alias("t"), F.col("x.b.v").alias("macro_f05"))


@dataclass(frozen=True)
class Policy:
    """Which pairs become links: A, a score of ``t`` or more; B, also a probability of any match of ``tau`` or more; C, as B by
    scores less ``alpha`` times the ambiguity and ``beta`` times the conflicts."""

    kind: str = "A"
    t: float = 0.5
    tau: float = 0.0
    alpha: float = 0.0
    beta: float = 0.0
    macro_f05: float | None = None


def quantile_gates(entities: DataFrame, n: int = 45, low: float = 0.02, high: float = 0.9) -> list[float]:
    """0 and ``n`` quantiles of the probability of any match."""
    at = [low + (high - low) * k / (n - 1) for k in range(n)]
    found = entities.agg(F.percentile("any_match", F.array(*map(F.lit, at))).alias("x")).first().x
    return [0.0, *(found or [])]


def fit_policy(kind: str, pairs: DataFrame, entities: DataFrame, alphas: tuple[float, ...] = (0.0, 0.1, 0.25, 0.5), betas: tuple[float, ...] = (0.0, 0.05, 0.2, 0.5)) -> Policy:
    """The policy of a kind with the best macro F0.5 on ``pairs`` (q, p, score, label, and for C conflict_count) of ``entities`` (q,
    g, and but for A any_match).  Of equal ones the lowest gate and least penalties, then the highest threshold."""
    if kind == "A":
        best = M.best_threshold(M.threshold_curve(pairs, entities)).first()
        return Policy("A", best.t, macro_f05=best.macro_f05)
    gates, found = quantile_gates(entities), []
    for a, b in [(0.0, 0.0)] if kind == "B" else product(alphas, betas):
        scored = pairs if kind == "B" else penalised(pairs, a, b).withColumn("score", F.round("score", 9))
        best = gate_curve(scored, entities, gates).orderBy(F.desc("macro_f05"), "tau").first()
        found.append(Policy(kind, best.t, best.tau, a, b, best.macro_f05))
    return max(found, key=lambda x: (x.macro_f05, -x.alpha, -x.beta))


def apply_policy(policy: Policy, pairs: DataFrame) -> DataFrame:
    """``pairs`` (q, p, score, for C conflict_count, and but for A any_match) with ``pred``."""
    scores = penalised(pairs, policy.alpha, policy.beta).withColumn("_s", F.round("score", 9)).select("q", "p", "_s") if policy.kind == "C" else None
    out = pairs.join(scores, ["q", "p"]) if scores is not None else pairs.withColumn("_s", F.col("score"))
    pred = F.col("_s") >= policy.t
    if policy.kind != "A":
        pred = pred & (F.col("any_match") >= policy.tau)
    return out.withColumn("pred", F.coalesce(pred, F.lit(False))).drop("_s")


def match_lists(queries: DataFrame, links: DataFrame) -> DataFrame:
    """(q, ids): a row for each query, its links' ids by falling score, joined by commas; '' without links."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("p")))), lambda x: x["p"].cast("string")), ",")
    return queries.select("q").join(links.groupBy("q").agg(ids.alias("ids")), "q", "left").withColumn("ids", F.coalesce("ids", F.lit("")))
