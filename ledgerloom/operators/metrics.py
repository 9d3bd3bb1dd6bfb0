"""Evaluation of linkage: per-entity F0.5, summaries, losses, threshold curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.ranks import running


def f05(g: Column, k: Column, tp: Column) -> Column:
    """F0.5 of an entity with ``g`` true links, ``k`` predicted and ``tp`` right ones; nothing to find and nothing found is 1."""
    return F.when((g == 0) & (k == 0), F.lit(1.0)).otherwise(F.lit(1.25) * tp / (F.lit(0.25) * g + k))


def f_beta(precision: Column, recall: Column, beta: float = 0.5) -> Column:
    b2 = beta * beta
    return F.coalesce(F.try_divide((1 + b2) * precision * recall, b2 * precision + recall), F.lit(0.0))


def entity_table(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """``entities`` (q, g, ...) with n_cand, c (true candidates), k, tp, f05, ceiling_f05 and error_type; ``pairs`` has q, label, pred.

    Entities without candidates keep zeros."""
    per = pairs.groupBy("q").agg(
        F.count("*").alias("n_cand"),
        F.sum("label").alias("c"),
        F.sum(F.col("pred").cast("int")).alias("k"),
        F.sum((F.col("pred") & (F.col("label") == 1)).cast("int")).alias("tp"),
    )
    out = entities.join(per, "q", "left").fillna(0, ["n_cand", "c", "k", "tp"])
    g, k, tp, c = (F.col(x) for x in ("g", "k", "tp", "c"))
    out = out.withColumn("f05", F.round(f05(g, k, tp), 9)).withColumn("ceiling_f05", F.round(f05(g, c, c), 9))
    return out.withColumn("error_type", error_type(g, k, tp, c))


def error_type(g: Column, k: Column, tp: Column, c: Column) -> Column:
    return F.when((g == 0) & (k > 0), "singleton_fp").when(k > tp, "matcher_fp").when(c > tp, "matcher_fn").when(g > c, "blocking_miss").otherwise("correct")


def summary(t: DataFrame) -> DataFrame:
    """One row of headline measures of an entity table; null where undefined."""
    s, m = F.col("g") == 0, F.col("g") > 0
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    part = lambda a, b: F.round(F.try_divide(F.sum(a), F.sum(b)), 6)
    thousand = lambda c: F.round(F.try_divide(1000.0 * F.sum(F.when(s, c)), F.count_if(s)), 6)
    covered = F.col("c") / F.col("g")
    return t.agg(
        F.count("*").alias("n"),
        F.round(F.avg("f05"), 6).alias("macro_f05"),
        F.round(F.avg("ceiling_f05"), 6).alias("ceiling_f05"),
        F.round(F.avg(F.when(s, F.col("f05"))), 6).alias("singleton_accuracy"),
        F.round(F.avg(F.when(m, F.col("f05"))), 6).alias("matched_f05"),
        F.count_if(s).alias("n_singletons"),
        share(s).alias("singleton_rate"),
        thousand(F.col("k")).alias("fp_per_1000_singletons"),
        thousand((F.col("k") > 0).cast("int")).alias("affected_per_1000_singletons"),
        F.sum("g").alias("gold_links"),
        F.sum("k").alias("predicted_links"),
        F.sum("tp").alias("true_links"),
        part("tp", "k").alias("pair_precision"),
        part("tp", "g").alias("pair_recall"),
        F.round(F.avg(F.when(F.col("k") > 0, F.col("tp") / F.col("k")).otherwise(1.0)), 6).alias("entity_precision"),
        F.round(F.avg(F.when(m, F.col("tp") / F.col("g")).otherwise((F.col("k") == 0).cast("double"))), 6).alias("entity_recall"),
        part("c", "g").alias("blocking_recall"),
        F.round(F.avg(F.when(m, covered)), 6).alias("candidate_macro_recall"),
        share(F.when(m, F.col("c") > 0)).alias("any_match_coverage"),
        share(F.when(m, F.col("c") == F.col("g"))).alias("all_match_coverage"),
        F.round(F.avg("n_cand"), 6).alias("candidates_mean"),
        F.round(F.percentile("n_cand", F.lit(0.95)), 6).alias("candidates_p95"),
        F.max("n_cand").alias("candidates_max"),
        share(F.col("n_cand") == 0).alias("zero_candidate_rate"),
        F.round(F.avg("k"), 6).alias("predicted_mean"),
        share(F.col("c") == F.col("g")).alias("fully_covered"),
        share(F.col("f05") == 1).alias("perfect"),
    )


def loss_parts(t: DataFrame) -> DataFrame:
    """(error_type, n, loss): what each kind of error takes from the macro F0.5; the losses add up to 1 minus it."""
    return t.groupBy("error_type").agg(F.count("*").alias("n"), F.sum(1 - F.col("f05")).alias("lost")).withColumn("all", F.sum("n").over(Window.partitionBy())).select("error_type", "n", F.round(F.col("lost") / F.col("all"), 6).alias("loss"))


def threshold_curve(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """(t, macro_f05) for each distinct score t (links are those of score >= t) and for none predicted (t = infinity).

    Taking an entity's pairs in order of score changes its F0.5 by known steps; steps of equal scores are summed first, and
    a running sum over distinct scores, by ranges, gives the curve, however many pairs there are.
    """
    w = Window.partitionBy("q").orderBy(F.desc("score"), "p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = pairs.join(entities.select("q", "g"), "q").withColumn("k", F.count("*").over(w)).withColumn("tp", F.sum("label").over(w))
    now = f05(F.col("g"), F.col("k"), F.col("tp"))
    before = f05(F.col("g"), F.col("k") - 1, F.col("tp") - F.col("label"))
    steps = p.groupBy(F.col("score").alias("t")).agg(F.sum(now - before).alias("step"))
    base = entities.agg(F.count("*").alias("n"), F.sum((F.col("g") == 0).cast("double")).alias("start"))
    curve = running(steps, "t", ["step"], descending=True).crossJoin(F.broadcast(base))  # one row
    curve = curve.select("t", F.round((F.col("start") + F.col("run_step")) / F.col("n"), 9).alias("macro_f05"))
    none = base.select(F.lit(float("inf")).alias("t"), F.round(F.col("start") / F.col("n"), 9).alias("macro_f05"))
    return none.unionByName(curve)


def best_threshold(curve: DataFrame) -> DataFrame:
    """The row of the curve with the best F0.5; of equal ones the highest threshold."""
    return curve.orderBy(F.desc("macro_f05"), F.desc("t")).limit(1)


def mann_whitney_auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """ROC AUC by the rank sum of positives, ties sharing their mean rank; ranks come from a running count over distinct scores."""
    per = rows.groupBy(score).agg(F.count("*").alias("n"), F.sum(label).alias("pos"))
    per = running(per, score, ["n"]).withColumn("rank", F.col("run_n") - F.col("n") + (F.col("n") + 1) / 2.0)
    tot = per.agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("np"), F.sum(F.col("n") - F.col("pos")).alias("nn"))
    return tot.select(F.round(F.try_divide(F.col("r") - F.col("np") * (F.col("np") + 1) / 2.0, F.col("np") * F.col("nn")), 6).alias("auc"))


def precision_recall(pairs: DataFrame) -> DataFrame:
    """(score, k, tp, precision, recall) for each distinct score, links being those of that score or more."""
    per = pairs.groupBy("score").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    out = running(per, "score", ["n", "pos"], descending=True).crossJoin(F.broadcast(pairs.agg(F.sum("label").alias("g"))))  # one row
    return out.select("score", F.col("run_n").alias("k"), F.col("run_pos").alias("tp"), F.round(F.col("run_pos") / F.col("run_n"), 6).alias("precision"), F.round(F.col("run_pos") / F.col("g"), 6).alias("recall"))


def thinned(curve: DataFrame, x: str, y: str, most: int = 400) -> DataFrame:
    """At most ``most`` points of a curve, evenly spaced in order of falling ``x``, and its best point (the first of equal ones)."""
    from ledgerloom.operators.ranks import global_row_number

    n = curve.agg(F.count("*").alias("_n"), F.max_by(x, F.struct(y, x)).alias("_best"))  # one row
    at = global_row_number(curve.withColumn("_x", -F.col(x)), ["_x"], "_at").drop("_x").crossJoin(F.broadcast(n))
    # row k is taken if a multiple of (n - 1) / (most - 1), cut to a whole number, is k
    point = F.ceil((F.col("_at") - 1) * (most - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    hit = F.floor(point * (F.col("_n") - 1) / (most - 1)) == F.col("_at") - 1
    return at.where((F.col("_n") <= most) | hit | (F.col(x) == F.col("_best"))).drop("_n", "_at", "_best")


def outcome(label: Column, pred: Column) -> Column:
    """TP, FP, FN or TN of a pair."""
    return F.when(pred & (label == 1), "TP").when(pred, "FP").when(label == 1, "FN").otherwise("TN")


def match_sets(predicted: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """One row of measures of predicted links (q, p) against true ones, over all ``queries`` (q); fails where a link is there twice
    or of an unknown query."""
    from ledgerloom.operators.checks import repeated, require_empty, unknown

    for name, links in (("predicted", predicted), ("true", truth)):
        require_empty(repeated(links, "q", "p"), f"{name} links twice")
        require_empty(unknown(links, queries, "q"), f"{name} links of unknown queries")
    per = queries.select("q").join(truth.groupBy("q").agg(F.count("*").alias("g")), "q", "left").join(predicted.groupBy("q").agg(F.count("*").alias("k")), "q", "left")
    per = per.join(predicted.join(truth, ["q", "p"]).groupBy("q").agg(F.count("*").alias("tp")), "q", "left").fillna(0, ["g", "k", "tp"])
    f = f05(F.col("g"), F.col("k"), F.col("tp"))
    return per.agg(
        F.count("*").alias("n"), F.round(F.avg(f), 6).alias("macro_f05"), F.sum("tp").alias("true_links"), F.sum("g").alias("gold_links"), F.sum("k").alias("predicted_links"),
        F.round(F.try_divide(F.sum("tp"), F.sum("k")), 6).alias("pair_precision"), F.round(F.try_divide(F.sum("tp"), F.sum("g")), 6).alias("pair_recall"),
        F.round(F.avg(F.when(F.col("g") == 0, (F.col("k") == 0).cast("double"))), 6).alias("singleton_accuracy"),
    )


def bootstrap_ci(t: DataFrame, rounds: int = 200, seed: int = 7) -> DataFrame:
    """Mean F0.5 with a 95 % interval by Poisson resampling: each entity weighs a Poisson(1) count in each round, by the md5 of seed,
    round and entity."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("r").cast("string"), F.col("q").cast("string")).cast("binary")), 1, 8)
    draw = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    count = F.lit(0)
    total, term = 0.0, 2.718281828459045**-1
    for k in range(8):
        total += term
        count = count + (draw > total).cast("int")
        term /= k + 1
    each = t.select("q", "f05", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("r")).withColumn("n", count)
    means = each.groupBy("r").agg((F.sum(F.col("n") * F.col("f05")) / F.sum("n")).alias("mean"))
    return means.agg(F.avg("mean").alias("mean"), F.stddev_pop("mean").alias("se"), F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))
