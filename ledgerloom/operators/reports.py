"""Smaller operators of reports, audits and sampling: DataFrames in, DataFrames out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.ranks import global_row_number
from ledgerloom.operators.splits import seeded


def fetch(rows: DataFrame, by: list[str], wanted: DataFrame) -> DataFrame:
    """Rows by their 0-based place in order of ``by``: a row for each one of ``wanted`` (row_id and more), repeats too."""
    placed = global_row_number(rows, by, "_place").withColumn("row_id", F.col("_place") - 1).drop("_place")
    return wanted.join(placed, "row_id")


def scaled(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """``rows`` with ``scaled`` (min to max of the group as 0 to 1; null if they are equal) and ``percentile`` (rank within the group)."""
    w = Window.partitionBy(*by)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return rows.withColumn("scaled", F.try_divide(F.col(column) - low, high - low)).withColumn("percentile", F.percent_rank().over(w.orderBy(column)))


def probes(left: Column, right: Column) -> dict[str, Column]:
    """Blocking probes of two arrays of words: which keys they would share."""
    first, least = (lambda a: F.get(a, F.lit(0))), (lambda a: F.array_min(a))
    same = lambda a, b: F.coalesce((a == b) & (a != ""), F.lit(False))
    found = {
        "first_token": same(first(left), first(right)),
        "least_token": same(least(left), least(right)),
        "prefix_4": same(F.substring(F.array_join(left, " "), 1, 4), F.substring(F.array_join(right, " "), 1, 4)),
        "any_token": F.arrays_overlap(left, right) & (F.size(left) > 0),
    }
    return found | {"first_or_prefix": found["first_token"] | found["prefix_4"]}


def without_owned(rows: DataFrame, owners: DataFrame, key: str, split: str) -> DataFrame:
    """Rows whose ``key`` nobody owns, or somebody of the ``split`` does (a guard against leaks); ``owners`` has key and split."""
    owned = owners.groupBy(key).agg(F.max((F.col("split") == split).cast("int")).alias("_own"))
    return rows.join(owned, key, "left").where("_own is null or _own = 1").drop("_own")


#: Pool records, and queries, of a country and first word that one task pairs, at about.
TILE = 1 << 10


def first_word_negatives(queries: DataFrame, pool: DataFrame, truth: DataFrame, seed: str = "42") -> DataFrame:
    """(q, p, kind) for each query (id, country, first): the pool record of its country and first word (hard), and one of its country
    (random), the first by md5 of those that aren't its matches.

    A country and first word is cut in tiles of ``TILE`` pool records, kept as arrays, by ``TILE`` queries.  A query takes the least of
    each array, so all pairs are hashed but none is shuffled or sorted.
    A random one is the next record of the country after the query in order of md5, so no pairs of a country are made."""
    key = ["country", "first"]
    owners = truth.groupBy("p").agg(F.collect_list("q").alias("owners"))
    qs = queries.where("first is not null and first != ''").select(F.col("id").alias("q"), *key)
    ps = pool.select(F.col("id").alias("p"), *key).join(owners, "p", "left")
    tiles = lambda rows, name: rows.groupBy(*key).agg(F.ceil(F.count("*") / TILE).cast("int").alias(name))
    sizes = tiles(qs, "across").join(tiles(ps, "down"), key)
    at = lambda c, n: F.expr(f"cast(pmod(xxhash64({c}), {n}) as int)")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    qs = qs.join(sizes, key).select("q", *key, at("q", "across").alias("a"), every("down").alias("d"))
    arrays = ps.join(sizes, key).select(*key, "across", at("p", "down").alias("d"), F.struct("p", "owners").alias("x")).groupBy(*key, "across", "d").agg(F.collect_list("x").alias("xs"))
    arrays = arrays.select(*key, "d", "xs", every("across").alias("a"))
    free = F.filter("xs", lambda x: x["owners"].isNull() | ~F.array_contains(x["owners"], F.col("q")))
    least = F.array_min(F.transform(free, lambda x: F.struct(seeded(seed, F.concat_ws(":", "q", x["p"])).alias("at"), x["p"].alias("p"))))
    tile, n = [*key, "a", "d"], int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number, as few bytes are much work here
    hard = qs.repartition(n, *tile).join(arrays.repartition(n, *tile), tile).select("q", least.alias("least"))
    # Two uses of the least keep its column below the aggregation, whose sort would else carry the arrays.
    hard = hard.groupBy("q").agg(F.min("least").alias("least"), F.count("least").alias("n")).where("n > 0").select("q", F.col("least.p").alias("p"), F.lit("hard").alias("kind"))
    mixed = queries.select("country", F.col("id").alias("q"), F.lit(None).cast(pool.schema["id"].dataType).alias("p"), seeded(seed, F.concat(F.lit("q"), F.col("id").cast("string"))).alias("at"))
    mixed = mixed.unionByName(pool.select("country", F.lit(None).cast(queries.schema["id"].dataType).alias("q"), F.col("id").alias("p"), seeded(seed, F.concat(F.lit("p"), F.col("id").cast("string"))).alias("at")))
    # The next one is the last one in falling order: a frame up to the end would be read again for each row.
    before = Window.partitionBy("country").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    around = mixed.withColumn("next", F.last("p", ignorenulls=True).over(before)).where("q is not null and next is not null")
    near = around.select("q", F.col("next").alias("p"), F.lit("random").alias("kind"))
    return hard.unionByName(near.join(truth.select("q", "p"), ["q", "p"], "left_anti"))


def first_known(rows: DataFrame, by: list[str], column: str, order: list[str]) -> DataFrame:
    """The first value of ``column`` that isn't null in each group, in ``order``; null if there is none."""
    value = F.min(F.when(F.col(column).isNotNull(), F.struct(*order, F.col(column).alias("_v"))))
    return rows.groupBy(*by).agg(value.getField("_v").alias(column))


def placed_differences(a: DataFrame, b: DataFrame, place: str, columns: list[str]) -> DataFrame:
    """Places at which two tables differ, or that one of them lacks, with both sides' values."""
    side = lambda t, n: t.select(place, F.struct(*columns).alias(n))
    return side(a, "left").join(side(b, "right"), place, "full").where("not (left <=> right)")


def ablation(runs: DataFrame, most: int = 20) -> DataFrame:
    """(run, step, ancestor, gain): each run's chain of parents, up to ``most`` steps, with what its F0.5 gains over each.

    ``runs`` has name, parent, macro_f05."""
    up = runs.select(F.col("name").alias("ancestor"), F.col("parent").alias("_next"), F.col("macro_f05").alias("_value"))
    chain = runs.where("parent is not null").select(F.col("name").alias("run"), F.col("parent").alias("ancestor"), "macro_f05")
    out = None
    for step in range(1, most + 1):
        found = chain.join(up, "ancestor")
        here = found.select("run", F.lit(step).alias("step"), "ancestor", F.round(F.col("macro_f05") - F.col("_value"), 6).alias("gain"))
        out = here if out is None else out.unionByName(here)
        chain = found.where("_next is not null").select("run", F.col("_next").alias("ancestor"), "macro_f05")
        if chain.isEmpty():
            break
    return out


def chosen(runs: DataFrame, without: tuple[str, ...] = ("P-oracle",)) -> DataFrame:
    """The run of the best macro F0.5, of equal ones the fastest."""
    return runs.where(~F.col("name").isin(*without)).orderBy(F.desc("macro_f05"), "wall_s", "name").limit(1)


def robust(trials: DataFrame, top: int = 5) -> DataFrame:
    """(trial, mean, std, robust_score): of the ``top`` trials by mean over folds, the mean less the standard deviation, the best first;
    ``trials`` has trial, fold, value."""
    per = trials.groupBy("trial").agg(F.round(F.avg("value"), 9).alias("mean"), F.round(F.stddev_pop("value"), 9).alias("std"))
    return per.orderBy(F.desc("mean"), "trial").limit(top).withColumn("robust_score", F.round(F.col("mean") - F.col("std"), 9))


def pruned(trials: DataFrame, warm: int = 1) -> DataFrame:
    """(trial, step) at which a median pruner stops a trial: its running mean is under the median of the earlier trials' at the same step.

    ``trials`` has trial, step, value (the running mean); the first ``warm`` steps never stop one."""
    earlier = trials.select(F.col("trial").alias("other"), "step", F.col("value").alias("theirs"))
    both = trials.join(earlier, "step").where("other < trial").groupBy("trial", "step").agg(F.max("value").alias("value"), F.percentile("theirs", F.lit(0.5)).alias("median"))
    return both.where(f"value < median and step >= {warm}").groupBy("trial").agg(F.min("step").alias("step"))


def reasons(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, gap): by how much the mean of a feature is larger in false links than in true ones, the largest gaps first."""
    fp, tp = F.col("pred") & (F.col("label") == 0), F.col("pred") & (F.col("label") == 1)
    row = pairs.agg(*[F.round(F.avg(F.when(fp, F.col(c))) - F.avg(F.when(tp, F.col(c))), 6).alias(c) for c in columns])
    return row.unpivot([], columns, "feature", "gap").orderBy(F.desc(F.abs("gap")), "feature")


def score_issues(scores: DataFrame, queries: DataFrame) -> DataFrame:
    """(issue, q, p) of score rows: of no query, twice, or without a finite score."""
    issue = lambda rows, name: rows.select(F.lit(name).alias("issue"), "q", "p")
    bad = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    twice = scores.groupBy("q", "p").agg(F.count("*").alias("n")).where("n > 1")
    return issue(scores.join(queries.select("q").distinct(), "q", "left_anti"), "query unknown").unionByName(issue(twice, "scored twice")).unionByName(issue(scores.where(bad), "no finite score"))


def per_group(rows: DataFrame, by: list[str], key: str, n: int, seed: str = "42") -> DataFrame:
    """``n`` rows of each group, the first by md5 of seed and key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(seeded(seed, F.col(key)), key))).where(F.col("_n") <= n).drop("_n")


def case_style(c: Column) -> Column:
    """How a text's ASCII letters are written: none, upper, lower, title (each word's first letter only), or mixed."""
    letters = F.regexp_replace(c, "[^A-Za-z]", "")
    return (
        F.when(letters == "", "none").when(letters == F.upper(letters), "upper").when(letters == F.lower(letters), "lower")
        .when(~c.rlike(r"(?:^|[^A-Za-z])[a-z]|[A-Za-z][A-Z]"), "title").otherwise("mixed")
    )


def file_digests(spark, path: str) -> DataFrame:
    """(path, size, sha256) of files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def ceiling_curve(found: DataFrame, truth: DataFrame, queries: DataFrame, cuts: list[int]) -> DataFrame:
    """(cut, found, ceiling_f05): what a perfect matcher would reach of the candidates (q, p, rank) of the first ``cut`` ranks."""
    total = queries.agg(F.count("*").alias("n"))  # one row
    hit = truth.join(found.select("q", "p", "rank"), ["q", "p"], "left")
    per = hit.groupBy("q").agg(F.count("*").alias("g"), *[F.count_if(F.col("rank") <= c).alias(f"c{c}") for c in cuts])
    f = lambda c: F.lit(1.25) * F.col(f"c{c}") / (F.lit(0.25) * F.col("g") + F.col(f"c{c}"))
    row = per.agg(F.count("*").alias("matched"), *[F.sum(f"c{c}").alias(f"c{c}") for c in cuts], *[F.sum(F.when(F.col(f"c{c}") > 0, f(c)).otherwise(0.0)).alias(f"f{c}") for c in cuts]).crossJoin(F.broadcast(total))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("cut"), F.coalesce(f"c{c}", F.lit(0)).alias("found"), F.round((F.coalesce(f"f{c}", F.lit(0.0)) + F.col("n") - F.col("matched")) / F.col("n"), 6).alias("ceiling_f05")) for c in cuts]))
    return row.select(each.alias("x")).select("x.*")
