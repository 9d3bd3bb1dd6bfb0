"""Queries on scored pairs: metrics, thresholds, policies, assignments, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators import checks, decide, splits
from ledgerloom.operators import metrics as M
from ledgerloom.queries.base import PAIRS_SQL, entities, pairs, query, table

F05 = "case when {g} = 0 and {k} = 0 then 1.0 else 1.25 * {tp} / (0.25 * {g} + {k}) end"
TABLE_SQL = f"""
with {PAIRS_SQL},
per as (
  select q, count(*) as n_cand, sum(label)::bigint as c, sum((score >= 0.6)::int)::bigint as k, sum((score >= 0.6 and label = 1)::int)::bigint as tp
  from pairs group by q
),
raw as (
  select q, nation, segment, g, coalesce(n_cand, 0)::bigint as n_cand, coalesce(c, 0)::bigint as c, coalesce(k, 0)::bigint as k, coalesce(tp, 0)::bigint as tp
  from entities left join per using (q)
),
t as (
  select *, round(({F05.format(g="g", k="k", tp="tp")})::double, 9) as f05, round(({F05.format(g="g", k="c", tp="c")})::double, 9) as ceiling_f05,
    case when g = 0 and k > 0 then 'singleton_fp' when k > tp then 'matcher_fp' when c > tp then 'matcher_fn' when g > c then 'blocking_miss' else 'correct' end as error_type
  from raw
)
"""


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.entity_table(entities(spark, sf_dir), pairs(spark, sf_dir).withColumn("pred", F.col("score") >= 0.6))


@query(TABLE_SQL + "select q, nation, segment, g, n_cand, c, k, tp, f05, ceiling_f05, error_type from t")
def entity_f05_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir)


@query(
    TABLE_SQL
    + """select count(*) as n, round(avg(f05), 6) as macro_f05, round(avg(ceiling_f05), 6) as ceiling_f05,
  round(avg(f05) filter (g = 0), 6) as singleton_accuracy, round(avg(f05) filter (g > 0), 6) as matched_f05,
  count(*) filter (g = 0) as n_singletons, round(avg((g = 0)::int), 6) as singleton_rate,
  round(1000.0 * sum(k) filter (g = 0) / nullif(count(*) filter (g = 0), 0), 6) as fp_per_1000_singletons,
  round(1000.0 * count(*) filter (g = 0 and k > 0) / nullif(count(*) filter (g = 0), 0), 6) as affected_per_1000_singletons,
  sum(g)::bigint as gold_links, sum(k)::bigint as predicted_links, sum(tp)::bigint as true_links,
  round(sum(tp)::double / nullif(sum(k), 0), 6) as pair_precision, round(sum(tp)::double / nullif(sum(g), 0), 6) as pair_recall,
  round(avg(case when k > 0 then tp / k else 1.0 end), 6) as entity_precision, round(avg(case when g > 0 then tp / g else (k = 0)::int end), 6) as entity_recall,
  round(sum(c)::double / nullif(sum(g), 0), 6) as blocking_recall, round(avg(c / g) filter (g > 0), 6) as candidate_macro_recall,
  round(avg((c > 0)::int) filter (g > 0), 6) as any_match_coverage, round(avg((c = g)::int) filter (g > 0), 6) as all_match_coverage,
  round(avg(n_cand), 6) as candidates_mean, round(quantile_cont(n_cand, 0.95), 6) as candidates_p95, max(n_cand) as candidates_max,
  round(avg((n_cand = 0)::int), 6) as zero_candidate_rate, round(avg(k), 6) as predicted_mean,
  round(avg((c = g)::int::double), 6) as fully_covered, round(avg((f05 = 1)::int::double), 6) as perfect
from t"""
)
def headline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.summary(_table(spark, sf_dir))


@query(TABLE_SQL + "select error_type, count(*) as n, round(sum(1 - f05) / (select count(*) from t), 6) as loss from t group by 1")
def loss_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.loss_parts(_table(spark, sf_dir))


@query(TABLE_SQL + "select segment, least(g, 3)::bigint as mult, count(*) as n, round(avg(f05), 6) as macro_f05, round(avg(ceiling_f05), 6) as ceiling_f05 from t group by all")
def slice_f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir).groupBy("segment", F.least("g", F.lit(3)).cast("long").alias("mult"))
    return t.agg(F.count("*").alias("n"), F.round(F.avg("f05"), 6).alias("macro_f05"), F.round(F.avg("ceiling_f05"), 6).alias("ceiling_f05"))


STEPS_SQL = f"""
run as (
  select {{tau}} q, p, score, label, g,
    count(*) over w as k, sum(label) over w as tp
  from pairs join entities using (q) {{gate}}
  window w as (partition by {{tau}} q order by score desc, p rows unbounded preceding)
),
steps as (
  select {{tau}} score as t, sum(({F05.format(g="g", k="k", tp="tp")}) - ({F05.format(g="g", k="(k - 1)", tp="(tp - label)")})) as step from run group by all
),
base as (select count(*) as n, sum((g = 0)::int)::double as start from entities)
"""
CURVE_SQL = f"""
with {PAIRS_SQL}, {STEPS_SQL.format(tau="", gate="")},
curve as (
  select 'infinity'::double as t, round(start / n, 9) as macro_f05 from base
  union all
  select t, round(((start + sum(step) over (order by t desc rows unbounded preceding)) / n)::double, 9) from steps, base
)
"""


@query(CURVE_SQL + "select t, macro_f05 from curve")
def threshold_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.threshold_curve(pairs(spark, sf_dir), entities(spark, sf_dir))


@query(CURVE_SQL + "select t, macro_f05 from curve order by macro_f05 desc, t desc limit 1")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.best_threshold(threshold_curve(spark, sf_dir))


@query(
    f"""with {PAIRS_SQL}, gates as (select unnest([0.0, 0.25, 0.5, 0.75, 0.9])::double as tau),
top as (select q, max(score) as any_match from pairs group by q),
{STEPS_SQL.format(tau="tau,", gate="join top using (q) join gates on any_match >= tau")},
curve as (
  select tau, 'infinity'::double as t, round(start / n, 9) as macro_f05 from gates, base
  union all
  select tau, t, round(((start + sum(step) over (partition by tau order by t desc rows unbounded preceding)) / n)::double, 9) from steps, base
)
select tau, t, macro_f05 from curve qualify row_number() over (partition by tau order by macro_f05 desc, t desc) = 1"""
)
def policy_gate_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    e = entities(spark, sf_dir).join(p.groupBy("q").agg(F.max("score").alias("any_match")), "q", "left").withColumn("any_match", F.coalesce("any_match", F.lit(-1.0)))
    return decide.gate_curve(p, e, [0.0, 0.25, 0.5, 0.75, 0.9])


@query(
    f"""with {PAIRS_SQL},
two as (
  select *, coalesce(nth_value(score, 2) over w, 0.0) as second, max(score) over w as best
  from pairs window w as (partition by q order by score desc, p rows between unbounded preceding and unbounded following)
)
select q, p, second, round(coalesce(second / nullif(best, 0), 0.0), 9) as ambiguity, round(score - 0.3 * coalesce(second / nullif(best, 0), 0.0) - 0.05 * (p % 3), 9) as score from two"""
)
def policy_penalised_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decide.penalised(pairs(spark, sf_dir).withColumn("conflict_count", F.col("p") % 3), 0.3, 0.05)
    return out.select("q", "p", "second", F.round("ambiguity", 9).alias("ambiguity"), F.round("score", 9).alias("score"))


CLAIMS_SQL = "claims as (select l_suppkey as q, l_partkey as p, round(max(l_discount), 6) as score from lineitem group by all)"


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("q"), F.col("l_partkey").alias("p")).agg(F.round(F.max("l_discount"), 6).alias("score"))


@query(f"with {CLAIMS_SQL} select q, p, score from claims qualify row_number() over (partition by p order by score desc, q) = 1")
def unique_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.unique_assignment(_claims(spark, sf_dir))


@query(f"with {CLAIMS_SQL} select claims, count(*) as n from (select p, count(*) as claims from claims group by p) group by claims")
def collision_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.collisions(_claims(spark, sf_dir))


@query(
    f"""with {PAIRS_SQL}
select c_custkey as q, coalesce(ids, '') as ids from customer
left join (select q, string_agg(p::varchar, ',' order by score desc, p) as ids from pairs where score >= 0.5 group by q) on q = c_custkey"""
)
def submission_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("q"))
    return decide.match_lists(q, pairs(spark, sf_dir).where("score >= 0.5"))


@query(
    """with lists as (select l_orderkey as q, string_agg(l_partkey::varchar, ',') as ids from lineitem group by 1),
each as (select q, unnest(string_split(ids, ',')) as p from lists)
select 'query missing' as issue, o_orderkey::varchar as id from orders where o_orderkey not in (select q from lists)
union all select 'query unknown', q::varchar from lists where q not in (select o_orderkey from orders)
union all select 'match twice', p from (select q, p from each group by q, p having count(*) > 1)
union all select 'match unknown', p from each where p not in (select p_partkey::varchar from part) and p <> q::varchar
union all select 'matches itself', p from each where p = q::varchar
union all select 'match no candidate', p from each where (q, p) not in (select l_orderkey, l_partkey::varchar from lineitem where l_quantity >= 2)"""
)
def submission_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("p"), "l_quantity")
    lists = items.groupBy("q").agg(F.array_join(F.collect_list(F.col("p").cast("string")), ",").alias("ids"))
    queries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q"))
    pool = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"))
    return checks.submission_issues(lists, queries, pool, items.where("l_quantity >= 2"))


@query(
    """with s as (select label as y0, (vec_id * 37 % 1000) / 1000.0 as score, (label % 2)::int as y from embeddings),
per as (select score, count(*) as n, sum(y) as pos from s group by score),
r as (select *, sum(n) over (order by score) - n + (n + 1) / 2.0 as rank from per)
select round(((sum(rank * pos) - sum(pos) * (sum(pos) + 1) / 2.0) / nullif(sum(pos) * sum(n - pos), 0))::double, 6) as auc from r"""
)
def auc_mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") * 37 % 1000 / 1000.0).alias("score"), (F.col("label") % 2).cast("int").alias("y"))
    return M.mann_whitney_auc(e, "score", "y")


@query(f"with {PAIRS_SQL} select least(floor(score * 20), 19)::bigint as bin, count(*) as n, round(avg(score), 6) as predicted, round(avg(label), 6) as observed from pairs group by 1")
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.least(F.floor(F.col("score") * 20), F.lit(19)).cast("long").alias("bin")
    return pairs(spark, sf_dir).groupBy(b).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("predicted"), F.round(F.avg("label"), 6).alias("observed"))


@query(
    f"""with {PAIRS_SQL}, s as (select greatest(least(score, 1 - 1e-6), 1e-6) as p, label from pairs)
select round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 6) as nll, round(avg((p - label) * (p - label)), 6) as brier from s"""
)
def calibration_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, y = F.greatest(F.least("score", F.lit(1 - 1e-6)), F.lit(1e-6)), F.col("label")
    return pairs(spark, sf_dir).agg(F.round(F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))), 6).alias("nll"), F.round(F.avg((p - y) * (p - y)), 6).alias("brier"))


@query(
    f"""with {PAIRS_SQL}, d as (select score, count(*) as n, sum(label) as pos from pairs group by score),
r as (select score, sum(n) over w as k, sum(pos) over w as tp, sum(pos) over () as g from d window w as (order by score desc rows unbounded preceding))
select score, k::bigint as k, tp::bigint as tp, round((tp / k)::double, 6) as precision, round((tp / g)::double, 6) as recall from r"""
)
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.precision_recall(pairs(spark, sf_dir))


SPLIT_SQL = """select c_custkey, c_mktsegment,
  case when place < 0.7 then 'fit' when place < 0.8 then 'early_stop' when place < 0.9 then 'tune' else 'holdout' end as split from (
  select *, (row_number() over w - 0.5) / count(*) over (partition by c_nationkey, c_mktsegment) as place from customer
  window w as (partition by c_nationkey, c_mktsegment order by md5('42:' || c_custkey::varchar), c_custkey))"""


@query(SPLIT_SQL)
def split_stratified_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return splits.stratified(c, "c_custkey", ["c_nationkey", "c_mktsegment"], {"fit": 0.7, "early_stop": 0.1, "tune": 0.1, "holdout": 0.1}).select("c_custkey", "c_mktsegment", "split")


@query("select o_orderkey, ((row_number() over (partition by o_orderpriority order by md5('42:' || o_orderkey::varchar), o_orderkey) - 1) % 5)::bigint as fold from orders")
def folds_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.folds(table(spark, sf_dir, "orders"), "o_orderkey", ["o_orderpriority"]).select("o_orderkey", F.col("fold").cast("long").alias("fold"))


@query(
    f"""with {PAIRS_SQL}, ranked as (select *, row_number() over (partition by q order by score desc, p) as rank from pairs),
n as (select *, row_number() over (partition by q, label order by rank, p) as nth from ranked),
f as (select *, label = 0 and nth > 3 as far from n),
d as (select *, row_number() over (partition by q, far order by md5('42:' || q::varchar || ':' || p::varchar), p) as draw from f),
k as (select q, p, case when label = 1 then 'positive' when not far then 'hard' when draw <= 2 then 'easy' end as kind from d)
select q, p, kind, round(1.0 / count(*) over (partition by q), 9) as weight from k where kind is not null"""
)
def negative_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "p")))
    return splits.negatives(p, hard=3).select("q", "p", "kind", F.round("weight", 9).alias("weight"))


@query(
    f"""with {PAIRS_SQL}, combos as (select * from (values (0.0, 0.0), (0.0, 0.05), (0.2, 0.0), (0.2, 0.05)) v(alpha, beta)),
two as (select *, coalesce(nth_value(score, 2) over w, 0.0) as second, max(score) over w as best from pairs window w as (partition by q order by score desc, p rows between unbounded preceding and unbounded following)),
scored as (select alpha::double as alpha, beta::double as beta, q, p, label, round(score - alpha * coalesce(second / nullif(best, 0), 0.0) - beta * (p % 3), 9) as score from two, combos),
run as (select alpha, beta, q, p, score, label, g, count(*) over w as k, sum(label) over w as tp from scored join entities using (q) window w as (partition by alpha, beta, q order by score desc, p rows unbounded preceding)),
steps as (select alpha, beta, score as t, sum(({F05.format(g="g", k="k", tp="tp")}) - ({F05.format(g="g", k="(k - 1)", tp="(tp - label)")})) as step from run group by all),
base as (select count(*) as n, sum((g = 0)::int)::double as start from entities),
curve as (select alpha::double as alpha, beta::double as beta, 'infinity'::double as t, round(start / n, 9) as macro_f05 from combos, base
  union all select alpha, beta, t, round(((start + sum(step) over (partition by alpha, beta order by t desc rows unbounded preceding)) / n)::double, 9) from steps, base)
select alpha, beta, t, macro_f05 from curve qualify row_number() over (partition by alpha, beta order by macro_f05 desc, t desc) = 1"""
)
def policy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.plans import tuning

    p = pairs(spark, sf_dir).withColumn("conflict_count", F.col("p") % 3)
    return tuning.policy_search(p, entities(spark, sf_dir), [0.0, 0.2], [0.0, 0.05])


@query(
    TABLE_SQL
    + """, draws as (
  select r, f05, (('0x' || substr(md5('7:' || r::varchar || ':' || q::varchar), 1, 8))::bigint + 0.5) / 4294967296.0 as u from t, unnest(range(1, 201)) as x(r)
),
steps as (select k, sum(1 / factorial(k::int)) over (order by k) * exp(-1.0) as total from unnest(range(0, 8)) as x(k)),
counts as (select r, f05, (select count(*) from steps where u > total) as n from draws),
means as (select r, sum(n * f05) / sum(n) as mean from counts group by r)
select round(avg(mean), 6) as mean, round(stddev_pop(mean), 6) as se, round(quantile_cont(mean, 0.025), 6) as low, round(quantile_cont(mean, 0.975), 6) as high from means"""
)
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.bootstrap_ci(_table(spark, sf_dir)).select(*[F.round(c, 6).alias(c) for c in ("mean", "se", "low", "high")])
