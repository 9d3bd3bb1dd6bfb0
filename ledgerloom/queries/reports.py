"""Queries of the smaller operators: audits, samples, reports, and a whole run by rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators import decide, learn, reports, retrieval, splits
from ledgerloom.operators import metrics as M
from ledgerloom.plans import linkage
from ledgerloom.queries.base import PAIRS_SQL, RECORDS_SQL, entities, pairs, query, records, table, truth
from ledgerloom.queries.linking import FOUND_SQL, PASSES, WIDE_SQL, _found, _split, _wide
from ledgerloom.sources import tables


@query("select c_mktsegment, n_name, count(*) as n, round(sum(o_totalprice), 2) as total from customer join nation on c_nationkey = n_nationkey join orders on o_custkey = c_custkey where o_totalprice >= 100000 group by all")
def views_and_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL with parameters over views of two catalogs of files."""
    tables.register_views(spark, sf_dir, ["customer", "nation"], "people")
    tables.register_views(spark, sf_dir, ["orders"], "sales")
    sql = """select c_mktsegment, n_name, count(*) as n, round(sum(o_totalprice), 2) as total from people_customer join people_nation on c_nationkey = n_nationkey
      join sales_orders on o_custkey = c_custkey where o_totalprice >= :least group by all"""
    return spark.sql(sql, args={"least": 100000})


@query("with p as (select *, row_number() over (order by o_totalprice, o_orderkey) - 1 as row_id from orders), w as (select i as slot, i * 37 % 1000 as row_id from range(0, 1500) t(i)) select slot, row_id, o_orderkey from w join p using (row_id)")
def positional_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.range(1500).select(F.col("id").alias("slot"), (F.col("id") * 37 % 1000).alias("row_id"))
    return reports.fetch(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], wanted).select("slot", "row_id", "o_orderkey")


@query(
    """select p_partkey, round((p_retailprice - min(p_retailprice) over w) / nullif(max(p_retailprice) over w - min(p_retailprice) over w, 0), 6) as scaled,
  round(percent_rank() over (partition by p_brand order by p_retailprice), 6) as percentile from part window w as (partition by p_brand)"""
)
def scaled_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = reports.scaled(table(spark, sf_dir, "part"), "p_retailprice", ["p_brand"])
    return t.select("p_partkey", F.round("scaled", 6).alias("scaled"), F.round("percentile", 6).alias("percentile"))


PROBE = "coalesce(({0}) and {1} <> '', false)"


@query(
    f"""with {WIDE_SQL}, x as (select (t.q is not null)::int as label, a.name as l, b.name as r from wide w join records a on a.id = w.q join records b on b.id = w.p left join truth t on t.q = w.q and t.p = w.p),
y as (select label, {PROBE.format("l[1] = r[1]", "l[1]")} as a, {PROBE.format("list_min(l) = list_min(r)", "list_min(l)")} as b,
  {PROBE.format("left(array_to_string(l, ' '), 4) = left(array_to_string(r, ' '), 4)", "array_to_string(l, ' ')")} as c, list_has_any(l, r) as d from x)
select label, count(*) as n, round(avg(a::int), 6) as first_token, round(avg(b::int), 6) as least_token, round(avg(c::int), 6) as prefix_4, round(avg(d::int), 6) as any_token, round(avg((a or c)::int), 6) as first_or_prefix from y group by label"""
)
def blocking_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    x = linkage.labelled(_wide(spark, sf_dir).select("q", "p"), truth(rows))
    x = x.join(rows.select(F.col("id").alias("q"), F.col("name").alias("l")), "q").join(rows.select(F.col("id").alias("p"), F.col("name").alias("r")), "p")
    found = reports.probes(F.col("l"), F.col("r"))
    return x.groupBy("label").agg(F.count("*").alias("n"), *[F.round(F.avg(c.cast("int")), 6).alias(n) for n, c in found.items()])


@query(
    """with owners as (select l_partkey as p, case when l_orderkey % 5 = 0 then 'tune' else 'fit' end as split from lineitem where l_quantity > 45),
o as (select p, max((split = 'tune')::int) as own from owners group by p)
select p_partkey as p, p_size from part left join o on p = p_partkey where own is null or own = 1"""
)
def without_owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p"), F.when(F.col("l_orderkey") % 5 == 0, "tune").otherwise("fit").alias("split"))
    return reports.without_owned(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), "p_size"), owners, "p", "tune")


@query(
    f"""with {RECORDS_SQL}, qs as (select id, country, name[1] as first from records where src = 1), pool as (select id, country, name[1] as first from records where src <> 1),
hard as (select qs.id as q, pool.id as p from qs join pool on qs.country = pool.country and qs.first = pool.first and qs.first <> '' where not exists (select 1 from truth t where t.q = qs.id and t.p = pool.id)
  qualify row_number() over (partition by qs.id order by md5('42:' || qs.id::varchar || ':' || pool.id::varchar), pool.id) = 1),
mixed as (select country, id as q, null as p, md5('42:q' || id::varchar) as u from qs union all select country, null, id, md5('42:p' || id::varchar) from pool),
near as (select q, first_value(p ignore nulls) over (partition by country order by u rows between current row and unbounded following) as p from mixed)
select q, p, 'hard' as kind from hard union all select q, p, 'random' from near where q is not null and p is not null and not exists (select 1 from truth t where t.q = near.q and t.p = near.p)"""
)
def first_word_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    side = rows.select("id", "src", "country", F.get("name", F.lit(0)).alias("first"))
    return reports.first_word_negatives(side.where("src = 1"), side.where("src <> 1"), truth(rows))


@query("select o_custkey, arg_min(v, o_orderkey) filter (v is not null) as first_urgent from (select *, case when o_orderpriority like '1%' then o_totalprice end as v from orders) group by 1")
def first_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("first_urgent", F.when(F.col("o_orderpriority").startswith("1"), F.col("o_totalprice")))
    return reports.first_known(o, ["o_custkey"], "first_urgent", ["o_orderkey"])


@query("with f as (select c_nationkey % 5 as fold, c_mktsegment as run, round(avg(c_acctbal), 6) as f05 from customer group by all) select fold, run, f05, rank() over (partition by fold order by f05 desc) as place from f")
def fold_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "customer").groupBy((F.col("c_nationkey") % 5).alias("fold"), F.col("c_mktsegment").alias("run")).agg(F.round(F.avg("c_acctbal"), 6).alias("f05"))
    return f.withColumn("place", F.rank().over(Window.partitionBy("fold").orderBy(F.desc("f05"))))


@query(
    """with c as (select o_totalprice as t, round(sin(o_orderkey), 6) as v, o_orderkey from orders), u as (select t, max(v) as v from c group by t),
n as (select *, row_number() over (order by t desc) - 1 as k, count(*) over () as n from u), b as (select t as best from n order by v desc, t desc limit 1),
points as (select distinct floor(i * (n - 1) / 399.0)::bigint as k from (select max(n) as n from n), range(0, 400) x(i))
select t, v from n, b where n <= 400 or k in (select k from points) or t = best"""
)
def thinned_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = table(spark, sf_dir, "orders").groupBy(F.col("o_totalprice").alias("t")).agg(F.max(F.round(F.sin("o_orderkey"), 6)).alias("v"))
    return M.thinned(curve, "t", "v")


@query(
    """with a as (select o_orderkey, row_number() over (order by o_orderkey) as place, o_custkey % 10 as v from orders), b as (select o_orderkey, row_number() over (order by o_orderkey desc) as place, o_custkey % 10 as v from orders where o_orderkey % 9 > 0)
select coalesce(a.place, b.place) as place, a.v as left_v, b.v as right_v from a full join b on a.place = b.place where a.v is distinct from b.v"""
)
def placed_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.operators.ranks import global_row_number

    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 10).alias("v"))
    a = global_row_number(o, ["o_orderkey"], "place")
    b = global_row_number(o.where("o_orderkey % 9 > 0").withColumn("_d", -F.col("o_orderkey")), ["_d"], "place")
    return reports.placed_differences(a, b, "place", ["v"]).select("place", F.col("left.v").alias("left_v"), F.col("right.v").alias("right_v"))


SHARES = ", ".join(f"{0.02 + 0.88 * k / 44!r}" for k in range(45))


@query(f"with q as (select c_custkey % 97 / 97.0 as any_match from customer) select 0.0::double as tau union all select round(unnest(quantile_cont(any_match, [{SHARES}])), 6) from q")
def quantile_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 97 / 97.0).alias("any_match"))
    return spark.createDataFrame([(round(x, 6),) for x in decide.quantile_gates(q)], "tau double")


LIMITS = (("all", 8), ("name", 4))


@query(f"with {FOUND_SQL} select pass, q, p, score, rank from found where (pass = 'all' and rank <= 8 or pass = 'name' and rank <= 4) and score >= 0.08")
def narrow_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A narrower retrieval at once: what a wide one gives when it is truncated."""
    _, q, p, pool = _split(spark, sf_dir)
    return retrieval.retrieve(q, p, pool, linkage.passes_for(linkage.Settings(passes=PASSES, limits=LIMITS, least=0.08)))


@query(
    f"""with {WIDE_SQL}, c as (select q, count(*) as n from wide group by q), t as (select q, count(*) as g, count(w.q) as f from (select q, p from truth) tt left join (select q, p from wide) w using (q, p) group by q)
select id as q, coalesce(c.n, 0) as n_candidates, coalesce(g, 0) as n_true, coalesce(f, 0) as n_found from records left join c on c.q = id left join t on t.q = id where src = 1"""
)
def candidate_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    return linkage.candidate_scope(rows.where("src = 1").select(F.col("id").alias("q")), _wide(spark, sf_dir), truth(rows))


@query(
    f"""with {WIDE_SQL} select a.country, b.src, count(*) as links, count(w.q) as found, round(count(w.q) / count(*), 6) as recall
from truth t left join wide w on w.q = t.q and w.p = t.p join records a on a.id = t.q join records b on b.id = t.p group by all"""
)
def recall_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    hit = retrieval.hits(_wide(spark, sf_dir), truth(rows)).join(rows.select(F.col("id").alias("q"), "country"), "q").join(rows.select(F.col("id").alias("p"), "src"), "p")
    return hit.groupBy("country", "src").agg(F.count("*").alias("links"), F.sum("hit").alias("found"), F.round(F.avg("hit"), 6).alias("recall"))


@query(
    f"""with {FOUND_SQL}, cuts as (select unnest([1, 2, 5, 10, 20])::int as cut), total as (select count(*) as n_all from records where src = 1),
per as (select cut, t.q, count(*) as g, count(*) filter (rank <= cut) as c from truth t cross join cuts left join found f on f.pass = 'all' and f.q = t.q and f.p = t.p group by all)
select cut, sum(c)::bigint as found, round((sum(case when c > 0 then 1.25 * c / (0.25 * g + c) else 0 end) + max(n_all) - count(*)) / max(n_all), 6) as ceiling_f05 from per, total group by cut"""
)
def ceiling_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    return reports.ceiling_curve(_found(spark, sf_dir).where("pass = 'all'"), truth(rows), rows.where("src = 1"), [1, 2, 5, 10, 20])


@query(
    f"""with {PAIRS_SQL}, r as (select *, row_number() over (partition by q order by score desc, p) as score_rank, count(*) over (partition by q) as n from pairs)
select q, p, label, 1.0::double as weight from r where label = 1 or score_rank <= 8 or ('0x' || substr(md5('0:' || q::varchar || ':' || p::varchar), 1, 8))::bigint / 4294967296.0 < 4.0 / greatest(n - 8, 1)"""
)
def training_rows_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("q")
    p = pairs(spark, sf_dir).withColumn("score_rank", F.row_number().over(w.orderBy(F.desc("score"), "p"))).withColumn("n_cand_ctx", F.count("*").over(w))
    return splits.training_rows(p, "E1").select("q", "p", "label", "weight")


@query(f"with {PAIRS_SQL} select q, p, label, case when g = 0 and label = 0 then 3.0 else 1.0 end::double as weight from pairs left join entities using (q)")
def training_rows_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.training_rows(pairs(spark, sf_dir), "E2", entities(spark, sf_dir)).select("q", "p", "label", "weight")


@query(
    f"""with {PAIRS_SQL}, k as (select q, count(*) as k, sum(label) as tp from pairs where score >= 0.7 group by q), g as (select q, sum(label) as g from pairs group by q),
e as (select c_custkey as q, coalesce(g, 0)::bigint as g, coalesce(k, 0)::bigint as k, coalesce(tp, 0)::bigint as tp from customer left join g on g.q = c_custkey left join k on k.q = c_custkey)
select count(*) as n, round(avg(case when g = 0 and k = 0 then 1.0 else 1.25 * tp / (0.25 * g + k) end), 6) as macro_f05, sum(tp)::bigint as true_links, sum(g)::bigint as gold_links, sum(k)::bigint as predicted_links,
  round(sum(tp) / sum(k), 6) as pair_precision, round(sum(tp) / sum(g), 6) as pair_recall, round(avg((k = 0)::int) filter (g = 0), 6) as singleton_accuracy from e"""
)
def match_set_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    return M.match_sets(p.where("score >= 0.7"), p.where("label = 1"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("q")))


@query(f"with {PAIRS_SQL} select case when score >= 0.6 and label = 1 then 'TP' when score >= 0.6 then 'FP' when label = 1 then 'FN' else 'TN' end as outcome, count(*) as n from pairs group by 1")
def pair_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).groupBy(M.outcome(F.col("label"), F.col("score") >= 0.6).alias("outcome")).agg(F.count("*").alias("n"))


RUNS_SQL = "runs as (select 'r' || s_suppkey::varchar as name, case when s_suppkey > 7 then 'r' || (s_suppkey - 7)::varchar end as parent, s_acctbal as macro_f05, s_nationkey::double as wall_s from supplier where s_suppkey <= 100)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("r"), c.cast("string"))
    s = table(spark, sf_dir, "supplier").where("s_suppkey <= 100")  # the runs of a study, of which there are few
    return s.select(name(F.col("s_suppkey")).alias("name"), F.when(F.col("s_suppkey") > 7, name(F.col("s_suppkey") - 7)).alias("parent"), F.col("s_acctbal").alias("macro_f05"), F.col("s_nationkey").cast("double").alias("wall_s"))


@query(
    f"""with recursive {RUNS_SQL}, chain as (
  select name as run, 1 as step, parent as ancestor, macro_f05 from runs where parent is not null
  union all select run, step + 1, runs.parent, chain.macro_f05 from chain join runs on runs.name = ancestor where runs.parent is not null and step < 20)
select run, step, ancestor, round(chain.macro_f05 - runs.macro_f05, 6) as gain from chain join runs on runs.name = ancestor"""
)
def ablation_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.ablation(_runs(spark, sf_dir))


@query(f"with {RUNS_SQL} select name, macro_f05, wall_s from runs where name <> 'r3' order by macro_f05 desc, wall_s, name limit 1")
def chosen_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.chosen(_runs(spark, sf_dir), ("r3",)).select("name", "macro_f05", "wall_s")


TRIALS_SQL = "t as (select s_nationkey as trial, s_suppkey % 5 as fold, avg(s_acctbal) as value from supplier group by all)"


@query(f"with {TRIALS_SQL}, p as (select trial, round(avg(value), 9) as mean, round(stddev_pop(value), 9) as std from t group by trial order by mean desc, trial limit 5) select *, round(mean - std, 9) as robust_score from p")
def robust_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("trial"), (F.col("s_suppkey") % 5).alias("fold")).agg(F.avg("s_acctbal").alias("value"))
    return reports.robust(t)


@query(f"with {TRIALS_SQL}, r as (select a.trial, a.fold, max(a.value) as value, median(b.value) as median from t a join t b on a.fold = b.fold and b.trial < a.trial group by all) select trial, min(fold) as step from r where value < median and fold >= 1 group by trial")
def pruned_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("trial"), (F.col("s_suppkey") % 5).alias("step")).agg(F.avg("s_acctbal").alias("value"))
    return reports.pruned(t)


@query(
    f"""with {PAIRS_SQL}, x as (select label, o_totalprice, length(o_orderpriority) as size from pairs join orders on o_orderkey = p where score >= 0.5),
m as (select avg(o_totalprice) filter (label = 0) - avg(o_totalprice) filter (label = 1) as o_totalprice, avg(size) filter (label = 0) - avg(size) filter (label = 1) as size from x)
select 'o_totalprice' as feature, round(o_totalprice, 6) as gap from m union all select 'size', round(size, 6) from m"""
)
def false_link_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("p"), "o_totalprice", F.length("o_orderpriority").cast("double").alias("size"))
    return reports.reasons(pairs(spark, sf_dir).join(o, "p").withColumn("pred", F.col("score") >= 0.5), ["o_totalprice", "size"])


@query(
    """with s as (select l_suppkey as q, l_partkey as p, case when l_linenumber = 7 then null when l_quantity = 50 then 'nan'::double else l_discount::double end as score from lineitem)
select 'query unknown' as issue, q, p from s where q not in (select s_suppkey from supplier where s_nationkey < 20)
union all select 'scored twice', q, p from s group by q, p having count(*) > 1 union all select 'no finite score', q, p from s where score is null or isnan(score)"""
)
def score_row_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("l_linenumber") == 7, None).when(F.col("l_quantity") == 50, float("nan")).otherwise(F.col("l_discount").cast("double"))
    s = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("q"), F.col("l_partkey").alias("p"), score.alias("score"))
    return reports.score_issues(s, table(spark, sf_dir, "supplier").where("s_nationkey < 20").select(F.col("s_suppkey").alias("q")))


@query("select o_orderpriority, o_orderkey from orders qualify row_number() over (partition by o_orderpriority order by md5('42:' || o_orderkey::varchar), o_orderkey) <= 25")
def sample_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.per_group(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], "o_orderkey", 25)


STYLES = ["p_name", "p_brand", "p_type"]


@query(
    "with x as ("
    + " union all ".join(f"select '{c}' as field, {c} as v, regexp_replace({c}, '[^A-Za-z]', '', 'g') as a from part" for c in STYLES)
    + r""") select field, case when a = '' then 'none' when a = upper(a) then 'upper' when a = lower(a) then 'lower'
  when not regexp_matches(v, '(?:^|[^A-Za-z])[a-z]|[A-Za-z][A-Z]') then 'title' else 'mixed' end as style, count(*) as n from x group by all"""
)
def case_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(*STYLES).unpivot([], STYLES, "field", "v")
    return p.groupBy("field", reports.case_style(F.col("v")).alias("style")).agg(F.count("*").alias("n"))


ROLE = "('0x' || substr(md5('0:' || id::varchar), 1, 8))::bigint / 4294967296.0"


@query(
    f"""with {WIDE_SQL}, e as (select id as q, {ROLE} as u, (select count(*) from truth t where t.q = id) as g from records where src = 1),
tune as (select * from e where u >= 0.7), x as (select q, p, score, exists (select 1 from truth t where t.q = wide.q and t.p = wide.p)::int as label from wide),
run as (select q, p, score, label, g, count(*) over w as k, sum(label) over w as tp from x join tune using (q) window w as (partition by q order by score desc, p rows unbounded preceding)),
steps as (select score as t, sum((1.25 * tp / (0.25 * g + k)) - case when g = 0 and k = 1 then 1.0 else 1.25 * (tp - label) / (0.25 * g + k - 1) end) as step from run group by score),
base as (select count(*) as n, sum((g = 0)::int)::double as start from tune),
curve as (select 'infinity'::double as t, round(start / n, 9) as v from base union all select t, round(((start + sum(step) over (order by t desc rows unbounded preceding)) / n)::double, 9) from steps, base),
best as (select t from curve order by v desc, t desc limit 1),
links as (select q, p, score from x, best where score >= t qualify row_number() over (partition by p order by score desc, q) = 1),
lists as (select q, string_agg(p::varchar, ',' order by score desc, p) as ids from links group by q)
select e.q, coalesce(ids, '') as ids from e left join lists using (q)"""
)
def linkage_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run by rules over documents as records: retrieval, a threshold tuned on 30 % of the queries, one-to-one links, match lists of all."""
    rows = records(spark, sf_dir)
    links = truth(rows)
    found = tables.stored(spark, f"labelled candidates of {sf_dir}", lambda: linkage.labelled(_wide(spark, sf_dir), links))
    known = rows.where("src = 1").select(F.col("id").alias("q")).join(links.groupBy("q").agg(F.count("*").alias("g")), "q", "left").fillna(0, ["g"])
    bundle = linkage.fit_bundle(linkage.Settings(kind="rule", unique=True), found, known)
    out = linkage.apply_bundle(bundle, found.drop("label"), known).where("pred").select("q", "p", F.col("prob").alias("score"))
    return decide.match_lists(known, out)


@query(
    f"""with {PAIRS_SQL}, d as (select score, count(*) as n, sum(label) as pos from pairs group by score), r as (select *, row_number() over (order by score) as i, sum(n) over w as cn, sum(pos) over w as cp from d window w as (order by score rows unbounded preceding)),
m as (select a.i as a, b.i as b, (b.cp - a.cp + a.pos) / (b.cn - a.cn + a.n) as mean from r a join r b on b.i >= a.i),
f as (select a, b, min(mean) over (partition by a order by b desc rows unbounded preceding) as low from m), v as (select b as i, max(low) as calibrated from f group by b)
select q, p, score as prob, label::double as label, round(calibrated::double, 6) as calibrated from pairs join r using (score) join v using (i)"""
)
def calibrated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isotonic probabilities of the pairs' scores."""
    rows = pairs(spark, sf_dir).withColumn("label", F.col("label").cast("double")).withColumnRenamed("score", "prob")
    out = learn.Calibrator("isotonic").fit(rows).apply(rows)
    return out.withColumn("calibrated", F.round("calibrated", 6)).select("q", "p", "prob", "label", "calibrated")
