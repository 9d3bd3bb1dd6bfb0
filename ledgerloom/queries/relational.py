"""Queries of relational operators: scans, joins, aggregates, windows, set operations, reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators import checks
from ledgerloom.operators import metrics as M
from ledgerloom.queries.base import query, table
from ledgerloom.sources.tables import encode_id, sample


@query("select l_orderkey, l_linenumber, l_extendedprice from lineitem where l_shipdate >= timestamp '1998-01-01' and l_discount >= 0.05 and l_quantity < 10")
def scan_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp_ntz '1998-01-01' and l_discount >= 0.05 and l_quantity < 10")
    return t.select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("select o_orderkey, o_totalprice from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'MACHINERY')")
def semi_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(ids, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("select p_partkey, p_name from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_returnflag = 'R' and l_quantity >= 45)")
def anti_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return checks.unknown(table(spark, sf_dir, "part"), known, "p_partkey").select("p_partkey", "p_name")


@query("select k, case when a is null then 'right' else 'left' end as side from (select distinct l_orderkey as k, true as a from lineitem where l_returnflag = 'R') full join (select distinct o_orderkey as k, true as b from orders where o_orderstatus = 'F') using (k) where a is null or b is null")
def full_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"))
    return checks.coverage(a, table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k")), "k")


@query(
    """with a as (select l_partkey as k, l_suppkey as s from lineitem where l_returnflag = 'R'), b as (select l_partkey as k, l_suppkey as s from lineitem where l_returnflag = 'A')
select *, 'left' as side from (from a except all from b) union all select *, 'right' as side from (from b except all from a)"""
)
def except_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    side = lambda f: t.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("s"))
    return checks.difference(side("R"), side("A"))


@query("select coalesce(o_orderpriority, 'ALL') as priority, coalesce(o_orderstatus, 'ALL') as status, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by rollup (o_orderpriority, o_orderstatus)")
def union_all_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return t.select(F.coalesce("o_orderpriority", F.lit("ALL")).alias("priority"), F.coalesce("o_orderstatus", F.lit("ALL")).alias("status"), "n", "total")


@query("select l_orderkey, unnest(string_split(ids, ','))::bigint as l_partkey from (select l_orderkey, string_agg(l_partkey::varchar, ',') as ids from lineitem group by 1)")
def explode_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(F.col("l_partkey").cast("string")), ",").alias("ids"))
    return lists.select("l_orderkey", F.explode(F.split("ids", ",")).alias("p")).select("l_orderkey", F.col("p").cast("long").alias("l_partkey"))


@query("select l_orderkey, string_agg(l_partkey::varchar, ',' order by l_extendedprice desc, l_linenumber, l_partkey) as ids from lineitem group by 1")
def rows_to_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct((-F.col("l_extendedprice")).alias("a"), F.col("l_linenumber").alias("b"), F.col("l_partkey").alias("p"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["p"].cast("string")), ",")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(ids.alias("ids"))


@query("select l_suppkey as k, count(distinct l_partkey) as parts, count(*) as n, min(l_quantity) as lo, max(l_quantity) as hi from lineitem group by 1 having count(distinct l_orderkey) > 3")
def group_having_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k"))
    t = t.agg(F.count_distinct("l_partkey").alias("parts"), F.count("*").alias("n"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.count_distinct("l_orderkey").alias("o"))
    return t.where("o > 3").drop("o")


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.repeated(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query(
    """select o_orderkey as q, l_suppkey as p, c_nationkey as q_country, s_nationkey as p_country from lineitem join orders on l_orderkey = o_orderkey
join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where c_nationkey <> s_nationkey"""
)
def country_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    q = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("q"), F.col("c_nationkey").alias("q_country"))
    p = t("supplier").select(F.col("s_suppkey").alias("p"), F.col("s_nationkey").alias("p_country"))
    links = t("lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_suppkey").alias("p"))
    return links.join(q, "q").join(p, "p").where("q_country <> p_country").select("q", "p", "q_country", "p_country")


@query(
    """with t as (select c_mktsegment, o_orderpriority, count(*) as n from orders join customer on o_custkey = c_custkey group by all)
select *, round((n / sum(n) over (partition by c_mktsegment))::double, 6) as row_share, round((n / sum(n) over (partition by o_orderpriority))::double, 6) as column_share from t"""
)
def crosstab_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    t = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"))
    share = lambda by: F.round(F.col("n") / F.sum("n").over(Window.partitionBy(by)), 6)
    return t.withColumn("row_share", share("c_mktsegment")).withColumn("column_share", share("o_orderpriority"))


@query("select l_shipmode, coalesce(a, 0)::bigint as a, coalesce(n, 0)::bigint as n, coalesce(r, 0)::bigint as r from (select l_linestatus as l_shipmode, sum((l_returnflag = 'A')::int) as a, sum((l_returnflag = 'N')::int) as n, sum((l_returnflag = 'R')::int) as r from lineitem group by 1)")
def pivot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("l_shipmode")).pivot("l_returnflag", ["A", "N", "R"]).count()
    return t.select("l_shipmode", *[F.coalesce(F.col(c), F.lit(0)).alias(c.lower()) for c in "ANR"])


@query("select p_partkey, 'size' as measure, p_size::double as value from part union all select p_partkey, 'price', p_retailprice from part")
def unpivot_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return t.unpivot("p_partkey", ["size", "price"], "measure", "value")


@query(
    """select c_mktsegment, count(*) as n, round(avg(c_acctbal), 4) as mean, round(stddev_samp(c_acctbal), 4) as std, min(c_acctbal) as min, round(quantile_cont(c_acctbal, 0.25), 4) as q1,
round(quantile_cont(c_acctbal, 0.5), 4) as median, round(quantile_cont(c_acctbal, 0.75), 4) as q3, max(c_acctbal) as max from customer group by 1"""
)
def describe_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = "c_acctbal"
    q = lambda p: F.round(F.percentile(c, F.lit(p)), 4)
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), F.round(F.avg(c), 4).alias("mean"), F.round(F.stddev_samp(c), 4).alias("std"), F.min(c).alias("min"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max(c).alias("max")
    )


@query(
    """select s_nationkey, count(*) as n, count(*) filter (l_returnflag = 'R') as returned, round(avg(case when l_returnflag = 'R' then l_extendedprice end), 4) as returned_price,
sum((l_quantity > 25)::int)::bigint as large from lineitem join supplier on l_suppkey = s_suppkey group by 1"""
)
def conditional_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    r = F.col("l_returnflag") == "R"
    return t.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.count_if(r).alias("returned"), F.round(F.avg(F.when(r, F.col("l_extendedprice"))), 4).alias("returned_price"), F.count_if(F.col("l_quantity") > 25).alias("large"))


@query("select round(quantile_cont(n, 0.95), 6) as p95, round(avg(n), 6) as mean from (select coalesce(n, 0) as n from customer left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey)")
def percentile_with_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    t = table(spark, sf_dir, "customer").join(n, "c_custkey", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return t.agg(F.round(F.percentile("n", F.lit(0.95)), 6).alias("p95"), F.round(F.avg("n"), 6).alias("mean"))


@query("select l_suppkey, l_orderkey, l_linenumber, row_number() over w as rank from lineitem window w as (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey) qualify row_number() over w <= 3")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey")
    return table(spark, sf_dir, "lineitem").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("select p_partkey, ceil(5 * (rn - 1) / (n - 1.0)) + (rn = 1)::int as quintile from (select p_partkey, row_number() over (order by p_retailprice, p_partkey) as rn, count(*) over () as n from part)")
def rank_quintiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").count()
    from ledgerloom.operators.ranks import global_row_number

    t = global_row_number(table(spark, sf_dir, "part"), ["p_retailprice", "p_partkey"], "rn")
    return t.select("p_partkey", (F.ceil(5 * (F.col("rn") - 1) / F.lit(n - 1.0)) + (F.col("rn") == 1).cast("int")).cast("double").alias("quintile"))


@query("select user_id, event_id, max(value) over (partition by user_id order by ts, event_id rows unbounded preceding) as best from events")
def cumulative_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.max("value").over(w).alias("best"))


@query(
    """select p_brand, p_partkey from (select *, max(p_size) over (partition by p_brand order by p_retailprice, p_size desc, p_partkey rows between unbounded preceding and 1 preceding) as before from part)
where before is null or p_size > before"""
)
def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy("p_retailprice", F.desc("p_size"), "p_partkey").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "part").withColumn("before", F.max("p_size").over(w)).where("before is null or p_size > before").select("p_brand", "p_partkey")


@query("select event_id from (select event_id, event_type, lead(event_type) over (partition by user_id order by ts, event_id) as next from events) where next is null or next <> event_type")
def run_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("next", F.lead("event_type").over(w)).where("next is null or next <> event_type").select("event_id")


@query(
    """select (select count(*) from (select l_partkey from lineitem where l_returnflag = 'R' intersect select l_partkey from lineitem where l_returnflag = 'N')) as shared,
(select count(*) from (select l_partkey from lineitem where l_returnflag = 'R' union select l_partkey from lineitem where l_returnflag = 'N')) as either"""
)
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    a, b = (t.where(F.col("l_returnflag") == f).select("l_partkey") for f in "RN")
    return a.intersect(b).agg(F.count("*").alias("shared")).crossJoin(a.union(b).distinct().agg(F.count("*").alias("either")))


@query("select cap, count(*) filter (n <= cap) as inside, round(avg(least(n, cap)), 6) as mean from (select o_custkey, count(*) as n from orders group by 1), (select unnest([1, 5, 10, 20])::int as cap) group by cap")
def cap_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    caps = spark.createDataFrame([(x,) for x in (1, 5, 10, 20)], "cap int")
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(caps)).groupBy("cap").agg(F.count_if(F.col("n") <= F.col("cap")).alias("inside"), F.round(F.avg(F.least("n", "cap")), 6).alias("mean"))


@query("select round(corr(l_quantity, l_extendedprice), 6) as r, round(stddev_pop(l_discount), 6) as spread, round(avg(l_discount) - stddev_pop(l_discount), 6) as robust from lineitem")
def correlation_and_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.stddev_pop("l_discount")
    return table(spark, sf_dir, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.round(s, 6).alias("spread"), F.round(F.avg("l_discount") - s, 6).alias("robust"))


@query("select least(floor((o_totalprice - lo) / nullif(hi - lo, 0) * 20), 19)::bigint as bin, count(*) as n from orders, (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders) group by 1")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders")
    ends = t.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    bin_ = F.least(F.floor(F.try_divide(F.col("o_totalprice") - F.col("lo"), F.col("hi") - F.col("lo")) * 20), F.lit(19)).cast("long")
    return t.crossJoin(F.broadcast(ends)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k, sha256(props) as digest, md5(event_type || ':' || event_id::varchar) as seed from events")
def json_and_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events")
    k = F.expr("try_cast(get_json_object(props, '$.k') as bigint)")
    return t.select("event_id", k.alias("k"), F.sha2(F.col("props").cast("binary"), 256).alias("digest"), F.md5(F.concat_ws(":", "event_type", "event_id").cast("binary")).alias("seed"))


@query(
    """select l_orderkey, l_linenumber, l_partkey, least(greatest(l_quantity, 5), 30) as clipped, case when l_discount >= 0.08 then 'high' when l_discount >= 0.04 then 'mid' else 'low' end as band,
round(ln(1 + l_quantity), 6) as log1p, round(1 / (1 + exp(-l_tax)), 6) as sigmoid, coalesce(round(1.25 * l_tax * l_discount / nullif(0.25 * l_tax + l_discount, 0), 6), 0) as f_beta from lineitem"""
)
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    band = F.when(c("l_discount") >= 0.08, "high").when(c("l_discount") >= 0.04, "mid").otherwise("low")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.least(F.greatest("l_quantity", F.lit(5.0)), F.lit(30.0)).alias("clipped"), band.alias("band"),
        F.round(F.log1p("l_quantity"), 6).alias("log1p"), F.round(1 / (1 + F.exp(-c("l_tax"))), 6).alias("sigmoid"), F.round(M.f_beta(c("l_tax"), c("l_discount")), 6).alias("f_beta"),
    )


@query("select c_custkey, (case when c_custkey % 2 = 0 then 2 else 3 end) * 10000000000 + c_custkey as code from customer")
def encode_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    name = F.concat(F.when(F.col("c_custkey") % 2 == 0, "S2-").otherwise("S3-"), F.col("c_custkey").cast("string"))
    return c.select("c_custkey", encode_id(name).alias("code"))


@query("select q, min(p) as p, count(*) as n from (select l_orderkey as q, l_partkey as p from lineitem) group by q")
def representative_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("q")).agg(F.min("l_partkey").alias("p"), F.count("*").alias("n"))


@query("select * from customer where ('0x' || substr(md5('42:' || c_custkey::varchar), 1, 8))::bigint / 4294967296.0 < 0.1 or c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def scan_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the customers by md5, and all with an order of the highest priority: a sampling operator."""
    keep = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return sample(table(spark, sf_dir, "customer"), 0.1, keep, id_col="c_custkey")


@query(
    """select window_start, event_type, count(*) as n, round(sum(value), 4) as total from (select floor(epoch(ts))::bigint // 300 * 300 as window_start, event_type, value from events) group by all"""
)
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    t = t.groupBy(F.window("ts", "5 minutes"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return t.select(F.unix_timestamp("window.start").alias("window_start"), "event_type", "n", "total")
