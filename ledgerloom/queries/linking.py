"""Queries of retrieval over documents as records, and of pair features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import similarity as S
from ledgerloom.functions.text import replace
from ledgerloom.operators import features, retrieval
from ledgerloom.operators import metrics as M
from ledgerloom.plans import tuning
from ledgerloom.queries.base import KEYS_SQL, PAIRS_SQL, RECORDS_SQL, keys, pairs, query, records, table, truth
from ledgerloom.sources.tables import written

CAP = 2000
PASSES = tuple(retrieval.Pass(n, w, k, CAP, 0.05) for n, w, k in (("all", {"name": 1.0, "addr": 0.5}, 20), ("name", {"name": 1.0}, 10), ("addr", {"addr": 1.0}, 10)))

STATS_SQL = f"""
{RECORDS_SQL}, {KEYS_SQL},
df as (select country, key, count(distinct id) as df from keys where src <> 1 group by all),
n as (select country, count(*) as n from records where src <> 1 group by all)
"""
WEIGHTED_SQL = f"""
{STATS_SQL},
raw as (
  select id, src, country, key, coalesce(df, 0) as df, ln((1 + n) / (1 + coalesce(df, 0))) + 1 as idf, (family = 'name')::int as is_name
  from keys left join df using (country, key) join n using (country)
),
w as (
  select id, src, country, key, df,
    idf * (case when is_name = 1 then 1.0 else 0.5 end) / sqrt(sum(pow(idf * (case when is_name = 1 then 1.0 else 0.5 end), 2)) over (partition by id)) as w_all,
    idf * is_name / nullif(sqrt(sum(pow(idf * is_name, 2)) over (partition by id)), 0) as w_name,
    idf * (1 - is_name) / nullif(sqrt(sum(pow(idf * (1 - is_name), 2)) over (partition by id)), 0) as w_addr
  from raw
)
"""
FOUND_SQL = f"""
{WEIGHTED_SQL},
pq as (
  select a.id as q, b.id as p, round(sum(a.w_all * b.w_all), 9) as s_all, round(sum(a.w_name * b.w_name), 9) as s_name, round(sum(a.w_addr * b.w_addr), 9) as s_addr
  from w a join w b using (country, key) where a.src = 1 and b.src <> 1 and a.df between 1 and {CAP} group by all
),
long as (
  select 'all' as pass, q, p, s_all as score, 20 as k from pq union all select 'name', q, p, s_name, 10 from pq union all select 'addr', q, p, s_addr, 10 from pq
),
found as (
  select * from (select pass, q, p, score, k, row_number() over (partition by pass, q order by score desc, p) as rank from long where score >= 0.05) where rank <= k
)
"""
WIDE_SQL = f"""
{FOUND_SQL},
wide as (
  select q, p, max(score) as score, string_agg(pass, '+' order by pass) as passes,
    max(score) filter (pass = 'all') as score_all, max(rank) filter (pass = 'all') as rank_all,
    max(score) filter (pass = 'name') as score_name, max(rank) filter (pass = 'name') as rank_name,
    max(score) filter (pass = 'addr') as score_addr, max(rank) filter (pass = 'addr') as rank_addr
  from found group by q, p
)
"""


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    rows = records(spark, sf_dir)
    k = keys(rows)
    return rows, k.where("src = 1"), k.where("src <> 1"), rows.where("src <> 1")


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, q, p, pool = _split(spark, sf_dir)
    return retrieval.retrieve(q, p, pool, PASSES)


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.union_passes(_found(spark, sf_dir), [x.name for x in PASSES])


@query(f"with {STATS_SQL} select country, key, df, round(ln((1 + n) / (1 + df)) + 1, 6) as idf from df join n using (country)")
def pool_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, p, pool = _split(spark, sf_dir)
    df, n = retrieval.pool_stats(p, pool)
    return df.join(n, "country").select("country", "key", "df", F.round(F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1, 6).alias("idf"))


@query(f"with {WEIGHTED_SQL} select id, count(*) as n_keys, round(sum(w_all * w_all), 6) as norm_all, round(max(w_name), 6) as top_name, round(max(w_addr), 6) as top_addr from w where src = 1 group by id")
def pass_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, q, p, pool = _split(spark, sf_dir)
    w = retrieval.weighted(q, retrieval.pool_stats(p, pool), PASSES)
    zero = lambda c: F.round(F.max(F.when(F.col(c) >= 0, F.col(c))), 6)
    return w.groupBy("id").agg(F.count("*").alias("n_keys"), F.round(F.sum(F.col("w_all") * F.col("w_all")), 6).alias("norm_all"), zero("w_name").alias("top_name"), zero("w_addr").alias("top_addr"))


@query(f"with {FOUND_SQL} select pass, q, p, score, rank from found")
def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir)


@query(f"with {WIDE_SQL} select * from wide")
def pass_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(spark, sf_dir)


TRUNCATED_SQL = f"""
{WIDE_SQL},
cut as (
  select q, p, case when rank_all <= 8 and score_all >= 0.08 then score_all end as score_all, case when rank_all <= 8 and score_all >= 0.08 then rank_all end as rank_all,
    case when rank_name <= 4 and score_name >= 0.08 then score_name end as score_name, case when rank_name <= 4 and score_name >= 0.08 then rank_name end as rank_name
  from wide
)
"""


@query(
    f"""with {TRUNCATED_SQL}
select q, p, score_all, rank_all, score_name, rank_name, greatest(score_all, score_name) as score, (score_all is not null)::int + (score_name is not null)::int as n_passes,
  concat_ws('+', case when score_all is not null then 'all' end, case when score_name is not null then 'name' end) as passes
from cut where greatest(score_all, score_name) is not null"""
)
def truncate_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.truncate(_wide(spark, sf_dir), {"all": 8, "name": 4}, 0.08)


@query(
    f"""with {WIDE_SQL}, hits as (select q, p, w.q is not null as hit from truth t left join (select q, p from wide) w using (q, p)),
perq as (select q, sum(hit::int) as found, count(*) as g from hits group by q),
cands as (select id, coalesce(c, 0) as c from (select id from records where src = 1) left join (select q, count(*) as c from wide group by q) on q = id),
s as (select count(*) as n_query from records where src = 1), m as (select count(*) as n_pool from records where src <> 1)
select round((select sum(found) / sum(g) from perq)::double, 6) as pair_recall,
  round((select avg((found = g)::int) from perq), 6) as fully_covered,
  round(((select sum(1.25 * (found / g) / (0.25 + found / g)) from perq where found > 0) + n_query - (select count(*) from perq)) / n_query, 6) as ceiling_f05,
  round((select avg(c) from cands), 6) as candidates_mean, round((select quantile_cont(c, 0.95) from cands), 6) as candidates_p95,
  round(1 - (select sum(c) from cands) / (n_query * n_pool), 6) as reduction, (select sum(c) from cands)::bigint as n_candidates
from s, m"""
)
def candidate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, wide = records(spark, sf_dir), _wide(spark, sf_dir)
    per = retrieval.hits(wide, truth(rows)).groupBy("q").agg(F.sum("hit").alias("found"), F.count("*").alias("g"))
    cands = rows.where("src = 1").select(F.col("id").alias("q")).join(wide.groupBy("q").agg(F.count("*").alias("c")), "q", "left").join(per, "q", "left")
    c, recall = F.coalesce("c", F.lit(0)), F.col("found") / F.col("g")
    n_pool = rows.where("src <> 1").agg(F.count("*").alias("n_pool"))
    best = F.when(F.col("g").isNull(), 1.0).otherwise(M.f_beta(F.lit(1.0), recall))
    out = cands.crossJoin(F.broadcast(n_pool)).agg(
        F.round(F.sum("found") / F.sum("g"), 6).alias("pair_recall"), F.round(F.avg((F.col("found") == F.col("g")).cast("int")), 6).alias("fully_covered"),
        F.round(F.avg(best), 6).alias("ceiling_f05"), F.round(F.avg(c), 6).alias("candidates_mean"), F.round(F.percentile(c, F.lit(0.95)), 6).alias("candidates_p95"),
        F.round(1 - F.sum(c) / (F.count("*") * F.max("n_pool")), 6).alias("reduction"), F.sum(c).alias("n_candidates"),
    )
    return out


RECALL_SQL = f"{FOUND_SQL}, ks as (select unnest([1, 2, 5, 10, 20])::int as cut), passes as (select unnest(['all', 'name', 'addr']) as pass)"


@query(f"with {RECALL_SQL} select pass, cut, count(rank) filter (rank <= cut) as found, round(count(rank) filter (rank <= cut) / count(*), 6) as recall from truth cross join passes cross join ks left join found using (pass, q, p) group by pass, cut")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    ks, names = spark.createDataFrame([(k,) for k in (1, 2, 5, 10, 20)], "cut int"), spark.createDataFrame([("all",), ("name",), ("addr",)], "pass string")
    t = truth(records(spark, sf_dir)).crossJoin(F.broadcast(names)).join(_found(spark, sf_dir), ["pass", "q", "p"], "left").crossJoin(F.broadcast(ks))
    hit = F.count_if(F.col("rank") <= F.col("cut"))
    return t.groupBy("pass", "cut").agg(hit.alias("found"), F.round(hit / F.count("*"), 6).alias("recall"))


@query(f"with {FOUND_SQL}, passes as (select unnest(['all', 'name', 'addr', '-']) as without) select without, count(distinct (t.q, t.p)) filter (f.pass is not null and f.pass <> without) as found, count(distinct (t.q, t.p)) as links from truth t cross join passes left join found f on t.q = f.q and t.p = f.p group by without")
def leave_one_pass_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(x,) for x in ("all", "name", "addr", "-")], "without string")
    t = truth(records(spark, sf_dir)).crossJoin(F.broadcast(names)).join(_found(spark, sf_dir), ["q", "p"], "left")
    pair = F.struct("q", "p")
    return t.groupBy("without").agg(F.count_distinct(F.when(F.col("pass") != F.col("without"), pair)).alias("found"), F.count_distinct(pair).alias("links"))


@query(
    f"""with {WIDE_SQL}, miss as (
  select t.q, t.p, a.name as an, b.name as bn, a.addr as aa, b.addr as ba, a.country as ac, b.country as bc
  from truth t left join wide w using (q, p) join records a on t.q = a.id join records b on t.p = b.id where w.q is null
)
select q, p, case when len(aa) = 0 or len(ba) = 0 then 'no address' when len(an) = 0 or len(bn) = 0 then 'empty name' when ac <> bc then 'region differs'
  when len(list_intersect(an, bn)) = 0 then 'no shared token' when least(length(array_to_string(an, ' ')), length(array_to_string(bn, ' '))) <= 4 then 'short name' else 'ranked out' end as reason from miss"""
)
def miss_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    side = lambda i: rows.select(F.col("id").alias("qp"[i]), F.array_join("name", " ").alias(f"n{i}"), F.array_join("addr", " ").alias(f"a{i}"), F.col("country").alias(f"c{i}"), F.col("name").alias(f"t{i}"))
    missed = truth(rows).join(_wide(spark, sf_dir).select("q", "p"), ["q", "p"], "left_anti").join(side(0), "q").join(side(1), "p")
    missed = missed.withColumn("shared", F.size(F.array_intersect("t0", "t1")))
    return missed.select("q", "p", retrieval.miss_reason("a0", "a1", "n0", "n1", "c0", "c1", "shared").alias("reason"))


SEARCH_SQL = ", ".join(f"('all@{a},name@{n}>=0.05', {a}, {n})" for a in (2, 8, 20) for n in (1, 4, 10))


@query(
    f"""with {WIDE_SQL}, configs as (select * from (values {SEARCH_SQL}) v(config, a, n)),
cut as (select config, q, p from wide cross join configs where (rank_all <= a and score_all >= 0.05) or (rank_name <= n and score_name >= 0.05)),
per as (select config, t.q, count(c.q) as found, count(*) as g from truth t cross join configs left join cut c using (config, q, p) group by all),
x as (select config, sum(found) as found, sum(case when found > 0 then 1.25 * (found / g) / (0.25 + found / g) else 0 end) as gain, count(*) as matched from per group by config),
y as (select config, count(*) as candidates from cut group by config), t as (select count(*) as total from records where src = 1),
r as (select config, coalesce(candidates, 0)::bigint as candidates, found::bigint as found, round((gain + total - matched) / total, 6) as ceiling_f05 from x left join y using (config), t)
select * from r qualify coalesce(ceiling_f05 > max(ceiling_f05) over (order by candidates, ceiling_f05 desc, config rows between unbounded preceding and 1 preceding), true)"""
)
def blocking_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, wide = records(spark, sf_dir), _wide(spark, sf_dir)
    grid = [({"all": a, "name": n}, 0.05) for a in (2, 8, 20) for n in (1, 4, 10)]
    return tuning.pareto(tuning.blocking_search(wide, truth(rows), rows.where("src = 1").select(F.col("id").alias("q")), grid))


# The word-bag variant over documents

BAGS_SQL = f"""
{RECORDS_SQL},
bags as (select id, src, country, 'name' as field, unnest(name) as term from records union all select id, src, country, 'addr', unnest(addr) from records),
n as (select country, count(*) as n from records where src <> 1 group by all),
df as (select country, field, term, count(distinct id) as df from bags where src <> 1 group by all),
terms as (
  select id, country, field, term, df from (select distinct id, country, field, term from bags where src = 1) join df using (country, field, term) join n using (country)
  where df <= greatest(50.0, 0.02 * n) qualify row_number() over (partition by id, field order by df, term) <= 6
)
"""
BM25_SQL = f"""
{BAGS_SQL},
sizes as (select country, field, id, count(*) as size from bags where src <> 1 group by all),
mean as (select country, field, avg(size) as mean from sizes group by all),
tf as (select country, field, id, term, count(*) as tf from bags where src <> 1 group by all),
scored as (
  select terms.id as q, tf.id as p, field, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 9) as score
  from terms join tf using (country, field, term) join sizes on sizes.country = terms.country and sizes.field = terms.field and sizes.id = tf.id
  join mean on mean.country = terms.country and mean.field = terms.field join n on n.country = terms.country group by terms.id, tf.id, terms.field
),
ranked as (select q, p, field as channel, score, row_number() over (partition by q, field order by score desc, p) as rank from scored qualify rank <= 80)
"""


def _bags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = records(spark, sf_dir)
    each = lambda f: rows.select("id", "src", "country", F.lit(f).alias("field"), F.size(f).alias("size"), F.explode(f).alias("term"))
    bags = each("name").union(each("addr"))
    pool = bags.where("src <> 1")
    n = rows.where("src <> 1").groupBy("country").agg(F.count("*").alias("n"))
    df = pool.groupBy("country", "field", "term").agg(F.count_distinct("id").alias("df"))
    return retrieval.rare_terms(bags.where("src = 1").select("id", "country", "field", "term").distinct(), df, n), pool, n


@query(f"with {BAGS_SQL} select id, country, field, term, df from terms")
def rare_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bags(spark, sf_dir)[0].select("id", "country", "field", "term", "df")


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms, pool, n = _bags(spark, sf_dir)
    return retrieval.top(retrieval.bm25(terms, pool, n)).withColumnRenamed("field", "channel")


@query(f"with {BM25_SQL} select q, p, channel, score, rank from ranked")
def bm25_channel_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _channels(spark, sf_dir).select("q", "p", "channel", "score", "rank")


@query(
    f"""with {BM25_SQL}, fused as (select q, p, round(sum(1.0 / (60 + rank)), 9) as rrf, string_agg(channel, '+' order by channel) as channels from ranked group by q, p)
select q, p, rrf, channels, row_number() over (partition by q order by rrf desc, p) as place, count(*) over (partition by q) > 40 as overflow from fused qualify place <= 40"""
)
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fuse(_channels(spark, sf_dir))


# Pair features over part names of one brand and type

PARTS_SQL = "pp as (select a.p_partkey as q, b.p_partkey as p, a.p_name as l, b.p_name as r from part a join part b on a.p_brand = b.p_brand and a.p_type = b.p_type and a.p_partkey < b.p_partkey)"


#: Ids of an array, at most, and arrays' ids that are broadcast, at most.
RUN, SMALL = 1 << 5, 1 << 21


def _compared(spark: SparkSession, sf_dir: str, score) -> DataFrame:
    """(q, p, ...) for all pairs of parts of a brand and type, with the columns that ``score`` adds to pairs of names (l, r).

    Names are compared once for each two that meet, in arrays of their parts' ids; pairs are made from these last, and never shuffled."""
    group = ["p_brand", "p_type"]
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", *group).where("p_partkey is not null and p_brand is not null and p_type is not null")
    run = F.floor((F.row_number().over(Window.partitionBy(*group, "p_name").orderBy("p_partkey")) - 1) / RUN)
    runs = written(p.withColumn("run", run).groupBy(*group, "p_name", "run").agg(F.collect_list("p_partkey").alias("ids"), F.min("p_partkey").alias("lo"), F.max("p_partkey").alias("hi")).drop("run"), "runs")
    names = runs.where("p_name is not null").select(*group, "p_name").distinct()
    met = names.withColumnRenamed("p_name", "l").join(names.withColumnRenamed("p_name", "r"), group).select("l", "r").distinct()
    scores = written(score(met), "scores")
    few = lambda rows, n: F.broadcast(rows) if n <= SMALL else rows
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    a = runs.select(*group, F.col("p_name").alias("l"), F.col("ids").alias("qs"), "lo").repartition(max(n, spark.sparkContext.defaultParallelism))
    b = runs.select(*group, F.col("p_name").alias("r"), F.col("ids").alias("ps"), "hi")
    both = a.join(few(b, runs.agg(F.sum(F.size("ids"))).first()[0] or 0), group).where("lo < hi").join(few(scores, scores.count()), ["l", "r"], "left")
    kept = [c for c in scores.columns if c not in ("l", "r")]
    both = both.select(F.explode("qs").alias("q"), "ps", "hi", *kept).where("q < hi")
    return both.select("q", F.explode("ps").alias("p"), *kept).where("q < p")


def _kernels(names: list[str]):
    return lambda met: S.on_distinct(met, "l", "r", names).select("l", "r", *[F.round(f"l_{n}", 6).alias(n) for n in names])


@query(f"with {PARTS_SQL} select q, p, round(1 - levenshtein(l, r) / greatest(length(l), length(r)), 6) as lev, round(least(length(l), length(r)) / greatest(length(l), length(r)), 6) as len_ratio from pp")
def feat_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, r = F.col("l"), F.col("r")
    return _compared(spark, sf_dir, lambda met: met.select("l", "r", F.round(S.levenshtein_similarity(l, r), 6).alias("lev"), F.round(S.length_ratio(l, r), 6).alias("len_ratio")))


@query(f"with {PARTS_SQL} select q, p, round(jaro_similarity(l, r), 6) as jaro, round(jaro_winkler_similarity(l, r), 6) as jaro_winkler, round(1 - damerau_levenshtein(l, r) / greatest(length(l), length(r)), 6) as damerau from pp")
def feat_jaro_damerau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir, _kernels(["jaro", "jaro_winkler", "damerau"]))


@query()
def feat_indel_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir, _kernels(["ratio", "token_set", "token_sort", "partial"]))


GRAMS = "list_transform(range(1, length({0}) + 1), lambda k: substr(' ' || {0} || ' ', k::int, 3))"


@query(
    f"""with {PARTS_SQL}, u as (select distinct x from (select l as x from pp union all select r from pp)),
g as (select x, gram, count(*) as n from (select x, unnest({GRAMS.format("x")}) as gram from u) group by all),
nn as (select x, sqrt(sum(n * n)) as norm from g group by x),
d as (select l, r, sum(a.n * b.n) as dot from (select distinct l, r from pp) join g a on a.x = l join g b on b.x = r and b.gram = a.gram group by l, r)
select q, p, round((coalesce(dot, 0) / (x1.norm * x2.norm))::double, 6) as cosine from pp left join d using (l, r) join nn x1 on x1.x = l join nn x2 on x2.x = r"""
)
def feat_char3_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir, lambda met: S.on_distinct(met, "l", "r", ["trigram"]).select("l", "r", F.round("l_trigram", 6).alias("cosine")))


@query(
    f"""with {WIDE_SQL}, x as (select q, p, a.name as l, b.name as r from wide join records a on a.id = q join records b on b.id = p)
select q, p, case when len(l) > 0 and len(r) > 0 then round(len(list_intersect(l, r)) / len(list_distinct(list_concat(l, r))), 6) end as jaccard,
  case when len(l) > 0 and len(r) > 0 then round(len(list_intersect(l, r)) / least(len(list_distinct(l)), len(list_distinct(r))), 6) end as containment,
  (len(l) > 0)::int + (len(r) > 0)::int as state from x"""
)
def feat_token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    x = _wide(spark, sf_dir).select("q", "p").join(rows.select(F.col("id").alias("q"), F.col("name").alias("l")), "q").join(rows.select(F.col("id").alias("p"), F.col("name").alias("r")), "p")
    l, r = F.col("l"), F.col("r")
    return x.select("q", "p", F.round(S.jaccard(l, r), 6).alias("jaccard"), F.round(S.containment(l, r), 6).alias("containment"), S.set_state(l, r).alias("state"))


@query(
    f"""with {WIDE_SQL}, idf as (
  select country, token, ln((n + 1) / (df + 1)) as idf from (select country, token, count(*) as df from (select distinct id, country, unnest(name) as token from records where src <> 1) group by all) join n using (country)),
tok as (select distinct id, country, unnest(name) as token from records), wt as (select id, token, coalesce(idf, 0.0) as w from tok left join idf using (country, token)),
x as (select q, p from wide), tot as (select id, sum(w) as t from wt group by id),
sh as (select x.q, x.p, sum(a.w) as s, max(a.w) as m from x join wt a on a.id = q join wt b on b.id = p and b.token = a.token group by all),
ml as (select x.q, x.p, max(a.w) as m from x join wt a on a.id = q left join wt b on b.id = p and b.token = a.token where b.id is null group by all),
mr as (select x.q, x.p, max(b.w) as m from x join wt b on b.id = p left join wt a on a.id = q and b.token = a.token where a.id is null group by all)
select x.q, x.p, round(coalesce(s, 0) / nullif(t1.t + t2.t - coalesce(s, 0), 0), 6) as name_wjacc,
  case when t1.t is not null and t2.t is not null then round(coalesce(s, 0), 6) end as name_shared_idf_sum, case when t1.t is not null and t2.t is not null then round(coalesce(sh.m, 0), 6) end as name_shared_idf_max,
  case when t1.t is not null and t2.t is not null then round(coalesce(ml.m, 0), 6) end as name_miss_idf_max_l, case when t1.t is not null and t2.t is not null then round(coalesce(mr.m, 0), 6) end as name_miss_idf_max_r
from x left join tot t1 on t1.id = q left join tot t2 on t2.id = p left join sh using (q, p) left join ml using (q, p) left join mr using (q, p)"""
)
def feat_weighted_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).withColumn("entity_id", F.col("id")).withColumn("tokens", F.array_distinct("name"))
    idf = features.token_idf(rows.where("src <> 1"), "tokens")
    return features.weighted_overlap(_wide(spark, sf_dir).select("q", "p"), rows, idf, "tokens", "name")


NUMBERS_SQL = """x as (select c_custkey as q, s_suppkey as p, regexp_extract_all(c_name, '\\d+') as l, regexp_extract_all(s_name, '\\d+') as r, c_name, s_name, c_mktsegment from customer join supplier on c_nationkey = s_nationkey)"""


@query(
    f"""with {NUMBERS_SQL}
select q, p, (len(list_intersect(l, r)) = 0)::int as num_conflict, (list_sort(l) = list_sort(r))::int as num_eq, ltrim(l[1], '0') as plain,
  case when p % 3 = 0 then (case when q % 2 = 0 then 1 else 3 end) else (case when q % 2 = 0 then 0 else 2 end) end as state,
  (len(list_intersect(l, r)) = 0)::int + (case when q % 2 = 0 and p % 3 <> 0 then (c_mktsegment <> 'MACHINERY')::int else 0 end) as conflicts from x"""
)
def feat_numbers_and_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    digits = lambda n: F.regexp_extract_all(n, F.lit(r"(\d+)"), F.lit(1))
    x = c.join(s, F.col("c_nationkey") == F.col("s_nationkey")).select(F.col("c_custkey").alias("q"), F.col("s_suppkey").alias("p"), digits("c_name").alias("l"), digits("s_name").alias("r"), "c_mktsegment")
    a, b = F.when(F.col("q") % 2 == 0, F.col("c_mktsegment")).otherwise(""), F.when(F.col("p") % 3 != 0, "MACHINERY").otherwise("")
    n = S.set_conflict(F.col("l"), F.col("r"))
    conflicts = n + F.coalesce(S.conflict(a, b), F.lit(0))
    return x.select("q", "p", n.alias("num_conflict"), S.set_equal(F.col("l"), F.col("r")).alias("num_eq"), replace(F.col("l")[0], ("^0+", "")).alias("plain"), S.state(a, b).alias("state"), conflicts.alias("conflicts"))


@query(
    f"""with {PAIRS_SQL}, o as (select p, o_totalprice as price from pairs join orders on o_orderkey = p),
r as (select *, row_number() over w as score_rank, count(*) over g as n, max(score) over g as best, avg(score) over g as mean, coalesce(stddev_samp(score) over g, 0) as sd, rank() over (partition by q order by price desc) as price_rank,
  price - max(price) over g as price_gap, sum((price >= 0.9)::int) over g as hi, sum(label) over g - label > 0 as other from pairs join o using (p) window w as (partition by q order by score desc, p), g as (partition by q)),
s as (select *, coalesce(max(case when score_rank = 2 then score end) over (partition by q), 0) as second from r)
select q, p, score_rank, n as n_cand_ctx, round(score - best, 6) as score_gap_best, round(best - second, 6) as score_top2_gap, round(greatest(-10, least(10, (score - mean) / (sd + 1e-6))), 6) as score_z,
  round(price_gap, 4) as price_gap_best, price_rank, hi::bigint as n_hi, other::int as other_exact from s"""
)
def context_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("p"), F.col("o_totalprice").alias("price"))
    t = features.context(pairs(spark, sf_dir).join(o, "p"), gaps={"price_gap_best": "price"}, ranks={"price_rank": "price"}, high={"n_hi": "price"})
    t = t.withColumn("other_exact", features.others_exact(t, "label"))
    r = lambda c, n=6: F.round(c, n).alias(c)
    return t.select("q", "p", "score_rank", "n_cand_ctx", r("score_gap_best"), r("score_top2_gap"), r("score_z"), r("price_gap_best", 4), "price_rank", "n_hi", "other_exact")


@query(
    f"""with {WIDE_SQL}
select q, p, coalesce(1.0 / rank_all, 0)::double as rr_all, coalesce(1.0 / rank_name, 0)::double as rr_name, coalesce(1.0 / rank_addr, 0)::double as rr_addr,
  round((coalesce(1.0 / (60 + rank_all), 0) + coalesce(1.0 / (60 + rank_name), 0) + coalesce(1.0 / (60 + rank_addr), 0))::double, 6) as rrf,
  (rank_all is not null)::int + (rank_name is not null)::int + (rank_addr is not null)::int as n_passes from wide"""
)
def retrieval_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = features.retrieval_features(_wide(spark, sf_dir))
    return t.select("q", "p", "rr_all", "rr_name", "rr_addr", F.round("rrf", 6).alias("rrf"), "n_passes")


@query(
    """with x as (select a.vec_id as q, b.vec_id as p, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine
  from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 100 = 0)
select q, p, cosine, row_number() over (partition by q order by cosine desc, p) as rank from x qualify rank <= 10"""
)
def dense_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each vector whose id is a multiple of 100, a stated query set, the ten nearest of its label among all."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("l"), "label")
    x = e.select(F.col("vec_id").alias("p"), F.col("embedding").alias("r"), "label").join(q, "label").where("p <> q")
    x = x.select("q", "p", F.round(S.dense_cosine(F.col("l"), F.col("r")), 6).alias("cosine"))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "p"))).where("rank <= 10")
