"""The registry of queries and the views that they share, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.tables import spread, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL twin if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Documents as records of three sources: the first sentence is the name, the rest of the text the address.

WORDS_SQL = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9à-ÿ]+'), lambda x: x <> '')"
RECORDS_SQL = f"""
records as (
  select doc_id as id, 1 + doc_id % 3 as src, lang as country,
         {WORDS_SQL.format("split_part(text, '.', 1)")} as name,
         {WORDS_SQL.format("substr(text, length(split_part(text, '.', 1)) + 1)")} as addr
  from documents
),
truth as (
  select a.q, b.id as p from
    (select min(id) as q, country, array_to_string(name, ' ') as grp from records where src = 1 and len(name) >= 3 group by country, grp) a
    join (select id, country, array_to_string(name, ' ') as grp from records where src <> 1) b on a.country = b.country and a.grp = b.grp
)
"""
KEYS_SQL = """
keys as (
  select distinct id, src, country, 'name' as family, 'n|' || unnest(name) as key from records
  union all
  select distinct id, src, country, 'addr' as family, 'a|' || unnest(addr) as key from records
)
"""


def words(c) -> object:
    return F.filter(F.split(F.lower(c), "[^a-z0-9à-ÿ]+"), lambda x: x != "")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.split_part(F.col("text"), F.lit("."), F.lit(1))
    rest = F.expr("substring(text, length(split_part(text, '.', 1)) + 1)")
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    build = lambda: d.select(F.col("doc_id").alias("id"), (1 + F.col("doc_id") % 3).alias("src"), F.col("lang").alias("country"), words(first).alias("name"), words(rest).alias("addr"))
    return stored(spark, f"records of {sf_dir}", build)


def truth(rows: DataFrame) -> DataFrame:
    """(q, p): of records with one name of three words or more in a country, the first of source 1 owns those of the others."""
    named = rows.withColumn("grp", F.array_join("name", " "))
    own = named.where("src = 1 and size(name) >= 3").groupBy("country", "grp").agg(F.min("id").alias("q"))
    return named.where("src <> 1").select(F.col("id").alias("p"), "country", "grp").join(own, ["country", "grp"]).select("q", "p")


def keys(rows: DataFrame) -> DataFrame:
    """(id, src, country, family, key): words of names and of addresses."""
    of = lambda f, c: F.transform(F.array_distinct(c), lambda t: F.struct(F.lit(f).alias("family"), F.concat(F.lit(f[0] + "|"), t).alias("key")))
    return rows.select("id", "src", "country", F.explode(F.concat(of("name", F.col("name")), of("addr", F.col("addr")))).alias("k")).select("id", "src", "country", "k.family", "k.key")


# Orders as scored pairs: customers are queries, their orders candidates.

PAIRS_SQL = """
pairs as (
  select o_custkey as q, o_orderkey as p, (o_orderkey * 7919 % 1000) / 1000.0::double as score,
         case when o_orderkey * 31 % 10 < 3 then 1 else 0 end as label
  from orders
),
entities as (
  select c_custkey as q, c_nationkey as nation, c_mktsegment as segment, coalesce(sum(label), 0)::bigint + case when c_custkey % 4 = 0 then 1 else 0 end as g
  from customer left join pairs on q = c_custkey group by 1, 2, 3
)
"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("p"), (F.col("o_orderkey") * 7919 % 1000 / 1000.0).alias("score"), F.when(F.col("o_orderkey") * 31 % 10 < 3, 1).otherwise(0).alias("label"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pairs(spark, sf_dir).groupBy("q").agg(F.sum("label").alias("hits"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("q"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return c.join(found, "q", "left").select("q", "nation", "segment", (F.coalesce("hits", F.lit(0)) + F.when(F.col("q") % 4 == 0, 1).otherwise(0)).alias("g"))
