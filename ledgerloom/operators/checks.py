"""Contracts of tables and of submissions: each check returns the rows that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks a contract."""


def require_empty(rows: DataFrame, message: str) -> None:
    found = rows.limit(5).collect()
    if found:
        raise ContractError(f"{message}: {[r.asDict() for r in found]}")


def repeated(rows: DataFrame, *by: str) -> DataFrame:
    """Values of ``by`` that occur more than once, with their number."""
    return rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")


def unknown(rows: DataFrame, known: DataFrame, *by: str) -> DataFrame:
    """Rows whose key isn't known."""
    return rows.join(known.select(*by).distinct(), list(by), "left_anti")


def coverage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one of two tables has."""
    a, b = a.select(key).distinct().withColumn("in_a", F.lit(True)), b.select(key).distinct().withColumn("in_b", F.lit(True))
    return a.join(b, key, "full").where("in_a is null or in_b is null").select(key, F.when(F.col("in_a").isNull(), "right").otherwise("left").alias("side"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table only, with the side that has them."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))


def country_conflicts(truth: DataFrame, records: DataFrame) -> DataFrame:
    """Truth pairs (q, p) of records in different countries."""
    left, right = records.select(F.col("entity_id").alias("q"), F.col("country").alias("q_country")), records.select(F.col("entity_id").alias("p"), F.col("country").alias("p_country"))
    return truth.join(left, "q").join(right, "p").where("q_country <> p_country")


def submission_issues(lists: DataFrame, queries: DataFrame, pool: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(issue, id): what is wrong with match lists (q, ids): repeated, missing or unknown queries, repeated ids, ids of a wrong
    source, of the query itself, or of no record, and matches that were no candidates."""
    each = lists.select("q", F.posexplode(F.split("ids", ",")).alias("at", "p")).withColumn("p", F.trim("p")).where("p != ''")
    issue = lambda rows, name, c: rows.select(F.lit(name).alias("issue"), F.col(c).cast("string").alias("id"))
    found = [
        issue(repeated(lists, "q"), "query twice", "q"),
        issue(unknown(queries, lists, "q"), "query missing", "q"),
        issue(unknown(lists, queries, "q"), "query unknown", "q"),
        issue(repeated(each, "q", "p"), "match twice", "p"),
        issue(each.where("p = q"), "matches itself", "p"),
        issue(unknown(each, pool.select(F.col("p").cast("string").alias("p")), "p").where("p != q"), "match unknown", "p"),
    ]
    if candidates is not None:
        found.append(issue(each.join(candidates.select("q", F.col("p").cast("string").alias("p")).distinct(), ["q", "p"], "left_anti"), "match no candidate", "p"))
    return reduce(DataFrame.unionByName, found)
