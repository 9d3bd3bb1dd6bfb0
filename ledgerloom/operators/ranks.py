"""Ranks over a whole table without bringing it to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def global_row_number(rows: DataFrame, by: list[str], name: str = "row_no") -> DataFrame:
    """``rows`` with their 1-based place in order of ``by`` (a total order): ranges of the first column are counted, and rows ranked
    within theirs.

    Ranges are cut at approximate quantiles of that column, kept as values, so equal ones stay together and a row's range doesn't
    depend on how partitions come out."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx(by[0], [k / parts for k in range(1, parts)] or [0.5]).alias("c")).first()["c"] or []
    where = sum((F.col(by[0]) > F.lit(c)).cast("int") for c in sorted(set(cuts))) if cuts else F.lit(0)
    ranged = rows.withColumn("_range", where)
    n = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    n = n.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    return ranged.withColumn("_k", inside).join(F.broadcast(n), "_range").withColumn(name, F.col("_before") + F.col("_k")).drop("_range", "_before", "_k")


def running(rows: DataFrame, by: str, columns: list[str], descending: bool = False) -> DataFrame:
    """``rows`` (one for each value of ``by``) with ``run_<column>``: the column's sum over the rows up to this one in order of ``by``.

    Ranges of ``by`` are summed first, and each adds its own running sums, so that no task holds the whole table."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx(by, [k / parts for k in range(1, parts)] or [0.5]).alias("c")).first()["c"] or []
    where = sum((F.col(by) > F.lit(c)).cast("int") for c in sorted(set(cuts))) if cuts else F.lit(0)
    ranged = rows.withColumn("_range", where.cast("int"))
    way = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    total = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])  # a row for each partition
    before = Window.orderBy(way("_range")).rowsBetween(Window.unboundedPreceding, -1)
    total = total.select("_range", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in columns])
    inside = Window.partitionBy("_range").orderBy(way(by)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.join(F.broadcast(total), "_range")
    return out.select(*rows.columns, *[(F.col(f"_b_{c}") + F.sum(c).over(inside)).alias(f"run_{c}") for c in columns])
