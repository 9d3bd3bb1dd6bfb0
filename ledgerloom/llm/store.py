"""Tables in the folder that driver and executors share (``spark.checkpoint.dir``).

Writing a stage's rows as Parquet there cuts lineage, survives lost executors and gives later
joins a true size, so that Catalyst broadcasts only what it has measured.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.sources.tables import release


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only where none is set and the session runs on one machine."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        place = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, and ``release`` when it ends."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


#: Rows in an Arrow batch, so that batches of long texts stay small beside an executor's heap.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` in batches of 2,000 rows, unless the session says otherwise than by default."""
    if df.sparkSession.conf.get(BATCH, "10000") == "10000":
        df.sparkSession.conf.set(BATCH, "2000")
    return df.mapInArrow(lean(run), schema)


def materialise(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and return it as read from there.

    A plan of very many small tables takes snappy for ``codec``: with zstd, executors went beyond their memory."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerloom/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that ``df`` has already, so that helper columns never clash with its own."""
    held = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in held:
            n = f"_{n}"
        held.add(n.lower())
        out.append(n)
    return out


def small(table: DataFrame, rows: int = 1 << 19) -> DataFrame:
    """A written table of narrow rows, to be broadcast if it has at most ``rows`` of them, and else joined by a shuffle."""
    return F.broadcast(table) if table.count() <= rows else table.hint("merge")


#: Rows of a range, at least, where the number of rows is known.
RANGE = 1 << 18


def numbered(df: DataFrame, order: list, value=None, tag: str = "numbered", partitions: int | None = None, rows: int | None = None, once: bool = False, codec: str = "zstd") -> DataFrame:
    """Add ``row_no`` (0-based position in ``order``) and, given ``value``, ``before`` (its sum over earlier rows).

    Rows are dealt into contiguous ranges and written once, so that a range keeps its number; the totals
    of the ranges (one row each) are summed, and each range adds its own running sums.  With ``once``, one of the rows
    equal in ``order`` (then names of columns) is taken.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if rows is not None:  # fewer ranges for small tables
        n = max(1, min(n, -(-rows // RANGE)))
    value = F.lit(0) if value is None else value
    ranged = materialise(
        df.withColumn("_value", value.cast("long")).repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()),
        tag,
        codec,
    )
    w = Window.partitionBy("_range").orderBy(*order)
    if once:
        same = [F.col(c).eqNullSafe(F.lag(c).over(w)) for c in order]
        again = F.row_number().over(w) > 1
        for x in same:
            again = again & x
        ranged = ranged.withColumn("_again", again).where("not _again").drop("_again")
    totals = ranged.groupBy("_range").agg(F.count("*").alias("_n"), F.sum("_value").alias("_sum"))
    totals = totals.selectExpr(
        "_range",
        "sum(_n) over (order by _range) - _n as _n_before",
        "sum(_sum) over (order by _range) - _sum as _sum_before",
    )
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.withColumn("_k", F.row_number().over(w)).withColumn("_run", F.sum("_value").over(run))
    out = out.join(totals, "_range")
    return out.select(
        *[c for c in df.columns],
        (F.col("_n_before") + F.col("_k") - 1).cast("long").alias("row_no"),
        (F.col("_sum_before") + F.col("_run") - F.col("_value")).cast("long").alias("before"),
    )
