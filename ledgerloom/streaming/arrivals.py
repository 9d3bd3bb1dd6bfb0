"""Linking records as they arrive: a stream of new records against the standing pool."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.functions.text import clean_records
from ledgerloom.operators import keys, retrieval


def link_arrivals(arrivals: DataFrame, pool_keys: DataFrame, pool: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, passes: tuple[retrieval.Pass, ...] = retrieval.NARROW) -> StreamingQuery:
    """Candidates of each micro-batch of ``arrivals`` (a stream of raw records), given to ``sink`` with the batch's number.

    The checkpoint and the batch number let the sink write each batch once, also after a restart."""

    def one(batch: DataFrame, number: int) -> None:
        fresh = keys.exploded(keys.record_keys(clean_records(batch.dropDuplicates(["entity_id"]))))
        sink(retrieval.retrieve(fresh, pool_keys, pool, passes), number)

    return arrivals.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def best_so_far(previous: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of earlier and new candidates of each query and pass: a top-k that merges."""
    merged = previous.unionByName(found).groupBy("pass", "q", "p").agg(F.max("score").alias("score"))
    return retrieval.top(merged, k, ("pass", "q"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events and value by type and tumbling window, late ones up to ``late`` counted in."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def read_records_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of raw records appearing in a folder."""
    return spark.readStream.schema("entity_id string, business_name string, business_address string, country string").parquet(folder)
