"""Connected components of an edge table by alternating large-star and small-star steps.

Each round is two aggregations and two joins over (node, neighbour) pairs and is written to the shared folder,
so that lineage stays short and no link or component ever reaches the driver (only a count and a checksum do).
A node's neighbours are reduced by partial aggregation; joins on a hub are split by Spark's skew handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.store import materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge between different nodes; root is the smallest node reachable.

    Loops and repeated edges don't matter; edges with a null end are left out; no edges give no rows.
    """
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(f"{a} is not null and {b} is not null and {a} != {b}").distinct()
    e, before = materialise(e, "edges"), None
    while True:
        seen = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x"), F.sum(F.shiftright(F.xxhash64("lo", "hi"), 24)).alias("s")).first()
        if tuple(seen) == before or not seen.n:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = tuple(seen)
        both = e.union(e.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        e = materialise(small.union(least.toDF("hi", "lo")).distinct(), "edges")
