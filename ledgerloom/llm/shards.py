"""Contiguous shards of near-equal bytes, by global prefix sums.

Rows are put in one order and dealt into ranges; the ranges' byte totals are summed, each range adds its own running sums,
and the corpus is cut at equal targets: a document lies in the shard that holds its middle byte.  A cut is off its
target by at most half of the document it falls in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.store import materialise, numbered


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) per row, in ``shards`` shards from 0.

    ``size`` is the text's UTF-8 bytes plus 1, a null text having none (its crc32 is that of no bytes).  The order is that
    of ids, rows without one last, then of size and crc32; equal rows are told apart arbitrarily, which changes no
    result.  ``slot`` counts up from 0 within a shard.  Equal texts are not kept together, since a group of copies may be
    larger than a shard.  A shard may stay empty if there are few rows or one is very long.  ``grown_shard`` is null, as
    this is the law ``bytes``.  An empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))).alias("text_crc32"),
    )
    order = [F.col("id").asc_nulls_last(), F.col("size"), F.col("text_crc32")]
    placed = numbered(materialise(rows, "sizes"), order, F.col("size"), "shards")
    total = placed.agg(F.coalesce(F.max(F.col("before") + F.col("size")), F.lit(1))).first()[0]
    placed = placed.withColumn("shard", F.expr(f"cast((2 * cast(before as decimal(30, 0)) + size) * {shards} div {2 * total} as int)"))
    placed = materialise(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("row_no").alias("first"))  # a row for each shard
    out = placed.join(F.broadcast(first), "shard")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row_no") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
