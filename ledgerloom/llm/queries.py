"""The queries of the training-data operators: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm import shards

    return shards.shard(_documents(spark, sf_dir))


def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm import mixture

    return mixture.mix(_documents(spark, sf_dir))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm import simhash

    return simhash.near_duplicates(_documents(spark, sf_dir))


def op4_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm import extract

    return extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm import decontam

    return decontam.contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm import linededup

    return linededup.remove_repeats(_documents(spark, sf_dir), long=50)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of a replica of the pages' archive in which some records lost their first character to a tilde."""
    from ledgerloom.llm import warc

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    hurt = F.when(F.md5(F.col("url").cast("binary")).startswith("0d"), F.concat(F.lit("~"), F.substring("html", 2, 1 << 30))).otherwise(F.col("html"))
    ours = pages.select("page_id", warc.record(F.col("url"), F.col("page_id"), F.col("html")).alias("record"))
    theirs = pages.select("page_id", warc.record(F.col("url"), F.col("page_id"), hurt).alias("record"))
    return warc.fixity(ours, theirs, ["page_id"])


def op8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm import spans

    return spans.remove_repeats(_documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm import quality

    return quality.measure(_documents(spark, sf_dir))


def op10_tokens(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    from ledgerloom.llm import tokens

    return tokens.digest(tokens.write_tokens(_documents(spark, sf_dir), path or public_tokenizers.path("word_bpe_49k.json")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
