"""Reading and writing the engine's files: TSV records and truth, Parquet tables, match lists, JSON run files."""

from __future__ import annotations

import ctypes
import json
import math
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "entity_id string, business_name string, business_address string, country string"
TRUTH = "source1_entity_id string, matched_entity_ids string"
_PLAIN = {"sep": "\t", "header": True, "quote": "", "escape": "", "nullValue": "\x00", "emptyValue": "", "encoding": "UTF-8"}


def read_tsv(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """A TSV file, all as declared: no quotes, no null words, '' kept.  ``strict`` fails on a malformed row or header."""
    options = _PLAIN | ({"mode": "FAILFAST", "enforceSchema": False} if strict else {})
    return spark.read.options(**{k: str(v) if not isinstance(v, bool) else v for k, v in options.items()}).schema(schema).csv(path)


def read_records(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Records with ``source``, the id's prefix; missing fields are ''."""
    rows = read_tsv(spark, path, RECORD, strict)
    return rows.fillna("").withColumn("source", F.substring("entity_id", 1, 2))


def read_truth(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Truth pairs (q, p) and entities (q, g), of which a singleton has g = 0."""
    rows = read_tsv(spark, path, TRUTH, strict).fillna("")
    ids = F.filter(F.transform(F.split("matched_entity_ids", ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = rows.select(F.col("source1_entity_id").alias("q"), ids.alias("ids"))
    return rows.select("q", F.explode("ids").alias("p")), rows.select("q", F.size("ids").alias("g"))


def encode_id(c):
    """'S2-17' as 20000000017: the source's digit, then ten digits."""
    return F.substring(c, 2, 1).cast("long") * 10_000_000_000 + F.substring(c, 4, 20).cast("long")


def sample(rows: DataFrame, share: float, keep: DataFrame | None = None, seed: int = 42, id_col: str = "entity_id") -> DataFrame:
    """A share of the rows by the md5 of seed and id, the same on each run, and all rows whose id is in ``keep``."""
    picked = rows.withColumn("_in", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0 < share)
    if keep is not None:
        marks = keep.select(id_col).distinct().withColumn("_kept", F.lit(True))
        picked = picked.join(marks, id_col, "left").withColumn("_in", F.col("_in") | F.coalesce("_kept", F.lit(False))).drop("_kept")
    return picked.where("_in").drop("_in")


def register_views(spark: SparkSession, folder: str, names: list[str], catalog: str = "") -> None:
    """Views of a folder's Parquet tables for SQL, named by table or, with a ``catalog``, catalog_table, so that SQL can join several folders."""
    for n in names:
        spark.read.parquet(f"{folder}/{n}.parquet").createOrReplaceTempView(f"{catalog}_{n}" if catalog else n)


def write_keys(keys: DataFrame, path: str) -> None:
    """Exploded keys (id, country, family, key) as Parquet by country, for retrievals to come."""
    write_table(keys.sortWithinPartitions("key"), path, "country")


def write_table(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Parquet in zstd, in folders of ``by``; the committer's _SUCCESS marks a whole table."""
    writer = rows.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_lists(lists: DataFrame, path: str, column: str = "matched_entity_ids") -> None:
    """(q, ids) as TSV with the header source1_entity_id and ``column``, a row for each query."""
    out = lists.select(F.col("q").alias("source1_entity_id"), F.col("ids").alias(column)).orderBy("source1_entity_id")
    out.write.mode("overwrite").options(sep="\t", header=True, quote="", emptyValue="", escapeQuotes=False).csv(path)


def to_json(value) -> str:
    """Canonical JSON: sorted keys, NaN and infinities as null."""

    def plain(x):
        if isinstance(x, float) and not math.isfinite(x):
            return None
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list | tuple) else x

    return json.dumps(plain(value), sort_keys=True, ensure_ascii=False)


def fingerprint(spark: SparkSession, value) -> str:
    """sha256 of the canonical JSON."""
    return spark.range(1).select(F.sha2(F.lit(to_json(value)).cast("binary"), 256).alias("h")).first().h


def _file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file(spark, path)
    return fs.exists(p)


def cached(spark: SparkSession, path: str, inputs, build) -> DataFrame:
    """The table at ``path`` if it was made whole from equal ``inputs``, else ``build()`` written there."""
    mark = f"{path}.manifest"
    want = fingerprint(spark, inputs)
    if exists(spark, f"{path}/_SUCCESS") and exists(spark, mark) and [r.value for r in spark.read.text(mark).collect()] == [want]:
        return spark.read.parquet(path)
    write_table(build(), path)
    spark.createDataFrame([(want,)], "value string").coalesce(1).write.mode("overwrite").text(mark)
    return spark.read.parquet(path)


_STORED: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that several plans of an application read, such as records' keys: built and written once, in the folder that the
    driver and the executors share, and read from there.

    Without such a folder (``spark.checkpoint.dir``) a session on one machine takes a temporary one, and others build it each time."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _STORED or not exists(spark, f"{_STORED[key]}/_SUCCESS"):
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place:
            if not spark.sparkContext.master.startswith("local"):
                return build()
            place = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        path = f"{place.rstrip('/')}/ledgerloom/{key[0]}/stored-{fingerprint(spark, name)[:24]}"
        write_table(build(), path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def release() -> None:
    """Give a worker's free memory back: it outlives its tasks, and would hold their largest arrays beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows``, computed once: written to the folder that the driver and the executors share, and read from there.

    On a cluster ``spark.checkpoint.dir`` must name that folder; a session on one machine without it takes a temporary one."""
    spark = rows.sparkSession
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        place = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
    path = f"{place.rstrip('/')}/ledgerloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    write_table(rows, path)
    return spark.read.schema(rows.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """Rows of fewer files than there are cores, dealt over these; a table of more files is left as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def leaderboard(spark: SparkSession, pattern: str) -> DataFrame:
    """Run files (one JSON object each) as a table, the best macro F0.5 first and then the fastest."""
    runs = spark.read.option("multiLine", True).json(pattern)
    return runs.orderBy(F.desc("macro_f05"), F.asc("wall_s"))
