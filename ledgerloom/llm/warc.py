"""WARC records, and a Merkle fixity audit of their replicas.

Each record of an archive is hashed; records in order, with the byte range that each takes, are the leaves of a tree whose
nodes hash up to ``FAN`` children with the range they span.  Two replicas are compared by their roots.  Where these differ,
the audit goes down one level at a time, joining only the children of nodes that differ, so that the work follows the
damage and not the archive; a tree of n records has log(n) / log(FAN) levels, each a small table.  Nodes are compared by their
number, as replicas of an archive hold the same records in the same order: one that lacks a record differs in all that follow.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.store import map_batches, materialise, numbered

#: Children of a node, at most.
FAN = 16


def record(uri: Column, number: Column, payload: Column) -> Column:
    """A WARC/1.0 resource record (as text) of a page; null parts are empty."""
    uri, number, payload = (F.coalesce(c.cast("string"), F.lit("")) for c in (uri, number, payload))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Record-ID: <urn:page:"), number,
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(payload).cast("string"),
        F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n"),
    )


def _named(order: list[str]) -> list[str]:
    """The names of the order columns beside those of a leaf."""
    return [f"record_{c}" if c in ("node", "start", "end", "hash", "replica_hash", "damaged") else c for c in order]


def leaves(records: DataFrame, order: list[str], record_col: str = "record") -> DataFrame:
    """(order columns, node, start, end, hash) of each record: its number, byte range and sha256, in ``order``.

    Rows equal in ``order`` are ordered by their hashes.  A null record is empty.  An order column named as one of the others
    becomes ``record_`` and its name."""
    body = F.coalesce(F.col(record_col).cast("binary"), F.lit(b""))
    keys = [f"by{k}" for k in range(len(order))]
    rows = records.select(*(F.col(c).alias(k) for c, k in zip(order, keys, strict=True)), F.octet_length(body).cast("long").alias("size"), F.sha2(body, 256).alias("hash"))
    rows = numbered(materialise(rows, "records"), [*(F.col(k).asc_nulls_last() for k in keys), F.col("hash")], F.col("size"), "leaves")
    rows = rows.select(*(F.col(k).alias(c) for c, k in zip(_named(order), keys, strict=True)), F.col("row_no").alias("node"), F.col("before").alias("start"), (F.col("before") + F.col("size")).alias("end"), "hash")
    return materialise(rows, "leaves")


def tree(leaf: DataFrame) -> list[DataFrame]:
    """Levels (node, start, end, hash) from the leaves to the root; no records give no root."""
    level = leaf.select("node", "start", "end", "hash")
    levels, n = [level], level.count()
    while n > 1:
        child = F.struct("node", "start", "end", "hash")
        level = level.groupBy(F.floor(F.col("node") / FAN).alias("parent")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list(child)).alias("children"))
        label = F.concat_ws("\n", F.transform("children", lambda c: F.concat_ws(" ", c["start"], c["end"], c["hash"])))
        level = materialise(level.select(F.col("parent").alias("node"), "start", "end", F.sha2(label.cast("binary"), 256).alias("hash")), "nodes")
        levels.append(level)
        n = -(-n // FAN)
    return levels


def audit(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """(node, start, end, ours, theirs) of the records whose range or hash differs, or that one replica lacks (null there)."""
    if len(ours) != len(theirs):  # of different heights: every record is compared
        wrong, depth = None, 1
    else:
        wrong, depth = None, len(ours)
    for k in range(depth - 1, -1, -1):
        a = ours[k].select("node", F.struct("start", "end", "hash").alias("a"))
        b = theirs[k].select("node", F.struct("start", "end", "hash").alias("b"))
        if wrong is not None:
            below = wrong.select(F.explode(F.sequence(F.col("node") * FAN, F.col("node") * FAN + FAN - 1)).alias("node"))
            a, b = a.join(below, "node", "left_semi"), b.join(below, "node", "left_semi")
        wrong = materialise(a.join(b, "node", "full").where("not (a <=> b)"), "wrong")
    start, end = (F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in ("start", "end"))
    return wrong.select("node", start, end, F.col("a.hash").alias("ours"), F.col("b.hash").alias("theirs"))


def fixity(records: DataFrame, replica: DataFrame, order: list[str], record_col: str = "record") -> DataFrame:
    """(order columns, node, start, end, hash, replica_hash, damaged) of each record of ``records``, by an audit of ``replica``.

    Repeated rows are records of their own; an empty archive gives no rows.  Records that only the replica has are not listed.
    """
    mine, other = leaves(records, order, record_col), leaves(replica, order, record_col)
    wrong = audit(tree(mine), tree(other)).select("node", "theirs", F.lit(True).alias("damaged"))
    out = mine.join(wrong, "node", "left")
    damaged = F.coalesce("damaged", F.lit(False))
    return out.select(*_named(order), "node", "start", "end", "hash", F.when(damaged, F.col("theirs")).otherwise(F.col("hash")).alias("replica_hash"), damaged.alias("damaged"))


_LENGTH = re.compile(rb"(?im)^Content-Length:[ \t]*(\d+)")


def _members(raw: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file in pieces, unzipped if it is gzip (members one after the other)."""
    if raw[:2] != b"\x1f\x8b":
        for at in range(0, len(raw), step):
            yield raw[at : at + step]
        return
    at = 0
    while at < len(raw):
        unzip = zlib.decompressobj(31)
        while at < len(raw) and not unzip.eof:
            piece = raw[at : at + step]
            at += len(piece)
            yield unzip.decompress(piece)
        at -= len(unzip.unused_data)


def parse(raw: bytes) -> Iterator[tuple[int, int, str, bytes, bool]]:
    """(offset, length, header, payload, whole) of each record of a WARC file's bytes (plain, or gzip members), of which only the
    current record is held unzipped.  A record that is cut short isn't ``whole``; bytes between records are passed over."""
    held, base, pieces = bytearray(), 0, _members(raw)

    def more(size: int) -> bool:
        while len(held) < size:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        while (begin := held.find(b"WARC/")) < 0:
            gone = max(0, len(held) - 4)
            del held[:gone]
            base += gone
            if not more(len(held) + 1):
                return
        del held[:begin]
        base += begin
        while (head := held.find(b"\r\n\r\n")) < 0:
            if not more(len(held) + 1):
                yield base, len(held), held.decode("utf-8", "replace"), b"", False
                return
        m = _LENGTH.search(held, 0, head + 2)
        stop = head + 4 + (int(m[1]) if m else 0)
        whole = more(stop) and m is not None
        more(stop + 4)
        end = min(stop, len(held))
        end += 4 if held[end : end + 4] == b"\r\n\r\n" else 0
        yield base, end, held[:head].decode("utf-8", "replace"), bytes(held[head + 4 : stop]), whole
        del held[:end]
        base += end


def read_warc(spark: SparkSession, path: str, batch_bytes: int = 16 << 20) -> DataFrame:
    """(path, offset, length, uri, header, payload binary, whole) of the records of WARC files, of up to 2 GB each as they are stored.

    Records go on in batches of about ``batch_bytes``."""
    names = ["path", "offset", "length", "uri", "header", "payload", "whole"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.bool_()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for where, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, size = [], 0
                for at, length, head, payload, whole in parse(raw.as_py()):
                    uri = re.search(r"(?im)^WARC-Target-URI:[ \t]*(.*?)\r?$", head)
                    rows.append((where, at, length, uri and uri[1], head, payload, whole))
                    size += length
                    if size >= batch_bytes:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return map_batches(files, run, "path string, offset long, length long, uri string, header string, payload binary, whole boolean")
