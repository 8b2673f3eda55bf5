"""Operator 8, token-ID output: Parquet list columns with controlled encodings, row groups and pages.

One part file per shard, shards and rows in ascending doc_id order. A file's columns are `shard`, `doc_id`,
`local_start`, `n_tokens` and the list column `ids`. Spark's own Parquet writer encodes them: ids by
dictionary (the vocabulary has under 2^16 entries, so an id takes two bytes at most), and where a row
group's dictionary outgrows its page, or dictionaries are turned off, by the version-2 writer's delta
encoding. Row groups and pages have set sizes and every page has an entry in the page index, so a reader
may fetch the metadata columns alone, or the ids of a few documents.

Starts are stored from the shard's own first token. A document's global start is its local one plus the
tokens of the shards before; the reader derives those sums from the metadata columns.

Nulls and ties: a null text is encoded as an empty one (its end id alone). Null doc_ids sort first. Rows with equal
doc_ids are ordered by a hash of the text; rows that agree in both are alike in every column. Empty input
gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import tokens
from .common import new_path, sliced, small_batches, utf8

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
#: Tokens' text aimed at in one shard.
SHARD_BYTES = 32 << 20

FILE_SCHEMA = "shard int, doc_id long, local_start long, n_tokens long, ids array<int>"


def _encode(path: str | None, end_id: int):
    def run(batches):
        enc, at, end = tokens.encoder(path), 0, np.array([end_id], "<u4").tobytes()
        for b in sliced(batches):
            packed = [x + end for x in enc.encode_all(b.column("text").to_pylist())]
            n = np.array([len(x) // 4 for x in packed], "int64")
            ends = np.cumsum(n)
            offsets = np.concatenate([[0], ends]).astype("int32")
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.RecordBatch.from_arrays(
                [b.column("shard"), b.column("doc_id"), pa.array(at + ends - n), pa.array(n), ids],
                ["shard", "doc_id", "local_start", "n_tokens", "ids"],
            )
            at += int(n.sum())

    return run


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: str | None = None,
    end_id: int = tokens.END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int | None = None,
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
    dictionary: bool = True,
) -> None:
    """Encode every whole text and write the files to `path`, a folder that all executors share."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(F.col(text_col)).alias("text"))
    if shards is None:
        total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
        shards = max(1, -(-total // SHARD_BYTES))
    tie = F.xxhash64("text")
    dealt = (
        rows.withColumn("tie", tie)
        .repartitionByRange(shards, "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    )
    encoded = dealt.mapInArrow(_encode(vocabulary, end_id), FILE_SCHEMA)
    (
        encoded.write.option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", str(dictionary).lower())
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.dictionary.page.size", 1 << 20)
        .option("compression", "zstd")
        .parquet(path)
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, shard, local_start: reads no token pages."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    return _with_starts(files.drop("ids"), files)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, shard, local_start, ids. Filters on doc_id reach the files' page indexes."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    return _with_starts(files, files)


#: Files up to which their starts are broadcast (16 bytes each).
FILES = 1 << 16


def _with_starts(rows: DataFrame, files: DataFrame) -> DataFrame:
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("_total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))  # a row for each file
    if totals.count() <= FILES:
        bases = F.broadcast(bases)
    return rows.join(bases, "shard").withColumn("start", F.col("_base") + F.col("local_start")).drop("_base")


def _digest(batches):
    for b in batches:
        ids = b.column("ids")
        values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        ends = ids.offsets.to_numpy()
        crc = [zlib.crc32(values[i:j]) for i, j in zip(ends[:-1], ends[1:])]
        names = [c for c in b.schema.names if c != "ids"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(crc, pa.int64())], [*names, "ids_crc32"])


def _digests(rows: DataFrame, *columns: str) -> DataFrame:
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.select(*columns, "ids").mapInArrow(_digest, f"{kinds}, ids_crc32 bigint")


def token_digest(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of rows from read_tokens()."""
    return _digests(read, "doc_id", "start", "n_tokens")


def token_file_report(spark: SparkSession, docs: DataFrame, **kw) -> DataFrame:
    """Write `docs` to new files in the shared folder, read them back, and digest each document's ids."""
    path = new_path(spark, "tokens")
    write_tokens(docs, path, **kw)
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    # the ids are digested where they are read; what meets the files' starts is a few numbers a document
    found = _with_starts(_digests(files, "doc_id", "shard", "local_start", "n_tokens"), files)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")
