"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: White space of the word rules: the bytes x20 and x09-x0D.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only on a local master, where driver and tasks share the machine, may it be unset: then a temporary folder serves."""
    context = spark.sparkContext
    where = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where and context.master.startswith("local") and not context.master.startswith("local-cluster"):
        where = getattr(shared_dir, "own", None)
        if where is None:
            where = shared_dir.own = tempfile.mkdtemp(prefix="weftline-")
    if not where:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return where.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/weftline/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Most bytes of an Arrow batch, unless the session sets its own limit.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Hold the Arrow batches of this session to BATCH_BYTES, so that what Python workers hold doesn't grow with the rows' size; a limit that is set already stays."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and survives lost executors.

    The tables stay as long as their readers may need them: until `drop_saved()`, or until the folder is cleared."""
    spark = df.sparkSession
    small_batches(spark)
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_saved(spark: SparkSession) -> None:
    """Delete all tables that this session's operators have written to the shared folder. DataFrames that still read them fail afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, each with underscores in front as far as `df` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def sliced(batches, rows: int = 1000):
    """Arrow batches in slices, so that what Python makes of one stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def utf8(text: Column) -> Column:
    """UTF-8 bytes of a text; null gives no bytes."""
    return F.coalesce(text, F.lit("")).cast("binary")


#: Copies of one row beyond which they are numbered in several tasks.
COPIES = 1 << 16


def prefix_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, most: int, chunk_rows: int) -> DataFrame:
    """Add `out`: the sum of `value`, an expression over `keys` and `order`, over the rows before this one within its keys.

    Rows of a key stand in the order of (hash of `order`, `order`), whatever the table's size. A key is dealt to parts by the top bits of that hash, so that a hot key is
    sorted by many tasks; only the parts' sums meet. `most`, the rows of the largest key, and `chunk_rows` set the number of parts, which changes no result.
    Rows that agree in all columns are counted before they are dealt, and stand one behind the other. `keys` must not hold nulls.
    """
    h, chunk, n, total, base, copy, block = fresh(df, "_hash", "_chunk", "_n", "_total", "_base", "_copy", "_block")
    bits = (-(-max(most, 1) // chunk_rows) - 1).bit_length()
    rows = df.groupBy(*df.columns).agg(F.count("*").alias(n)).withColumn(h, F.xxhash64(*order))
    rows = rows.withColumns({chunk: F.shiftright(h, 64 - bits) if bits else F.lit(0).cast("long"), total: F.col(n) * value})
    parts = rows.groupBy(*keys, chunk).agg(F.sum(total).alias(base))
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, chunk, F.coalesce(F.sum(base).over(before), F.lit(0)).alias(base))
    inside = Window.partitionBy(*keys, chunk).orderBy(h, *order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn(total, F.coalesce(F.sum(total).over(inside), F.lit(0))).join(parts, [*keys, chunk])
    number = lambda some, first, last: some.select("*", F.explode(F.sequence(first, last)).alias(copy))
    few = placed if most <= COPIES else placed.where(F.col(n) <= COPIES)
    every = number(few, F.lit(0).cast("long"), F.col(n) - 1)
    if most > COPIES:
        many = placed.where(F.col(n) > COPIES).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / COPIES))).alias(block)).repartition(h, block)
        every = every.unionByName(number(many, F.col(block) * COPIES, F.least((F.col(block) + 1) * COPIES, F.col(n)) - 1).drop(block))
    return every.withColumn(out, F.col(base) + F.col(total) + F.col(copy) * value).select(*df.columns, out)


def packed(x: np.ndarray) -> bytes:
    """An array of numbers, compressed. Bytes of one weight stand together, so small numbers take little room."""
    plain = np.ascontiguousarray(x)
    planes = plain.view(np.uint8).reshape(len(plain), plain.itemsize).T.tobytes()
    return plain.dtype.str.encode().ljust(4) + len(plain).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    kind, n = np.dtype(data[:4].decode().strip()), int.from_bytes(data[4:12], "little")
    planes = pa.decompress(data[12:], n * kind.itemsize, codec="zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(kind.itemsize, n).T.copy().view(kind).reshape(n)
