"""Intermediate tables in the folder that all executors share, and joins of tables whose size Spark can't tell."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only on a local master, where driver and tasks share the machine, may it be unset: then a temporary folder serves."""
    context = spark.sparkContext
    where = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="weftline-")
    return where.rstrip("/")


def large(df: DataFrame) -> DataFrame:
    """A table to be joined by sorting and merging. Spark guesses a table's size from its files, and takes tables that explode() has made longer, or that files hold in few bytes, for small ones: without
    this it may gather millions of rows on the driver to send them to all executors."""
    return df.hint("merge")


def saver(spark: SparkSession) -> Callable[[DataFrame, str], DataFrame]:
    """A function (df, name) that writes a table to the shared folder and reads it back."""
    where = f"{shared_dir(spark)}/weftline/{spark.sparkContext.applicationId}"

    def save(df: DataFrame, name: str) -> DataFrame:
        path = f"{where}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return save
