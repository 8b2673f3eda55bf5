"""Images and curves made from the test tables, in Spark and as DuckDB SQL: the inputs of the registered queries.

An image's rows are embeddings: 64 vectors make a frame, a component is a pixel, floor(64 * component) its value; a last frame of under 16 rows is part of the one before.
A curve is an order: every four orders stand for one curve in four frames, shifted along and across by the customer key. Of every eight curves, in the even frames one runs backwards, one
begins near the end of the same curve in the odd frames, one does both, one branches off, and one turns back on itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    last = e.agg(F.max("vec_id").alias("most"))  # one row
    e = e.join(last).withColumn("f", F.expr("least(vec_id div 64, greatest(0, (most - 15) div 64))")).select("vec_id", "f", F.posexplode("embedding").alias("x", "e"))
    return e.select((F.col("f") + 1).cast("int").alias("frame"), (F.col("vec_id") - F.col("f") * 64).cast("int").alias("y"), "x", F.floor(F.lit(64) * F.col("e").cast("double")).cast("double").alias("v"))


PIXELS_SQL = """
    raw AS (SELECT vec_id, least(vec_id // 64, greatest(0, ((SELECT max(vec_id) FROM embeddings) - 15) // 64)) AS f, CAST(unnest(range(len(embedding))) AS INTEGER) AS x, unnest(embedding) AS e FROM embeddings),
    pixels AS MATERIALIZED (SELECT CAST(f + 1 AS INTEGER) AS frame, CAST(vec_id - f * 64 AS INTEGER) AS y, x, floor(64 * e::DOUBLE) AS v FROM raw)
"""


def curve_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.expr("o_orderkey div 4").alias("c"), F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("u"))
    # an order makes up to 22 points, and its file may be read by one task; AQE leaves this number of tasks alone
    o = o.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k")
    o = o.withColumn("kind", F.when(F.col("k") % 2 == 1, F.col("c") % 8).otherwise(0))  # how it differs from the curve in the odd frames
    o = o.withColumn("n", F.when((F.col("c") % 8).between(2, 5), 18 + F.col("c") % 5).otherwise(8 + F.col("c") % 9))
    points = o.withColumn("i", F.explode(F.expr("sequence(0, cast(n - 1 as int))")))
    points = points.withColumn("p", F.when(F.col("kind").isin(1, 3), F.col("n") - 1 - F.col("i")).otherwise(F.col("i")))
    along = F.when(F.col("kind").isin(2, 3), F.col("p") + F.col("n") - 8).when((F.col("kind") == 5) & (F.col("p") > 11), 23 - F.col("p")).otherwise(F.col("p"))
    aside = F.when((F.col("kind") == 4) & (F.col("p") > 6), F.col("p") - 6).when((F.col("kind") == 5) & (F.col("p") > 11), 1).otherwise(0)
    points = points.withColumns({"q": along, "aside": aside})
    i, p, q = F.col("i"), F.col("p"), F.col("q")
    return points.select(
        (F.col("k") % 4 + 1).cast("int").alias("frame"), F.col("c").cast("int").alias("contour"), (i + 1).alias("point"),
        ((F.col("c") % 64) * 64 + q + (F.col("u") % 3 - 1) * 2).cast("double").alias("x"),
        (F.expr("c div 64") * 16 + F.col("aside") + (p * p % 5) * F.lit(0.25) + (F.col("u") % 7) * F.lit(0.5)).cast("double").alias("y"),
        (F.lit(-1.5) + F.lit(0.1) * ((F.col("c") + q) % 31)).cast("double").alias("angle"),
        (1 + F.col("u") % 10).cast("double").alias("response"),
        F.when((F.col("u") + i) % 4 > 0, (1 + i % 3) * F.lit(0.5)).cast("double").alias("width"),
    )


CURVES_SQL = """
    orders_n AS (SELECT o_orderkey // 4 AS c, o_orderkey AS k, o_custkey AS u, CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey // 4 % 8 ELSE 0 END AS kind, CASE WHEN o_orderkey // 4 % 8 BETWEEN 2 AND 5 THEN 18 + o_orderkey // 4 % 5 ELSE 8 + o_orderkey // 4 % 9 END AS n FROM orders),
    orders_i AS (SELECT *, unnest(range(CAST(n AS BIGINT))) AS i FROM orders_n),
    orders_p AS (SELECT *, CASE WHEN kind IN (1, 3) THEN n - 1 - i ELSE i END AS p FROM orders_i),
    orders_q AS (SELECT *, CASE WHEN kind IN (2, 3) THEN p + n - 8 WHEN kind = 5 AND p > 11 THEN 23 - p ELSE p END AS q, CASE WHEN kind = 4 AND p > 6 THEN p - 6 WHEN kind = 5 AND p > 11 THEN 1 ELSE 0 END AS aside FROM orders_p),
    curves AS MATERIALIZED (
        SELECT CAST(k % 4 + 1 AS INTEGER) AS frame, CAST(c AS INTEGER) AS contour, CAST(i + 1 AS INTEGER) AS point,
               CAST((c % 64) * 64 + q + (u % 3 - 1) * 2 AS DOUBLE) AS x,
               CAST((c // 64) * 16 + aside AS DOUBLE) + CAST(p * p % 5 AS DOUBLE) * 0.25::DOUBLE + CAST(u % 7 AS DOUBLE) * 0.5::DOUBLE AS y,
               -1.5::DOUBLE + 0.1::DOUBLE * CAST((c + q) % 31 AS DOUBLE) AS angle, CAST(1 + u % 10 AS DOUBLE) AS response,
               CASE WHEN (u + i) % 4 > 0 THEN CAST(1 + i % 3 AS DOUBLE) * 0.5::DOUBLE END AS width
        FROM orders_q)
"""
