"""Points made by explode() are never gathered on the driver for a join, however small Spark takes them to be; larger cells change no pair of a join by box."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import components, spatial
from weftline.plans.queries import QUERIES

TABLES = "/root/testdata/sf0.001"


@pytest.fixture
def eager(spark):
    """All that Spark takes for under 1 GB is sent to all executors."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("name", ["box_neighbours", "mean_shift_curves", "mean_shift_curves_wide", "nearest_point", "overlap_match", "overlap_points", "renumber_curves", "unmatched_curves", "overlap_runs", "overlap_type"])
def test_points_are_not_broadcast(eager, name):
    assert "Broadcast" not in planned(QUERIES[name](eager, TABLES))


def test_edges_are_not_broadcast(eager):
    e = eager.range(100).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert "Broadcast" not in planned(components._small_star(components._large_star(e)))


def test_box_join_finds_each_pair_once(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice([rng.uniform(-40, 40), rng.randrange(-12, 12) * 3.0]), rng.choice([rng.uniform(-40, 40), rng.randrange(-12, 12) * 3.0])) for k in range(300)]
    p = spark.createDataFrame([*rows, (300, None, 1.0), (301, float("nan"), 1.0)], "id int, x double, y double")
    got = sorted((r.a, r.b) for r in spatial.box_join(p, p, 3.0).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).collect())
    assert got == sorted((a, b) for a, x, y in rows for b, u, v in rows if abs(x - u) <= 3 + 1e-9 and abs(y - v) <= 3 + 1e-9)
