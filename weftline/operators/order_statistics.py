"""Values at given places of sorted groups, of any size, without sorting them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Parts that a range of values is cut into, and values of a range that are sorted in one task.
PARTS, FEW = 1024, 10_000


def at_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], save: Callable[[DataFrame, str], DataFrame], parts: int = PARTS, few: int = FEW) -> DataFrame:
    """For each group of `keys`, the values (doubles) at some 0-based places of its sorted values that aren't null; `_n` is their number, and may stand in the places' expressions. Places
    beyond the group's ends give null.

    A place's range of values is cut into even parts, whose values are counted (in the tasks that read them first), and the part that holds the place is the next range, from its least to its largest value,
    until these are one or the range holds no more than `few` values. No task sorts or holds more than that for a place, however large or uneven a group is."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("_name"), at.cast("long").alias("_at")) for name, at in ranks.items())))
    state = sizes.withColumn("_r", each).select(*keys, "_n", "_lo", "_hi", F.col("_r._name").alias("_name"), F.col("_r._at").alias("_at"), F.col("_n").alias("_in"))
    state = save(state.where((F.col("_at") >= 0) & (F.col("_at") < F.col("_n"))), "ranges")  # _at counts from _lo, _in is the number of values from _lo to _hi
    done: list[DataFrame] = []
    while True:
        done.append(state.where("_lo = _hi").select(*keys, "_name", F.col("_lo").alias("_value")))
        small = state.where((F.col("_lo") < F.col("_hi")) & (F.col("_in") <= few))
        inside = rows.join(small.select(*keys, "_name", "_lo", "_hi", "_at"), keys).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        done.append(inside.groupBy(*keys, "_name", "_at").agg(F.sort_array(F.collect_list("_v")).alias("_all")).select(*keys, "_name", F.get("_all", F.col("_at").cast("int")).alias("_value")))
        large = state.where((F.col("_lo") < F.col("_hi")) & (F.col("_in") > few))
        if large.isEmpty():
            break
        inside = rows.join(large, keys).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        # halves first, as the whole range may be beyond what a double holds
        share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        cut = inside.groupBy(*keys, "_name", "_at", "_n", F.least(F.lit(parts - 1), F.floor(share * parts)).alias("_part")).agg(F.count("*").alias("_in"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        before = F.sum("_in").over(Window.partitionBy(*keys, "_name").orderBy("_part")) - F.col("_in")  # at most `parts` rows
        cut = cut.withColumn("_before", before).where((F.col("_before") <= F.col("_at")) & (F.col("_at") < F.col("_before") + F.col("_in")))
        state = save(cut.select(*keys, "_n", "_lo", "_hi", "_name", (F.col("_at") - F.col("_before")).alias("_at"), "_in"), "ranges")
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    found = every.groupBy(*keys).agg(*(F.max(F.when(F.col("_name") == name, F.col("_value"))).alias(name) for name in ranks))
    return sizes.select(*keys, "_n").join(found, keys, "left")
