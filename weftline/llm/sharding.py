"""Operator 1, sharding: a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points on a ring of 64-bit positions. A document's key hashes to a position
and goes to the owner of the next point clockwise; a shard that is full passes it on, clockwise, to the next
shard with room. Arcs arrive in ring order, starting at the ring's zero; the keys of an arc arrive in the order of a second hash.

All keys of one arc (between two neighbouring points) try the same shards in the same order, so the
walk needs only the arcs' counts: shards x vnodes numbers, whatever the data. The driver walks
them; the rows find their shard from their rank within their arc. With `slack` None capacities are
the exact shares (counts at most one apart, law `rows`); otherwise a shard holds at most
ceil((1 + slack) * rows / shards) rows and fewer keys move when a shard is added.

Nulls and ties: a null text counts as empty. A row without a key is placed by the hash of its text.
Rows with equal keys share an arc, so they part only where it meets a full shard; fully equal rows are interchangeable and have neighbouring places. Empty input gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prefix_sum, utf8

VNODES = 512
#: Rows of an arc that one task sorts.
ARC_ROWS = 50_000


def ring(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the points in ascending order (signed 64-bit), and their owners. More shards only add points."""
    at = np.array([xxhash.xxh64_intdigest(f"{s}/{v}", seed=1) for s in range(shards) for v in range(vnodes)], "uint64").view("int64")
    owner = np.repeat(np.arange(shards, dtype="int32"), vnodes)
    order = np.lexsort((owner, at))
    return at[order], owner[order]


def capacities(rows: int, shards: int, slack: float | None) -> list[int]:
    if slack is None:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [int(np.ceil((1 + slack) * rows / shards))] * shards


def walk(counts: dict[int, int], owner: np.ndarray, caps: list[int]) -> list[tuple[int, int, int, int]]:
    """Segments (arc, first rank, shard, first slot) of keys that arrive arc by arc and walk clockwise past full shards."""
    room, load, open_ = list(caps), [0] * len(caps), sum(c > 0 for c in caps)
    out = []
    for arc in sorted(counts):
        left, rank, i = counts[arc], 0, arc
        while left and open_:
            s = int(owner[i % len(owner)])
            take = min(left, room[s])
            if take:
                out.append((arc, rank, s, load[s]))
                room[s] -= take
                load[s] += take
                open_ -= room[s] == 0
                left, rank = left - take, rank + take
            i += 1
    return out


def assign_shards(docs: DataFrame, shards: int, vnodes: int = VNODES, slack: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, home_shard (the ring's first choice), shard, slot (gapless from 0 in each shard)."""
    spark = docs.sparkSession
    at, owner = ring(shards, vnodes)
    ring_at = spark.sparkContext.broadcast((at, owner))

    @F.pandas_udf("int")
    def arc_of(position: pd.Series) -> pd.Series:
        points = ring_at.value[0]
        return pd.Series(np.searchsorted(points, position.to_numpy("int64"), "left") % len(points))

    ident = F.col(id_col).cast("long")
    place = F.when(ident.isNotNull(), F.xxhash64(ident)).otherwise(F.xxhash64(F.lit("no key"), text_col))
    counts = {r._arc: r["count"] for r in docs.select(arc_of(place).alias("_arc")).groupBy("_arc").count().collect()}  # at most shards x vnodes rows
    rows = sum(counts.values())
    segments = walk(counts, owner, capacities(rows, shards, slack))
    plan = spark.sparkContext.broadcast(
        (
            np.array([a for a, *_ in segments], "int64"),
            np.array([r for _, r, *_ in segments], "int64"),
            np.array([s for _, _, s, _ in segments], "int32"),
            np.array([x for *_, x in segments], "int64"),
        )
    )

    @F.pandas_udf("shard int, slot long, home_shard int")
    def seat(arc: pd.Series, rank: pd.Series) -> pd.DataFrame:
        arcs, first, shard, slot = plan.value
        lo, r = np.searchsorted(arcs, arc.to_numpy("int64"), "left"), rank.to_numpy("int64")
        hi = np.searchsorted(arcs, arc.to_numpy("int64"), "right")
        i = hi - 1
        while (back := (first[i] > r) & (i > lo)).any():  # an arc's keys seldom meet more than one full shard
            i = i - back
        return pd.DataFrame({"shard": shard[i], "slot": slot[i] + r - first[i], "home_shard": ring_at.value[1][arc.to_numpy("int64")]})

    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(ident.alias("doc_id"), (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), place.alias("_place")).withColumn("_arc", arc_of("_place"))
    ranked = prefix_sum(keyed, ["_arc"], ["_place", "doc_id", "text_crc32", "size"], F.lit(1), "_rank", max(counts.values(), default=1), ARC_ROWS)
    return ranked.select("doc_id", "size", "text_crc32", seat("_arc", "_rank").alias("_seat")).select("doc_id", "size", "text_crc32", "_seat.*")
