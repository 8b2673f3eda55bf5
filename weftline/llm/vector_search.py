"""Operator 3, exact top-k search with vector-approximation files.

Vectors are integer vectors, floor(scale * component). They are dealt to blocks of bounded size. A block's approximation is written once: the
quantile edges of each dimension and one byte for each component, its cell. Every block of queries is scanned against every block of approximations, never
against vectors: cells bound each score from below and above, and candidates whose upper bound is under the block's k-th best lower bound drop out. The k best lower
bounds of all blocks give each query its own bound, and what stays below that drops out too. Exact vectors are then read by a join on the rows that are left, in the order
of upper bounds: the first 2k of each query, and of the others those whose upper bound still reaches the k-th score found. The result is exact.

Nulls and ties: vectors that are null or hold a null, NaN or infinite component take no part, nor do rows without an id. Rows with equal ids are rows of their
own: each is a query if its id is one, and a candidate of the others. Only vectors of the query's length are its candidates. Ties go to the smaller
id. Components and scores of any finite size are exact; a score that a long cannot hold is given, and ranked, as the nearest long. Empty input gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import saved

SCALE = 64
K = 20
#: Cells of a dimension; a cell takes one byte.
CELLS = 256
#: Components of one block.
QUERY_BLOCK = 1 << 19
CANDIDATE_BLOCK = 1 << 21
#: Bounds of queries by candidates that are held at a time.
SCAN_CELLS = 1 << 20

FILE = "d int, block int, rows binary, edges binary, cells binary"
BOUNDS = "q long, c long, low double, high double"
LONG = (-(1 << 63), (1 << 63) - 1)
#: The largest double; scaled components are held to it.
LARGEST = 1.7976931348623157e308


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array<double> of whole numbers), d (its length): every row with an id and a whole, finite vector."""
    most = F.lit(LARGEST / scale)
    exact = lambda e: F.lit(float(scale)) * F.greatest(-most, F.least(most, e.cast("double")))
    x = F.transform(F.col(vec_col), lambda e: F.when(F.abs(exact(e)) < 2.0**52, F.floor(exact(e)).cast("double")).otherwise(exact(e)))  # larger doubles are whole
    fit = F.forall(F.col(vec_col), lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) <= F.lit(LARGEST)))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(fit)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v")).withColumn("d", F.size("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def approximate(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges, cells): of each dimension the least and the largest value of every cell, (2, d, CELLS), and the cell of every component."""
    n, d = x.shape
    ordered = np.sort(x, axis=0)
    at = np.linspace(0, n - 1, CELLS + 1).astype("i8")
    edges, cells = np.zeros((2, d, CELLS)), np.zeros((n, d), "u1")
    for k in range(d):
        upper = np.unique(ordered[at[1:], k])  # a cell holds the values up to its own upper end
        own = np.searchsorted(upper, x[:, k])
        cells[:, k] = own
        first = np.searchsorted(ordered[:, k], upper[:-1], "right")
        edges[1, k, :len(upper)] = upper
        edges[0, k, :len(upper)] = ordered[np.concatenate([[0], first]), k]
    return edges, cells


def _approximations(table: pa.Table) -> pa.Table:
    x, d, block = _matrix(table.column("v")), table.column("d")[0].as_py(), table.column("block")[0].as_py()
    edges, cells = approximate(x)
    return pa.table({"d": pa.array([d], pa.int32()), "block": pa.array([block], pa.int32()), "rows": [table.column("row").to_numpy().tobytes()], "edges": [edges.tobytes()], "cells": [cells.tobytes()]})


def scan(q: np.ndarray, q_rows: np.ndarray, edges: np.ndarray, cells: np.ndarray, rows: np.ndarray, k: int):
    """(queries, candidates, lower, upper bounds) of what may be among the k best of each query, some queries at a time."""
    n, d = cells.shape
    dims = np.arange(d)
    low, high = edges[0][dims, cells], edges[1][dims, cells]
    middle, half = low / 2 + high / 2, high / 2 - low / 2
    peak = float((np.abs(q).max(0, initial=0) * np.maximum(np.abs(edges[0]).max(1, initial=0), np.abs(edges[1]).max(1, initial=0))).sum())
    kind = "float32" if peak < 2**21 else "float64"  # sums of halves are exact in 24 bits
    slack = 0.0 if peak < 2**50 else peak * 2.0**-40
    middle, half = middle.astype(kind), half.astype(kind)
    step = max(1, SCAN_CELLS // max(n, 1))
    for at in range(0, len(q), step):
        part = q[at:at + step].astype(kind)
        center = (part @ middle.T).astype("float64")
        reach = (np.abs(part) @ half.T).astype("float64") + slack
        if peak < 1e300:
            lower, upper = (np.clip(x, -(2.0**63), 2.0**63) for x in (center - reach, center + reach))  # as scores are
        else:
            lower, upper = np.full(center.shape, -(2.0**63)), np.full(center.shape, 2.0**63)
        own = rows[None, :] == q_rows[at:at + step, None]
        lower[own] = upper[own] = -np.inf
        best = np.partition(lower, max(0, n - k), axis=1)[:, max(0, n - k)] if n else np.zeros(len(part))
        i, j = np.nonzero((upper >= best[:, None]) & ~own)
        yield q_rows[at + i], rows[j], lower[i, j], upper[i, j]


def _scan(k: int):
    def run(batches):
        for b in batches:
            for n, q_rows, vectors, rows, edges, cells in zip(*(b.column(c).to_pylist() for c in ("d", "q_rows", "vectors", "rows", "edges", "cells"))):
                q_rows, rows = np.frombuffer(q_rows, "i8"), np.frombuffer(rows, "i8")
                q = np.frombuffer(vectors, "f8").reshape(len(q_rows), n)
                for found in scan(q, q_rows, np.frombuffer(edges, "f8").reshape(2, n, CELLS), np.frombuffer(cells, "u1").reshape(len(rows), n), rows, k):
                    yield pa.RecordBatch.from_arrays([*map(pa.array, found)], ["q", "c", "low", "high"])

    return run


def _query_block(table: pa.Table) -> pa.Table:
    d, block = table.column("d")[0].as_py(), table.column("block")[0].as_py()
    return pa.table({"d": pa.array([d], pa.int32()), "block": pa.array([block], pa.int32()), "q_rows": [table.column("row").to_numpy().tobytes()], "vectors": [_matrix(table.column("v")).tobytes()]})


def inner_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, held to the range of a long."""
    if float((np.abs(x) * np.abs(y)).sum(1).max(initial=0)) < 2**52:
        return (x * y).sum(1).astype("i8")
    exact = (sum(int(a) * int(b) for a, b in zip(r, s)) for r, s in zip(x.tolist(), y.tolist()))
    return np.array([min(max(e, LONG[0]), LONG[1]) for e in exact], "i8")


def _scores(batches):
    for b in batches:
        n = b.num_rows
        score = np.zeros(n, "i8")
        widths = np.diff(b.column("v").offsets.to_numpy())
        for d in np.unique(widths):  # vectors of one length at a time
            some = np.flatnonzero(widths == d)
            pick = lambda c: b.column(c).take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(len(some), d)  # noqa: E731,B023
            score[some] = inner_products(pick("w"), pick("v"))
        yield pa.RecordBatch.from_arrays([b.column("q"), b.column("vec_id"), b.column("high"), pa.array(score)], ["q", "vec_id", "high", "score"])


def top_k(df: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of the rows for which `is_query` (a condition on vec_id) holds."""
    rows = integer_vectors(df, id_col, vec_col, scale).withColumn("query", F.coalesce(is_query, F.lit(False)))
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")  # once written, a row's number is fixed
    sizes = rows.groupBy("d").agg(F.count("*").alias("n"), F.count(F.when(F.col("query"), 1)).alias("nq"))
    in_blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(F.col(n) * F.greatest("d", F.lit(1)) / size)).cast("int")
    sizes = sizes.select("d", in_blocks("n", candidate_block).alias("blocks"), in_blocks("nq", query_block).alias("q_blocks"))
    placed = rows.join(sizes, "d")
    part = lambda m: F.pmod(F.xxhash64("row"), F.col(m)).cast("int").alias("block")
    file = placed.select("d", "row", "v", part("blocks")).groupBy("d", "block").applyInArrow(_approximations, FILE)
    file = saved(file, "approximations").join(sizes, "d")
    queries = placed.where("query").select("d", "row", "v", part("q_blocks")).groupBy("d", "block").applyInArrow(_query_block, "d int, block int, q_rows binary, vectors binary")
    queries = saved(queries, "query-blocks").join(sizes, "d")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    file = file.select("d", F.col("block").alias("cb"), every("q_blocks").alias("qb"), "rows", "edges", "cells")
    queries = queries.select("d", F.col("block").alias("qb"), every("blocks").alias("cb"), "q_rows", "vectors")
    bounds = saved(queries.join(file, ["d", "qb", "cb"]).mapInArrow(_scan(k), BOUNDS), "bounds")

    by = lambda *order: F.row_number().over(Window.partitionBy("q").orderBy(*order))
    floor = bounds.select("q", "low", by(F.desc("low")).alias("n")).where(F.col("n") <= k).groupBy("q").agg(F.count("*").alias("n"), F.min("low").alias("floor"))
    left = bounds.join(floor.where(F.col("n") == k).select("q", "floor"), "q", "left").where("floor is null or high >= floor").select("q", "c", "high")
    left = saved(left, "candidates")

    def read(some: DataFrame) -> DataFrame:
        """Scores of some rows of `left`, from their exact vectors."""
        both = some.join(rows.select(F.col("row").alias("c"), "vec_id", "v"), "c").join(rows.where("query").select(F.col("row").alias("q"), F.col("v").alias("w")), "q")
        return both.select("q", "vec_id", "high", "v", "w").mapInArrow(_scores, "q long, vec_id long, high double, score long")

    ranked = left.withColumn("n", by(F.desc("high"), "c"))
    first = saved(read(ranked.where(F.col("n") <= 2 * k)), "first-scores")
    sure = first.select("q", "score", by(F.desc("score")).alias("n")).where(F.col("n") == k).select("q", F.col("score").alias("sure"))
    rest = ranked.where(F.col("n") > 2 * k).join(sure, "q").where(F.col("high") >= F.col("sure") * (1 - F.signum("sure") * F.lit(2.0**-50)))  # a long may round up as a double
    every_score = first.union(read(rest.select("q", "c", "high")))
    names = rows.where("query").select(F.col("row").alias("q"), F.col("vec_id").alias("query_id"))
    best = every_score.select("q", by(F.desc("score"), "vec_id").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
    return best.join(names, "q").select("query_id", "rank", "vec_id", "score")
