import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import vector_search


def brute(rows, k, scale=64):
    ok = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok.append((i, [math.floor(scale * float(x)) for x in v]))
    out = []
    for a, (q, v) in enumerate(ok):
        if q % 20 == 0:
            scored = sorted((-min(max(sum(x * y for x, y in zip(v, w)), -(1 << 63)), (1 << 63) - 1), i) for b, (i, w) in enumerate(ok) if a != b and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread,blocks", [(0.2, (64, 1000)), (30.0, (400, 3000))])
def test_matches_brute_force(spark, spread, blocks):
    rng = np.random.default_rng(4)
    vecs = rng.normal(0, spread, (400, 16)).astype("float32")
    vecs[50:120] = vecs[40]  # ties and one very common vector
    vecs[7] *= 1e6  # an outlier
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)]
    rows += [(1000, None), (1020, [1.0, None] * 8), (1040, [math.nan] * 16), (1060, [math.inf] * 16), (None, [0.1] * 16), (60, [0.0] * 16), (60, [0.0] * 16), (41, rows[41][1]), (1080, [0.5, 0.5]), (1081, [0.5, -0.5]), (1100, [])]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "vec_id long, embedding array<float>, score int, query_id string")
    got = vector_search.top_k(df, F.col("vec_id") % 20 == 0, k=7, query_block=blocks[0], candidate_block=blocks[1]).collect()
    rows32 = [(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(map(tuple, got)) == brute(rows32, 7)


def test_few_rows_large_values_and_empty_tables(spark):
    rows = [(0, [2.0**24, -3.0]), (1, [2.0**24, 5.0]), (2, [2.0**40, 1.0]), (3, [2.0**60, -1.0]), (4, [-(2.0**900), 1.0]), (20, [0.25, 3.0**20]), (40, [1e15 + 0.25, 7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vector_search.top_k(df, F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, got)) == brute(rows, 20)
    assert vector_search.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert vector_search.top_k(df.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 400), st.integers(0, 9), st.sampled_from([1.0, 40.0, 1e4, 1e12]), st.integers(0, 99))
def test_bounds_hold(n, d, spread, seed):
    rng = np.random.default_rng(seed)
    x = np.floor(rng.normal(0, spread, (n, d)))
    edges, cells = vector_search.approximate(x)
    dims = np.arange(d)
    assert (edges[0][dims, cells] <= x).all() and (x <= edges[1][dims, cells]).all()
    rows = np.arange(n)
    seen = {}
    for q, c, low, high in vector_search.scan(x[:20], rows[:20], edges, cells, rows, 5):
        s = np.clip((x[q] * x[c]).sum(1), -(2.0**63), 2.0**63)
        assert (low <= s).all() and (s <= high).all()
        for a, b in zip(q.tolist(), c.tolist()):
            seen.setdefault(a, set()).add(b)
    exact = np.clip(x[:20] @ x.T, -(2.0**63), 2.0**63)
    for q in range(min(n, 20)):
        order = [c for c in sorted(rows, key=lambda c: -exact[q, c]) if c != q]
        if len(order) >= 5:
            assert {c for c in order if exact[q, c] > exact[q, order[4]]} <= seen[q]


def test_most_vectors_stay_unread():
    rng = np.random.default_rng(0)
    x = np.floor(64 * rng.normal(0, 0.15, (5000, 64)))
    rows = np.arange(5000)
    edges, cells = vector_search.approximate(x)
    left = sum(len(f[0]) for f in vector_search.scan(x[:20], rows[:20], edges, cells, rows, 20))
    assert 400 <= left < 600
