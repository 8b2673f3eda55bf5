import itertools
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import packing
from weftline.llm.packing import Solver


def fill(counts, placed, capacity):
    """Sequences as lists of (offset, length), expanded from the solver's rows."""
    out, seen = defaultdict(list), defaultdict(set)
    for size, rank, bins, first, each, offset in placed:
        for i in range(bins * each):
            assert rank + i not in seen[size]
            seen[size].add(rank + i)
            out[first + i // each].append((offset + i % each * size, size))
    assert {s: len(r) for s, r in seen.items()} == {s: n for s, n in counts.items() if n}
    for row in out.values():
        at = 0
        for offset, size in sorted(row):
            assert offset == at
            at += size
        assert at <= capacity
    return out


def optimum(items, capacity):
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins)}.values():
            if bins[k] >= items[i]:
                go(i + 1, bins[:k] + [bins[k] - items[i]] + bins[k + 1:])
        go(i + 1, bins + [capacity - items[i]])

    go(0, [])
    return best[0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_reduction_keeps_the_optimum(items):
    counts = {s: items.count(s) for s in set(items)}
    solver = Solver(counts, 20)
    solver.reduce()
    rest = [s for s, n in solver.left.items() for _ in range(n)]
    assert solver.fixed + optimum(rest, 20) == optimum(items, 20)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_solver_is_best_fit_on_the_remainder(items):
    counts = {s: items.count(s) for s in set(items)}
    solver = Solver(counts, 64)
    solver.reduce()
    rest = sorted((s for s, n in solver.left.items() for _ in range(n)), reverse=True)
    fixed = solver.fixed
    rooms = []
    for s in rest:
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - s)
        else:
            rooms.append(64 - s)
    solver.best_fit()
    assert solver.sequences == fixed + len(rooms)
    assert len(fill(counts, solver.placed, 64)) == solver.sequences


def test_solver_size_does_not_grow_with_the_counts():
    rng = random.Random(5)
    counts = {s: rng.randrange(10**9) for s in range(1, 4097)}
    solver = Solver(counts, 4096).solve()
    assert len(solver.placed) < 200_000
    total = sum(s * n for s, n in counts.items())
    assert solver.sequences >= -(-total // 4096)


@pytest.mark.parametrize("capacity", [8, 4096])
def test_documents(spark, capacity):
    texts = [None, "", "a", "a b c d e f g h i j k l", "same words here", "same words here"] + ["w " * n for n in (3, 5, 7, 8, 15, 31)]
    rows = [(i if i != 4 else None, t, 5, "z") for i, t in enumerate(texts)] + [(7, "w " * 5, 5, "z")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int, piece string")
    got = packing.pack_documents(docs, capacity).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    want = sorted(len((t or "").split()) + 1 for _, t, *_ in rows)
    starts = [sum(g.length for g in v) for k, v in by_doc.items() if k not in (7,)]
    assert sum(want) == sum(r.length for r in got) and set(starts) <= set(want)
    assert len(by_seq) <= -(-sum(want) // capacity) + 1
    assert packing.pack_documents(docs.limit(0), capacity).count() == 0


def test_pieces_match_the_tokenizer(spark):
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from weftline.llm import tokens

    plain = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    texts = {0: None, 1: "", 2: "Hello, World! " * 9, 3: "\u0958. \u09dc! \u0130?", 4: "don't stop... " * 40, 5: "word"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for capacity in (7, 4096):
        want = []
        for i, t in texts.items():
            ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
            for k, at in enumerate(range(0, len(ids), capacity)):
                part = ids[at:at + capacity]
                want.append((i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
        got = packing.pack_documents(docs, capacity).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
        assert sorted(map(tuple, got)) == want


def test_places_do_not_depend_on_parts(spark, monkeypatch):
    rows = [(i % 40, i % 3, 0, 5 + i % 4, i % 7) for i in range(300)]
    pieces = spark.createDataFrame(rows, packing.PIECES.replace("ids_crc32", "_chunk"))
    one = sorted(map(tuple, packing.pack_pieces(pieces, 16).collect()))
    monkeypatch.setattr(packing, "CLASS_ROWS", 3)
    assert sorted(map(tuple, packing.pack_pieces(pieces.repartition(5), 16).collect())) == one and len({(r[5], r[6]) for r in one}) == 300
