import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import mixing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1000), max_size=12))
def test_targets(sizes):
    got = mixing.targets(sizes)
    assert sum(got) == sum(sizes)
    weigh = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    assert all(t <= 3 * s for t, s in zip(got, sizes))
    free = {t / w for t, s, w in zip(got, sizes, weigh) if t < 3 * s}
    assert len(free) <= 1
    assert all(Fraction(3 * s) <= u * w for u in free for t, s, w in zip(got, sizes, weigh) if t == 3 * s)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=8), st.integers(1, 9))
def test_drawn_counts(quota, shards):
    drawn = mixing.draw_counts(quota, shards, 1)
    assert drawn.sum(0).tolist() == quota and np.ptp(drawn.sum(1)) <= 1 and drawn.min() >= 0


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 99))
def test_permutation(n, key):
    got = mixing.permute(np.arange(n), np.full(n, n), np.full(n, key))
    assert sorted(got) == list(range(n))


def docs_of(spark):
    texts = [None, "", "  \n", "one"] + [" ".join(f"d{i}w{j}" for j in range(1 + i * 37 % 400)) for i in range(150)]
    rows = [(i if i != 9 else None, t, [None, "b", "a", "é", "a"][i % 5] if i < 150 else "tiny", 1, "x") for i, t in enumerate(texts)]
    rows += [rows[20]] * 3
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target string")


def test_documents(spark):
    rows, docs = docs_of(spark)
    got = mixing.mix_documents(docs, block=8, shards=5).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(i), words(t)) for i, t, *_ in rows)
    total, taken, target = Counter(), Counter(), {}
    for r in got:
        total[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r["size"]
    names = sorted((s for s in total if s is not None)) + [None]
    want = mixing.targets([total[s] for s in names])
    for s, t in zip(names, want):
        assert target[s] == float(t) and taken[s] == round(t)
    again = mixing.mix_documents(docs.repartition(7), block=8, shards=5).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix_documents(docs.limit(0)).count() == 0
    assert [r.taken for r in mixing.mix_documents(docs.where("doc_id < 3")).collect()] == [0, 0, 0]


def test_slots_and_blocks(spark):
    rows, docs = docs_of(spark)
    mix = mixing.Mix(docs, block=8, shards=5)
    slots = defaultdict(set)
    laps = defaultdict(set)
    for r in mix.blocks.collect():
        slots[r.shard].add(r.slot)
        laps[r._source, r.block].add(r.lap)
    assert all(s == set(range(len(s))) for s in slots.values()) and len(slots) == 5
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert max(map(len, laps.values())) <= 3


def test_texts_follow_the_mix(spark):
    rows, docs = docs_of(spark)
    once = spark.createDataFrame(list(dict.fromkeys(rows)), docs.schema)
    got = mixing.mixed_texts(once, block=8, shards=5).collect()
    report = {str((r.doc_id, r.source, r["size"])): r.taken for r in mixing.mix_documents(once, block=8, shards=5).collect()}
    size = {(r[0], r[2]): len((r[1] or "").split()) for r in rows}
    taken = Counter()
    texts = {(r[0], r[2]): r[1] for r in rows}
    for r in got:
        taken[str((r.doc_id, r.source, size[r.doc_id, r.source]))] += len(r.text.split())
        assert set(r.text.split()) <= set(texts[r.doc_id, r.source].split())
    assert {k: v for k, v in report.items() if v} == dict(taken)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 300), st.floats(0, 3), st.integers(1, 70))
def test_slot_counts(words, share, block):
    target = min(round(words * share), 3 * words)
    slots, last = mixing.slot_counts(words, target, block)
    per = -(-words // block)
    size = lambda r: block if r % per < words // block else words % block
    assert sum(size(r) for r in range(slots - 1)) + last == target and 0 <= last <= block and slots <= 3 * per


def test_small_sources_and_brute_force(spark):
    rows = [(i, "w " * (100 if i == 0 else 2000 if i == 1 else 50 + i), "a" if i == 0 else "b" if i == 1 else "c") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.Mix(docs)
    sources = {r._source: r for r in mix.sources.collect()}
    taken = {r.doc_id: r.taken for r in mix.report().collect()}
    want = Counter()
    for s, r in sources.items():
        words, block = r.source_size, mixing.BLOCK
        slots, last = mixing.slot_counts(words, round(r.target), block)
        placed = [p for p in mix.placed.collect() if p._source == s]
        owner = [p.doc_id for p in sorted(placed, key=lambda p: p._start) for _ in range(p["size"])]
        n, whole = -(-words // block), words // block
        for slot in range(slots):
            lap, at = divmod(slot, n)
            if at < whole:
                at = int(mixing.permute(np.array([at]), np.array([whole]), np.array([(lap * len(sources) + s) * 1000003 + mixing.SEED]))[0])
            for w in owner[at * block:at * block + (last if slot == slots - 1 else block)]:
                want[w] += 1
        assert sum(v for k, v in want.items() if k in {p.doc_id for p in placed}) == round(r.target)
    assert {k: v for k, v in taken.items() if v} == dict(want)


def test_parts_change_no_place(spark, monkeypatch):
    _, docs = docs_of(spark)
    one = sorted(map(str, mixing.mix_documents(docs, block=8, shards=5).collect()))
    monkeypatch.setattr(mixing, "SOURCE_ROWS", 3)
    assert sorted(map(str, mixing.mix_documents(docs, block=8, shards=5).collect())) == one
