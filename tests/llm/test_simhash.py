import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aAÄbÉ \n\x1c\x85\xa0.x"), max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) % 2**64 == plain_fingerprint(text)


def test_fingerprint_of_long_texts(monkeypatch):
    text = " ".join(f"w{i * 7919 % 101}" for i in range(500))
    monkeypatch.setattr(simhash, "PART_BYTES", 100)
    assert simhash.fingerprint(text.encode()) % 2**64 == plain_fingerprint(text)
    assert simhash.fingerprint(b"") == simhash.fingerprint(b" \n ") == 0


@pytest.mark.parametrize("positions", [list(range(64)), list(range(3, 34))])
def test_masks_cover_every_pair_within_the_radius(positions):
    found = simhash.masks(positions, 3)
    assert len(found) == 15
    rng = random.Random(1)
    for _ in range(3000):
        d = sum(1 << p for p in rng.sample(positions, rng.randint(1, 3)))
        assert any(d & m == 0 for m in found)
    assert max(len(positions) - m.bit_count() for m in found) <= len(positions) // 2 + 1


def brute(fps):
    fps = sorted(fps)
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if ((a ^ b) % 2**64).bit_count() <= 3:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {f: root(f) for f in fps}


@pytest.mark.parametrize("bucket", [512, 8])
def test_edges_connect_what_links_connect(spark, bucket):
    rng = random.Random(7)
    fps = {0, -1}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 5, 60])):
            y = x
            for b in rng.sample(range(64), rng.randint(0, 4)):
                y ^= 1 << b
            fps.add(y - 2**64 if y >> 63 else y)
            x = y if rng.random() < 0.3 else x
    from weftline.llm.common import saved
    from weftline.operators.components import connected_components

    edges = simhash.near_edges(spark.createDataFrame([(f,) for f in fps], "fp long"), 3, bucket)
    got = {r.node: r.component for r in connected_components(edges, saved).collect()}
    want = brute(fps)
    sizes = {r: sum(v == r for v in want.values()) for r in want.values()}
    assert got == {f: r for f, r in want.items() if sizes[r] > 1}


def test_documents(spark):
    rng = random.Random(2)
    base = " ".join(f"word{rng.randrange(400)}" for _ in range(400))
    near = [base.replace(f"word{i} ", "other ", 1) for i in range(25)]
    texts = [None, "", " ", "a", "A", "a b", "a b c d"] + near + [base, base.upper()] + [" ".join(f"x{rng.randrange(900)}" for _ in range(30)) for _ in range(20)]
    rows = [(i, t, 5, 1) for i, t in enumerate(texts)] + [(None, base, 5, 1), (8, near[1], 5, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long, component_id int")
    got = simhash.near_duplicates(docs).collect()
    prints = {i: plain_fingerprint(t) for i, t, *_ in rows}
    signed = lambda x: x - 2**64 if x >> 63 else x
    comp = brute({signed(p) for p in prints.values()})
    least = {}
    for i, p in prints.items():
        if i is not None:
            c = comp[signed(p)]
            least[c] = min(least.get(c, i), i)
    assert sorted((str(r.doc_id), r.fp, r.component_id) for r in got) == sorted((str(i), signed(plain_fingerprint(t)), least[comp[signed(plain_fingerprint(t))]]) for i, t, *_ in rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_spanning_edges_of_large_runs():
    fps = np.unique(np.random.default_rng(3).integers(0, 2**12, 3000)).astype("int64")
    u, v = simhash._links(fps, np.full(len(fps), len(fps)), 3)
    assert len(u) == len(fps) - 1


def test_documents_whose_text_hashes_clash_all_stay(spark, monkeypatch):
    monkeypatch.setattr(simhash, "row_key", lambda text_col: F.lit(bytearray(b"same")))
    texts = ["one two three four five", "six seven eight nine ten", "alpha beta gamma delta epsilon", "one two three four five"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "quite another text than these")], "doc_id bigint, text string")
    kept = simhash.one_of_each_group(docs)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [0, 1, 2, None]
