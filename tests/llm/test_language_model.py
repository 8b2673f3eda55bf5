"""The Pitman-Yor language model: exact columns against plain counting, its probabilities against the formula and their sum, the sampler against enumeration."""

import math
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import language_model as lm
from weftline.llm.common import packed, unpacked

HELD = lambda c: F.crc32(c.cast("string")) % 7 == 2


def is_held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def tokens(text):
    return [*(text or "").encode().translate(lm.LOWER).split(), b""]


def texts(n=150, seed=3):
    """Words that follow one another by a rule, so that the word before tells something; copies; odd rows."""
    rng = np.random.default_rng(seed)
    follow = {i: rng.integers(0, 60, 3) for i in range(90)}
    out = []
    for d in range(n):
        w, own = int(rng.integers(60)), []
        for _ in range(int(rng.integers(0, 50))):
            w = int(rng.choice(follow[w])) if rng.random() < 0.8 else int(rng.integers(90))
            own.append(f"Word{w}" if rng.random() < 0.95 else f"x{rng.integers(10**6)}")
        out.append((d, " ".join(own)))
    return out + [(3, out[3][1]), (3, out[3][1]), (None, "word1 word2"), (None, None), (1000, ""), (1001, None), (1002, "ÄÖ word1\x0bword2\x00 x"), (1003, "word1 " * 4000)]


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)


@pytest.fixture(scope="module")
def scored(spark):
    docs = texts()
    return docs, sorted((tuple(r) for r in lm.scored_texts(frame(spark, docs), HELD).collect()), key=repr)


def test_counts_and_base_are_exact(scored):
    docs, got = scored
    c = Counter(t for d, text in docs if not is_held(d) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    want = sorted([(d, is_held(d), len(t := tokens(text)), sum(x in c for x in t), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t)) for d, text in docs], key=repr)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-12)


def test_the_model_beats_the_base_on_held_out_texts(scored):
    _, got = scored
    held = [r for r in got if r[1]]
    n = sum(r[2] for r in held)
    assert sum(r[6] for r in held) / n > sum(r[5] for r in held) / n + 0.2


def test_repeated_rows_score_alike_and_reruns_agree(spark, scored):
    docs, got = scored
    assert len({r[6] for r in got if r[0] == 3}) == 1
    again = sorted((tuple(r) for r in lm.scored_texts(frame(spark, docs).coalesce(1), HELD).collect()), key=repr)
    assert np.allclose([r[6] for r in again], [r[6] for r in got], rtol=1e-9)


def as_rows(spark, docs):
    return frame(spark, docs).select(F.col("doc_id").alias("id"), F.coalesce(HELD(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("text").cast("binary").alias("text"))


@pytest.mark.parametrize("deal", [None, "many"])
def test_scores_follow_the_formula_and_add_up_to_one(spark, monkeypatch, deal):
    docs = texts(60)
    rows = as_rows(spark, docs)
    if deal:  # five shards, two hot words in parts
        hot = np.sort(lm.word_hashes([b"", b"word1"]))
        deal = lm.Deal(5, hot, np.array([3, 2]))
    model = lm.train(rows.where("not held_out"), deal=deal)
    t = model.totals
    counts, mean, seats = {}, {}, {}
    for r in model.shards.collect():
        words, start, contexts, n = lm._unpacked_pairs([r[c] for c in lm._ROW])
        own = unpacked(r.tables) / lm.SAMPLES
        s = unpacked(r.seats).astype(float).reshape(lm.SAMPLES, 2, -1)
        for i, w in enumerate(words.tolist()):
            assert w not in seats
            seats[w] = s[:, :, i]
            for j in range(start[i], start[i + 1]):
                counts[w, int(contexts[j])], mean[w, int(contexts[j])] = int(n[j]), own[j]
    c = Counter(x for d, text in docs if not is_held(d) for x in tokens(text))
    assert len(seats) == len(c) == t.words and sum(counts.values()) == t.tokens
    assert np.allclose(t.parent_customers, sum(s[:, 0] for s in seats.values())) and np.allclose(t.parent_tables, sum(s[:, 1] for s in seats.values()))

    def share(w):
        if w is None:
            return (lm.STRENGTH + t.parent_discount * t.parent_tables) * lm.UNKNOWN / (lm.STRENGTH + t.parent_customers)
        k, s = seats[w].T
        return (k - t.parent_discount * s + (lm.STRENGTH + t.parent_discount * t.parent_tables) * (1 - lm.UNKNOWN) / t.words) / (lm.STRENGTH + t.parent_customers)

    def probability(w, u):
        n = lm.STRENGTH + t.customers[u]
        return (counts.get((w, u), 0) - t.discount * mean.get((w, u), 0.0)) / n + np.mean([(lm.STRENGTH + t.discount * t.tables[s][u]) / n * share(w)[s] for s in range(lm.SAMPLES)])

    def hashed(x):
        return int(lm.word_hashes([x])[0])

    for u in [int(lm.bucket(lm.word_hashes([b"word1"]))[0]), int(lm.bucket(lm.word_hashes([b""]))[0]), 77]:
        assert sum(probability(w, u) for w in [*seats, None]) == pytest.approx(1)
    want = []
    for d, text in docs:
        own = tokens(text)
        before = [b"", *own[:-1]]
        want.append((d, sum(math.log10(probability(hashed(x) if x in c else None, hashed(y) % lm.CONTEXTS)) for x, y in zip(own, before))))
    got = sorted(((r.id, r.score) for r in lm.score(rows, model).collect()), key=repr)
    assert [x for x, _ in got] == [x for x, _ in sorted(want, key=repr)]
    assert np.allclose([x for _, x in got], [x for _, x in sorted(want, key=repr)], rtol=1e-9)


def test_chunks_and_shards_change_no_count(spark, monkeypatch):
    docs = texts(40)
    rows = as_rows(spark, docs)
    one = {r.id: r for r in lm.score(rows.where("id < 1000"), lm.train(rows)).collect() if r.id is not None}
    many = {r.id: r for r in lm.score(rows.where("id < 1000"), lm.train(rows, deal=lm.Deal(7, lm.word_hashes([b"word2"]), np.array([4])))).collect() if r.id is not None}
    assert one.keys() == many.keys()
    for d, r in one.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (many[d].n_tokens, many[d].n_known, many[d].train_tokens)
        assert many[d].base_score == pytest.approx(r.base_score) and many[d].score == pytest.approx(r.score, rel=0.05)


def test_chunks_of_documents_keep_contexts_inside_texts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lm, "CHUNK", 5)
    b = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array([True] * 4), pa.array([b"a b", b"", b"b c d e f", None], pa.binary())], ["id", "held", "text"])
    got = [(ids, sizes.tolist(), words.tolist(), contexts.tolist()) for ids, _, sizes, words, contexts in lm._tokens(iter([b]))]
    assert [g[0] for g in got] == [[1, 2, 3], [4]] and [g[1] for g in got] == [[3, 1, 6], [1]]
    h = lm.word_hashes([b"", b"a", b"b", b"c", b"d", b"e", b"f"])
    end, a, w, c, d, e, f = lm.bucket(h).tolist()
    assert got[0][3] == [end, a, w, end, end, w, c, d, e, f] and got[1][3] == [end]


def seatings(c, t, d):
    """Weight of all seatings of c customers at t tables, customer by customer."""
    if c == 0:
        return 1.0 if t == 0 else 0.0
    total = 0.0
    for new in product([0, 1], repeat=c):
        if sum(new) != t or not new[0]:
            continue
        w, tables = 1.0, 0
        for k, x in enumerate(new):
            if x:
                tables += 1
            else:
                w *= k - d * tables
        total += w
    return total


def test_stirling_numbers():
    got = lm.log_stirling(0.6, 8, 8)
    for c in range(9):
        for t in range(9):
            want = seatings(c, t, 0.6)
            assert got[c, t] == pytest.approx(math.log(want)) if want > 0 else got[c, t] == -np.inf


@pytest.mark.parametrize("draw", [lambda n, c, a, d, rng: lm.draw_tables(np.full(n, c), np.full(n, a), d, rng), lambda n, c, a, d, rng: lm.draw_parent_tables(np.full(n, c), a, d, rng)])
def test_tables_have_their_conditional(draw):
    rng, c, a, d, n = np.random.default_rng(5), 6, 1.7, 0.4, 60_000
    w = np.array([seatings(c, t, d) * a ** t for t in range(1, c + 1)])
    got = np.bincount(draw(n, c, a, d, rng), minlength=c + 1)[1:] / n
    assert np.abs(got - w / w.sum()).max() < 0.01


@pytest.mark.parametrize("d, a, c", [(0.5, 3, 1000), (0.8, 0.1, 1000), (0.8, 100, 1000), (0.8, 30, 100), (0.8, 300, 100), (0.3, 30, 500)])
def test_many_customers_have_nearly_their_conditional(d, a, c):
    t = np.arange(1, min(c, 400) + 1)
    w = lm.log_stirling(d, c, len(t))[c, 1:] + np.log(a) * t
    w = np.exp(w - w.max())
    mean = (w * t).sum() / w.sum()
    spread = np.sqrt((w * (t - mean) ** 2).sum() / w.sum())
    got = lm.draw_tables(np.full(4000, c), np.full(4000, float(a)), d, np.random.default_rng(5))
    assert abs(got.mean() - mean) < 1.1 and got.std() == pytest.approx(spread, rel=0.1)


def test_few_and_very_many_customers():
    got = lm.draw_tables(np.array([0, 1, 2, 64, 65, 10**9]), np.ones(6), 0.5, np.random.default_rng(1))
    assert got[:2].tolist() == [0, 1] and (got[2:] >= 1).all() and got[5] < 1000


@pytest.mark.parametrize("docs", [[], [(5, None)], [(d, "a b") for d in range(100) if is_held(d)][:2]])
def test_empty_tables_and_no_training_texts(spark, docs):
    got = lm.scored_texts(frame(spark, docs), HELD).collect()
    assert len(got) == len(docs)
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)


def test_other_columns_are_not_read(spark):
    d = spark.createDataFrame([(1, "a b", 7, "x", True)], "doc_id int, text string, n_tokens int, id string, held_out boolean")
    got = lm.scored_texts(d, HELD)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"] and got.first().n_tokens == 3


def test_hot_words_of_a_sample(spark):
    docs = [(i, "the " * 30 + f"w{i}") for i in range(400)]
    deal = lm._deal(as_rows(spark, docs))
    assert lm.word_hashes([b"the"])[0] in deal.hot and deal.shards == 1


@pytest.mark.parametrize("x", [np.zeros(0, np.uint64), np.array([1, 2**63], np.uint64), np.array([-5, 7], np.int32), np.array([0.5, np.pi])])
def test_packed_arrays_come_back(x):
    y = unpacked(packed(x))
    assert y.dtype == x.dtype and y.tolist() == x.tolist()
