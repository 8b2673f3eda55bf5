import zlib

import numpy as np
import pytest

from weftline.llm import toxicity


def numeric(f, w, e=1e-6):
    out = np.zeros_like(w)
    for k in range(len(w)):
        d = np.zeros_like(w)
        d[k] = e
        out[k] = (f(w + d) - f(w - d)) / (2 * e)
    return out


def test_gradients_of_the_risk():
    rng = np.random.default_rng(3)
    rows = [sorted(rng.choice(6, rng.integers(0, 4), replace=False).tolist()) for _ in range(40)]
    p, u = toxicity.Sparse(rows[:10]), toxicity.Sparse(rows[10:])
    w, prior = rng.normal(size=7), 0.2
    fp, fu = p.dot(w), u.dot(w)
    up = u.back(toxicity.sigmoid(fu) / u.n, 7) - p.back(prior * toxicity.sigmoid(fp) / p.n, 7)
    assert np.allclose(up, numeric(lambda v: toxicity.nnpu_risk(p.dot(v), u.dot(v), prior)[1], w), atol=1e-5)
    first = -p.back(prior * toxicity.sigmoid(-fp) / p.n, 7)
    assert np.allclose(first, numeric(lambda v: toxicity.nnpu_risk(p.dot(v), u.dot(v), prior)[0], w), atol=1e-5)


def test_hidden_positives_among_the_unlabelled_are_found():
    rng = np.random.default_rng(4)
    make = lambda toxic: sorted({int(rng.integers(4)) for _ in range(2)} | {4 + int(rng.integers(20)) for _ in range(3)}) if toxic else sorted({4 + int(rng.integers(20)) for _ in range(3)})
    pos = [make(True) for _ in range(300)]
    truth = rng.random(3000) < 0.2
    unl = [make(t) for t in truth]
    w = toxicity.train(pos, unl, 24, 0.2, 0)
    found = toxicity.sigmoid(toxicity.Sparse(unl).dot(w)) >= 0.3
    assert (found == truth).mean() > 0.98


def made(spark, n=900):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(n):
        words = [f"{a}{b}" for a, b in zip(rng.choice(list("abcdefgh"), 40), rng.choice(["ing", "ed", "or", "est", "al"], 40))]
        bad = i % 6 == 0
        if bad:
            words[int(rng.integers(40))] = str(rng.choice(["Vile", "vilest!", "grotty"]))
        rows.append((i, " ".join(words), "en", "s"))
        if i % 2:
            labels.append((i, 1, int(bad)))
        elif bad and i % 4 == 0:
            labels.append((i, 1, 1))
    rows += [(None, "no id", "en", "s"), (9001, None, "en", "s"), (9002, "", None, None), (9003, "aing " * 20000 + "grotty", "en", "s"), (0, rows[0][1], "en", "s")]
    return spark.createDataFrame([(*r, 0.1) for r in rows], "doc_id long, text string, lang string, source string, score double"), spark.createDataFrame(labels + [(None, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int"), rows


def test_held_out_rows_are_scored_well(spark):
    docs, labels, rows = made(spark)
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    right = [r.predicted == (r.doc_id % 6 == 0) for r in got if r.doc_id is not None and r.doc_id < 900 and r.held_out]
    assert sum(right) / len(right) > 0.97
    assert next(r.predicted for r in got if r.doc_id == 9003) == 1
    again = toxicity.toxicity_scores(docs.repartition(5), labels).collect()
    assert {r.doc_id: r.score for r in again} == pytest.approx({r.doc_id: r.score for r in got})


def test_without_labels_or_rows(spark):
    docs, labels, _ = made(spark, 30)
    assert {r.score for r in toxicity.toxicity_scores(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity_scores(docs.limit(0), labels).count() == 0
