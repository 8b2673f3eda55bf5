import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import quality


def plain(text):
    import re

    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if x]
    over = lambda a, b: a / max(b, 1)
    n, chars = len(w), len(t)
    return {
        "chars": chars, "words": n, "word_length": over(chars, n), "upper": over(sum(c.isupper() for c in t), chars),
        "marks": over(sum(c in "*&$#%!@^~<>{}[]=+_\\" for c in t), n), "bars": over(t.count("|"), n), "stops": over(sum(c in ".,;:?" for c in t), n),
        "digits": over(sum(c in "0123456789" for c in t), chars), "distinct": over(len(set(w)), n), "echoes": over(sum(a == b for a, b in zip(w, w[1:])), n),
        "lines": len(lines), "line_length": over(chars, len(lines)), "same_lines": over(len(lines) - len(set(lines)), len(lines)), "letters": over(sum(c.isalpha() for c in t), chars),
    }


def test_statistics(spark):
    texts = [None, "", "  \n ", "one", "a a a b\na a a b\n\nÄÖ É | x* 12", "A! B? c; \tword word " * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for r in quality.with_statistics(df, "text").collect():
        want = plain(texts[r.i])
        for s in quality.STATISTICS:
            assert r["_q_" + s] == pytest.approx(want[s]), (r.i, s)


def made(spark, n=600):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.integers(300)}" for _ in range(rng.integers(5, 80))]
        bad = i % 4 == 0
        if bad:
            words = [w + "***" for w in words] if i % 8 else [words[0]] * len(words)
        rows.append((i, " ".join(words), "en", "s"))
        if i % 3:
            labels.append((i, int(not bad), 0))
    rows += [(None, "no id here", "en", "s"), (9001, None, "en", "s"), (9002, "", None, None), (1, rows[1][1], "en", "s"), (9003, "word " * 20000, "en", "s")]
    return spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, source string, score double"), spark.createDataFrame(labels + [(None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int"), rows


def test_held_out_rows_are_scored_well(spark):
    docs, labels, rows = made(spark)
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    right = [r.predicted == (r.doc_id % 4 != 0) for r in got if r.doc_id is not None and r.doc_id < 600 and r.held_out]
    assert sum(right) / len(right) > 0.97
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    flat = quality.quality_scores(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in flat] == [0.5]


def test_compiled_rules_match_the_matrix(spark):
    rng = np.random.default_rng(5)
    x = rng.random((400, len(quality.STATISTICS)))
    y = ((x[:, 3] > 0.6) | ((x[:, 5] < 0.3) & (x[:, 8] > 0.5))).astype("float64")
    rules = quality.tree_rules(x, y)
    a = quality.rule_matrix(x, rules)
    w, b = quality.lasso_logistic(a, y)
    assert 0 < (w != 0).sum() < len(rules) / 2
    model = quality.RuleEnsemble([(r, float(v)) for r, v in zip(rules, w) if v], b)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ["_q_" + s for s in quality.STATISTICS])
    got = [r[0] for r in df.select(model.column()).collect()]
    want = 1 / (1 + np.exp(-(a @ w + b)))
    assert np.allclose(got, want) and ((want > 0.5) == (y > 0.5)).mean() > 0.95
    assert len(model.explain()) == len(model.rules) and not math.isnan(model.intercept)


def test_lasso_optimality():
    rng = np.random.default_rng(2)
    a = (rng.random((300, 12)) > 0.5).astype("float64")
    y = (rng.random(300) < 1 / (1 + np.exp(-(2 * a[:, 0] - 1)))).astype("float64")
    w, b = quality.lasso_logistic(a, y, 0.01, 5000)
    g = a.T @ (1 / (1 + np.exp(-(a @ w + b))) - y) / len(y)
    assert np.all(np.abs(g[w == 0]) <= 0.01 + 1e-4) and np.allclose(g[w != 0], -0.01 * np.sign(w[w != 0]), atol=1e-4)


def test_scoring_runs_no_python(spark):
    docs, _, _ = made(spark, 8)
    model = quality.RuleEnsemble([(((3, True, 0.5),), 1.0)], 0.1)
    plan = model.score(docs.drop("score"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert model.score(docs.drop("score")).columns == [*docs.drop("score").columns, "score"]
    assert model.score(docs.drop("score")).where(F.col("score").isNull()).count() == 0
