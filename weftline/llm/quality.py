"""Operator 4, quality by a sparse rule ensemble.

Statistics of a text are Spark columns. Small trees are grown on a sample of labelled rows; every path from a root is a rule, a
conjunction of comparisons of statistics. Lasso logistic regression over the rules leaves few of them, and those are
compiled back into one Spark column: scoring is a scan without Python.

The fit reads at most about `sample` labelled rows, drawn by a hash; scoring reads every whole text.

Nulls and ties: a null text counts as empty, all of whose statistics are 0; it is scored like any other. Rows without id are scored, not learned from. Of several labels of one document
the highest counts. Where no rows, or only rows of one label, can be learned from, every score is that label's share (0.5 without
labels). Empty input gives no rows. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD
from .toxicity import _sample, fold

SAMPLE = 20_000
TREES = 30
DEPTH = 3
BINS = 32
#: Lasso penalty of each rule's weight.
PENALTY = 2e-3
THRESHOLD = 0.3

#: The statistics, in the order of the fit's columns.
STATISTICS = ("chars", "words", "word_length", "upper", "marks", "bars", "stops", "digits", "distinct", "echoes", "lines", "line_length", "same_lines", "letters")

#: A rule: comparisons (statistic, whether above, threshold) that all hold.
Rule = tuple[tuple[int, bool, float], ...]


def with_statistics(df: DataFrame, text_col: str, prefix: str = "_q_") -> DataFrame:
    """Add a double column for each of STATISTICS, named with `prefix`."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("double")
    df = df.withColumns({f"{prefix}w": F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), f"{prefix}l": F.filter(F.split(t, "\n", -1), lambda x: F.length(x) > 0)})
    w, l = F.col(f"{prefix}w"), F.col(f"{prefix}l")
    n, chars, lines = F.size(w).cast("double"), F.length(t).cast("double"), F.size(l).cast("double")
    over = lambda x, y: x / F.greatest(y, F.lit(1.0))
    echo = F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.when(a == b, 1))
    found = {
        "chars": chars,
        "words": n,
        "word_length": over(chars, n),
        "upper": over(count(r"\p{Lu}"), chars),
        "marks": over(count(r"[*&$#%!@^~<>{}\[\]=+_\\]"), n),
        "bars": over(count(r"\|"), n),
        "stops": over(count(r"[.,;:?]"), n),
        "digits": over(count(r"\d"), chars),
        "distinct": over(F.size(F.array_distinct(w)).cast("double"), n),
        "echoes": over(F.size(F.array_compact(echo)).cast("double"), n),
        "lines": lines,
        "line_length": over(chars, lines),
        "same_lines": over(lines - F.size(F.array_distinct(l)), lines),
        "letters": over(count(r"\p{L}"), chars),
    }
    return df.withColumns({prefix + k: found[k] for k in STATISTICS}).drop(f"{prefix}w", f"{prefix}l")


def cut_points(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Thresholds of each column: middles between neighbouring quantiles."""
    out = []
    for c in x.T:
        q = np.unique(np.quantile(c, np.linspace(0, 1, bins + 1), method="nearest"))
        out.append((q[1:] + q[:-1]) / 2)
    return out


def grow(codes: np.ndarray, y: np.ndarray, weight: np.ndarray, depth: int, features: np.ndarray, n_cuts: list[int], path: tuple = ()) -> list[tuple]:
    """Paths (feature, above, cut index) of a tree by the Gini gain; codes[i, f] is the number of cuts of feature f under the value."""
    total, ones = weight.sum(), (weight * y).sum()
    if not depth or total < 8 or ones <= 0 or ones >= total:
        return []
    best = (1e-9 * total, None, None)
    for f in features:
        if not n_cuts[f]:
            continue
        n = np.bincount(codes[:, f], weight, n_cuts[f] + 1).cumsum()[:-1]
        p = np.bincount(codes[:, f], weight * y, n_cuts[f] + 1).cumsum()[:-1]
        ok = (n >= 4) & (total - n >= 4)
        m, q = np.where(ok, n, 1), np.where(ok, total - n, 1)
        gain = np.where(ok, p * p / m + (ones - p) ** 2 / q - ones * ones / total, 0)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], int(f), k)
    if best[1] is None:
        return []
    _, f, k = best
    out = []
    for above in (False, True):
        side = (codes[:, f] > k) == above
        own = (*path, (f, above, k))
        out += [own, *grow(codes[side], y[side], weight[side], depth - 1, features, n_cuts, own)]
    return out


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 1) -> list[Rule]:
    """Distinct paths of trees over bootstrap samples and random halves of the statistics."""
    rng, cuts = np.random.default_rng(seed), cut_points(x)
    codes = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], axis=1)
    found: dict[Rule, None] = {}
    for _ in range(trees):
        weight = rng.multinomial(len(y), np.full(len(y), 1 / len(y))).astype("float64")
        some = rng.permutation(x.shape[1])[:max(2, x.shape[1] // 2)]
        for path in grow(codes, y, weight, depth, some, [len(c) for c in cuts]):
            found[tuple(sorted((f, above, float(cuts[f][k])) for f, above, k in path))] = None
    return list(found)


def rule_matrix(x: np.ndarray, rules: list[Rule]) -> np.ndarray:
    out = np.empty((len(x), len(rules)))
    for r, rule in enumerate(rules):
        out[:, r] = np.logical_and.reduce([(x[:, f] > t) == above for f, above, t in rule])
    return out


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the mean logistic loss plus `penalty` times the weights' absolute sum, by accelerated proximal
    gradient steps. Columns are centred for the fit; the intercept has no penalty."""
    mean = a.mean(0)
    c = a - mean
    rate = 4 / max(1e-9, np.linalg.norm(c, 2) ** 2 / len(y) + 1)
    w, b = np.zeros(a.shape[1]), 0.0
    vw, vb, t = w, b, 1.0
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-np.clip(c @ vw + vb, -40, 40))) - y
        step = vw - rate * (c.T @ g) / len(y)
        new = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        new_b = vb - rate * g.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return w, float(b - mean @ w)


@dataclass
class RuleEnsemble:
    rules: list[tuple[Rule, float]]  # those of nonzero weight
    intercept: float

    def column(self, prefix: str = "_q_") -> Column:
        """The score, from 0 to 1, over the columns of with_statistics()."""
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            holds = None
            for f, above, t in rule:
                c = F.col(prefix + STATISTICS[f])
                one = c > t if above else c <= t
                holds = one if holds is None else holds & one
            z = z + F.when(holds, F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-z))

    def score(self, docs: DataFrame, text_col: str = "text", out: str = "score") -> DataFrame:
        """`docs` with the score; a column of the name `out` is replaced."""
        held = with_statistics(docs.select(F.struct("*").alias("held"), F.col(text_col).alias("text")), "text")
        return held.select(*(F.col("held").getField(c).alias(c) for c in docs.columns if c.lower() != out.lower()), self.column().alias(out))

    def explain(self) -> list[str]:
        """The rules in words, strongest first."""
        text = lambda rule: " and ".join(f"{STATISTICS[f]} {'>' if above else '<='} {t:.4g}" for f, above, t in rule)
        return [f"{w:+.3f} if {text(rule)}" for rule, w in sorted(self.rules, key=lambda r: -abs(r[1]))]


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", trees: int = TREES, penalty: float = PENALTY) -> RuleEnsemble:
    """Learn from the labelled rows for which `usable` (a condition on the id column) holds."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).where(usable).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("double").alias("_y"))
    n, ones = known.agg(F.count("*"), F.count(F.when(F.col("_y") == 1, 1))).first()
    share = ones / n if n else 0.5
    flat = RuleEnsemble([], float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    if not 0 < ones < n:
        return flat
    drawn = known.where(_sample(F.col("_id"), min(1, sample / n), "quality"))  # about `sample` rows at most
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(drawn), "_id")
    found = with_statistics(rows, "_text").select("_id", "_y", *("_q_" + s for s in STATISTICS)).toArrow().to_pandas().sort_values(["_id", "_q_chars"])
    y = found["_y"].to_numpy()
    if not len(y) or y.min() == y.max():
        return flat
    x = found[["_q_" + s for s in STATISTICS]].to_numpy("float64")
    rules = tree_rules(x, y, trees)
    if not rules:
        return flat
    a = rule_matrix(x, rules)
    _, first = np.unique(a, axis=1, return_index=True)  # of rules alike on the sample, the first
    rules = [rules[i] for i in sorted(first)]
    w, b = lasso_logistic(a[:, sorted(first)], y, penalty)
    return RuleEnsemble([(r, float(v)) for r, v in zip(rules, w) if v], b)


def quality_scores(docs: DataFrame, labels: DataFrame, held_out_fold: int = 0, folds: int = 5, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every document; rows of the held-out fold are not learned from."""
    model = fit(docs, labels, fold(F.col(id_col), folds) != held_out_fold, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(F.col(id_col), folds) == held_out_fold).alias("held_out"), F.col(text_col).alias("_text"))
    return model.score(rows, "_text").drop("_text").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
