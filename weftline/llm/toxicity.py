"""Operator 9, toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other text, labelled or not, is unlabelled and may hide more of them. Numpy
classifiers minimise the non-negative risk estimate

    prior * E_pos[l(f)] + max(0, E_unl[l(-f)] - prior * E_pos[l(-f)]),

where `prior` is the share of toxic ones among the labelled rows that may be learned from, and l is the logistic loss. When a
batch's second term turns negative, its gradient is followed upwards, so the classifiers cannot gain from fitting
unlabelled positives as negatives. The score is the mean of several classifiers, trained on batches in different orders.

A document is the set of its words (runs of letters, lower case) and of their first 3 to 6 letters. The classifiers see those of
these features whose share among positives significantly exceeds that among the unlabelled; Spark counts them.
The fit reads samples of the rows (at most about `positives` and `unlabelled` of them, drawn by a hash); scoring reads every whole text.

Nulls and ties: a null text counts as empty and scores what a text without known features scores. Rows without an id are
scored, not learned from. Of several labels of one document the highest counts. Without labels, or without significant
features, every text scores the prior (0 where there is no label). Empty input gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

POSITIVES = 5_000
UNLABELLED = 12_000
FEATURES = 2_048
#: A feature's G statistic must reach this.
SIGNIFICANT = 16.0
PREFIXES = (3, 4, 5, 6)
MEMBERS = 3
EPOCHS = 80
BATCHES = 8
THRESHOLD = 0.3
CACHE_WORDS = 300_000
#: Rows for which counts of features are held at a time.
BLOCK_ROWS = 500

_WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[int]:
    """Hashes of a word and of its first letters."""
    names = [f"w {word}"] + [f"{n} {word[:n]}" for n in PREFIXES if len(word) >= n]
    return [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x in names]


class _Cache(dict):
    """Word to something made of its features; forgets all when full."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, word: str):
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = self.make(word)
        return found


def document_words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def _count(batches):
    cache = _Cache(lambda w: np.array(features_of(w), "i8"))
    seen, flags = [], []

    def out():
        ids = np.concatenate([np.zeros(0, "i8"), *seen])
        own = np.repeat(np.array(flags, "i8").reshape(-1, 2), [len(s) for s in seen], axis=0)
        found, back = np.unique(ids, return_inverse=True)
        sums = [np.bincount(back, own[:, k], len(found)).astype("i8") for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(found), *map(pa.array, sums)], ["feature", "pos", "unl"])

    for b in batches:
        for text, pos, unl in zip(*(b.column(c).to_pylist() for c in ("text", "pos", "unl"))):
            seen.append(np.unique(np.concatenate([np.zeros(0, "i8"), *map(cache.__getitem__, document_words(text))])))
            flags.append((pos, unl))
            if len(seen) >= BLOCK_ROWS:
                yield out()
                seen, flags = [], []
    if seen:
        yield out()


def _vector(cache: _Cache, text: str | None) -> list[int]:
    return sorted({i for w in document_words(text) for i in cache[w]})


def _index_cache(index: dict[int, int]) -> _Cache:
    return _Cache(lambda w: tuple(index[f] for f in features_of(w) if f in index))


def _vectors(index):
    def run(batches):
        cache = _index_cache(index.value)
        for b in batches:
            rows = [_vector(cache, t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("pos"), b.column("unl"), pa.array(rows, pa.list_(pa.int32()))], ["pos", "unl", "x"])

    return run


class Sparse:
    """Rows of indexes of present features."""

    def __init__(self, rows: list[list[int]]):
        self.n = len(rows)
        self.at = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.index = np.fromiter((i for r in rows for i in r), "i8")

    def dot(self, w: np.ndarray) -> np.ndarray:
        return w[-1] + np.bincount(self.at, w[self.index], self.n)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        out = np.bincount(self.index, g[self.at], size)
        out[-1] = g.sum()
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def nnpu_risk(f_pos: np.ndarray, f_unl: np.ndarray, prior: float) -> tuple[float, float]:
    """The positive part of the risk, and the corrected negative part, which may be below zero."""
    loss = lambda z: np.logaddexp(0, -z)
    return prior * loss(f_pos).mean(), loss(-f_unl).mean() - prior * loss(-f_pos).mean()


def train(pos: list[list[int]], unl: list[list[int]], features: int, prior: float, seed: int, epochs: int = EPOCHS, decay: float = 3e-4, rate: float = 0.05) -> np.ndarray:
    """Weights of the features, and the intercept, by Adam on the non-negative risk."""
    rng = np.random.default_rng(seed)
    w = np.zeros(features + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    n = max(1, min(BATCHES, len(pos) // 16))
    for epoch in range(epochs):
        p, u = np.array_split(rng.permutation(len(pos)), n), np.array_split(rng.permutation(len(unl)), n)
        for i, j in zip(p, u):
            xp, xu = Sparse([pos[k] for k in i]), Sparse([unl[k] for k in j])
            fp, fu = xp.dot(w), xu.dot(w)
            down = xu.back(sigmoid(fu) / xu.n, len(w)) - xp.back(prior * sigmoid(fp) / xp.n, len(w))
            if nnpu_risk(fp, fu, prior)[1] < 0:
                g = -down
            else:
                g = down - xp.back(prior * sigmoid(-fp) / xp.n, len(w))
            g[:-1] += decay * w[:-1]
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w - rate * (1 - epoch / epochs) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


@dataclass
class ToxicityModel:
    features: dict[int, int]
    weights: np.ndarray  # a row for each classifier; the last column is the intercept
    prior: float

    def score(self, docs: DataFrame, text_col: str = "text", out: str = "score") -> DataFrame:
        """Add the score, from 0 to 1, to `docs`."""
        model = docs.sparkSession.sparkContext.broadcast(self)  # at most `features` entries

        @F.pandas_udf("double")
        def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            cache = _index_cache(model.value.features)  # gone with the task
            for t in texts:
                yield pd.Series(model.value.score_texts(t, cache))

        return docs.withColumn(out, scored(F.col(text_col)))

    def score_texts(self, texts, cache: _Cache | None = None) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(texts), self.prior)
        cache = _index_cache(self.features) if cache is None else cache
        x = Sparse([_vector(cache, t) for t in texts])
        return np.mean([sigmoid(x.dot(w)) for w in self.weights], axis=0)


def fold(ident: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; 0 for rows without id."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


def _sample(ident: Column, share: float, salt: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), ident), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, positives: int = POSITIVES, unlabelled: int = UNLABELLED, features: int = FEATURES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", members: int = MEMBERS) -> ToxicityModel:
    """Learn from the rows of `docs` for which `usable` (a condition on the id column) holds, and their labels."""
    spark = docs.sparkSession
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).where(usable).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).alias("_y"))
    rows = docs.where(F.col(id_col).isNotNull()).where(usable).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    n_known, n_pos = known.agg(F.count("*"), F.count(F.when(F.col("_y") == 1, 1))).first()
    n_rows = rows.count()
    prior = n_pos / n_known if n_known else 0.0
    if not 0 < prior < 1:
        return ToxicityModel({}, np.zeros((0, 1)), prior)
    sampled = known.where("_y = 1").where(_sample(F.col("_id"), min(1, positives / n_pos), "positive")).select("_id", F.lit(True).alias("_p"))
    drawn = rows.join(F.broadcast(sampled), "_id", "left").select("text", F.coalesce("_p", F.lit(False)).cast("int").alias("pos"), _sample(F.col("_id"), min(1, unlabelled / max(1, n_rows)), "unlabelled").cast("int").alias("unl"))  # `sampled` has about `positives` ids at most
    drawn = saved(drawn.where("pos + unl > 0"), "toxicity-sample")
    total_pos, total_unl = drawn.agg(F.coalesce(F.sum("pos"), F.lit(0)), F.coalesce(F.sum("unl"), F.lit(0))).first()
    if not total_pos or not total_unl:
        return ToxicityModel({}, np.zeros((0, 1)), prior)
    counts = drawn.mapInArrow(_count, "feature long, pos long, unl long").groupBy("feature").agg(F.sum("pos").alias("p"), F.sum("unl").alias("u"))
    p, u, a, b = F.col("p"), F.col("u"), F.lit(float(total_pos)), F.lit(float(total_unl))
    rate = (p + u) / (a + b)
    g = 2 * (p * F.log(p / (a * rate)) + F.when(u > 0, u * F.log(u / (b * rate))).otherwise(0.0))
    g = g + 2 * (F.when(p < a, (a - p) * F.log((a - p) / (a * (1 - rate)))).otherwise(0.0) + F.when(u < b, (b - u) * F.log((b - u) / (b * (1 - rate)))).otherwise(0.0))
    best = counts.where((p > 1) & (p / a > 1.5 * u / b)).select("feature", g.alias("g")).where(F.col("g") >= SIGNIFICANT).orderBy(F.desc("g"), "feature").limit(features)
    index = {r.feature: i for i, r in enumerate(best.collect())}  # at most `features` rows
    if not index:
        return ToxicityModel({}, np.zeros((0, 1)), prior)
    shared = spark.sparkContext.broadcast(index)
    x = drawn.mapInArrow(_vectors(shared), "pos int, unl int, x array<int>").toArrow()  # bounded by the sample, and the few known features of each row
    found = sorted(zip(x.column("x").to_pylist(), x.column("pos").to_pylist(), x.column("unl").to_pylist()))  # an order that doesn't depend on how rows are dealt
    pick = lambda c: [r[0] for r in found if r[c]]
    weights = np.stack([train(pick(1), pick(2), len(index), prior, seed) for seed in range(members)])
    return ToxicityModel(index, weights, prior)


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out_fold: int = 2, folds: int = 4, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every document; rows of the held-out fold are not learned from."""
    model = fit(docs, labels, fold(F.col(id_col), folds) != held_out_fold, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(F.col(id_col), folds) == held_out_fold).alias("held_out"), F.col(text_col).alias("_text"))
    scored = model.score(rows, "_text").drop("_text")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
