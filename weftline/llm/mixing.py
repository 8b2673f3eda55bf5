"""Operator 6, mixing sources to target weights.

A source's documents stand one behind the other and are cut into blocks of `block` words. The mix is a number of output shards of equally
many slots. Each shard draws how many of its slots each source fills, multinomially over what the sources still have to give; the
last shard takes what is left. The slots of a
source are numbered through all shards; slot number r reads block perm(r mod blocks), where perm is a pseudorandom permutation of the
source's whole blocks, another one each time around, and leaves a shorter block at the source's end for the end of each round. A source's last slot takes only the words that its
target still lacks, so every source ends at its target, rounded to a word. Slots and blocks meet in a join on the block's index.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share all sizes; a target stops at `repeats` times its source's
size and the excess is shared anew by weight. No block is read more than `repeats` times.

Nulls and ties: a null text has no words and is taken 0 times. Null is a source of its own. Rows alike in id, source and text are interchangeable. Empty input, or input without
words, gives the documents with nothing taken. In mixed_texts() a document comes once for each round that takes words of it, under the same doc_id; rows have no order.
The table of sources (about a kilobyte each, for the draws of its shards) is worked out on the driver; everything else is not.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, WORD, prefix_sum, saved

BLOCK = 64
SHARDS = 64
REPEATS = 3
WEIGHTS = (5, 2, 1)
SEED = 20240
#: Documents of one source that one task sorts.
SOURCE_ROWS = 4_000


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> list[Fraction]:
    """Each source's words in the mix; sizes in the sources' order."""
    weigh = [weights[i % len(weights)] for i in range(len(sizes))]
    out = [Fraction(0)] * len(sizes)
    left, open_ = Fraction(sum(sizes)), set(range(len(sizes)))
    while open_:
        unit = left / sum(weigh[i] for i in open_)
        above = {i for i in open_ if unit * weigh[i] > repeats * sizes[i]}
        for i in above or open_:
            out[i] = Fraction(repeats * sizes[i]) if above else unit * weigh[i]
        if not above:
            break
        left -= sum(out[i] for i in above)
        open_ -= above
    return out


def draw_counts(quota: list[int], shards: int, seed: int) -> np.ndarray:
    """(shards, sources): slots of each source in each shard. Columns sum to `quota`, rows differ by one at most."""
    rng, left = np.random.default_rng(seed), np.array(quota, "int64")
    total, out = int(left.sum()), np.zeros((shards, len(quota)), "int64")
    for k in range(shards):
        need = total * (k + 1) // shards - total * k // shards
        while need:
            if need == left.sum():
                got = left.copy()
            else:
                got = np.minimum(rng.multinomial(need, left / left.sum()), left)
            out[k] += got
            left -= got
            need -= int(got.sum())
    return out


def _mixed(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of 0..n-1 under `key`, for each element: a Feistel network that walks until it is inside."""
    x, n, key = (np.asarray(a).astype("uint64") for a in (x, n, key))
    half = np.maximum(1, np.ceil(np.ceil(np.log2(np.maximum(n, 2).astype("float64"))) / 2)).astype("uint64")
    low = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.copy(), np.arange(len(x))
    while len(todo):
        a, b, k, m, h = out[todo] >> half[todo], out[todo] & low[todo], key[todo], low[todo], half[todo]
        for r in range(4):
            a, b = b, a ^ (_mixed(b, k * np.uint64(8) + np.uint64(r)) & m)
        out[todo] = (a << h) | b
        todo = todo[out[todo] >= n[todo]]
    return out.astype("int64")


def slot_counts(words: int, target: int, block: int) -> tuple[int, int]:
    """How many slots a source of so many words fills to give `target` of them, and the words of the last one."""
    if not words or not target:
        return 0, 0
    per_round, (rounds, rest) = -(-words // block), divmod(target, words)
    slots = rounds * per_round + -(-rest // block)
    if rest:
        return slots, rest - (rest - 1) // block * block
    return slots, words - (per_round - 1) * block


def _slots(bounds: np.ndarray, first: np.ndarray, words: np.ndarray, quota: np.ndarray, last: np.ndarray, sources: int, total: int, block: int, seed: int):
    """Slot numbers to slots. bounds: first slot of each (shard, source), shard by shard; first: first slot of each (shard, source) among its source's; words, quota and
    last: of each source, its words, its slots and the words of its last slot."""

    shard_ends = np.append(bounds[max(sources, 1)::max(sources, 1)], total)

    def run(batches):
        for b in batches:
            g = b.column(0).to_numpy()
            cell = np.searchsorted(bounds, g, "right") - 1
            shard, source = cell // sources, cell % sources
            r = first[cell] + g - bounds[cell]
            n, whole = -(-words[source] // block), words[source] // block
            lap, at = r // n, r % n
            inner = np.flatnonzero(at < whole)
            at[inner] = permute(at[inner], whole[inner], (lap[inner] * sources + source[inner]) * 1000003 + seed)
            most = np.where(r == quota[source] - 1, last[source], block)
            begin = bounds[shard * sources]
            end = shard_ends[shard]
            place = permute(g - begin, end - begin, shard + (1 << 40) + seed)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (shard.astype("int32"), place, source.astype("int32"), lap.astype("int32"), at, most)], ["shard", "slot", "_source", "lap", "block", "most"])

    return run


#: Blocks of more words don't fit the parts of mixed_texts().
MOST_BLOCK = (1 << 20) - 1


class Mix:
    """A mix of `docs`. `placed` has a row for each document with words (doc_id, size, source, its place among its source's words);
    `blocks` has the drawn slots, a row for each document part in a slot: shard, slot, source, lap, block, doc_id, from_word, n_words."""

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", repeated: bool = True):
        spark = docs.sparkSession
        if not 0 < block <= MOST_BLOCK:
            raise ValueError(f"a block has 1 to {MOST_BLOCK} words")
        size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
        sizes = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(text_col).alias("text_hash"))
        self.sizes = saved(sizes if repeated else sizes.distinct(), "sizes")
        found = {r.source: (r["size"], r.n) for r in self.sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
        names = sorted((s for s in found if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in found)
        words = [found[s][0] for s in names]
        aims = targets(words, weights, repeats)
        counted = [slot_counts(w, round(t), block) for t, w in zip(aims, words)]
        quota = [n for n, _ in counted]
        kinds = "source string, _source int, source_size long, target double"
        self.sources = spark.createDataFrame([(s, i, w, float(t)) for i, (s, w, t) in enumerate(zip(names, words, aims))], kinds)
        total = sum(quota)
        named = self.sizes.join(self.sources, self.sizes.source.eqNullSafe(self.sources.source)).drop(self.sources.source)
        self.empty = named.where("size = 0")
        most = max((n for _, n in found.values()), default=1)
        self.placed = prefix_sum(named.where("size > 0"), ["_source"], ["doc_id", "text_hash", "size"], F.col("size"), "_start", most, SOURCE_ROWS)
        drawn = draw_counts(quota, shards, seed)
        bounds = np.concatenate([[0], drawn.ravel().cumsum()[:-1]]) if drawn.size else np.zeros(0, "int64")
        first = (drawn.cumsum(0) - drawn).ravel()
        number = lambda x: np.array(x, "int64")
        slots = spark.range(total).mapInArrow(_slots(bounds, first, number(words), number(quota), number([n for _, n in counted]), len(names), total, block, seed), "shard int, slot long, _source int, lap int, block long, most long")
        index = F.explode(F.expr(f"sequence(_start div {block}, (_start + size - 1) div {block})"))
        parts = self.placed.select("doc_id", "text_hash", "size", "_source", "_start", index.alias("block"))
        both = slots.join(parts, ["_source", "block"])
        begin = F.greatest(F.col("_start"), F.col("block") * block)
        end = F.least(F.col("_start") + F.col("size"), F.col("block") * block + F.col("most"))
        both = both.select("shard", "slot", "_source", "lap", "block", "doc_id", "text_hash", "size", "_start", (begin - F.col("_start")).alias("from_word"), (end - begin).alias("n_words"))
        self.blocks = both.where("n_words > 0")

    def report(self) -> DataFrame:
        """doc_id, size, source, source_size, target, taken: one row per document."""
        taken = self.blocks.groupBy("_source", "_start").agg(F.sum("n_words").alias("taken"))
        keep = lambda df: df.select("doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
        return keep(self.placed.join(taken, ["_source", "_start"], "left")).unionByName(keep(self.empty.withColumn("taken", F.lit(0))))


def mix_documents(docs: DataFrame, **kw) -> DataFrame:
    return Mix(docs, **kw).report()


_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS.encode())] = True


def _excerpt(text: str, parts: np.ndarray) -> str:
    """The words of some parts of a text, each first word * 2^20 + number of words; what stood between neighbouring words stays between them."""
    raw = text.encode("utf-8", "surrogatepass")
    blank = np.ones(len(raw) + 2, bool)
    np.take(_BLANK, np.frombuffer(raw, "u1"), out=blank[1:-1])
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edge[::2], edge[1::2]
    parts = np.sort(parts)
    first = parts >> 20
    last = first + (parts & (1 << 20) - 1)
    new = np.flatnonzero(np.concatenate([[True], first[1:] != last[:-1]]))
    to = np.concatenate([last[new[1:] - 1], last[-1:]])
    return b"\n".join(raw[starts[a]:ends[b - 1]] for a, b in zip(first[new], to)).decode("utf-8", "surrogatepass")


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The documents as the mix takes them: for each lap in which blocks of a document are drawn, a row with all its columns and the
    drawn words as its text. Fully drawn documents keep their text as it stands. Repeated rows share their draws."""
    mix = Mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, repeated=False, **kw)
    part = F.col("from_word") * (1 << 20) + F.col("n_words")  # a part has a block's words at most
    drawn = mix.blocks.groupBy("doc_id", "text_hash", "_source", "lap", "size").agg(F.collect_list(part).alias("parts"), F.sum("n_words").alias("drawn"))  # at most a document's blocks
    drawn = drawn.select("doc_id", "text_hash", "_source", F.when(F.col("drawn") < F.col("size"), F.col("parts")).alias("parts")).join(mix.sources.select("_source", "source"), "_source")

    @F.pandas_udf("string")
    def excerpt(text: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([t if p is None else _excerpt(t, np.asarray(p, "i8")) for t, p in zip(text, parts)])

    held = docs.select(F.col(id_col).cast("long").alias("own_id"), F.xxhash64(text_col).alias("own_hash"), F.col(source_col).cast("string").alias("own_source"), F.struct("*").alias("held"))
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash")) & F.col("own_source").eqNullSafe(F.col("source"))
    whole = lambda c: F.col("held").getField(c)
    return held.join(drawn, same).select(*((excerpt(whole(c), "parts") if c == text_col else whole(c)).alias(c) for c in docs.columns))
