"""Language-model scoring by a hierarchical Pitman-Yor model of words after words.

A word is a customer of the restaurant of its context, which is a bucket of the hash of the word before it (the end of a text at its start). All context restaurants share one parent, whose
customers are their tables; its base gives a share to the one event "unknown word" and spreads the rest evenly over the words of the training texts. Given all else, the number of
tables that serve a word in a restaurant is drawn from its exact conditional (generalised Stirling numbers), which is a Gibbs step over the seating of all the word's customers; for more than
SMALL customers, from a law of the same leading mean and variance. A text's probability is the product of its tokens' predictive probabilities, each averaged over the samples.

How the work is spread: tasks count their tokens by word and context and deal them to shards by ranges of word hashes, packed; a shard holds all contexts of its words, so a word's tables
and its share of the parent stay in one row. Between shards only the restaurants' totals pass, arrays of as many numbers as there are buckets. Words with a large share of a sample are
shards of their own, whose counts are merged, and whose tokens are scored, in parts. Texts are then dealt to the same shards, which hand back each document's partial sums.

Words are told apart by 64 bits of hash. Nulls and ties: a null text is an empty one, which has the end token only; a null doc_id counts as one that may be learned from; all rows are kept,
repeated ones too, and other columns are not read. Without training tokens all words are unknown and the base is one event.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, saved, small_batches, unpacked

#: Buckets of contexts, in bits; the arrays that pass between shards have so many numbers.
CONTEXT_BITS = 18
CONTEXTS = 1 << CONTEXT_BITS
#: Tokens that a task gathers before it deals them out, and tokens of a shard.
CHUNK = 1 << 21
SHARD = 1 << 21
#: A part of the documents, by hash, is read to find words that need shards of their own, of at least this share and so at most as many; this only sets how the work is dealt.
SAMPLED, HOT = 16, 1 / 512
MOST_PARTS = 4096
#: Customers of a dish up to which the number of tables is drawn from its exact conditional.
SMALL = 64
#: Rows of the parent's table of Stirling numbers; more customers are seated as so many.
PARENT = 1 << 14
BURN_IN, SAMPLES = 2, 3
STRENGTH = 1.0
#: Share of the base for the event "unknown word".
UNKNOWN = 0.5
#: Ranges that arrays over the contexts are cut into, and parts in which their sums are taken first.
SLICES, PARTS = 16, 64

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes; the end token is the empty word."""
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def bucket(hashes: np.ndarray) -> np.ndarray:
    """The context bucket of a word: bits that take no part in dealing words to shards."""
    return (hashes & np.uint64(CONTEXTS - 1)).astype(np.int64)


@dataclass
class Deal:
    """How words go to shards: even ranges of hashes, and a shard for each of some words, with the number of its parts."""
    shards: int
    hot: np.ndarray
    parts: np.ndarray

    def cuts(self, words: np.ndarray) -> np.ndarray:
        """Where each range's words begin in sorted words."""
        edges = [(i << 64) // self.shards for i in range(self.shards)]
        return np.append(np.searchsorted(words, np.array(edges, np.uint64)), len(words))


def _deal(docs: DataFrame) -> Deal:
    total = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("rows")).first()
    tokens = (total.bytes or 0) // 6 + total.rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = Counter()
            for t in b.column(0).to_pylist():
                found.update(words_of(t or b""))
                found[b""] += 1
            n = sum(found.values())
            often = [(w, k) for w, k in found.items() if k >= HOT * n / 2]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in often] + [None], pa.binary()), pa.array([k for _, k in often] + [n], pa.int64())], ["word", "n"])

    sample = docs.where(F.pmod(F.xxhash64("id", "text"), F.lit(SAMPLED)) == 0).select("text")
    n = sample.mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    n = {None if r.word is None else bytes(r.word): r.n for r in n.collect()}  # a batch has at most 2 / HOT words of such a share
    whole = max(n.pop(None, 0), 1)
    shards = max(1, -(-tokens // SHARD))
    hot = sorted((int(h), k / whole) for h, k in zip(word_hashes(list(n)).tolist(), n.values()) if k / whole >= max(HOT, 1 / (4 * shards)))
    return Deal(shards, np.array([h for h, _ in hot], np.uint64), np.array([min(MOST_PARTS, int(share * tokens) // SHARD + 1) for _, share in hot], np.int64))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Documents in chunks of about CHUNK tokens: ids, held_out, tokens of each, and for every token its word's hash and its context."""
    ids, held, sizes, hashes = [], [], [], []
    n = 0
    for b in batches:
        for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            words = words_of(t.as_buffer().to_pybytes() if t.is_valid else b"")
            words.append(b"")
            ids.append(i)
            held.append(h)
            sizes.append(len(words))
            hashes.append(word_hashes(words))
            n += len(words)
            if n >= CHUNK:
                yield ids, held, np.array(sizes), *_with_context(hashes)
                ids, held, sizes, hashes, n = [], [], [], [], 0
    if ids:
        yield ids, held, np.array(sizes), *_with_context(hashes)


def _with_context(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Every text ends with the end token, so the token before a text's first one is an end token, too."""
    own = np.concatenate(hashes)
    before = np.empty_like(own)
    before[1:], before[0] = own[:-1], own[-1]
    return own, bucket(before)


def _dealt(deal: Deal, words: np.ndarray, start: np.ndarray, salt: int) -> Iterator[tuple[int, int, slice, slice]]:
    """Shard, part, words and entries, from sorted words and where the entries of each begin (one more than words)."""
    is_hot = np.isin(words, deal.hot)
    for s, (x, y) in enumerate(zip((cuts := deal.cuts(words))[:-1].tolist(), cuts[1:].tolist())):
        edges = np.flatnonzero(is_hot[x:y]) + x
        for a, b in zip([x, *(edges + 1)], [*edges, y]):
            if a < b:
                yield s, 0, slice(a, b), slice(start[a], start[b])
        for e in edges.tolist():
            i = int(np.searchsorted(deal.hot, words[e]))
            yield deal.shards + i, salt % int(deal.parts[i]), slice(e, e + 1), slice(start[e], start[e + 1])


def sorted_pairs(words: np.ndarray, contexts: np.ndarray, *values: np.ndarray) -> tuple:
    """Entries in the order of (word, context): the words, where the entries of each begin, and the entries' contexts and values."""
    own, which = np.unique(words, return_inverse=True)
    key = which.astype(np.int64) << CONTEXT_BITS | contexts
    order = np.argsort(key, kind="stable")
    key = key[order]
    return own, np.searchsorted(key >> CONTEXT_BITS, np.arange(len(own) + 1)), key & (CONTEXTS - 1), *(v[order] for v in values)


def counted_pairs(words: np.ndarray, contexts: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs: the words, where the pairs of each begin, the pairs' contexts and counts."""
    own, start, contexts, times = sorted_pairs(words, contexts, times)
    which = np.repeat(np.arange(len(own)), np.diff(start))
    first = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (contexts[1:] != contexts[:-1])][:len(which)])
    return own, np.searchsorted(which[first], np.arange(len(own) + 1)), contexts[first], np.add.reduceat(times, first) if len(first) else times


#: Packed arrays of a row: words, entries of each, and by entry the context and the count, or the document.
PAIRS = "words binary, widths binary, contexts binary, counts binary"
_ROW = ["words", "widths", "contexts", "counts"]


def _packed_pairs(words, start, contexts, values) -> list[bytes]:
    return [packed(np.diff(words, prepend=np.uint64(0))), packed(np.diff(start).astype(np.uint32)), packed(np.diff(contexts, prepend=0).astype(np.int32)), packed(values.astype(np.uint64 if len(values) and values.max() >= 1 << 32 else np.uint32))]


def _unpacked_pairs(row: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    words, widths, contexts, values = map(unpacked, row)
    return np.cumsum(words, dtype=np.uint64), np.append(0, np.cumsum(widths, dtype=np.int64)), np.cumsum(contexts, dtype=np.int64), values.astype(np.int64)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * len(types), types)], names)


def _training_pairs(deal: Deal):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId()
        for _, _, _, hashes, contexts in _tokens(batches):
            words, start, contexts, times = counted_pairs(hashes, contexts, np.ones(len(hashes), np.int64))
            salt += 1
            rows = [(s, p, *_packed_pairs(words[w], start[w.start:w.stop + 1], contexts[e], times[e])) for s, p, w, e in _dealt(deal, words, start, salt)]
            yield _batch(rows, ["shard", "part", *_ROW], [pa.int64(), pa.int64(), *[pa.binary()] * 4])
    return count


def _merged(table: pa.Table) -> pa.Table:
    """One row of a group's rows, equal pairs added up."""
    rows = [_unpacked_pairs(list(r)) for r in zip(*(table[c].to_pylist() for c in _ROW))]
    words = np.concatenate([np.repeat(r[0], np.diff(r[1])) for r in rows])
    out = counted_pairs(words, np.concatenate([r[2] for r in rows]), np.concatenate([r[3] for r in rows]))
    return pa.Table.from_batches([_batch([(table["shard"][0].as_py(), *_packed_pairs(*out))], ["shard", *_ROW], [pa.int64(), *[pa.binary()] * 4])])


def _sums(arrays: list[np.ndarray]) -> Iterator[tuple]:
    """Arrays over the contexts, in slices."""
    both = np.stack(arrays)
    for i, x in enumerate(np.array_split(both, SLICES, axis=1)):
        yield i, x.astype("<i8").tobytes()


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, "<i8") for x in table["data"].to_pylist())
    return pa.table({"slice": table["slice"][:1], "part": table["part"][:1], "data": pa.array([total.tobytes()], pa.binary())})


def _context_sums(rows: DataFrame, arrays: int) -> np.ndarray:
    """The sums over all tasks of `arrays` arrays over the contexts, from rows (slice, part, data): first within parts, then over these."""
    kind = "slice bigint, part bigint, data binary"
    rows = rows.groupBy("slice", "part").applyInArrow(_added, kind).groupBy("slice").applyInArrow(_added, kind)
    out = [np.zeros((arrays, len(x)), np.int64) for x in np.array_split(np.zeros(CONTEXTS), SLICES)]
    for r in rows.collect():
        out[r.slice] = np.frombuffer(r.data, "<i8").reshape(arrays, -1)
    return np.concatenate(out, axis=1)


#: Numbers that go with the sums over contexts, in a slice of their own.
_TOTALS = ["tokens", "words", "pairs", "pairs_1", "pairs_2", "words_1", "words_2"]


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums, totals = np.zeros((2, CONTEXTS), np.int64), np.zeros(len(_TOTALS), np.int64)
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(1, 5))):
            words, start, contexts, counts = _unpacked_pairs(list(row))
            sums[0] += np.bincount(contexts, counts, CONTEXTS).astype(np.int64)
            sums[1] += np.bincount(contexts, minlength=CONTEXTS)
            wide = np.diff(start)
            totals += [counts.sum(), len(words), len(counts), (counts == 1).sum(), (counts == 2).sum(), (wide == 1).sum(), (wide == 2).sum()]
    part = TaskContext.get().partitionId() % PARTS
    yield _batch([(i, part, x) for i, x in _sums(list(sums))] + [(SLICES, part, totals.astype("<i8").tobytes())], ["slice", "part", "data"], [pa.int64(), pa.int64(), pa.binary()])


def discount(once: int, twice: int) -> float:
    """From how many things occur once and twice."""
    return float(min(max(once / (once + 2 * twice) if once else 0.5, 0.05), 0.95))


@lru_cache
def log_stirling(d: float, customers: int, tables: int) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: the weight of all seatings of c customers at t tables, [c, t]."""
    out = np.full((customers + 1, tables + 1), -np.inf)
    out[0, 0] = 0
    t = np.arange(1, tables + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(customers):
            stay = np.where(c - d * t > 0, np.log(np.maximum(c - d * t, 1e-300)), -np.inf)
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay + out[c, 1:])
    return out


def draw_tables(counts: np.ndarray, weight: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables that serve a dish: one draw for each of `counts` customers, where a new table weighs `weight` and a table with n customers n - d."""
    tables = np.minimum(counts, 1)
    table = log_stirling(d, SMALL, SMALL)
    first = np.minimum(counts, SMALL)
    order = np.argsort(first, kind="stable")
    edges = np.searchsorted(first[order], np.arange(2, SMALL + 2))
    with np.errstate(divide="ignore"):
        log_weight = np.log(weight)
    for c, x, y in zip(range(2, SMALL + 1), edges[:-1].tolist(), edges[1:].tolist()):
        for at in (order[i:i + (1 << 16)] for i in range(x, y, 1 << 16)):
            w = table[c, 1:c + 1] + log_weight[at, None] * np.arange(1, c + 1)
            w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
            tables[at] = 1 + (w < rng.random((len(at), 1)) * w[:, -1:]).sum(axis=1)
    many = np.flatnonzero(counts > SMALL)
    if len(many):
        tables[many] = _tables_of_many(counts[many], weight[many], d, rng)
    return tables


def _tables_of_many(counts: np.ndarray, weight: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """As draw_tables, for many customers: a binomial draw with the mean and variance that the conditional has at the saddle point of its generating function exp(weight (1 - y^d) / d), y = 1 - x."""
    low, high, want = np.full(len(counts), -150.0), np.zeros(len(counts)), np.log(counts / weight)
    for _ in range(60):
        mid = (low + high) / 2
        with np.errstate(divide="ignore"):
            below = np.log(-np.expm1(mid)) + (d - 1) * mid > want
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    y = np.exp(low)
    x, shape = -np.expm1(low), -np.expm1(d * low) / d
    mean, first = weight * shape, x * y ** (d - 1) / shape  # of the tables, and of a table's customers
    second = first + x * x * (1 - d) * y ** (d - 2) / shape
    chance = np.clip(first * first / second, 1e-12, 1)
    n = np.maximum(1, np.rint(mean / chance)).astype(np.int64)
    return np.minimum(1 + rng.binomial(n, np.minimum(1, mean / n)), counts)


def draw_parent_tables(customers: np.ndarray, weight: float, d: float, rng: np.random.Generator, most: int = 64) -> np.ndarray:
    """As draw_tables, for many customers and one small weight, with which over `most` tables don't come up."""
    customers = np.minimum(customers, PARENT)
    out = np.zeros(len(customers), np.int64)
    kinds, which = np.unique(customers, return_inverse=True)
    w = log_stirling(d, int(kinds[-1]) if len(kinds) else 0, most)[kinds, 1:] + np.log(weight) * np.arange(1, most + 1)
    w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
    for i in range(0, len(out), 1 << 16):
        own = w[which[i:i + (1 << 16)]]
        out[i:i + (1 << 16)] = 1 + (own < rng.random((len(own), 1)) * own[:, -1:]).sum(axis=1)
    return out


@dataclass
class Totals:
    """What passes between shards: numbers of the training texts, discounts, and totals of the restaurants, by sample where there are some."""
    tokens: int
    words: int
    discount: float
    parent_discount: float
    customers: np.ndarray
    tables: np.ndarray
    parent_customers: np.ndarray
    parent_tables: np.ndarray

    def parent_new(self) -> np.ndarray:
        """The parent's weight of a new table, for each sample."""
        return STRENGTH + self.parent_discount * self.parent_tables

    def word_share(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The parent's probability of words, from their customers and tables in it; without training words there are none."""
        return (customers - self.parent_discount * tables + self.parent_new() * ((1 - UNKNOWN) / max(self.words, 1))) / (STRENGTH + self.parent_customers)

    def unknown_share(self) -> np.ndarray:
        return self.parent_new() * (UNKNOWN if self.words else 1.0) / (STRENGTH + self.parent_customers)

    def predictive(self, contexts: np.ndarray, counts: np.ndarray, tables: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Averaged predictive probabilities of tokens. counts, tables: of the word in the context's restaurant, tables averaged over the samples; share: [token, sample]."""
        n = STRENGTH + self.customers[contexts]
        out = (counts - self.discount * tables) / n
        for s in range(share.shape[1]):
            out += (STRENGTH + self.discount * self.tables[s][contexts]) / n * share[:, s] / share.shape[1]
        return out


def gibbs(start: np.ndarray, contexts: np.ndarray, counts: np.ndarray, totals: Totals, sweeps: int, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sweeps over one shard's words, the other shards' totals being given: tables of each pair, and each word's customers and tables in the parent."""
    which = np.repeat(np.arange(len(start) - 1), np.diff(start))
    new = STRENGTH + totals.discount * totals.tables[-1][contexts]
    parent_new = float(totals.parent_new()[-1]) * (1 - UNKNOWN) / max(totals.words, 1)
    customers = np.diff(start)  # at first, a table a pair
    seats = np.minimum(customers, 1)
    for _ in range(sweeps):
        share = totals.word_share(customers, seats)
        tables = draw_tables(counts, new * share[which], totals.discount, rng)
        customers = np.add.reduceat(tables, start[:-1]) if len(tables) else tables
        seats = draw_parent_tables(customers, parent_new, totals.parent_discount, rng)
        yield tables, customers, seats


def _sampled(shared, sweeps: int, turn: int, seed: int, keep: bool):
    """Sweeps over shards. Rows: the sums of all that passes between shards, for the last sweep or, with keep, for each; with keep, the shards' words and pairs with their tables, too."""
    n = sweeps if keep else 1

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["shard", *_ROW, "tables", "seats", "slice", "part", "data"], [pa.int64(), *[pa.binary()] * 6, pa.int64(), pa.int64(), pa.binary()]
        totals: Totals = shared.value
        sums, numbers = np.zeros((n, CONTEXTS), np.int64), np.zeros(2 * n, np.int64)
        for b in batches:
            for shard, *row in zip(*(b.column(i).to_pylist() for i in range(5))):
                words, start, contexts, counts = _unpacked_pairs(row)
                every, seats = np.zeros(len(counts), np.int64), []
                for s, (tables, customers, own) in enumerate(gibbs(start, contexts, counts, totals, sweeps, np.random.default_rng([seed, turn, shard]))):
                    if keep or s == sweeps - 1:
                        at = s if keep else 0
                        sums[at] += np.bincount(contexts, tables, CONTEXTS).astype(np.int64)
                        numbers[2 * at:2 * at + 2] += [customers.sum(), own.sum()]
                    every += tables
                    seats += [customers, own]
                if keep:
                    yield _batch([(shard, *row, packed(every.astype(np.uint64 if len(every) and every.max() >= 1 << 32 else np.uint32)), packed(np.concatenate(seats).astype(np.uint64)), None, None, None)], names, types)
        part = TaskContext.get().partitionId() % PARTS
        yield _batch([(None, *[None] * 6, i, part, x) for i, x in [*_sums(list(sums)), (SLICES, numbers.astype("<i8").tobytes())]], names, types)
    return sample


def _numbers(rows: DataFrame) -> np.ndarray | None:
    got = rows.where(F.col("slice") == SLICES).groupBy("slice", "part").applyInArrow(_added, "slice bigint, part bigint, data binary").groupBy("slice").applyInArrow(_added, "slice bigint, part bigint, data binary").collect()
    return np.frombuffer(got[0].data, "<i8") if got else None


@dataclass
class Model:
    """A trained model: how words are dealt, its shards (a written table), and the totals of its samples."""
    deal: Deal
    shards: DataFrame
    totals: Totals


def train(docs: DataFrame, deal: Deal | None = None, burn_in: int = BURN_IN, samples: int = SAMPLES, seed: int = 1) -> Model:
    """A model of the texts of docs(id, held_out, text), all of which it learns from."""
    spark = docs.sparkSession
    deal = deal or _deal(docs)
    kind, keys = f"shard bigint, {PAIRS}", ["shard", "part"]
    pairs = docs.mapInArrow(_training_pairs(deal), f"shard bigint, part bigint, {PAIRS}").groupBy(*keys).applyInArrow(_merged, kind)
    pairs = saved(pairs, "pairs")
    if len(deal.hot):
        own = pairs.where(F.col("shard") >= deal.shards).groupBy("shard").applyInArrow(_merged, kind)
        pairs = pairs.where(F.col("shard") < deal.shards).unionByName(saved(own, "hot-pairs"))
    stats = saved(pairs.mapInArrow(_stats, "slice bigint, part bigint, data binary"), "pair-sums")
    numbers = _numbers(stats)
    n = dict(zip(_TOTALS, (numbers if numbers is not None else np.zeros(len(_TOTALS), np.int64)).tolist()))
    sums = _context_sums(stats.where(F.col("slice") < SLICES), 2)
    one = lambda x: np.array([x], float)
    totals = Totals(n["tokens"], n["words"], discount(n["pairs_1"], n["pairs_2"]), discount(n["words_1"], n["words_2"]), sums[0], sums[1:], one(n["pairs"]), one(n["words"]))
    for turn, (sweeps, keep) in enumerate([(burn_in, False), (samples, True)]):
        if not sweeps:
            continue
        schema = f"shard bigint, {PAIRS}, tables binary, seats binary, slice bigint, part bigint, data binary"
        rows = saved(pairs.mapInArrow(_sampled(spark.sparkContext.broadcast(totals), sweeps, turn, seed, keep), schema), "samples")
        m = samples if keep else 1
        drawn = rows.where("data IS NOT NULL").select("slice", "part", "data")
        numbers = _numbers(drawn)
        numbers = (numbers if numbers is not None else np.zeros(2 * m, np.int64)).reshape(m, 2).astype(float)
        totals = Totals(totals.tokens, totals.words, totals.discount, totals.parent_discount, totals.customers, _context_sums(drawn.where(F.col("slice") < SLICES), m), numbers[:, 0], numbers[:, 1])
    return Model(deal, rows.where("data IS NULL").drop("slice", "part", "data"), totals)


def _requests(deal: Deal):
    """Rows of tokens for the shards, and a row of its documents for each chunk, which goes to a shard of its own (below 0)."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "part", "chunk", *_ROW, "ids", "held", "sizes"]
        types = [pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 4, pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64())]
        task = TaskContext.get().partitionId()
        for k, (ids, held, sizes, hashes, contexts) in enumerate(_tokens(batches)):
            chunk = task << 32 | k
            words, start, contexts, docs = sorted_pairs(hashes, contexts, np.repeat(np.arange(len(ids)), sizes))
            rows = [(s, p, chunk, *_packed_pairs(words[w], start[w.start:w.stop + 1], contexts[e], docs[e]), None, None, None) for s, p, w, e in _dealt(deal, words, start, task + k)]
            yield _batch([*rows, (-1 - chunk, 0, chunk, None, None, None, None, ids, held, sizes.tolist())], names, types)
    return ask


def _scored(shared, samples: int):
    """A shard's tokens: for each chunk, its documents with tokens here, and their numbers of known tokens and sums of logarithms."""
    def score(table: pa.Table) -> pa.Table:
        totals: Totals = shared.value
        names, types = ["chunk", "docs", "known", "base", "score", "ids", "held", "sizes"], [pa.int64(), *[pa.binary()] * 4, pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64())]
        rows = table.to_pylist()
        of_model = next((r for r in rows if r["chunk"] is None), None)
        if of_model:
            words, start, contexts, counts = _unpacked_pairs([of_model[c] for c in _ROW])
            key = np.repeat(np.arange(len(words)), np.diff(start)) << CONTEXT_BITS | contexts
            mean = unpacked(of_model["tables"]) / samples
            seats = unpacked(of_model["seats"]).astype(float).reshape(samples, 2, len(words))
            share, times = totals.word_share(seats[:, 0].T, seats[:, 1].T), np.add.reduceat(counts, start[:-1])
        else:
            words, key, counts, mean, times, share = np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 4, np.zeros((0, samples))
        # one more of each, for what isn't there
        times, share, counts, mean = np.append(times, 0), np.vstack([share, totals.unknown_share()]), np.append(counts, 0), np.append(mean, 0)
        base = np.log10((times + 1) / (totals.tokens + totals.words + 1))
        out = []
        for r in rows:
            if r["chunk"] is None:
                continue
            if r["words"] is None:
                out.append((r["chunk"], None, None, None, None, r["ids"], r["held"], r["sizes"]))
                continue
            asked, begin, contexts, docs = _unpacked_pairs([r[c] for c in _ROW])
            at = np.searchsorted(words, asked)
            at[(at == len(words)) | (np.append(words, np.uint64(0))[at] != asked)] = len(words)
            at = np.repeat(at, np.diff(begin))
            wanted = at << CONTEXT_BITS | contexts
            pair = np.searchsorted(key, wanted)
            pair[(np.append(key, -1)[pair] != wanted) | (at == len(words))] = len(key)
            found = np.log10(totals.predictive(contexts, counts[pair], mean[pair], share[at]))
            here, which = np.unique(docs, return_inverse=True)
            add = lambda x: np.bincount(which, x, len(here))
            out.append((r["chunk"], packed(here.astype(np.uint32)), packed(add(times[at] > 0).astype(np.uint32)), packed(add(base[at])), packed(add(found)), None, None, None))
        return pa.Table.from_batches([_batch(out, names, types)])
    return score


def _documents(n_train: int, id_type: pa.DataType):
    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        of = next(r for r in rows if r["docs"] is None)
        known, base, score = np.zeros((3, len(of["ids"])))
        for r in sorted((r for r in rows if r["docs"] is not None), key=lambda r: r["docs"] + r["score"]):  # always added up in one order
            at = unpacked(r["docs"])
            known[at] += unpacked(r["known"])
            base[at] += unpacked(r["base"])
            score[at] += unpacked(r["score"])
        return pa.table([pa.array(of["ids"], pa.int64()).cast(id_type), pa.array(of["held"], pa.bool_()), pa.array(of["sizes"], pa.int64()), pa.array(known.astype(np.int64)), pa.array(np.full(len(known), n_train)), pa.array(base), pa.array(score)],
                        names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return add


def score(docs: DataFrame, model: Model) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of docs(id, held_out, text)."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    id_type = docs.schema["id"].dataType
    samples = len(model.totals.parent_tables)
    sent = f"chunk bigint, {PAIRS}, ids array<bigint>, held array<boolean>, sizes array<bigint>"
    asked = docs.mapInArrow(_requests(model.deal), f"shard bigint, part bigint, {sent}")
    own = model.shards
    parts = F.lit(0).cast("long")
    if len(model.deal.hot):
        # a shard of one word is sent to all its parts; it has at most as many pairs as there are contexts
        parts = F.coalesce(F.get(F.lit(model.deal.parts.tolist()), (F.col("shard") - model.deal.shards).cast("int")), F.lit(1)) - 1
        parts = F.when(F.col("shard") >= model.deal.shards, parts).otherwise(0).cast("long")
    own = own.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts)))
    both = asked.unionByName(own, allowMissingColumns=True)
    sums = both.groupBy("shard", "part").applyInArrow(_scored(spark.sparkContext.broadcast(model.totals), samples), "chunk bigint, docs binary, known binary, base binary, score binary, ids array<bigint>, held array<boolean>, sizes array<bigint>")
    return sums.groupBy("chunk").applyInArrow(_documents(model.totals.tokens, to_arrow_type(id_type)), f"id {id_type.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def scored_texts(docs: DataFrame, held_out: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Train on the rows that aren't held out (a condition on the id), and score all. `id_col` is of an integer type."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    model = train(rows.where(~F.col("held_out")), **how)
    return score(rows, model).withColumnRenamed("id", id_col)
