"""Operator 2, line dedup by an exact set-similarity join.

A line is the set of its words (A-Z lower-cased, split at x20 and x09-x0D). A line with `min_words` words or more is removed when
the set of an earlier one (by doc_id, then line number) has a Jaccard similarity of `threshold` or more with its own. Nothing
is capped, and whole lines are compared.

1. Rarity: the words of all texts are counted in a table of 2^20 hashed cells. Its size is fixed; it only sets the order of words.
2. Equal sets: lines are dealt by the 128-bit hash of their set; all but a set's first line are matches at once.
3. Candidates: a set's words are ordered by rarity and its prefix (the words of which two similar sets must share one) is dealt by word.
   A word whose cell counts over `FREQUENT` isn't dealt alone. In sets of up to `PAIRED` words it is dealt together with each next word of the prefix:
   two similar sets share two words at least, so they share the first two of them. Pairs grow with the square of a prefix, so longer sets with such a word
   are dealt by parts: words are dealt by hash to more parts than two similar sets of their sizes can have words that only one of them holds, so in some part
   the sets hold the very same words (parts_records). A line has about half as many records as words, at most.
   In a bucket sorted by size, a window keeps the length filter; the positional filter and a parity bitmap (its differing bits never outnumber the
   differing words) drop what cannot reach the threshold. A bucket hands on the records that have a candidate, never its pairs. A large bucket is
   dealt in parts, each two of which meet in a bucket of their own, so no task holds a whole one.
4. Verification: these lines are read again. Two sets may meet in many buckets; they count in the one of the first word that they share. By the first keys of
   each set most of the other meetings are told, so that a line's words, which can tell for sure, go to few buckets, where they are compared. A bucket reports the number of links of each of its sets, its earliest linked set and
   a spanning tree of what it has linked: rows in proportion to its records.
5. Links: two different sets that are similar are linked, and linked sets are one class. A set stands for all lines that have it.

The result depends neither on FREQUENT nor on any other size: every pair of similar sets is found, whatever the table's size.

Nulls and ties: a null text has no lines. A null doc_id comes last (as the largest long). Rows alike in doc_id and text are one document and share their
fate; rows of one doc_id are told apart by a 64-bit hash of the text. Empty input gives no rows. Other columns are passed on by dedup_lines, whatever their names, and not read.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import fresh, saved, sliced, utf8

THRESHOLD = 0.8
MIN_WORDS = 1
#: log2 of the cells of the rarity table.
CELLS = 20
#: Bits of a word's key: its cell's rank, then some of its hash. A set's hash also covers the words' whole hashes.
KEY_BITS = 44
#: Words whose cell counts more are not dealt alone, so no bucket of a single word has more lines.
FREQUENT = 1 << 13
#: Sets of more words are dealt by parts instead of pairs of frequent words.
PAIRED = 12
#: log2 of the bits of the table that marks the lines to be read again.
MARKS = 26
#: Bytes of text that are worked on at a time.
PIECE = 1 << 18
#: Words of lines that are worked on at a time.
BLOCK_WORDS = 1 << 17
#: Pairs of a bucket that are compared at a time.
BLOCK_PAIRS = 1 << 17
#: Records of a bucket beyond which it is dealt in parts of about this size; more where that would make over 2^LARGE large buckets.
BUCKET = 1 << 15
LARGE = 22
#: Records that a partition of candidates should hold.
PARTITION_RECORDS = 1 << 19
#: Bytes of text for one partition of sets.
PARTITION_BYTES = 16 << 20
#: Packed blocks are dealt to this many groups for each partition; a task holds one group at a time.
GROUPS = 4
LAST = (1 << 63) - 1

#: Lines of a map task of which equal ones are folded together.
FOLD_LINES = 1 << 14
#: Bytes of lines that are verified at a time, but for larger buckets.
VERIFY_BYTES = 1 << 20

PACKED = np.dtype("<u8")  # a bucket's key of 48 bits, then a position of 16 bits
RECORD = np.dtype([("key", "<u8"), ("id", "<u8"), ("b0", "<u8"), ("b1", "<u8"), ("size", "<u4")])  # size: four times the set's size, plus the side
COPY = np.dtype([("doc", "<i8"), ("row", "<i8"), ("line", "<i4"), ("mdoc", "<i8"), ("mrow", "<i8"), ("mline", "<i4")])
PLACE, MATCH = ["doc", "row", "line"], ["mdoc", "mrow", "mline"]
PLACES = "doc long, row long, line int, mdoc long, mrow long, mline int"
LINES = "s0 long, s1 long, doc long, row long, line int, size int, b0 long, b1 long, keys binary, mdoc long, mrow long, mline int"
FOUND = f"key long, id long, at int, {PLACES}"
LINKED = f"links long, rdoc long, rrow long, rline int, {PLACES}"
KEY48 = np.uint64((1 << 48) - 1)
#: Keys of a set by which most pairs that have met before are told.
FIRST_KEYS = 6
NO_KEY = np.uint64((1 << 64) - 1)

# words as numbers: a polynomial of random values of their bytes
_GROWTH = 0x9E3779B97F4A7C15  # odd, so it has an inverse
#: Longer words are hashed one by one.
LONG_WORD = 256


def _polynomial() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    value = np.random.default_rng(7).integers(1, 1 << 63, 256, "u8")
    value[65:91] = value[97:123]
    blank = np.zeros(256, bool)
    blank[[32, *range(9, 14)]] = True
    value[blank] = 0

    def powers(factor: int) -> np.ndarray:
        out = np.full(PIECE, factor, "u8")
        out[0] = 1
        return np.multiply.accumulate(out)

    return value, blank, powers(_GROWTH), powers(pow(_GROWTH, -1, 1 << 64))


_VALUE, _BLANK, _POWER, _INVERSE = _polynomial()


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = (x + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


def _piece_words(piece: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of at most PIECE bytes, and the number of words in each line."""
    x = np.frombuffer(piece, "u1")
    blank = np.ones(len(x) + 2, bool)
    np.take(_BLANK, x, out=blank[1:-1])
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edge[::2], edge[1::2]
    lines = np.flatnonzero(x == 10)
    before = np.searchsorted(starts, lines)
    counts = np.diff(np.concatenate([[0], before, [len(starts)]]))
    if not len(starts):
        return np.zeros(0, "u8"), counts
    terms = _VALUE[x] * _POWER[:len(x)]
    length = ends - starts
    h = mixed(np.add.reduceat(terms, starts) * _INVERSE[starts], 1) ^ length.astype("u8")
    for i in np.flatnonzero(length >= LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(piece[starts[i]:ends[i]].lower(), 7)
    return mixed(h), counts


def line_words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a UTF-8 text, and the number of words in each of its lines."""
    if len(text) <= PIECE:
        return _piece_words(text)
    hashes, counts, at = [], [np.zeros(1, "i8")], 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            end = max(text.rfind(b, at, end) for b in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) + 1
        if end <= at:  # a word longer than a piece
            end = min((i for i in (text.find(b, at + PIECE) for b in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if i >= 0), default=len(text))
            h, n = mixed(np.array([xxhash.xxh3_64_intdigest(text[at:end].lower(), 7)], "u8")), np.ones(1, "i8")
        else:
            h, n = _piece_words(text[at:end])
        hashes.append(h)
        counts[-1] = counts[-1].copy()
        counts[-1][-1] += n[0]
        counts.append(n[1:]) if len(n) > 1 else None
        at = end
    return np.concatenate([np.zeros(0, "u8"), *hashes]), np.concatenate(counts)


def _texts(batches):
    """(docs, rows, lines of each, word hashes, words in each line) of some documents at a time."""
    docs, rows, texts, size = [], [], [], 0

    def out():
        h, counts = line_words(b"\n".join(texts))
        return np.array(docs, "i8"), np.array(rows, "i8"), np.array([t.count(b"\n") + 1 for t in texts], "i8"), h, counts

    for b in sliced(batches):
        for doc, row, text in zip(b.column("doc").to_pylist(), b.column("row").to_pylist(), b.column("text").to_pylist()):
            if docs and size + len(text) > PIECE:
                yield out()
                docs, rows, texts, size = [], [], [], 0
            docs.append(doc), rows.append(row), texts.append(text)
            size += len(text) + 1
    if docs:
        yield out()


def _blocks(batches, min_words: int):
    """Lines with enough words, some at a time: (doc, row, line number) arrays, words in each, hashes of all words."""
    for docs, rows, lines, h, counts in _texts(batches):
        of = np.repeat(np.arange(len(docs)), lines)
        number = np.arange(len(of)) - np.repeat(np.cumsum(lines) - lines, lines)
        keep = counts >= max(min_words, 1)
        if not keep.all():
            h = h[np.repeat(keep, counts)]
            of, number, counts = of[keep], number[keep], counts[keep]
        ends, at = np.cumsum(counts), 0
        while at < len(counts):
            done = ends[at - 1] if at else 0
            to = min(max(at + 1, int(np.searchsorted(ends, done + BLOCK_WORDS, "right"))), at + (1 << 64 - KEY_BITS))
            yield docs[of[at:to]], rows[of[at:to]], number[at:to].astype("i4"), counts[at:to], h[done:ends[to - 1]]
            at = to


def _sets(counts: np.ndarray, h: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each line, its distinct words: their keys in ascending order, their hashes, their line; and the set sizes."""
    shift = np.uint64(KEY_BITS)
    both = np.repeat(np.arange(len(counts), dtype="u8") << shift, counts) | ordered_keys(h, rank)
    order = np.argsort(both)
    both = both[order]
    new = np.ones(len(both), bool)
    np.not_equal(both[1:], both[:-1], out=new[1:])
    both = both[new]
    line = (both >> shift).astype("i8")
    return both & ((np.uint64(1) << shift) - np.uint64(1)), h[order[new]], line, np.bincount(line, minlength=len(counts))


def _cell_rows(total: np.ndarray) -> pa.RecordBatch:
    parts = {i: p for i, p in enumerate(total.reshape(64, -1)) if p.any()}
    return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([p.tobytes() for p in parts.values()], pa.binary())], ["part", "counts"])


def _count_words(batches):
    total = np.zeros(1 << CELLS, "i8")
    for *_, h, _ in _texts(batches):
        np.add.at(total, (h & np.uint64((1 << CELLS) - 1)).astype("i8"), 1)
    yield _cell_rows(total)


def _add_cells(batches):
    total = np.zeros((64, (1 << CELLS) // 64), "i8")
    for b in batches:
        for part, counts in zip(b.column("part").to_pylist(), b.column("counts").to_pylist()):
            total[part] += np.frombuffer(counts, "i8")
    yield _cell_rows(total)


def _cells(parts: DataFrame) -> np.ndarray:
    """Sums of the cells that tasks have counted: 2^CELLS numbers, whatever the data."""
    sums = parts.repartition(16, "part").mapInArrow(_add_cells, "part int, counts binary")
    out = np.zeros((64, (1 << CELLS) // 64), "i8")
    for r in sums.collect():  # 64 rows of fixed size
        out[r.part] = np.frombuffer(r.counts, "i8")
    return out.ravel()


def rarity(rows: DataFrame) -> np.ndarray:
    """Occurrences of the words of each cell."""
    return _cells(rows.mapInArrow(_count_words, "part int, counts binary"))


def ordered_keys(h: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Hashes as keys that ascend by rarity: the rank of the hash's cell, then the top of the hash."""
    rest = KEY_BITS - CELLS
    return (rank[h & np.uint64((1 << CELLS) - 1)].astype("u8") << np.uint64(rest)) | (h >> np.uint64(64 - rest))


def prefix_length(sizes: np.ndarray, cut: Fraction) -> np.ndarray:
    """Words of a set of which it shares at least one with every similar set."""
    return sizes + (-cut.numerator * sizes) // cut.denominator + 1


def size_bands(most: int, cut: Fraction) -> np.ndarray:
    """First sizes of the bands; sets that are similar are in one band or in neighbouring ones."""
    edges = [1, 2]
    while edges[-2] <= most or len(edges) < 4:
        edges.append(max(edges[-1] + 1, (edges[-1] - 1) * cut.denominator // cut.numerator + 1))
    return np.array([*edges, edges[-1] * 2 * cut.denominator // cut.numerator + 2], "i8")


def parts_records(keys: np.ndarray, sizes: np.ndarray, cut: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) by which whole sets, one behind the other in `keys`, are dealt: two similar ones have a key in common.

    Sets of a band and the next one up differ in at most D words in all. Their words are dealt by hash to D + 1 + s parts, so s + 1 parts at
    least are the same in both; one of those isn't empty, unless a set has over s empty parts, and then these are dealt too."""
    edges = size_bands(int(sizes.max(initial=1)), cut)
    own = np.searchsorted(edges, sizes, "right") - 1
    out = []
    for lower in (own, own - 1):
        some = np.flatnonzero(lower >= 0)
        band = lower[some]
        differ = (edges[band + 1] + edges[band + 2] - 2) * (cut.denominator - cut.numerator) // (cut.denominator + cut.numerator)
        spare = 2 + differ // 8
        parts = differ + 1 + spare
        begin = np.cumsum(parts) - parts
        word = np.repeat(lower >= 0, sizes)
        k = keys[word]
        of = np.repeat(np.arange(len(some)), sizes[some])
        place = begin[of] + (((mixed(k, 3) >> np.uint64(32)) * parts[of].astype("u8")) >> np.uint64(32)).astype("i8")
        signs, held = np.zeros(int(parts.sum()), "u8"), np.bincount(place, minlength=int(parts.sum()))
        np.add.at(signs, place, mixed(k, 4))
        owner = np.repeat(np.arange(len(some)), parts)
        number = np.arange(len(owner)) - begin[owner]
        empty = np.bincount(owner[held == 0], minlength=len(some))
        deal = (held > 0) | (empty > spare)[owner]
        signs = mixed(signs + mixed((band[owner] << 40 | number).astype("u8"), 5), 6)
        out.append((some[owner[deal]], signs[deal]))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def prefix_records(keys: np.ndarray, line: np.ndarray, sizes: np.ndarray, cut: Fraction, frequent_rank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key of 48 bits, position) by which sets are dealt. Keys from `frequent_rank` on are frequent ones.

    Two similar sets share a word of their prefixes. If the first one that they share isn't frequent, both are dealt by it. Else both have a frequent word in
    their prefix: they are dealt by pairs where both may be of up to PAIRED words, and by parts where one may be longer. (Pairs need a threshold above a half.)"""
    n, d = cut.numerator, cut.denominator
    paired = PAIRED if cut > Fraction(1, 2) else 0
    starts = np.cumsum(sizes) - sizes
    pos = np.arange(len(keys)) - starts[line]
    prefix = prefix_length(sizes, cut)[line]
    meets = (sizes * d >= (sizes + 1) * n)[line]  # smaller sets are similar to equal ones only
    inside = (pos < prefix) & meets
    hot = inside & ((keys >> np.uint64(KEY_BITS - CELLS)) >= frequent_rank)
    cold = np.flatnonzero(inside & ~hot)
    out = [(line[cold], mixed(keys[cold], 1), pos[cold])]
    pair = np.flatnonzero(hot & (sizes <= paired)[line])
    step = 1
    while len(pair):
        pair = pair[(pos[pair] + step <= prefix[pair]) & (pos[pair] + step < sizes[line[pair]])]
        out.append((line[pair], mixed(keys[pair] * np.uint64(31) + keys[pair + step], 2), pos[pair]))
        step += 1
    busy = np.zeros(len(sizes), bool)
    busy[line[hot]] = True
    busy &= sizes * d // n > paired
    if busy.any():
        some = np.flatnonzero(busy)
        of, key = parts_records(keys[busy[line]], sizes[some], cut)
        out.append((some[of], key, np.zeros(len(of), "i8")))
    at, key, pos = (np.concatenate([o[i] for o in out]) for i in range(3))
    return at, key >> np.uint64(16), pos


def _parity(keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, each the parity of the words that fall on it."""
    starts = np.cumsum(sizes) - sizes
    bit = np.uint64(1) << (keys & np.uint64(63))
    high = (keys & np.uint64(64)) > 0
    return np.bitwise_xor.reduceat(np.where(high, np.uint64(0), bit), starts), np.bitwise_xor.reduceat(np.where(high, bit, np.uint64(0)), starts)


def dealt_records(keys: np.ndarray, line: np.ndarray, sizes: np.ndarray, cut: Fraction, frequent_rank: int) -> tuple[np.ndarray, np.ndarray]:
    """The packed records of each set, one set's behind the other's, and their numbers."""
    at, key, pos = prefix_records(keys, line, sizes, cut, frequent_rank)
    order = np.argsort(at, kind="stable")
    return (key << np.uint64(16) | np.minimum(pos, 65535).astype("u8"))[order], np.bincount(at, minlength=len(sizes))


def _fold(tables: list[pa.RecordBatch]):
    """Of equal sets among some lines only the first keeps its records; the other lines become rows that point to it, so a common line takes few rows to its
    set's task."""
    t = pa.Table.from_batches(tables).combine_chunks()
    get = lambda c: t.column(c).to_numpy()
    s0, s1, doc, row, line = (get(c) for c in ("s0", "s1", *PLACE))
    order = np.lexsort((row, line, doc, s1, s0))
    new = np.ones(len(order), bool)
    new[1:] = (s0[order][1:] != s0[order][:-1]) | (s1[order][1:] != s1[order][:-1])
    first = np.empty(len(order), "i8")
    first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    lead = first == np.arange(len(first))
    rest = np.flatnonzero(~lead & ~((doc == doc[first]) & (row == row[first]) & (line == line[first])))  # a repeated row is no copy of itself
    names = [c.split()[0] for c in LINES.split(", ")]
    kept = t.filter(pa.array(lead))
    none = lambda n, kind: pa.nulls(n, kind)
    yield from kept.append_column("mdoc", none(len(kept), pa.int64())).append_column("mrow", none(len(kept), pa.int64())).append_column("mline", none(len(kept), pa.int32())).to_batches()
    n, to = len(rest), first[rest]
    columns = [none(n, pa.int64()), none(n, pa.int64()), *(pa.array(c[rest]) for c in (doc, row, line)), none(n, pa.int32()), none(n, pa.int64()), none(n, pa.int64()), none(n, pa.binary()), *(pa.array(c[to]) for c in (doc, row, line))]
    yield pa.RecordBatch.from_arrays(columns, names)


def _line_rows(min_words: int, cut: Fraction, table):
    names = [c.split()[0] for c in LINES.split(", ")][:9]

    def run(batches):
        rank, frequent_rank = table.value
        held, lines = [], 0
        for doc, row, number, counts, h in _blocks(batches, min_words):
            keys, h, line, sizes = _sets(counts, h, rank)
            starts = np.cumsum(sizes) - sizes
            b0, b1 = _parity(keys, sizes)
            s0, s1 = np.add.reduceat(mixed(h, 7), starts), np.add.reduceat(mixed(h, 8), starts)
            packed, n = dealt_records(keys, line, sizes, cut, frequent_rank)
            records = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(n) * PACKED.itemsize]).astype("<i4")), pa.py_buffer(packed)])
            columns = [s0.view("i8"), s1.view("i8"), doc, row, number, sizes.astype("i4"), b0.view("i8"), b1.view("i8")]
            held.append(pa.RecordBatch.from_arrays([*map(pa.array, columns), records], names))
            lines += len(counts)
            if lines >= FOLD_LINES:
                yield from _fold(held)
                held, lines = [], 0
        if held:
            yield from _fold(held)

    return run


def _packed(column) -> np.ndarray:
    """The records in a binary column, one row's behind the other's."""
    return np.frombuffer(b"".join(column.to_pylist()), PACKED)


def _cell(packed: np.ndarray) -> np.ndarray:
    return (packed >> np.uint64(64 - CELLS)).astype("i8")


def _count_keys(batches):
    """Records of each of 2^CELLS cells of keys."""
    total = np.zeros(1 << CELLS, "i8")
    for b in batches:
        np.add.at(total, _cell(_packed(b.column("keys"))), 1)
    yield _cell_rows(total)


def _keys_of(cells):
    """How often the keys in some cells are met, batch by batch."""

    def run(batches):
        for b in batches:
            packed = _packed(b.column("keys"))
            key, n = np.unique(packed[cells.value[_cell(packed)]] >> np.uint64(16), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.astype("i8")), pa.array(n)], ["key", "n"])

    return run


def large_buckets(lines: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys of the buckets to be dealt in parts, ascending; their parts; and the number of records that makes. Equal sets count too, so these are bounds.

    The keys of crowded cells are counted one by one; at most 2^LARGE buckets are large, whatever the data."""
    lines = lines.where("mdoc is null")
    held = _cells(lines.select("keys").mapInArrow(_count_keys, "part int, counts binary"))
    total = int(held.sum())
    most = max(BUCKET, total >> LARGE)
    if not (held > most).any():
        return np.zeros(0, "u8"), np.zeros(0, "i8"), total
    crowded = lines.sparkSession.sparkContext.broadcast(held > most)
    found = lines.select("keys").mapInArrow(_keys_of(crowded), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > most).orderBy("key").toArrow()
    n = found.column("n").to_numpy()
    parts = -(-n // most)
    return found.column("key").to_numpy().astype("u8"), parts, total + int((n * (parts - 1)).sum())


def _parts_of(key: np.ndarray, keys: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The number of parts of each bucket."""
    if not len(keys):
        return np.ones(len(key), "i8")
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return np.where(keys[at] == key, parts[at], 1)


def part_key(key: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The bucket in which two parts of a bucket meet."""
    both = np.minimum(own, other).astype("u8") << np.uint64(32) | np.maximum(own, other).astype("u8")
    return mixed(key + mixed(both, 9), 10) >> np.uint64(16)


def in_parts(records: np.ndarray, keys: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """`records`, those of a large bucket once for each pair of parts that theirs is in, under a key of that pair.

    Two parts stand on sides 1 and 2, where only records of different sides meet; a part with itself on side 3. Undivided buckets have side 0."""
    k = _parts_of(records["key"] >> np.uint64(16), keys, parts)
    large = k > 1
    if not large.any():
        return records
    k, some = k[large], records[large]
    own = (some["id"] % k.astype("u8")).astype("i8")
    out, own = np.repeat(some, k), np.repeat(own, k)
    other = np.arange(len(out)) - np.repeat(np.cumsum(k) - k, k)
    out["key"] = part_key(out["key"] >> np.uint64(16), own, other) << np.uint64(16) | (out["key"] & np.uint64(65535))
    out["size"] += np.where(own == other, 3, np.where(own < other, 1, 2)).astype("u4")
    return np.concatenate([records[~large], out])


def _pack(groups: int, table):
    """First lines of sets as records in blocks for each group; the other lines as copies. Rows come sorted by set, then by order."""

    def run(batches):
        last = None  # the set of the row before, and its first line
        for b in batches:
            get = lambda c: b.column(c).to_numpy(zero_copy_only=False)  # noqa: E731,B023
            n = b.num_rows
            if not n:
                continue
            s0, s1 = get("s0"), get("s1")
            first = np.concatenate([[last is None or (s0[0], s1[0]) != last[:2]], (s0[1:] != s0[:-1]) | (s1[1:] != s1[:-1])])
            doc, row, line = get("doc"), get("row"), get("line")
            run_of = np.maximum.accumulate(np.where(first, np.arange(n), -1))
            origin = lambda c, k: np.where(run_of >= 0, c[run_of], 0 if last is None else last[k])  # noqa: E731,B023
            odoc, orow, oline = origin(doc, 2), origin(row, 3), origin(line, 4)
            last = (s0[-1], s1[-1], odoc[-1], orow[-1], oline[-1])
            rest = ~first & ~((doc == odoc) & (row == orow) & (line == oline))  # a repeated row is no copy of itself
            copies = np.empty(rest.sum(), COPY)
            for name, values in (("doc", doc), ("row", row), ("line", line), ("mdoc", odoc), ("mrow", orow), ("mline", oline)):
                copies[name] = values[rest]
            lead = b.filter(pa.array(first))
            keys = lead.column("keys")
            packed = _packed(keys)
            per = np.diff(np.frombuffer(keys.buffers()[1], "<i4")[keys.offset:keys.offset + len(keys) + 1]) // PACKED.itemsize
            records = np.empty(len(packed), RECORD)
            records["key"] = packed
            for name, values in (("id", line_id(doc[first], row[first], line[first])), ("size", 4 * get("size")[first]), ("b0", get("b0")[first].view("u8")), ("b1", get("b1")[first].view("u8"))):
                records[name] = np.repeat(values, per)
            records = in_parts(records, *table.value)
            group = ((records["key"] >> np.uint64(16)) % np.uint64(groups)).astype("i8")
            order = np.argsort(group, kind="stable")
            records, group = records[order], group[order]
            cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, "i8")
            ends = np.append(cuts[1:], len(group))
            numbers = [*group[cuts].tolist()]
            columns = [np.ascontiguousarray(records[f]) for f in RECORD.names]
            blocks = [b"".join(c[i:j].tobytes() for c in columns) for i, j in zip(cuts, ends)]
            extra = [b""] * len(blocks)
            if len(copies):
                numbers.append(int(abs(int(last[0])) % groups))
                blocks.append(b"")
                extra.append(copies.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(blocks, pa.binary()), pa.array(extra, pa.binary())], ["group", "records", "copies"])

    return run


def _unpack(blocks: list[bytes]) -> dict[str, np.ndarray]:
    sizes = [len(b) // RECORD.itemsize for b in blocks]
    out, at = {}, 0
    for f in RECORD.names:
        out[f] = np.concatenate([np.frombuffer(b, RECORD[f], n, at * n) for b, n in zip(blocks, sizes)])
        at += RECORD[f].itemsize
    side = out["size"] & np.uint32(3)
    return out | {"pos": (out["key"] & np.uint64(65535)).astype("i8"), "key": out["key"] >> np.uint64(16), "side": side, "size": (out["size"] >> np.uint32(2)).astype("i8")}


def _passing(r: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, cut: Fraction) -> np.ndarray:
    """Which pairs of records of one key may be similar enough."""
    n, m = r["size"][i], r["size"][j]
    need = -((-cut.numerator * (n + m)) // (cut.numerator + cut.denominator))
    rest = np.minimum(n - r["pos"][i], m - r["pos"][j])
    k = np.flatnonzero((rest >= need) & ((r["side"][i] % 3 == 0) | (r["side"][i] != r["side"][j])))
    i, j = i[k], j[k]
    differ = np.bitwise_count(r["b0"][i] ^ r["b0"][j]).astype("i8") + np.bitwise_count(r["b1"][i] ^ r["b1"][j])
    return k[(differ <= n[k] + m[k] - 2 * need[k]) & (r["id"][i] != r["id"][j])]


def _buckets(r: dict[str, np.ndarray], cut: Fraction) -> dict[str, np.ndarray]:
    """Records that have a neighbour of like size in their bucket, sorted by bucket and size."""
    order = np.lexsort((r["size"], r["key"]))
    key, size = r["key"][order], r["size"][order]
    close = (key[1:] == key[:-1]) & (size[1:] * cut.numerator <= size[:-1] * cut.denominator)
    keep = np.zeros(len(key), bool)
    keep[1:] = close
    keep[:-1] |= close
    order = order[keep]
    return {f: c[order] for f, c in r.items()}


def _meetings(r: dict[str, np.ndarray], cut: Fraction):
    """(i, j): indexes of the records of each bucket that meet by size, some pairs at a time."""
    new = np.ones(len(r["key"]), "i8")
    new[1:] = r["key"][1:] != r["key"][:-1]
    low = np.cumsum(new) << 32  # buckets as small numbers, so that the size fits beside them
    end = np.searchsorted(low | r["size"], low | (r["size"] * cut.denominator // cut.numerator), "right")
    reach = end - np.arange(len(low)) - 1
    todo = np.flatnonzero(reach > 0)
    reach = reach[todo]
    at, skip = 0, 0  # the record that is next, and its pairs that are done
    while at < len(todo):
        total = np.cumsum(reach[at:at + BLOCK_PAIRS]) - skip
        some = int(np.searchsorted(total, BLOCK_PAIRS, "right"))
        if some:
            i, m, first = todo[at:at + some], reach[at:at + some].copy(), np.zeros(some, "i8")
            m[0] -= skip
            first[0] = skip
            at, skip = at + some, 0
        else:  # one record with more pairs than a block
            i, m, first = todo[at:at + 1], np.array([BLOCK_PAIRS]), np.array([skip])
            skip += BLOCK_PAIRS
        left = np.repeat(i, m)
        yield left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(m) - m - first, m)


def candidate_pairs(r: dict[str, np.ndarray], cut: Fraction):
    """Pairs of records, as indexes into what _buckets() has sorted, some at a time. A pair of sets may come in several buckets."""
    for i, j in _meetings(r, cut):
        ok = _passing(r, i, j, cut)
        yield i[ok], j[ok]


def line_id(doc: np.ndarray, row: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Hash of a line's place, by which lines are found again. Where two lines share one, both are read again and verified."""
    x = doc.astype("i8").view("u8") * np.uint64(0x9E3779B97F4A7C15) + row.astype("i8").view("u8") * np.uint64(0xC2B2AE3D27D4EB4F) + line.astype("i8").view("u8")
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed(x ^ (x >> np.uint64(27)), 11)


def _match(cut: Fraction):
    """The records that have a candidate in their bucket, group by group, and the copies. Rows come sorted by group."""
    names = [c.split()[0] for c in FOUND.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32()]

    def busy(blocks: list[bytes]):
        if blocks:
            r = _buckets(_unpack(blocks), cut)
            mark = np.zeros(len(r["key"]), bool)
            for i, j in candidate_pairs(r, cut):
                mark[i] = mark[j] = True
            n = int(mark.sum())
            columns = [r["key"][mark].astype("i8"), r["id"][mark].view("i8"), (r["pos"][mark] << 2 | r["side"][mark]).astype("i4")]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *(pa.nulls(n, pa.int32() if f.endswith("line") else pa.int64()) for f in COPY.names)], names)

    def run(batches):
        group, blocks = None, []
        for b in batches:
            for g, records, copies in zip(b.column("group").to_pylist(), b.column("records").to_pylist(), b.column("copies").to_pylist()):
                if copies:
                    c = np.frombuffer(copies, COPY)
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(len(c), k) for k in kinds), *(pa.array(c[f].copy()) for f in COPY.names)], names)
                if g != group:
                    yield from busy(blocks)
                    group, blocks = g, []
                if records:
                    blocks.append(records)
        yield from busy(blocks)

    return run


def _mark(found: DataFrame) -> np.ndarray:
    """A table of 2^MARKS bits, whatever the data, with those of the lines' ids set."""
    at = F.shiftrightunsigned("id", 64 - MARKS)
    words = found.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(id, {64 - MARKS}) & 63 as int))")).alias("bits"))
    found = words.toArrow()  # 2^(MARKS - 6) rows at most
    out = np.zeros(1 << (MARKS - 6), "u8")
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view("u8")
    return out


def _marked_lines(marks, cut: Fraction, table):
    def run(batches):
        bits, (rank, frequent_rank) = marks.value, table.value
        for b in sliced(batches):
            docs, rows, texts = b.column("doc").to_numpy(), b.column("row").to_numpy(), b.column("text").to_pylist()
            lines = np.array([t.count(b"\n") + 1 for t in texts], "i8")
            of = np.repeat(np.arange(len(texts)), lines)
            number = np.arange(len(of)) - np.repeat(np.cumsum(lines) - lines, lines)
            ids = line_id(docs[of], rows[of], number)
            at = ids >> np.uint64(64 - MARKS)
            hit = np.flatnonzero(bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1))
            words, last, parts = [], None, []
            for i, k in zip(of[hit].tolist(), number[hit].tolist()):
                if i != last:
                    last, parts = i, texts[i].split(b"\n")
                words.append(parts[k])
            h, counts = line_words(b"\n".join(words))
            some = np.flatnonzero(counts[:len(words)] > 0)  # a line without words is here by chance
            if not len(some):
                continue
            keys, _, line, sizes = _sets(counts[some], h, rank)
            b0, b1 = _parity(keys, sizes)
            first = first_keys(*dealt_records(keys, line, sizes, cut, frequent_rank))
            hit = hit[some]
            columns = [pa.array(ids[hit].view("i8")), pa.array(docs[of[hit]]), pa.array(rows[of[hit]]), pa.array(number[hit].astype("i4")), pa.array(sizes.astype("i4")), pa.array(b0.view("i8")), pa.array(b1.view("i8")), pa.array([x.tobytes() for x in first], pa.binary()), pa.array([words[k] for k in some.tolist()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", *PLACE, "size", "b0", "b1", "first", "words"])

    return run


def _word_numbers(lines: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the distinct words of each line, ascending, one line's behind the other's, and how many they are. Equal words have equal numbers."""
    number = defaultdict(itertools.count().__next__)
    found = [np.zeros(0, "u8")]
    for at in range(0, len(lines), 1000):
        words = b"\n".join(lines[at:at + 1000]).lower().split()
        found.append(np.fromiter(map(number.__getitem__, words), "u8", len(words)))
    both = np.unique(np.repeat(np.arange(len(lines), dtype="u8") << np.uint64(32), counts) | np.concatenate(found))
    return both & np.uint64(0xFFFFFFFF), np.bincount((both >> np.uint64(32)).astype("i8"), minlength=len(lines))


def _gather(values: np.ndarray, n: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of some rows, one row's behind the other's (`n` of each in all rows), and the place in `rows` of each."""
    starts, of = np.cumsum(n) - n, np.repeat(np.arange(len(rows)), n[rows])
    ends = np.cumsum(n[rows])
    return values[np.arange(len(of)) - np.repeat(ends - n[rows] - starts[rows], n[rows])], of


def _overlap(words: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words the sets of each pair share."""
    out, ends, at = np.zeros(len(i), "i8"), np.cumsum(n[i] + n[j]), 0
    while at < len(i):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), "right")))
        both = np.concatenate([of.astype("u8") << np.uint64(32) | values for values, of in (_gather(words, n, i[at:to]), _gather(words, n, j[at:to]))])
        both.sort()
        out[at:to] = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype("i8"), minlength=to - at)
        at = to
    return out


def _own_bucket(packed: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The key under which two sets are to count: of the keys that they share, the one with the first position in the first set, then the least."""
    best = np.full(len(i), np.uint64((1 << 64) - 1))
    for at in range(0, len(i), 1 << 15):
        (x, of), (y, other) = _gather(packed, n, i[at:at + (1 << 15)]), _gather(packed, n, j[at:at + (1 << 15)])
        tag = lambda values, rows: rows.astype("u8") << np.uint64(48) | values >> np.uint64(16)
        theirs = np.sort(tag(y, other))
        mine = tag(x, of)
        if len(theirs):
            shared = theirs[np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)] == mine
            np.minimum.at(best[at:at + (1 << 15)], of[shared], _ranked(x[shared]))
    return best & KEY48


def first_keys(packed: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each set, its FIRST_KEYS least (position, key), NO_KEY where it has fewer."""
    value = _ranked(packed)
    line = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((value, line))
    place = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
    out = np.full((len(n), FIRST_KEYS), NO_KEY)
    some = place < FIRST_KEYS
    out[line[some], place[some]] = value[order][some]
    return out


def _ranked(packed: np.ndarray) -> np.ndarray:
    """Packed records with the position in front of the key: sets count a link under the least of the keys that they share."""
    return (packed & np.uint64(65535)) << np.uint64(48) | packed >> np.uint64(16)


def _may_count(r: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs don't share, among their first keys, one before their bucket's: the others surely count elsewhere."""
    here = r["pos"][i].astype("u8") << np.uint64(48) | np.where(r["side"][i] == 0, r["key"][i], np.uint64(0))
    out = np.ones(len(i), bool)
    for a in range(FIRST_KEYS):
        mine = r["first"][i, a]
        before = (mine < here) & (mine != NO_KEY)
        for b in range(FIRST_KEYS):
            out &= ~(before & ((r["first"][j, b] & KEY48) == (mine & KEY48)) & (r["first"][j, b] != NO_KEY))
    return out


def _oriented(r: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair the same way round in every bucket."""
    flip = r["id"][i] > r["id"][j]
    return np.where(flip, j, i), np.where(flip, i, j)


def _link(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of each pair; labels are roots."""
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return
        least = np.minimum(a, b)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        while not np.array_equal(label, label[label]):
            label[:] = label[label]


def _verify(cut: Fraction, table, split):
    names = [c.split()[0] for c in LINKED.split(", ")]

    def linked(t: pa.Table):
        rank, frequent_rank = table.value
        lines = t.column("words").to_pylist()
        h, counts = line_words(b"\n".join(lines))
        keys, _, line, sizes = _sets(counts, h, rank)
        packed, n = dealt_records(keys, line, sizes, cut, frequent_rank)
        words, n_words = _word_numbers(lines, counts)
        b0, b1 = _parity(keys, sizes)
        get = lambda c: t.column(c).to_numpy()
        r = {"key": get("key").view("u8"), "id": get("id").view("u8"), "pos": (get("at") >> 2).astype("i8"), "side": get("at") & 3, "size": sizes, "b0": b0, "b1": b1, **{c: get(c) for c in PLACE}, "text": np.arange(len(lines)), "first": first_keys(packed, n)}
        r = _buckets(r, cut)
        size, text, m = n_words[r["text"]], r["text"], len(r["key"])
        order = np.lexsort((r["row"], r["line"], r["doc"]))
        rank_of = np.empty(m, "i8")
        rank_of[order] = np.arange(m)
        links, earliest, root = np.zeros(m, "i8"), np.full(m, m), np.arange(m)
        for i, j in candidate_pairs(r, cut):
            i, j = _oriented(r, i, j)
            new = _may_count(r, i, j)
            i, j = i[new], j[new]
            own = _own_bucket(packed, n, text[i], text[j])
            k = _parts_of(own, *split.value).astype("u8")
            there = np.where(k > 1, part_key(own, (r["id"][i] % k).astype("i8"), (r["id"][j] % k).astype("i8")), own)
            here = there == r["key"][i]
            i, j = i[here], j[here]
            shared = _overlap(words, n_words, text[i], text[j])
            good = shared * cut.denominator >= (size[i] + size[j] - shared) * cut.numerator
            i, j = i[good], j[good]
            np.add.at(links, i, 1)
            np.add.at(links, j, 1)
            np.minimum.at(earliest, i, rank_of[j])
            np.minimum.at(earliest, j, rank_of[i])
            _link(root, i, j)
        out = np.flatnonzero(links)
        later = earliest[out] < rank_of[out]
        to = order[np.minimum(earliest[out], m - 1)]
        places = [r[c][out] for c in PLACE]
        yield pa.RecordBatch.from_arrays([pa.array(links[out]), *(pa.array(r[c][root[out]]) for c in PLACE), *map(pa.array, places), *(pa.array(r[c][to], mask=~later) for c in PLACE)], names)

    return lambda batches: _by_bucket(batches, linked)


def _by_bucket(batches, work):
    """`work` on tables of some whole buckets at a time. Rows come sorted by `key`."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size < VERIFY_BYTES:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        key = t.column("key").to_numpy()
        end = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
        if end:
            yield from work(t.slice(0, end))
            t = t.slice(end)
        held, size = t.to_batches(), 0 if end else size
    if held and sum(b.num_rows for b in held):
        yield from work(pa.Table.from_batches(held).combine_chunks())


def _first_meetings(cut: Fraction):
    """The records that may have a link to count in their bucket, without their lines' words."""

    def busy(t: pa.Table):
        get = lambda c: t.column(c).to_numpy()
        first = np.frombuffer(b"".join(t.column("first").to_pylist()), "u8").reshape(-1, FIRST_KEYS)
        r = {"key": get("key").view("u8"), "id": get("id").view("u8"), "pos": (get("at") >> 2).astype("i8"), "side": get("at") & 3, "size": get("size").astype("i8"), "b0": get("b0").view("u8"), "b1": get("b1").view("u8"), "first": first}
        r = _buckets(r, cut)
        mark = np.zeros(len(r["key"]), bool)
        for i, j in candidate_pairs(r, cut):
            i, j = _oriented(r, i, j)
            new = _may_count(r, i, j)
            mark[i[new]] = mark[j[new]] = True
        yield pa.RecordBatch.from_arrays([pa.array(r["key"][mark].view("i8")), pa.array(r["id"][mark].view("i8")), pa.array((r["pos"][mark] << 2 | r["side"][mark]).astype("i4"))], ["key", "id", "at"])

    return lambda batches: _by_bucket(batches, busy)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, row, text: a document's place in the order, a hash that tells rows of one doc_id apart, and its UTF-8 text."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text_col).alias("row"), utf8(F.col(text_col)).alias("text"))


def line_links(docs: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(copies, linked). copies: doc, row, line, mdoc, mrow, mline: every line with the words of an earlier one, with the first that has them.
    linked: links, rdoc, rrow, rline, doc, row, line, mdoc, mrow, mline: the first line of a set that is similar to others, once for each bucket that has found some: how many,
    one line (r) of the class, and the earliest one (m) before this line, or null. Sum the links, take the least m, and join the r to get all of a set.
    doc and row are as in keyed(); lines are numbered from 0."""
    cut, context = Fraction(str(threshold)), docs.sparkSession.sparkContext
    rows = keyed(docs, id_col, text_col)
    counts = rarity(rows)
    rank = np.empty(len(counts), "u4")
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    table = context.broadcast((rank, int((counts <= FREQUENT).sum())))
    lines = saved(rows.mapInArrow(_line_rows(min_words, cut, table), LINES), "line-sets")
    keys, parts, records = large_buckets(lines)
    split = context.broadcast((keys, parts))  # 2^LARGE keys at most
    partitions = max(1, -(-(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // PARTITION_BYTES))
    sets = lines.where("mdoc is null").drop(*MATCH).repartition(partitions, "s0", "s1").sortWithinPartitions("s0", "s1", "doc", "line", "row")
    partitions = max(partitions, -(-records // PARTITION_RECORDS))
    packed = sets.mapInArrow(_pack(GROUPS * partitions, split), "group long, records binary, copies binary")
    found = saved(packed.repartition(partitions, "group").sortWithinPartitions("group").mapInArrow(_match(cut), FOUND), "line-candidates")
    busy = found.where("key is not null").select("key", "id", "at")
    marks = context.broadcast(_mark(busy))
    marked = rows.mapInArrow(_marked_lines(marks, cut, table), "id long, doc long, row long, line int, size int, b0 long, b1 long, first binary, words binary")
    texts = saved(marked.join(busy.select("id").distinct(), "id", "left_semi").dropDuplicates(["id", *PLACE]), "line-texts")
    by_key = lambda some: some.repartition(partitions, "key").sortWithinPartitions("key")
    kept = by_key(busy.join(texts.select("id", "size", "b0", "b1", "first"), "id")).mapInArrow(_first_meetings(cut), "key long, id long, at int")
    dealt = by_key(saved(kept, "line-meetings").distinct().join(texts.select("id", *PLACE, "words"), "id"))  # ids that two lines share come twice
    linked = saved(dealt.mapInArrow(_verify(cut, table, split), LINKED), "line-links")
    # a line's first among its task's lines may have an earlier one elsewhere
    firsts = found.where("key is null").select(*PLACE, *MATCH)
    moved = firsts.toDF(*MATCH, "fdoc", "frow", "fline")
    near = lines.where("mdoc is not null").select(*PLACE, *MATCH).join(moved, MATCH, "left")
    near = near.select(*PLACE, *(F.coalesce(f, m).alias(m) for f, m in zip(("fdoc", "frow", "fline"), MATCH)))
    return firsts.union(near).dropDuplicates(PLACE), linked


def later_lines(docs: DataFrame, **kw) -> DataFrame:
    """doc, row, line, mdoc: every line to be removed, with the doc of the earliest line that it matches (the first with the very same words, or else the
    earliest linked one)."""
    copies, linked = line_links(docs, **kw)
    near = linked.where("mdoc is not null").groupBy(*PLACE).agg(F.min("mdoc").alias("mdoc"))
    return copies.select(*PLACE, "mdoc").union(near)  # a copy is no set's first line, so no line comes twice


def removed_lines(docs: DataFrame, **kw) -> DataFrame:
    """doc, row, removed (line numbers, ascending), matches (for each of them the doc_id of an earlier line that it matches): documents that lose lines."""
    mine = F.sort_array(F.collect_list(F.struct("line", F.nullif("mdoc", F.lit(LAST)).alias("mdoc"))))
    return later_lines(docs, **kw).groupBy("doc", "row").agg(mine.alias("x")).select("doc", "row", F.col("x.line").alias("removed"), F.col("x.mdoc").alias("matches"))


def line_classes(docs: DataFrame, **kw) -> DataFrame:
    """doc, row, line, mdoc, copies, links, class: every line that another one matches. mdoc is of the earliest line that it matches (the first with its words, or
    else the earliest linked set's), null where that is none; copies are the other lines with its words, links the other sets that are similar to its own; class is the
    earliest line (doc, line, row) of all sets that its own is linked to, by way of others too."""
    copies, linked = line_links(docs, **kw)
    place = lambda mark: F.struct(F.col(f"{mark}doc").alias("doc"), F.col(f"{mark}line").alias("line"), F.col(f"{mark}row").alias("row"))
    copies = copies.select(place("").alias("at"), place("m").alias("set"))
    linked = linked.select(place("").alias("set"), "links", F.when(F.col("mdoc").isNotNull(), place("m")).alias("earlier"), place("r").alias("root"))
    classes = saved(connected_components(linked.select(F.col("set").alias("u"), F.col("root").alias("v")), saved), "line-classes").select(F.col("node").alias("set"), F.col("component").alias("class"))
    near = linked.groupBy("set").agg(F.sum("links").alias("links"), F.min("earlier").alias("earlier"))
    same = copies.groupBy("set").agg(F.count("*").alias("copies"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    sets = near.join(classes, "set").join(same, "set", "full").select("set", "earlier", none("links"), none("copies"), F.coalesce("class", "set").alias("class"))
    sets = saved(sets, "line-sets")
    lines = sets.select(F.col("set").alias("at"), F.col("earlier.doc").alias("mdoc"), "copies", "links", "class")
    lines = lines.union(copies.join(sets, "set").select("at", "set.doc", "copies", "links", "class"))
    return lines.select("at.doc", "at.row", "at.line", "mdoc", "copies", "links", "class")


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """doc_id, n_lines, n_removed, removed, matches, linked, copies, links, classes: one row per document. `linked` are the lines that any other matches, before or after them;
    `copies`, `links` and `classes` (doc_id, line and row hash of a class's first line, as text) stand in their order, and are as in line_classes()."""
    name = F.concat_ws(":", F.coalesce(F.nullif("class.doc", F.lit(LAST)).cast("string"), F.lit("null")), "class.line", "class.row")
    x = F.sort_array(F.collect_list(F.struct("line", "mdoc", "copies", "links", name.alias("class"))))
    gone = F.filter("x", lambda e: e.mdoc.isNotNull())
    found = line_classes(docs, id_col=id_col, text_col=text_col, **kw).groupBy("doc", "row").agg(x.alias("x"))
    found = found.select("doc", "row", F.transform(gone, lambda e: e.line).alias("removed"), F.transform(gone, lambda e: F.nullif(e.mdoc, F.lit(LAST))).alias("matches"), F.col("x.line").alias("linked"), "x.copies", "x.links", F.col("x.class").alias("classes"))
    own = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text_col).alias("row"),
        F.coalesce(F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"))) + 1, F.lit(0)).alias("n_lines"),
    )
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return own.join(found, ["doc", "row"], "left").select(
        "doc_id", "n_lines", F.size(none("removed", "array<int>")).alias("n_removed"), none("removed", "array<int>"), none("matches", "array<bigint>"),
        none("linked", "array<int>"), none("copies", "array<bigint>"), none("links", "array<bigint>"), none("classes", "array<string>"),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The documents, each with all its columns, without their later lines. A document that loses all its lines keeps an empty text."""
    doc, row, removed = fresh(docs, "_doc", "_row", "_removed")
    found = saved(removed_lines(docs, id_col=id_col, text_col=text_col, **kw), "removed-lines").select(F.col("doc").alias(doc), F.col("row").alias(row), F.col("removed").alias(removed))
    mine = docs.withColumns({doc: F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), row: F.xxhash64(text_col)})
    left = F.filter(F.split(F.col(text_col), "\n", -1), lambda line, i: ~F.array_contains(F.col(removed), i))
    text = F.when(F.col(removed).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    return mine.join(found, [doc, row], "left").withColumn(text_col, text).select(*docs.columns)
