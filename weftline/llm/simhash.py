"""Operator 5, SimHash near-dedup by covering locality-sensitive hashing.

A fingerprint's bit is 1 where it is set in over half of the document's shingle hashes. Fingerprints are linked at `radius` differing bits or fewer.
Each bit position is given a nonzero vector of radius + 1 bits; each of the 2^(radius+1) - 1 nonzero masks keeps the
positions whose vector has an odd product with it. For any `radius` positions some mask keeps none of them (radius equations in
radius + 1 unknowns have a nonzero solution), so every pair within the radius agrees under some mask: it collides in that table, for sure.

Only distinct fingerprints enter the tables, so exact copies cost one row. A bucket emits the edges of a spanning forest of
its links, never all its pairs. A bucket above `bucket` fingerprints is dealt anew by a second set of
masks over the bits its first mask left out, with the same guarantee; what then shares a bucket differs in about 14 known
positions only, so no bucket can exceed 2^14 or so fingerprints, whatever the data. No bucket is capped.

Nulls and ties: a null text counts as empty, with fingerprint zero. A null doc_id is never the smallest. Repeated rows share a component. Empty input gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import saved, utf8
from .tokens import split_at_blanks

SEED = 42
RADIUS = 3
WIDTH = 3
#: Fingerprints in a bucket that are compared without dealing the bucket anew.
BUCKET = 512
#: Longer texts are hashed in parts.
PART_BYTES = 4 << 20


def _counts(words: list[bytes], width: int) -> tuple[np.ndarray, int]:
    digest = xxhash.xxh64_intdigest
    rows = [words[i:] for i in range(width)]
    h = np.array([digest(b" ".join(s), SEED) for s in zip(*rows)], "<u8")
    ones = np.zeros(64, "int64")
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i:i + (1 << 16)].view("uint8").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="int64")
    return ones, len(h)


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text."""
    ones, n, tail = np.zeros(64, "int64"), 0, []
    for part in split_at_blanks(text, PART_BYTES) if len(text) > PART_BYTES else (text,):
        words = tail + part.lower().split()  # bytes: lower-cases A-Z and splits at x20 and x09-x0D only
        if len(words) >= width:
            more, m = _counts(words, width)
            ones, n = ones + more, n + m
            tail = words[len(words) - width + 1:]
        else:
            tail = words
    if not n:
        if not tail:
            return 0
        ones, n = _counts([b" ".join(tail)], 1)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _fingerprints(width: int):
    def run(batches):
        for b in batches:
            found = [fingerprint(t, width) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(found, pa.int64())], ["doc_id", "key", "fp"])

    return run


def masks(positions: list[int], radius: int) -> list[int]:
    """The covering masks over some bit positions, as unsigned integers."""
    vectors = 2 ** (radius + 1) - 1
    given = {p: i % vectors + 1 for i, p in enumerate(positions)}
    return [sum(1 << p for p, m in given.items() if (m & v).bit_count() % 2) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _tables(fp: Column, found: list[int]) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key")) for t, m in enumerate(found))))


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least member of each one's component."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        np.minimum.at(new, label, new)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _links(fp: np.ndarray, end: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (both fingerprints) that span the links within runs; end[i] is the end of the run that i lies in."""
    n = len(fp)
    at, left, right, held, lag = np.arange(n), [], [], 0, 1
    u = fp.view("uint64")
    while True:
        at = at[at + lag < end[at]]
        if not len(at):
            break
        near = at[np.bitwise_count(u[at] ^ u[at + lag]) <= radius]
        if len(near):
            left.append(near)
            right.append(near + lag)
            held += len(near)
        if held > 1 << 20:
            label = _forest(n, np.concatenate(left), np.concatenate(right))
            left, right = [np.flatnonzero(label != np.arange(n))], [label[label != np.arange(n)]]
            held = 0
        lag += 1
    if not left:
        return fp[:0], fp[:0]
    label = _forest(n, np.concatenate(left), np.concatenate(right))
    moved = label != np.arange(n)
    return fp[moved], fp[label[moved]]


def _bucket_edges(radius: int):
    def run(batches):
        """Rows come sorted by bucket; the last bucket of a batch waits for the next batch."""
        held = None
        for b in batches:
            new = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype("int64") for c in ("t", "key", "key2", "fp")])
            new = new if held is None else np.concatenate([held, new], axis=1)
            if not new.shape[1]:
                continue
            starts = np.flatnonzero(np.concatenate([[True], (new[:3, 1:] != new[:3, :-1]).any(0)]))
            ready, held = new[:, :starts[-1]], new[:, starts[-1]:]
            if ready.shape[1]:
                yield edges(ready, starts)
        if held is not None:
            yield edges(held, np.array([0, held.shape[1]]))

    def edges(rows, starts):
        end = np.repeat(starts[1:], np.diff(starts))
        u, v = _links(np.ascontiguousarray(rows[3]), end, radius)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def near_edges(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(u, v): edges that connect the distinct fingerprints in column `fp` as their links within `radius` do."""
    first = masks(list(range(64)), radius)
    rows = fps.select("fp", _tables(F.col("fp"), first).alias("x")).select("x.t", "x.key", F.lit(0).cast("long").alias("key2"), "fp")
    counts = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(counts, ["t", "key"]).select("t", "key", "key2", "fp", "n")
    find = lambda some: some.select("t", "key", "key2", "fp").mapInArrow(_bucket_edges(radius), "u long, v long")
    rows = saved(rows, "buckets")
    small = rows.where(F.col("n") <= bucket).repartition("t", "key").sortWithinPartitions("t", "key")
    again = None
    for t, m in enumerate(first):
        second = masks([p for p in range(64) if not m >> p & 1], radius)
        case = F.array(*(F.struct(F.lit(t * 64 + k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(x)).cast("long")).alias("key2")) for k, x in enumerate(second)))
        again = F.when(F.col("t") == t, case) if again is None else again.when(F.col("t") == t, case)
    large = rows.where(F.col("n") > bucket).select("key", "fp", F.explode(again).alias("x")).select("x.t", "key", "x.key2", "fp")
    large = large.repartition("t", "key", "key2").sortWithinPartitions("t", "key", "key2")
    return find(small).union(find(large))


def row_key(text_col: str) -> Column:
    """128 bits of a hash of the text, which together with the id tells rows apart; none for a null text."""
    return F.coalesce(F.unhex(F.substring(F.sha2(F.col(text_col).cast("binary"), 256), 1, 32)), F.lit(bytearray()))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = WIDTH, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, fp (long), component (its least fingerprint), component_id for every document; component_id is the smallest doc_id reachable."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(text_col).alias("key"), utf8(F.col(text_col)).alias("text"))
    marked = saved(rows.mapInArrow(_fingerprints(width), "doc_id long, key binary, fp long"), "fingerprints")
    own = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    labels = connected_components(near_edges(own, radius, bucket), saved).withColumnRenamed("node", "fp")
    linked = own.join(labels, "fp")
    comps = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = linked.join(comps, "component").select("fp", "component", "component_id")
    ids = saved(own.join(named, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), F.coalesce("component_id", "least").alias("component_id")), "components")
    return marked.join(ids, "fp").select("doc_id", "key", "fp", "component", "component_id")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The documents, with all their columns, without those linked to another one that stays: of each group the row with the smallest doc_id (null last) stays, once."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **kw)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    keep = saved(found.groupBy("component").agg(first.alias("m")).select(F.col("m.doc_id").alias("kept_id"), F.col("m.key").alias("kept")), "kept").distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_key(text_col).alias("key"), F.struct("*").alias("held"))
    rows = rows.join(keep, (F.col("key") == F.col("kept")) & F.col("id").eqNullSafe(F.col("kept_id")))
    return rows.dropDuplicates(["id", "key"]).select("held.*")
