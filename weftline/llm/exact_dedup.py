"""Operator 10, exact dedup with Patricia-trie owners.

Texts are equal when they agree after deleting white space. Each map task first folds the equal texts of a
bounded run of rows into one string with its best row and count, so a large group of copies reaches the shuffle as a few rows. Strings are dealt by length
and content hash and inserted, in whatever order they come, as full byte strings into a compressed radix trie for each partition.
A terminal node holds the owner (most code points, then smallest doc_id), and the number of rows. When a
trie holds more than `HELD_BYTES` of strings, its largest subtree is spilled: its owners go to the output and its nodes are freed. A string that comes again after that has
a second owner, and owners of one string meet in a last aggregation. The documents then look up their terminal node by its address, the SHA-256 of
their string.

Nulls and ties: a null text counts as empty; all empty texts are one group. A null doc_id loses every tie. Exactly one row of each group is kept: of rows that agree
in doc_id and code points with the owner, the one that stands first in the written table of rows. The others have the same keep_id, and kept is false. Empty input gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, saved, utf8

DROP = BLANKS.encode()
#: Bytes of distinct strings that a map task holds before it passes them on.
FOLD_BYTES = 32 << 20
#: Bytes of text aimed at in one partition of strings.
PARTITION_BYTES = 24 << 20

#: Bytes of strings that a trie holds before it spills.
HELD_BYTES = 32 << 20

FOLDED = "length int, hash long, content binary, points int, doc_id long, n long"
OWNERS = "digest binary, points int, keep_id long, n long"


def _better(a: tuple, b: tuple) -> tuple:
    """Of (code points, doc_id) the one that stays: most code points, then the smallest doc_id, null last."""
    rank = lambda x: (-x[0], x[1] is None, x[1] or 0)
    return a if rank(a) <= rank(b) else b


def _fold(batches):
    """Equal strings of a run of rows become one row."""
    held: dict[bytes, tuple] = {}
    size = 0

    def flush():
        keys = list(held)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([len(k) for k in keys], pa.int32()),
                pa.array([xxhash.xxh3_64_intdigest(k) - (1 << 63) for k in keys], pa.int64()),
                pa.array(keys, pa.binary()),
                pa.array([held[k][0] for k in keys], pa.int32()),
                pa.array([held[k][1] for k in keys], pa.int64()),
                pa.array([held[k][2] for k in keys], pa.int64()),
            ],
            ["length", "hash", "content", "points", "doc_id", "n"],
        )

    for b in batches:
        for doc, points, text in zip(b.column("doc_id").to_pylist(), b.column("points").to_pylist(), b.column("text")):
            key = text.as_buffer().to_pybytes().translate(None, DROP)
            old = held.get(key)
            if old is None:
                held[key] = (points, doc, 1)
                size += len(key) + 200
            else:
                held[key] = (*_better(old[:2], (points, doc)), old[2] + 1)
            if size > FOLD_BYTES:
                yield flush()
                held, size = {}, 0
    if held:
        yield flush()


def shared_prefix(a: bytes, b: bytes, start: int, end: int) -> int:
    """Up to where, at most `end`, a and b agree; they are known to agree up to `start`."""
    if a[start:end] == b[start:end]:
        return end
    step = 16
    while a[start:start + step] == b[start:start + step]:
        start, step = start + step, step * 2
    low, high = start, min(start + step, end)
    while low < high:
        middle = (low + high) // 2
        if a[low:middle + 1] == b[low:middle + 1]:
            low = middle + 1
        else:
            high = middle
    return low


class Node:
    """A node of the trie stands for string[:depth]; `owner` is (code points, doc_id, rows) where that is one of the strings."""

    __slots__ = ("string", "depth", "below", "owner")

    def __init__(self, string: bytes, depth: int, owner: tuple | None = None):
        self.string, self.depth, self.owner, self.below = string, depth, owner, {}


class Trie:
    """A compressed radix trie of byte strings. Edges are parts of strings that are held anyway, so a node costs no copy."""

    def __init__(self):
        self.root = Node(b"", 0)
        self.held: dict[int, int] = {}  # bytes below each child of the root
        self.size = 0

    def insert(self, string: bytes, owner: tuple) -> None:
        node = self.root
        while node.depth < len(string):
            first = string[node.depth]
            child = node.below.get(first)
            if child is None:
                node.below[first] = Node(string, len(string), owner)
                return self._grown(string)
            at = shared_prefix(child.string, string, node.depth, min(child.depth, len(string)))
            if at < child.depth:  # the string leaves the edge midway, or ends there: split it
                middle = node.below[first] = Node(string, at)
                middle.below[child.string[at]] = child
                child = middle
            node = child
        if node.owner is None:
            node.owner = owner
            return self._grown(string)
        node.owner = (*_better(node.owner[:2], owner[:2]), node.owner[2] + owner[2])

    def _grown(self, string: bytes) -> None:
        cost = len(string) + 300
        self.size += cost
        if string:
            self.held[string[0]] = self.held.get(string[0], 0) + cost

    def spill(self):
        """The (string, owner) of the largest subtree below the root, which is freed."""
        first = max(self.held, key=self.held.get)
        self.size -= self.held.pop(first)
        yield from self._owners(self.root.below.pop(first))

    def close(self):
        yield from self._owners(self.root)

    @staticmethod
    def _owners(top: Node):
        todo = [top]
        while todo:
            node = todo.pop()
            if node.owner is not None:
                yield node.string[:node.depth], node.owner
            todo += node.below.values()


def _own(batches):
    """A trie over one partition."""
    trie = Trie()

    def rows(found):
        out = []
        for string, owner in found:
            out.append((hashlib.sha256(string).digest(), *owner))
            if len(out) == 10_000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int32(), pa.int64(), pa.int64()))], ["digest", "points", "keep_id", "n"])

    for b in batches:
        for content, points, doc, n in zip(b.column("content"), *(b.column(c).to_pylist() for c in ("points", "doc_id", "n"))):
            trie.insert(content.as_buffer().to_pybytes(), (points, doc, n))
            while trie.size > HELD_BYTES and trie.held:
                yield from rows(trie.spill())
    yield from rows(trie.close())


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """digest, points, keep_id, group_size: one row per distinct normalised text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).alias("points"), utf8(F.col(text_col)).alias("text"))
    if partitions is None:
        total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        partitions = max(1, -(-total // PARTITION_BYTES))
    found = rows.mapInArrow(_fold, FOLDED).repartition(partitions, "length", "hash").mapInArrow(_own, OWNERS)
    best = F.min(F.struct((-F.col("points")).alias("less"), F.col("keep_id").isNull().alias("none"), "keep_id"))
    return found.groupBy("digest").agg(best.alias("best"), F.sum("n").alias("group_size")).select("digest", (-F.col("best.less")).alias("points"), "best.keep_id", "group_size")


def _digests(batches):
    for b in batches:
        digest = [hashlib.sha256(t.as_buffer().to_pybytes().translate(None, DROP)).digest() for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("own_points"), pa.array(digest, pa.binary())], ["doc_id", "own_points", "digest"])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per document, dropped ones too."""
    shared = owners(docs, id_col, text_col, partitions).where("group_size > 1")  # the rest own themselves
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).alias("own_points"), utf8(F.col(text_col)).alias("text")).mapInArrow(_digests, "doc_id long, own_points int, digest binary")
    best = F.col("points").isNull() | (F.col("own_points") == F.col("points")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    placed = rows.join(shared, "digest", "left").select("digest", "doc_id", F.when(F.col("points").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), "group_size", best.alias("best"))
    placed = saved(placed.withColumn("row", F.monotonically_increasing_id()), "owned")  # once written, a row's number is fixed
    ties = placed.where("best and group_size > 1").groupBy("digest").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    kept = F.col("best") & (F.col("first").isNull() | (F.col("row") == F.col("first")))
    return placed.join(ties, "digest", "left").select(
        "doc_id", "keep_id", F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
