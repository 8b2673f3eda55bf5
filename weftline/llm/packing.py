"""Operator 7, best-fit packing with Martello-Toth dominance reduction.

A document is its word ids and an end id. Longer documents than a sequence are cut into whole sequences and
one rest. Pieces of equal length are interchangeable, so the packing is solved on the number of pieces of each
length, at most `capacity` numbers whatever the data; the pieces then take their places by their rank among
those of their length.

Reduction: a small set {j}, {j, k} or {j, a, b} of pieces is fixed as a sequence of its own when it dominates every
other set that could hold j: whatever else fits beside j can be exchanged for the fixed pieces without needing more
sequences. Fixed sets leave the instance; the remainder goes by best fit in descending order of length.

Nulls and ties: a null text is an empty document (its end id alone). Equal rows are interchangeable. Empty input gives no
rows. Other columns of the input are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import fresh, prefix_sum, saved, sliced, utf8

CAPACITY = 4096
#: Pieces of one length that one task sorts.
CLASS_ROWS = 10_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str | None, end_id: int, capacity: int):
    def run(batches):
        enc, end = tokens.encoder(path), np.array([end_id], "<u4").tobytes()
        for b in sliced(batches):
            out = []
            for doc, packed in zip(b.column("doc_id").to_pylist(), enc.encode_all(b.column("text").to_pylist())):
                packed += end
                for k, at in enumerate(range(0, len(packed), 4 * capacity)):
                    part = packed[at:at + 4 * capacity]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = tokens.END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces of at most `capacity` ids."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(F.col(text_col)).alias("text"))
    return rows.mapInArrow(_cut(vocabulary, end_id, capacity), PIECES)


class Solver:
    """Packs a multiset of lengths. `placed` has rows (length, first rank, sequences, first sequence, pieces of this
    length in each, offset of the first): the pieces of a length with ranks from the first on fill that many sequences."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {s: n for s, n in counts.items() if n}
        self.sizes = sorted(self.left)
        self.used = defaultdict(int)
        self.sequences = 0
        self.fixed = 0
        self.placed: list[tuple[int, int, int, int, int, int]] = []

    def _take(self, size: int, bins: int, first: int, each: int, offset: int) -> None:
        self.placed.append((size, self.used[size], bins, first, each, offset))
        self.used[size] += bins * each
        self.left[size] -= bins * each
        if not self.left[size]:
            del self.left[size]
            self.sizes.pop(bisect.bisect_left(self.sizes, size))

    def _fix(self, members: list[int]) -> None:
        """Fix this set as often as the pieces left allow; a dominating set still dominates once a like one is gone."""
        each = {s: members.count(s) for s in sorted(set(members), reverse=True)}
        bins = min(self.left[s] // n for s, n in each.items())
        offset = 0
        for size, n in each.items():
            self._take(size, bins, self.sequences, n, offset)
            offset += size * n
        self.sequences += bins
        self.fixed += bins

    def _largest(self, room: int, without: dict[int, int]) -> int | None:
        """Largest length of at most `room` with a piece left besides those in `without`."""
        i = bisect.bisect_right(self.sizes, room) - 1
        while i >= 0 and self.left[self.sizes[i]] <= without.get(self.sizes[i], 0):
            i -= 1
        return self.sizes[i] if i >= 0 else None

    def _smallest(self, n: int, without: dict[int, int], above: int = 0) -> int:
        """Sum of the n smallest pieces longer than `above` besides `without`; over the capacity if there are fewer."""
        total = 0
        for s in self.sizes[bisect.bisect_right(self.sizes, above):]:
            k = min(n, self.left[s] - without.get(s, 0))
            total, n = total + k * s, n - k
            if not n:
                return total
        return self.capacity + 1

    def _pair(self, room: int, without: dict[int, int]) -> tuple[int, int, int] | None:
        """The two pieces left with the largest sum of at most `room`."""
        best = None
        hi = len(self.sizes) - 1
        for lo, a in enumerate(self.sizes):
            if self.left[a] <= without.get(a, 0):
                continue
            while hi >= lo and a + self.sizes[hi] > room:
                hi -= 1
            if hi < lo:
                break
            for i in range(hi, lo - 1, -1):
                b = self.sizes[i]
                if self.left[b] - without.get(b, 0) - (a == b) > 0:
                    if best is None or a + b > best[0]:
                        best = (a + b, b, a)
                    break
            if best and best[0] == room:
                break
        return best

    def _dominating(self, j: int) -> list[int] | None:
        """A set with j that dominates all sets that could hold j, if this can be told from at most three pieces."""
        own = {j: 1}
        room = self.capacity - j
        k = self._largest(room, own)
        if k is None:
            return [j]
        if k == room or self._smallest(2, own) > room:  # k fills the sequence, or nothing but one piece fits
            return [j, k]
        if self._smallest(3, own) <= room:
            return None
        total, a, b = self._pair(room, own)
        if k >= total:  # whatever two pieces fit also fit in the place of k
            return [j, k]
        if a == k and self._smallest(2, own, above=b) > room:  # of any two that fit, one is at most a and the other at most b
            return [j, a, b]
        return None

    def reduce(self) -> None:
        """Fix dominating sets, from the longest piece down, until a pass fixes nothing."""
        again = True
        while again:
            again = False
            for j in reversed(list(self.sizes)):
                while j in self.left and (members := self._dominating(j)):
                    self._fix(members)
                    again = True

    def best_fit(self) -> None:
        """Best fit in descending order: each piece goes to the fullest sequence that has room for it. Sequences with equal
        contents are kept as one group (room, first, number)."""
        groups: dict[int, list[tuple[int, int]]] = defaultdict(list)
        rooms: list[int] = []

        def put(room: int, first: int, n: int) -> None:
            if room and n:
                if not groups[room]:
                    bisect.insort(rooms, room)
                groups[room].append((first, n))

        for s in list(reversed(self.sizes)):
            while s in self.left:
                i = bisect.bisect_left(rooms, s)
                if i < len(rooms):
                    room = rooms[i]
                    first, n = groups[room].pop()
                    if not groups[room]:
                        del groups[room]
                        rooms.pop(i)
                else:
                    room, first, n = self.capacity, self.sequences, None
                each, have = room // s, self.left[s]
                whole = have // each if n is None else min(n, have // each)
                rest = have - whole * each if (n is None or whole < n) and have - whole * each < each else 0
                offset = self.capacity - room
                if whole:
                    self._take(s, whole, first, each, offset)
                    put(room - each * s, first, whole)
                if rest:
                    self._take(s, 1, first + whole, rest, offset)
                    put(room - rest * s, first + whole, 1)
                done = whole + (rest > 0)
                if n is None:
                    self.sequences += done
                else:
                    put(room, first + done, n - done)

    def solve(self) -> "Solver":
        self.reduce()
        self.best_fit()
        return self


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces with columns doc_id, piece, length and others. `pieces` should be a written table: it is read twice."""
    spark = pieces.sparkSession
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    solver = Solver(counts, capacity).solve()
    placed = sorted(solver.placed)
    seats = spark.sparkContext.broadcast(np.array(placed, "int64").reshape(-1, 6))

    @F.pandas_udf("sequence_id long, offset long")
    def seat(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        rows = seats.value
        size, rank = length.to_numpy("int64"), rank.to_numpy("int64")
        key = rows[:, 0].astype("float64") * 2.0**40 + rows[:, 1]  # exact: lengths take 12 bits, ranks 40
        i = np.searchsorted(key, size.astype("float64") * 2.0**40 + rank, "right") - 1
        inside = rank - rows[i, 1]
        return pd.DataFrame({"sequence_id": rows[i, 3] + inside // rows[i, 4], "offset": rows[i, 5] + inside % rows[i, 4] * size})

    order = [c for c in pieces.columns if c != "length"]
    rank, place = fresh(pieces, "_rank", "_seat")
    ranked = prefix_sum(pieces, ["length"], order, F.lit(1), rank, max(counts.values(), default=1), CLASS_ROWS)
    return ranked.select(*pieces.columns, seat("length", rank).alias(place)).select(*pieces.columns, f"{place}.*")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = tokens.END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(saved(token_pieces(docs, capacity, vocabulary, end_id, id_col, text_col), "pieces"), capacity)
