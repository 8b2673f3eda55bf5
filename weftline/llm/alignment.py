"""Alignment of two tokenizers over the same bytes, by byte-owner arrays.

Token indices are repeated over the bytes that they cover, once for each tokenizer. Where the pair of owners changes, a new overlap (link) begins; where both change at once, both tokenizers
end a token and a group ends. Neither vocabulary joins bytes across a single blank between two other characters, so texts are cut there and a worker remembers
what it has found for a part; new parts are encoded together, as one text.

First all documents are aligned and their distinct links written, packed. Links are then counted over the corpus, and each document's links looked up: in sorted arrays, where the
table of id pairs has at most HELD_PAIRS rows, else by a join.

Nulls and ties: texts that are null, empty, or that a tokenizer doesn't give back byte for byte have no tokens: zeros and an empty digest. All rows are kept, repeated
ids and null ids too. An id pair that shares its B id's highest count is one of the best, too. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, sliced, small_batches

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
#: Rows of the table of id pairs up to which it is sent to all workers (17 bytes a row).
HELD_PAIRS = 1 << 22
#: Parts that a worker remembers.
CACHE_PARTS = 250_000
#: Longer parts aren't remembered.
CACHE_CHARS = 64
#: Characters that are encoded at once.
JOINED_CHARS = 1 << 16
#: Links that a task gathers before it counts them.
GATHERED = 1 << 22

#: Single blanks between characters that aren't white space.
_BLANK = re.compile(r"(?<=\S) (?=\S)")
_SHIFT = 40
_MASK = (1 << _SHIFT) - 1

_aligners: dict[tuple, "Aligner"] = {}


def aligner(path_a: str | None = None, path_b: str | None = None) -> "Aligner":
    """This worker's aligner; the defaults are the public vocabularies."""
    if path_a is None or path_b is None:
        import public_tokenizers

        path_a, path_b = path_a or public_tokenizers.path(VOCABULARY_A), path_b or public_tokenizers.path(VOCABULARY_B)
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def overlaps(len_a: np.ndarray, len_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From the tokens' lengths in bytes, of equal sums: the first byte of each overlap, its A and B token, and the first byte of each group."""
    own_a, own_b = np.repeat(np.arange(len(len_a)), len_a), np.repeat(np.arange(len(len_b)), len_b)
    if not len(own_a):
        return (np.zeros(0, np.int64),) * 4
    new_a, new_b = own_a[1:] != own_a[:-1], own_b[1:] != own_b[:-1]
    first = np.r_[0, np.flatnonzero(new_a | new_b) + 1]
    return first, own_a[first], own_b[first], np.r_[0, np.flatnonzero(new_a & new_b) + 1]


class Aligner:
    """Aligned parts of texts. A part's result: its groups as text, its links as packed unsigned 32-bit numbers (A id above, B id in the low 16 bits), and its
    numbers of A tokens, B tokens and groups in one integer; None where the bytes aren't given back."""

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        size = self.a.get_vocab_size()
        self.bytes_a = [bytes(letters.get(c, 0) for c in self.a.id_to_token(i) or "") for i in range(size)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if max(len(pieces), size) > 1 << 16 or any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("ids have to fit 16 bits, and no piece may hold a blank behind another character")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        ids = [str(i) for i in range(max(size, len(pieces)))]
        self.text = [[i + mark for i in ids] for mark in ",|;"]
        self.known: dict[str, tuple | None] = {}

    def _ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """A and B ids of blank + text, or None where the bytes differ."""
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text, num_threads=1)
        whole = (" " + text).encode()
        if b"".join([self.bytes_a[i] for i in a]) != whole or b"".join([self.bytes_b[i] for i in b]) != whole:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def _align(self, parts: list[str]) -> Iterator[tuple | None]:
        """Results of parts that, but for the last, don't end in white space; all are encoded as one text."""
        ids = self._ids(" ".join(parts))
        if ids is None:
            if len(parts) == 1:
                yield None
            else:
                yield from self._align(parts[:len(parts) // 2])
                yield from self._align(parts[len(parts) // 2:])
            return
        a, b = ids
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        first, own_a, own_b, groups = overlaps(self.len_a[a], self.len_b[b])
        links = (a[own_a] << 16 | b[own_b]).astype("<u4")
        part_end = np.cumsum([len(p.encode()) + 1 for p in parts])
        group_a, group_b = (np.searchsorted(groups, ends - 1, "right") - 1 for ends in (ends_a, ends_b))
        last_a, last_b = (np.append(g[1:] != g[:-1], True) for g in (group_a, group_b))
        # a group's A ids stand before its B ids, so a token's place follows from the other tokenizer's tokens before it
        n_a, n_b = np.bincount(group_a, minlength=len(groups)), np.bincount(group_b, minlength=len(groups))
        place_a = np.arange(len(a)) + (np.cumsum(n_b) - n_b)[group_a]
        place_b = np.arange(len(b)) + np.cumsum(n_a)[group_b]
        words: list[str] = [""] * (len(a) + len(b))
        comma, bar, semicolon = self.text
        for i, at, last in zip(a.tolist(), place_a.tolist(), last_a.tolist()):
            words[at] = bar[i] if last else comma[i]
        for i, at, last in zip(b.tolist(), place_b.tolist(), last_b.tolist()):
            words[at] = semicolon[i] if last else comma[i]
        to_a, to_b, to_group, to_link = (np.searchsorted(x, part_end, "right") for x in (ends_a, ends_b, groups + 1, first + 1))
        from_a = from_b = from_group = from_link = 0
        for ta, tb, tg, tl in zip(to_a.tolist(), to_b.tolist(), to_group.tolist(), to_link.tolist()):
            yield "".join(words[from_a + from_b:ta + tb])[:-1], links[from_link:tl].tobytes(), ta - from_a | tb - from_b << _SHIFT | tg - from_group << 2 * _SHIFT
            from_a, from_b, from_group, from_link = ta, tb, tg, tl

    def learn(self, parts: list[str]) -> dict[str, tuple | None]:
        found: dict[str, tuple | None] = {}
        own: list[str] = []
        size = 0
        for p in parts:
            if p[-1:].isspace():
                found[p] = next(self._align([p]))
                continue
            own.append(p)
            size += len(p) + 1
            if size >= JOINED_CHARS:
                found.update(zip(own, self._align(own)))
                own, size = [], 0
        if own:
            found.update(zip(own, self._align(own)))
        if len(self.known) < CACHE_PARTS:
            self.known.update((p, x) for p, x in found.items() if len(p) <= CACHE_CHARS)
        return found

    def results(self, texts: list[str | None]) -> Iterator[list[tuple] | None]:
        """The results of all parts of each text, or None where it has no tokens."""
        known = self.known
        split = [_BLANK.split(t) if t else [] for t in texts]
        new = self.learn(list({p for own in split for p in own if p not in known}))
        for own in split:
            got = [new[p] if p in new else known[p] for p in own]
            yield got if got and None not in got else None


def pack(links: np.ndarray, times: np.ndarray) -> bytes:
    """Distinct links, sorted, and how often each occurs; bytes of one weight stand together, which compresses well."""
    plain = np.concatenate([np.diff(links, prepend=np.uint32(0)).astype("<u4"), times.astype("<u4")])
    return len(plain).to_bytes(8, "little") + pa.compress(plain.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    plain = np.frombuffer(pa.decompress(data[8:], 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n).T.copy().view("<u4").ravel()
    return np.cumsum(plain[:n // 2], dtype=np.uint32), plain[n // 2:].astype(np.int64)


def _aligned(path_a: str | None, path_b: str | None):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = aligner(path_a, path_b)
        for b in sliced(batches, 200):
            rows = []
            for got in worker.results(b.column(1).to_pylist()):
                if got is None:
                    rows.append((0, 0, 0, 0, "", b""))
                    continue
                links = np.frombuffer(b"".join(map(itemgetter(1), got)), "<u4")
                sizes = sum(map(itemgetter(2), got))
                digest = hashlib.sha256(";".join(map(itemgetter(0), got)).encode()).hexdigest()
                rows.append((sizes & _MASK, sizes >> _SHIFT & _MASK, sizes >> 2 * _SHIFT, len(links), digest, pack(*np.unique(links, return_counts=True))))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, pa.int64()) for x in columns[:4]), pa.array(columns[4], pa.string()), pa.array(columns[5], pa.binary())],
                ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])
    return align


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's distinct links and how often they occur."""
    links, times = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    held = 0

    def merged():
        every, n = np.concatenate(links), np.concatenate(times)
        order = np.argsort(every, kind="stable")
        every, n = every[order], n[order]
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]][:len(every)])
        return [every[first]], [np.add.reduceat(n, first) if len(first) else n]

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(links[0].astype(np.int64)), pa.array(times[0])], ["link", "times"])

    for b in sliced(batches):
        for data in b.column(0).to_pylist():
            if not data:
                continue
            x, n = unpack(data)
            links.append(x)
            times.append(n)
            held += len(x)
            if held > GATHERED:
                links, times = merged()
                held = len(links[0])
                if held > GATHERED // 2:
                    yield rows()
                    links, times, held = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
    links, times = merged()
    yield rows()


def _looked_up(shared):
    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        link, count, top = shared.value
        for b in sliced(batches, 200):
            best, total = [], []
            for data in b.column(6).to_pylist():
                if not data:
                    best.append(0)
                    total.append(0)
                    continue
                x, n = unpack(data)
                at = np.searchsorted(link, x)
                best.append(int(n[top[at]].sum()))
                total.append(int((n * count[at]).sum()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(6)), pa.array(best, pa.int64()), pa.array(total, pa.int64())],
                                             ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"])
    return look_up


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, 200):
        for row, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if data:
                x, n = unpack(data)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), row)), pa.array(x.astype(np.int64)), pa.array(n)], ["row", "link", "n"])


def link_counts(aligned: DataFrame) -> DataFrame:
    """How often an id pair is linked in the corpus, and whether no pair of its B id is linked more often: a, b, count, top."""
    counts = aligned.select("links").mapInArrow(_pairs, "link bigint, times bigint").groupBy("link").agg(F.sum("times").alias("count"))
    counts = saved(counts.withColumns({"a": F.shiftright("link", 16), "b": F.col("link").bitwiseAND(0xFFFF)}), "links")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("a", "b", "link", "count", (F.col("count") == F.col("most")).alias("top"))


def aligned_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, held_pairs: int = HELD_PAIRS) -> DataFrame:
    """A row for each document: its id, n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum."""
    spark = docs.sparkSession
    small_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    sizes = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
    aligned = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_aligned(path_a, path_b), f"id {id_type}, {sizes}, links binary")
    aligned = saved(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = saved(link_counts(aligned), "link-counts")
    if counts.count() <= held_pairs:
        held = counts.select("link", "count", "top").toArrow().sort_by("link")
        shared = spark.sparkContext.broadcast((np.asarray(held["link"]).astype(np.uint32), np.asarray(held["count"]), np.asarray(held["top"])))
        out = aligned.drop("row").mapInArrow(_looked_up(shared), f"id {id_type}, {sizes}, n_best bigint, count_sum bigint")
    else:
        each = aligned.select("row", "links").mapInArrow(_unpacked, "row bigint, link bigint, n bigint").join(counts, "link")
        sums = each.groupBy("row").agg(F.sum(F.when(F.col("top"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        out = aligned.join(sums, "row", "left").select("id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", zero("n_best"), zero("count_sum"))
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
