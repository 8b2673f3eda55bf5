"""Ranked lexical search as a blocked sparse matrix product: item-term multiplicities times term-document impacts.

The items are dealt to blocks of bounded size. For a block, one pass over all documents keeps of each what the block's terms need (occurrences and the document's length);
weights and impacts are 64-bit integers. Then every task builds its documents' term rows, merges an item's rows into one row of scores (Gustavson), and hands on each item's
best documents; a last step ranks them. Nothing is broadcast but a block's terms and their weights.

Nulls and ties: a null text, of an item or a document, has no terms; an item without terms, or whose terms no document holds, gives no row. A null item_id is returned as null;
items that repeat are ranked each by itself. Equal scores go by ascending doc_id, null last; rows that repeat are documents of their own. Other columns play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, sliced, small_batches

TOP = 10
#: Item-term entries of a block of items, at least one item a block.
BLOCK_TERMS = 1 << 19
#: Documents of a block of the product.
BLOCK_DOCS = 8192
#: Candidates a task holds before it reduces them.
HELD = 1 << 20
#: Parts that an item's candidates are ranked in first.
PARTS = 64
#: Bytes as they count in terms: A-Z lower-cased, all ASCII marks, blanks and controls as separators.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """All terms of a UTF-8 text in order."""
    return text.translate(FOLD).split()


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [Counter(terms_of(t or b"")) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([list(c) for c in found], pa.list_(pa.binary())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))], ["id", "terms", "times"])


def _blocks(items: DataFrame, id_type: str, block_terms: int):
    """The items in blocks: lists of (id, {term: multiplicity}). The driver holds one block and one partition of the items at a time."""
    own, size = [], 0
    for row in items.mapInArrow(_item_terms, f"id {id_type}, terms array<binary>, times array<bigint>").toLocalIterator():
        if not row.terms:
            continue
        if own and size + len(row.terms) > block_terms:
            yield own
            own, size = [], 0
        own.append((row.id, {bytes(t): n for t, n in zip(row.terms, row.times)}))
        size += len(row.terms)
    if own:
        yield own


def _counted(shared):
    """For every document with a term: its length and the block's terms in it."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for b in sliced(batches):
            keep, lengths, terms, times = [], [], [], []
            for i, text in enumerate(b.column(1)):
                words = terms_of(text.as_buffer().to_pybytes() if text.is_valid else b"")
                if not words:
                    continue
                found = Counter(filter(number.__contains__, words))
                keep.append(i)
                lengths.append(len(words))
                terms.append(np.fromiter(map(number.__getitem__, found), "<i4", len(found)).tobytes())
                times.append(np.fromiter(found.values(), "<i8", len(found)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keep, pa.int64())), pa.array(lengths, pa.int64()), pa.array(terms, pa.binary()), pa.array(times, pa.binary())], ["id", "n", "terms", "times"])
    return count


def _frequencies(n_terms: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(n_terms, np.int64)
        for b in batches:
            held += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), "<i4"), minlength=n_terms)
        there = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(held[there], pa.int64())], ["term", "df"])
    return count


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)


def impacts(times: np.ndarray, length: np.ndarray, weight: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """int64 impact of a term on a document, for occurrences, document lengths and weights given entry by entry."""
    m = 25 + (75 * length * n_docs) // all_terms
    return weight * ((1_000_000_000 * times) // (1000 * times + 8 * m))


def best(score: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by ascending id, ids that aren't known last."""
    at = np.arange(len(score))
    if len(at) > k:
        at = at[score >= np.partition(score, len(score) - k)[len(score) - k]]
    return at[np.lexsort((ids[at], ~known[at], -score[at]))][:k]


def merged_rows(row_start: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
    """One row of the product: the term rows of an item, each times its multiplicity, merged into int64 scores by document."""
    out = np.zeros(n_docs, np.int64)
    for t, k in zip(terms.tolist(), times.tolist()):
        own = slice(row_start[t], row_start[t + 1])
        out[doc[own]] += k * impact[own]  # a term has one entry a document
    return out


def _product(shared, n_docs: int, all_terms: int, k: int, id_type: pa.DataType):
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = shared.value
        found: list[list[np.ndarray]] = []

        def reduced() -> list[np.ndarray]:
            item, score, ids, known = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(item, kind="stable")
            keep = []
            for own in np.split(order, np.flatnonzero(np.diff(item[order])) + 1):
                keep.append(own[best(score[own], ids[own], known[own], k)])
            keep = np.concatenate(keep)
            return [item[keep], score[keep], ids[keep], known[keep]]

        held = 0
        for b in sliced(batches, BLOCK_DOCS):
            known = np.asarray(b.column(0).is_valid())
            ids = np.asarray(b.column(0).cast(pa.int64()).fill_null(0))
            n = np.asarray(b.column(1))
            parts = b.column(2).to_pylist()
            doc = np.repeat(np.arange(b.num_rows), [len(p) // 4 for p in parts])
            term = np.frombuffer(b"".join(parts), "<i4").astype(np.int64)
            times = np.frombuffer(b"".join(b.column(3).to_pylist()), "<i8")
            order = np.argsort(term, kind="stable")
            term, doc, times = term[order], doc[order], times[order]
            impact = impacts(times, n[doc], weight[term], n_docs, all_terms)
            row_start = np.searchsorted(term, np.arange(len(weight) + 1))
            for i, (terms, mult) in enumerate(items):
                score = merged_rows(row_start, doc, impact, b.num_rows, terms, mult)
                at = np.flatnonzero(score > 0)
                at = at[best(score[at], ids[at], known[at], k)]
                if len(at):
                    found.append([np.full(len(at), i), score[at], ids[at], known[at]])
                    held += len(at)
            if held > HELD:
                found = [reduced()]
                held = len(found[0][0])
                if held > HELD // 2:
                    yield _candidates(*found[0], id_type)
                    found, held = [], 0
        if found:
            yield _candidates(*reduced(), id_type)
    return multiply


def _candidates(item, score, ids, known, id_type) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, pa.int64(), mask=~known).cast(id_type), pa.array(score, pa.int64())], ["item", "doc", "score"])


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The k highest-scoring documents of every item: item_id, rank, doc_id, score. `id_col` is of an integer type."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    context = spark.sparkContext
    small_batches(spark)
    id_type, item_type = docs.schema[id_col].dataType, items.schema[item_col].dataType
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    out = None
    for block in _blocks(items.select(F.col(item_col).alias("id"), F.col(item_text).cast("binary").alias("text")), item_type.simpleString(), block_terms):
        number = {t: i for i, t in enumerate(sorted({t for _, own in block for t in own}))}
        counts = saved(texts.mapInArrow(_counted(context.broadcast(number)), f"id {id_type.simpleString()}, n bigint, terms binary, times binary"), "term-counts")
        total = counts.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        df = np.zeros(len(number), np.int64)
        for row in counts.select("terms").mapInArrow(_frequencies(len(number)), "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[row.term] = row.df
        rows = [(np.array([number[t] for t in own]), np.array(list(own.values()), np.int64)) for _, own in block]
        product = _product(context.broadcast((rows, weights(df, total.docs))), total.docs, total.terms, k, to_arrow_type(id_type))
        found = counts.mapInArrow(product, f"item int, doc {id_type.simpleString()}, score bigint")
        order = [F.desc("score"), F.asc_nulls_last("doc")]
        rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        found = found.withColumn("part", F.pmod(F.xxhash64("doc", "score"), F.lit(PARTS)))
        found = found.withColumn("rank", rank("item", "part")).where(F.col("rank") <= k).withColumn("rank", rank("item")).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, own) for i, (own, _) in enumerate(block)], f"item int, id {item_type.simpleString()}")
        found = found.join(names, "item").select(F.col("id").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"`{item_col}` {item_type.simpleString()}, rank int, `{id_col}` {id_type.simpleString()}, score bigint")
    return out
