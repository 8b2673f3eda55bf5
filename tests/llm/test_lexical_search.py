"""Ranked lexical search against the plain definition, and its edge cases."""

import math
import re

import numpy as np
import pytest

from weftline.llm.lexical_search import best, merged_rows, ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, t) for d, t in held if t]
    n_docs, n_terms = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for d, t in held:
            m = 25 + (75 * len(t) * n_docs) // n_terms
            score = 0
            for w in terms(text):
                tf = t.count(w)
                if tf:
                    score += math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * df[w] + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def run(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted((tuple(r) for r in ranked_search(d, i, **kw).collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(7)
    words = ["The", "zebra", "naïve", "x1", "_", "İ", "don't", "ÄB", "cat", "　", "a\x00b", "-", "ox"]
    docs = [(int(i), " ".join(rng.choice(words, rng.integers(0, 40)))) for i in range(60)]
    docs += [(5, docs[5][1]), (100, docs[7][1]), (101, docs[7][1]), (None, "cat cat"), (None, "cat cat"), (102, None), (103, ""), (104, "cat " * 3000 + "zebra")]
    items = [(1, "cat ZEBRA cat"), (2, "the naïve don't"), (3, None), (4, "unheard"), (None, "ox x1"), (1, "cat ZEBRA cat"), (6, "äb İ 　 a\x00b")]
    return docs, items


def test_same_rows_as_the_definition(spark, corpus):
    docs, items = corpus
    assert run(spark, docs, items) == brute(docs, items)


def test_blocks_of_items_and_k_change_nothing_else(spark, corpus):
    docs, items = corpus
    assert run(spark, docs, items, k=3, block_terms=2) == brute(docs, items, 3)


def test_all_documents_where_fewer_than_k(spark):
    docs = [(2, "cat"), (1, "cat"), (3, "dog")]
    found = run(spark, docs, [(9, "cat")])
    assert [r[1:3] for r in found] == [(1, 1), (2, 2)] and found == brute(docs, [(9, "cat")])


@pytest.mark.parametrize("docs, items", [([], [(1, "cat")]), ([(1, "cat")], []), ([], []), ([(1, None)], [(1, "cat")])])
def test_empty_tables(spark, docs, items):
    assert run(spark, docs, items) == []


def test_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "cat", "x", 5)], "doc_id int, text string, rank string, score bigint")
    items = spark.createDataFrame([("a", "cat", 3)], "item_id string, text string, doc_id bigint")
    found = ranked_search(docs, items)
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 1


def test_merged_rows_and_best():
    rng = np.random.default_rng(1)
    table = rng.integers(0, 4, (5, 30)) * rng.integers(0, 2, (5, 30))
    term, doc = np.nonzero(table)
    start = np.searchsorted(term, np.arange(6))
    score = merged_rows(start, doc, table[term, doc].astype(np.int64), 30, np.array([0, 3]), np.array([2, 5]))
    assert (score == 2 * table[0] + 5 * table[3]).all()
    ids = rng.permutation(30)
    want = sorted(range(30), key=lambda i: (-score[i], ids[i]))[:7]
    assert best(score, ids, np.ones(30, bool), 7).tolist() == want
