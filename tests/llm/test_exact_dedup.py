import hashlib
import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import exact_dedup


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6) | st.sampled_from([b"", b"a" * 40, b"a" * 90, b"a" * 40 + b"b" * 40]), st.integers(0, 3), st.integers(0, 9) | st.none()), max_size=30), st.integers(0, 5))
def test_trie_with_spilled_subtrees(rows, often):
    trie, got = exact_dedup.Trie(), []
    for k, (s, points, doc) in enumerate(rows):
        trie.insert(s, (points, doc, 1))
        if often and k % 7 == often and trie.held:
            got += trie.spill()
    got += trie.close()
    want, found = defaultdict(list), defaultdict(list)
    for s, points, doc in rows:
        want[s].append((-points, doc is None, doc or 0))
    for s, (points, doc, n) in got:
        found[s] += [(-points, doc is None, doc or 0)] + [(1, True, 0)] * (n - 1)
    assert {s: (min(v), len(v)) for s, v in found.items()} == {s: (min(v), len(v)) for s, v in want.items()}
    if not often:
        assert len(got) == len(want)


def brute(rows):
    norm = lambda t: (t or "").translate(dict.fromkeys(map(ord, " \t\n\x0b\x0c\r")))
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[norm(t)].append((-len(t or ""), i is None, i or 0, k))
    ident = lambda g: None if g[1] else g[2]
    return sorted(((i, ident(min(g)), len(g), min(g)[3] == k, hashlib.sha256(norm(t).encode()).hexdigest()) for k, (i, t) in enumerate(rows) for g in [groups[norm(t)]]), key=str)


def test_documents_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FOLD_BYTES", 1000)
    monkeypatch.setattr(exact_dedup, "HELD_BYTES", 2000)
    rng = random.Random(3)
    base = ["", " ", None, "é è\n", "a b", "ab", "a\tb ", "x" * 4000, "x" * 4000 + " ", "\x1ca", "a\x85", "a"]
    rows = [(i, rng.choice(base)) for i in range(300)] + [(1000 + i, f"u{i}") for i in range(50)] + [(None, "nobody")]
    docs = spark.createDataFrame([(*r, 1, "d") for r in rows], "doc_id long, text string, n int, digest string").repartition(5)
    got = exact_dedup.exact_duplicates(docs, partitions=3).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0
    twice = [(7, "t"), (7, "t"), (8, "t"), (None, "n"), (None, "n "), (None, "n "), (1, "a b"), (1, "ab"), (1, "a b"), (2, "ab")]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(twice, "doc_id long, text string").repartition(3), partitions=2).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(twice)
    assert sum(r.kept for r in got) == 3


def test_registered_sql_keeps_one_row_a_group(spark, tmp_path):
    import duckdb

    from weftline.llm import queries

    rows = [(1, "a b"), (1, "ab"), (1, "a b"), (None, "x"), (None, "x"), (3, None), (4, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duckdb.sql(queries.oracle_sql()["op10_exact_dedup"]).fetchall()
    got = queries.op10_exact_dedup(spark, str(tmp_path)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
