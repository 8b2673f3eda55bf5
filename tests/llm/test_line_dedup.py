import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import line_dedup

CUT = Fraction(4, 5)


def similar(x, y, cut=CUT):
    return len(x & y) >= cut * len(x | y)


def lines_of(rows, min_words=5):
    """(doc, line number, set) in order."""
    out = []
    for doc, text in rows:
        for i, line in enumerate((text or "").encode().lower().split(b"\n")):
            if len(line.split()) >= min_words:
                out.append((doc if doc is not None else line_dedup.LAST, i, frozenset(line.split()), text))
    return sorted(set(out), key=lambda r: r[:2])


def brute(rows):
    lines, out = lines_of(rows), {}
    for k, (doc, i, own, text) in enumerate(lines):
        found = {d for d, j, other, t in lines[:k] if (d, t, j) != (doc, text, i) and similar(own, other)}
        if found:
            out[doc, i] = found
    return out


def corpus(rng, docs, vocabulary, common):
    words = [f"w{i}" for i in range(vocabulary)]
    base = [" ".join(rng.choice(words[:common]) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randint(4, 60))) for _ in range(docs // 2)]
    rows = []
    for i in range(docs):
        lines = []
        for _ in range(rng.randint(0, 6)):
            w = rng.choice(base).split()
            for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
                w[rng.randrange(len(w))] = rng.choice(words)
            if rng.random() < 0.2:
                w = w[:-1]
            lines.append(" ".join(w).upper() if rng.random() < 0.1 else " ".join(w))
        rows.append((i * 7 % 1009, rng.choice(["\n", "\n\n"]).join(lines)))
    return rows


@pytest.mark.parametrize("frequent,paired", [(1 << 16, 12), (3, 1)])
def test_removed_lines_match_brute_force(spark, monkeypatch, frequent, paired):
    monkeypatch.setattr(line_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(line_dedup, "PAIRED", paired)
    rng = random.Random(frequent)
    rows = corpus(rng, 160, 300, 12) + [(2000, None), (2001, ""), (2002, "short line"), (2003, "a b c d e\n" * 3), (2004, "a b c d e"), (5, "a b c d e f"), (2005, "u u u u v"), (2006, "u v v v v"), (2007, "q q q q q"), (2008, "q q q q q q"), (None, "e d c b a")]
    hot = [f"h{i}" for i in range(30)]
    for i in range(40):  # a group of near copies
        w = list(hot)
        w[rng.randrange(30)] = f"x{i}"
        rows.append((3000 + i, " ".join(w)))
    rows += [rows[3], rows[3]]
    docs = spark.createDataFrame([(*r, 7, "s") for r in rows], "doc_id long, text string, line int, size string").repartition(4)
    got = {(r.doc, r.line): r.mdoc for r in line_dedup.later_lines(docs).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    assert all(got[k] in want[k] for k in got)


def test_report_and_texts(spark):
    rows = [(1, "one two three four five\nkeep this line here please\nend"), (2, "ONE two three  four five\nanother line of five words\nend"), (3, "another line of five words"), (4, None), (None, "one two three four five six\n\nlast")]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, removed int")
    got = {r.doc_id: (r.n_lines, r.n_removed, list(r.removed), list(r.matches)) for r in line_dedup.line_report(docs, min_words=5).collect()}
    assert got == {1: (3, 0, [], []), 2: (3, 1, [0], [1]), 3: (1, 1, [0], [2]), 4: (0, 0, [], []), None: (3, 1, [0], [1])}
    texts = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, min_words=5).collect()}
    assert texts == {1: rows[0][1], 2: "another line of five words\nend", 3: "", 4: None, None: "\nlast"}
    assert line_dedup.dedup_lines(docs).columns == docs.columns
    assert line_dedup.line_report(docs.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), min_size=1, max_size=25, unique=True), min_size=2, max_size=12), st.integers(0, 50), st.sampled_from([0, 4, 8, 12, 40]), st.sampled_from(["0.8", "0.6", "0.4"]))
def test_similar_sets_share_a_record_key(sets, frequent, paired, cut):
    cut = Fraction(cut)
    rank = np.arange(1 << line_dedup.CELLS, dtype="u4")
    sets = sets + [s[:-1] for s in sets if len(s) > 4] + [s + [99] for s in sets]
    counts = np.array([len(s) for s in sets])
    h = np.array([x | x << 50 for s in sets for x in s], "u8")
    keys, _, line, sizes = line_dedup._sets(counts, h, rank)
    before, line_dedup.PAIRED = line_dedup.PAIRED, paired
    try:
        at, key, pos = line_dedup.prefix_records(keys, line, sizes, cut, frequent)
    finally:
        line_dedup.PAIRED = before
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if set(x) != set(y) and similar(set(x), set(y), cut):
                assert set(key[at == i].tolist()) & set(key[at == j].tolist())


@pytest.mark.parametrize("size", [30, 64, 300, 2000])
def test_parts_of_long_sets_meet(size):
    rng = np.random.default_rng(size)
    for _ in range(30):
        x = rng.choice(1 << 40, 2 * size, replace=False).astype("u8")
        own, other = x[:size], x[size:]
        gone = int(rng.integers(0, size // 5))
        new = int((size - gone) / 0.8 - size) if gone < size // 9 else 0  # as many as Jaccard 0.8 allows
        near = np.concatenate([own[gone:], other[:max(0, new)]])
        assert len(own) - gone >= CUT * (len(own) + max(0, new))
        at, key = line_dedup.parts_records(np.concatenate([own, near]), np.array([len(own), len(near)]), CUT)
        assert set(key[at == 0].tolist()) & set(key[at == 1].tolist())
        assert len(key) < 0.65 * (len(own) + len(near)) + 16


def test_a_long_line_of_frequent_words_has_fewer_records_than_words():
    keys = np.arange(20_000, dtype="u8") << np.uint64(24)
    at, key, pos = line_dedup.prefix_records(keys, np.zeros(20_000, "i8"), np.array([20_000]), CUT, 0)
    assert 0 < len(key) < 20_000


def words_of(text):
    return [[w.lower() for w in line.split()] for line in text.split(b"\n")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"B", b"b", b" ", b"  ", b"\n", b"\t", b"\x0b", b"word", "\u00c4\u00e4".encode(), b"x" * 300, b"y" * 255, b"y" * 256]), max_size=60), st.sampled_from([256, 600, 1 << 18]))
def test_word_hashes(parts, piece):
    text = b"".join(parts)
    before, line_dedup.PIECE = line_dedup.PIECE, piece
    try:
        h, counts = line_dedup.line_words(text)
    finally:
        line_dedup.PIECE = before
    want = words_of(text)
    assert counts.tolist() == [len(w) for w in want]
    flat = [w for line in want for w in line]
    assert len(h) == len(flat)
    whole = {w: int(line_dedup.line_words(w)[0][0]) for w in set(flat)}
    assert h.tolist() == [whole[w] for w in flat] and len(set(whole.values())) == len(whole)


def test_word_hashes_of_a_vocabulary_are_distinct_and_spread():
    words = [f"{a}{i}" for i in range(20_000) for a in ("", "w", "aa")]
    h, counts = line_dedup.line_words(" ".join(words).encode())
    assert counts.tolist() == [60_000] and len(set(h.tolist())) == 60_000
    assert np.bincount(h & np.uint64(255), minlength=256).max() < 400 and np.bincount(h >> np.uint64(56), minlength=256).max() < 400


def brute_classes(rows, min_words=5):
    """(doc, line): (removed, copies, links, class) of all lines that another one matches, by all pairs. doc_ids are distinct."""
    first, count, out = {}, {}, {}
    for doc, i, own, _ in lines_of(rows, min_words):
        first.setdefault(own, (doc, i))
        count[own] = count.get(own, 0) + 1
    links = {x: [y for y in first if y != x and similar(x, y)] for x in first}
    least = dict(first)
    for _ in first:
        least = {x: min([least[x], *(least[y] for y in links[x])]) for x in first}
    for doc, i, own, _ in lines_of(rows, min_words):
        if links[own] or count[own] > 1:
            out[doc, i] = (first[own] != (doc, i) or any(first[y] < (doc, i) for y in links[own]), count[own] - 1, len(links[own]), least[own])
    return out


@pytest.mark.parametrize("frequent,pairs", [(1 << 16, 1 << 21), (3, 50)])
def test_all_links_and_classes_match_brute_force(spark, monkeypatch, frequent, pairs):
    monkeypatch.setattr(line_dedup, "VERIFY_BYTES", pairs * 50)
    monkeypatch.setattr(line_dedup, "FOLD_LINES", pairs)
    monkeypatch.setattr(line_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(line_dedup, "BLOCK_PAIRS", pairs)
    rng = random.Random(frequent)
    rows = [(i, t) for i, (_, t) in enumerate(corpus(rng, 120, 300, 12))] + [(2000, "a b c d e\na a b c d e"), (2001, "u u u u v"), (2002, "u v v v v"), (None, "e d c b a f")]
    hot = [f"h{i}" for i in range(30)]
    for i in range(40):  # near copies, each linked to all others
        w = list(hot)
        w[rng.randrange(30)] = f"x{i}"
        rows.append((3000 + i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r.doc, r.line): (r.mdoc is not None, r.copies, r.links, (r["class"].doc, r["class"].line)) for r in line_dedup.line_classes(docs).collect()}
    assert got == brute_classes(rows)
    report = {r.doc_id: r for r in line_dedup.line_report(docs, min_words=5).collect()}
    assert report[3000].links == [39] and report[3039].removed == [0] and report[3000].removed == [] and report[3000].classes == report[3039].classes
    assert report[2000].copies == [1, 1] and report[2000].links == [1, 1] and report[None].classes[0] == report[2000].classes[0]


def test_short_lines_of_the_query(spark, tmp_path):
    from weftline.llm.queries import op2_line_dedup

    rows = [(1, "end\n\none two\na b c d\nx y z"), (2, "END end\n\ntwo one one\na b c d e\nx y z w"), (3, "end\na b c\nd c b a"), (4, "\n \n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (list(r.removed), list(r.matches), list(r.linked), list(r.copies), list(r.links)) for r in op2_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {
        1: ([], [], [0, 2, 3], [2, 1, 1], [0, 0, 1]), 2: ([0, 2, 3], [1, 1, 1], [0, 2, 3], [2, 1, 0], [0, 0, 1]),
        3: ([0, 2], [1, 1], [0, 2], [2, 1], [0, 1]), 4: ([], [], [], [], []),
    }
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(corpus(random.Random(5), 60, 12, 12))] + [(100 + i, " ".join(random.Random(i).choices("abcdef", k=1 + i % 6))) for i in range(80)], "doc_id long, text string")
    made = [(r.doc_id, r.text) for r in docs.collect()]
    found = {(r.doc, r.line): (r.mdoc is not None, r.copies, r.links, (r["class"].doc, r["class"].line)) for r in line_dedup.line_classes(docs, min_words=1).collect()}
    assert found == brute_classes(made, 1)


def test_short_lines_of_the_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "end\nkeep", "en", "s", 8), (2, "new\nEnd", "en", "s", 7)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_repeated_lines(spark, docs, str(tmp_path)).collect()}
    assert got == {1: ("end\nkeep", 8), 2: ("new", 3)}


def test_large_buckets_are_dealt_in_parts():
    n = 1000
    r = np.zeros(n, line_dedup.RECORD)
    r["id"], r["size"], r["key"] = np.arange(n), 80, 3_000_000_000 << 16
    dealt = line_dedup.in_parts(r, np.array([5, 3_000_000_000], "u8"), np.array([2, 8]))
    assert len(dealt) == 8 * n and np.unique(dealt["key"], return_counts=True)[1].max() < 0.4 * n
    assert len(line_dedup.in_parts(r, np.array([5], "u8"), np.array([2]))) == n
    out = line_dedup._buckets(line_dedup._unpack([b"".join(dealt[f].tobytes() for f in line_dedup.RECORD.names)]), CUT)
    seen = [tuple(sorted(p)) for i, j in line_dedup.candidate_pairs(out, CUT) for p in zip(out["id"][i].tolist(), out["id"][j].tolist())]
    assert len(seen) == len(set(seen)) == n * (n - 1) // 2


def test_many_copies_and_a_long_line_of_frequent_words(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "FREQUENT", 1 << 10)
    long = " ".join(f"v{i}" for i in range(20_000))
    near = " ".join(f"v{i}" for i in range(1, 20_000))
    far = " ".join(f"v{i}" for i in range(5_000, 20_000))
    rows = [(0, long), (1, near), (2, far)] + [(3 + i, "\n".join(f"v{j}" for j in range(i, 20_000, 100)) + "\n" + "the same line\n" * 1000) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc, r.line) for r in line_dedup.later_lines(docs, min_words=2).collect()}
    assert got == {(1, 0)} | {(3 + i, 200 + k) for i in range(30) for k in range(1000) if (i, k) != (0, 0)}


def test_columns_with_internal_names_stay(spark):
    names = ["doc", "row", "line", "mdoc", "removed", "_doc", "_row", "_removed", "words", "group", "records", "s0"]
    docs = spark.createDataFrame([(i, "a b c d e", *range(len(names))) for i in range(3)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = line_dedup.dedup_lines(docs, min_words=5)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text, tuple(r)[2:]) for r in got.collect()) == [(i, "a b c d e" if i == 0 else "", tuple(range(len(names)))) for i in range(3)]
    assert line_dedup.line_report(docs).count() == 3


@pytest.mark.parametrize("size", [3])
def test_parts_change_no_result(spark, monkeypatch, size):
    monkeypatch.setattr(line_dedup, "BUCKET", size)
    monkeypatch.setattr(line_dedup, "FREQUENT", size)
    rng = random.Random(size)
    rows = [(i, t) for i, (_, t) in enumerate(corpus(rng, 60, 60, 12))] + [(3000 + i, " ".join([f"h{k}" for k in range(12)] + [f"x{i}"])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc, r.line): (r.mdoc is not None, r.copies, r.links, (r["class"].doc, r["class"].line)) for r in line_dedup.line_classes(docs).collect()}
    want = brute_classes(rows)
    assert got == want
    assert {(r.doc, r.line) for r in line_dedup.later_lines(docs).collect()} == {k for k, v in want.items() if v[0]}


@pytest.mark.parametrize("words", [None, 5])
def test_lines_of_every_length_are_compared_unless_a_least_number_is_asked_for(spark, words):
    """The rows of test_all_links_and_classes_match_brute_force at 2^16, some of whose copies have three words; without `min_words` these count."""
    rows = [(i, t) for i, (_, t) in enumerate(corpus(random.Random(1 << 16), 120, 300, 12))] + [(2000, "a b c d e\na a b c d e"), (2001, "u u u u v"), (None, "e d c b a f")]
    asked = {} if words is None else {"min_words": words}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r.doc, r.line): (r.mdoc is not None, r.copies, r.links, (r["class"].doc, r["class"].line)) for r in line_dedup.line_classes(docs, **asked).collect()}
    want = brute_classes(rows, words or 1)
    assert got == want
    assert {(r.doc, r.line) for r in line_dedup.later_lines(docs, **asked).collect()} == {k for k, v in want.items() if v[0]}
    assert words or set(want) > set(brute_classes(rows, 5))
