"""Alignment of two tokenizers against whole-text encoding and pairwise overlaps."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm.alignment import Aligner, aligned_documents, aligner, byte_letters, overlaps, pack, unpack


@pytest.fixture(scope="module")
def whole():
    """(text) -> A ids, A bytes, B ids, B bytes, from the tokenizers themselves on the whole text."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    letters = byte_letters()

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[1:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def encode(text):
        ia = a.encode(" " + text, add_special_tokens=False).ids
        ib = b.encode(text)
        return ia, [bytes(letters[c] for c in a.id_to_token(i)) for i in ia], ib, [piece(i) for i in ib]
    return encode


def brute(whole, docs):
    each = []
    for d, text in docs:
        if text:
            ia, ba, ib, bb = whole(text)
            full = (" " + text).encode()
            if b"".join(ba) == full == b"".join(bb):
                ends_a, ends_b = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
                cuts = [0, *sorted(set(ends_a) & set(ends_b))]
                links = [(x, y) for x, ex, nx in zip(ia, ends_a, map(len, ba)) for y, ey, ny in zip(ib, ends_b, map(len, bb)) if max(ex - nx, ey - ny) < min(ex, ey)]
                groups = ";".join(",".join(str(x) for x, e in zip(ia, ends_a) if s < e <= t) + "|" + ",".join(str(y) for y, e in zip(ib, ends_b) if s < e <= t) for s, t in zip(cuts, cuts[1:]))
                each.append((d, len(ia), len(ib), len(cuts) - 1, links, hashlib.sha256(groups.encode()).hexdigest()))
                continue
        each.append((d, 0, 0, 0, [], ""))
    count = Counter(x for e in each for x in e[4])
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    return sorted([(d, a, b, g, len(x), sum(count[p] == most[p[1]] for p in x), sum(count[p] for p in x), h) for d, a, b, g, x, h in each], key=repr)


def run(spark, docs, **kw):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    return sorted((tuple(r) for r in aligned_documents(d, **kw).collect()), key=repr)


DOCS = [
    (1, "The quick brown fox can't jump over naïve façades."), (2, "The quick brown  fox\n\n jumps \t over  "), (3, ""), (4, None), (5, " leading"), (6, "   "), (7, "日本語のテキスト と 한국어 mixed 🎉🎉"),
    (8, "<|endoftext|> and <s> </s> <unk> <0x41>"), (9, "a block ▁ in a text"), (10, "nul \x00 byte \x1c\x1d x y 　 z  w"), (11, "x" * 3000 + " " + "ab" * 700), (None, "The quick"), (1, "The quick"), (1, "The quick"),
    (12, "ﬁ ligature ½ ① é é"), (13, "1234567 8.9 --- ... !!! ??"), (14, "it's we'll I'M 'twas ' s"),
]


def test_same_rows_as_whole_texts(spark, whole):
    assert run(spark, DOCS) == brute(whole, DOCS)


def test_same_rows_by_a_join(spark, whole):
    assert run(spark, DOCS, held_pairs=0) == brute(whole, DOCS)


def test_given_documents(spark, whole):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(40).collect()]
    docs = [(d, t[:1500]) for d, t in docs]  # the brute-force version compares all pairs of tokens
    assert run(spark, docs) == brute(whole, docs)


def test_empty_table_and_other_columns(spark):
    assert run(spark, []) == []
    d = spark.createDataFrame([(1, "a b", 7, "x")], "doc_id int, text string, n_a int, row string")
    assert aligned_documents(d).columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab é\n\t 日'1. <|▁\x00"), max_size=25), max_size=6))
def test_parts_give_what_whole_texts_give(whole, texts):
    for text, got in zip(texts, aligner().results(texts)):
        ia, ba, ib, bb = whole(text)
        full = (" " + text).encode()
        if not text or b"".join(ba) != full or b"".join(bb) != full:
            assert got is None
        else:
            groups = ";".join(x[0] for x in got).split(";")
            assert [int(i) for g in groups for i in g.split("|")[0].split(",")] == ia
            assert [int(i) for g in groups for i in g.split("|")[1].split(",")] == ib


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.randoms())
def test_owner_arrays(len_a, rng):
    total = sum(len_a)
    cuts = sorted({total, *(rng.randrange(1, total + 1) for _ in range(rng.randrange(5)))})
    len_b = np.diff([0, *cuts])
    first, a, b, groups = overlaps(np.array(len_a), len_b)
    ends_a = np.cumsum(len_a)
    want = sorted((max(ea - na, eb - nb), i, j) for i, (ea, na) in enumerate(zip(ends_a, len_a)) for j, (eb, nb) in enumerate(zip(cuts, len_b)) if max(ea - na, eb - nb) < min(ea, eb))
    assert list(zip(first.tolist(), a.tolist(), b.tolist())) == want
    assert groups.tolist() == [0, *sorted(set(ends_a.tolist()) & set(cuts))][:-1]


def test_packed_links_come_back():
    x = np.array([3, 70000, 2**32 - 1], np.uint32)
    links, times = unpack(pack(x, np.array([1, 300, 5])))
    assert links.tolist() == x.tolist() and times.tolist() == [1, 300, 5]
    assert isinstance(aligner(), Aligner)
