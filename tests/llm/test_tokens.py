import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftline.llm import token_files, tokens

PLAIN = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
TEXTS = [None, "", " \n\t ", "Hello, World!", "don't can't'll x's", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "é é ΑΣ ΑΣ. İI ǅ", "a\x1cb\x85c\xa0d", "wörd!!! %%% x$$$ 12,3.4", "word " * 300, "x" * 5000, "日本語 テスト。。", "ab́... cd²!!"]


def plain(text):
    return np.array(PLAIN.encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()


def test_words_match_the_library():
    enc = tokens.WordEncoder(public_tokenizers.path(tokens.VOCABULARY))
    for _ in range(2):
        got = enc.encode_all([(t or "").encode() for t in TEXTS])
        assert [g + b"\x01\0\0\0" for g in got] == [plain(t) for t in TEXTS]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aB'sé́Σ<|>endoftxr \n\t\x1c\x85.,!1²٣"), max_size=40))
def test_random_texts_match_the_library(text):
    assert tokens.encoder().encode_all([text.encode()])[0] + b"\x01\0\0\0" == plain(text)


def test_long_texts_and_full_caches(monkeypatch):
    monkeypatch.setattr(tokens, "PART_BYTES", 64)
    monkeypatch.setattr(tokens, "CACHE_WORDS", 5)
    monkeypatch.setattr(tokens, "CACHE_STEMS", 3)
    enc = tokens.WordEncoder(public_tokenizers.path(tokens.VOCABULARY))
    long = "one two, three!\nfour " * 40 + "y" * 300 + " end"
    assert [x + b"\x01\0\0\0" for x in enc.encode_all([b"a b", long.encode(), b"c"])] == [plain("a b"), plain(long), plain("c")]
    assert len(enc.words) == 5 and 0 < len(enc.stems) <= 3


def test_words_of_letters_in_one_call_match_the_library():
    enc = tokens.WordEncoder(public_tokenizers.path(tokens.VOCABULARY))
    stems = [c * n + "x" for c in "abéßΣжق日" for n in range(1, 9)] + ["<w>", "w", "\u0345a", "a\u0301", "İ", "x1", "don't"]
    got = enc._encoded([s.encode() for s in stems])
    assert got == {s.encode(): plain(s)[:-4] for s in stems}
    assert enc._in_one([b"one", b"two"]) == [plain("one")[:-4], plain("two")[:-4]] and enc._in_one([b"one2", b"two"]) is None


def test_files_round_trip(spark):
    rows = [(i * 7 % 13, t) for i, t in enumerate(TEXTS)] + [(None, "none"), (3, "twice"), (3, "twice")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start int, ids string")
    got = token_files.token_file_report(spark, docs, shards=3).collect()
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    at = 0
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
    want = sorted((-1 if i is None else i, len(plain(t)) // 4, zlib.crc32(plain(t))) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want


def test_selective_reads_and_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(200)], "doc_id long, text string")
    path = f"file://{tmp_path}/t"
    token_files.write_tokens(docs, path, shards=4, row_group_bytes=4096, page_bytes=512, dictionary=False)
    assert "ids" not in token_files.read_metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    one = token_files.read_tokens(spark, path).where("doc_id = 77").collect()
    assert len(one) == 1 and np.array([*one[0].ids], "<u4").tobytes() == plain("text 77 " * 50)
    assert token_files.token_file_report(spark, docs.limit(0)).count() == 0


def test_letters_that_normalise_to_marks_match_the_library():
    import unicodedata

    enc = tokens.WordEncoder(public_tokenizers.path(tokens.VOCABULARY))
    changed = [c for c in map(chr, range(0x80, 0x30000)) if not 0xD800 <= ord(c) < 0xE000 and (unicodedata.normalize("NFC", c.lower()) != c or c.isalpha() and ord(c) < 0x1200)]
    texts = [form.replace("{}", c) for c in changed for form in ("a{}. {}!", "{}'s ({}).")]
    got = enc.encode_all([t.encode() for t in texts])
    for at in range(0, len(texts), 5000):
        want = PLAIN.encode_batch_fast(texts[at:at + 5000], add_special_tokens=False)
        assert [np.array(e.ids, "<u4").tobytes() for e in want] == got[at:at + 5000]


def test_encodings_row_groups_and_page_indexes(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(i, " ".join(str((i * 7919 + j * 104729) % 100003) for j in range(300))) for i in range(600)], "doc_id long, text string")
    for dictionary in (True, False):
        path = f"{tmp_path}/{dictionary}"
        token_files.write_tokens(docs, f"file://{path}", shards=2, row_group_bytes=16384, page_bytes=2048, dictionary=dictionary)
        files = sorted(glob.glob(f"{path}/*.parquet"))
        assert len(files) == 2
        groups = 0
        for f in files:
            meta = pq.ParquetFile(f).metadata
            groups += meta.num_row_groups
            for g in range(meta.num_row_groups):
                column = meta.row_group(g).column(4)
                assert column.path_in_schema.startswith("ids") and column.has_offset_index and meta.row_group(g).column(1).has_column_index
                kinds = set(column.encodings)
                assert ("RLE_DICTIONARY" in kinds) == dictionary and ("DELTA_BINARY_PACKED" in kinds) != dictionary
        assert groups > 2


def test_each_distinct_word_is_looked_up_once():
    class Counted(dict):
        looked = 0

        def get(self, *k):
            self.looked += 1
            return super().get(*k)

    enc = tokens.WordEncoder(public_tokenizers.path(tokens.VOCABULARY))
    enc.words = Counted()
    texts = [f"one two, three! w{i % 3} " * 200 for i in range(50)]
    for _ in range(2):
        enc.words.looked = 0
        assert [x + b"\x01\0\0\0" for x in enc.encode_all([t.encode() for t in texts])] == [plain(t) for t in texts]
        assert enc.words.looked < 50  # of 40,000 words


def test_words_of_letters_go_to_the_merges_and_match_the_library(tmp_path):
    import json

    import pytest

    enc = tokens.WordEncoder(public_tokenizers.path(tokens.VOCABULARY))
    called = []
    enc._in_one = lambda stems: called.append(stems)
    low = [chr(i) for i in range(0x80, 0x250) if chr(i).isalpha() and max(chr(i).lower()) < tokens.END_LETTER]
    stems = [f"{a}{c}{b}" for c in low for a, b in (("", ""), ("ab", ""), ("", "ab"))] + ["words", "schl\u00fcsse", "\u00ff", "a\u00ado"]
    got = enc.encode_all([s.encode() for s in stems])
    assert [x + b"\x01\0\0\0" for x in got] == [plain(s) for s in stems] and not called
    with pytest.raises(ValueError):
        enc.encode_all([b"a \xff b"])
    # a vocabulary that normalises or cuts in another way doesn't take the short way
    spec = json.loads(PLAIN.to_str())
    spec["normalizer"]["normalizers"].append({"type": "Replace", "pattern": {"String": "a"}, "content": "e"})
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec))
    own = Tokenizer.from_file(str(other))
    own_enc = tokens.WordEncoder(str(other))
    assert not own_enc.direct and own_enc.encode_all([b"banana bread"])[0] == np.array(own.encode("banana bread", add_special_tokens=False).ids, "<u4").tobytes()
