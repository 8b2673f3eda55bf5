"""Whole-text encoding with a public tokenizer, one cached word at a time.

The vocabulary splits at white space and never joins across it, so a text's ids are its words' ids
in order. Words repeat far more often than texts: each worker keeps the ids of the words it has met
(packed as little-endian unsigned 32-bit integers), looks each distinct word of a few megabytes up once,
and asks the tokenizers library only for new ones.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from itertools import islice

import numpy as np
import pyarrow as pa

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Words a worker remembers, and stems and marks that they are put together from; others are worked out anew each time they come.
CACHE_WORDS = 600_000
CACHE_STEMS = 200_000
#: ASCII punctuation that may end a word; the apostrophe is missing because it starts contractions.
TAIL = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
#: Longer texts are encoded in parts, so that a very long text needs bounded memory.
PART_BYTES = 4 << 20
#: Stands between texts as a word of its own, which no UTF-8 text holds, and the number it is given.
MARK = b"\xff"
BETWEEN = b" \xff "
NO_ID = b"\xff\xff\xff\xff"
#: The normaliser and the cutting into words under which letters below END_LETTER go to the merges as they are, byte by byte.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
CUTTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
END_LETTER = "\u0250"  # letters below are the same in every Unicode version in use
#: How the byte-level vocabulary writes the bytes that aren't themselves in Latin-1, of those that letters have.
BYTE_LETTERS = {b: 256 + n for n, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}

_encoders: dict[str, "WordEncoder"] = {}


def encoder(path: str | None = None) -> "WordEncoder":
    """This worker's encoder for a vocabulary file; the default is the public word vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class WordEncoder:
    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model._resize_cache(0)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.words: dict[bytes, bytes] = {}
        self.stems: dict[bytes, bytes] = {}
        normalizer, cutter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Whether words of letters may go to the merges alone.
        self.direct = bool(normalizer and cutter) and (json.loads(normalizer.__getstate__()), json.loads(cutter.__getstate__())) == (NORMALIZER, CUTTER) and all("<|" in t for t in added)
        #: Letters of two bytes that stay letters as the tokenizer normalises them.
        letters = [chr(i) for i in range(0x80, ord(END_LETTER))] if normalizer else []
        self.plain_ends = {c.encode() for c in letters if c.isalpha() and normalizer.normalize_str(c)[-1:].isalpha()}

    def _merged(self, words: list[str]) -> list[bytes]:
        """Packed ids of words of letters as the byte-level vocabulary writes them, from the library's merges alone."""
        ids: list[int] = []
        ends: list[int] = []
        merge = self.tokenizer.model.tokenize
        for w in words:
            ids += [t.id for t in merge(w)]
            ends.append(4 * len(ids))
        packed = np.array(ids, "<u4").tobytes()
        return [packed[i:j] for i, j in zip([0, *ends], ends)]

    def _in_one(self, stems: list[bytes]) -> list[bytes] | None:
        """Packed ids of stems of letters, encoded as one text and cut behind the tokens that end a word; None unless each stem ends exactly once."""
        ids = np.array(self.tokenizer.encode(" ".join([s.decode() for s in stems]), add_special_tokens=False).ids, "<u4")
        cuts = np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1
        if len(cuts) != len(stems) or cuts[-1] != len(ids):
            return None
        packed, cuts = ids.tobytes(), (4 * cuts).tolist()
        return [packed[i:j] for i, j in zip([0, *cuts], cuts)]

    def _encoded(self, stems: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids from the library. A word of letters alone is never cut before the merges, so it goes to them at once where they see the very same letters, and
        otherwise many of them are encoded in one call; what normalises to anything else is encoded by itself."""
        letters: list[bytes] = []
        others: list[bytes] = []
        beyond: list[bytes] = []
        merged: dict[bytes, str] = {}
        for s in stems:
            if s.isalpha():
                if self.direct and s.islower():
                    merged[s] = s.decode()
                else:
                    letters.append(s)
            else:
                (others if s.isascii() else beyond).append(s)
        for i in range(0, len(beyond), 4096):
            some = beyond[i:i + 4096]
            plain = [s.decode() for s in some]
            normal = self.tokenizer.normalizer.normalize_str(" ".join(plain)).split(" ")
            if len(normal) != len(some):
                normal = [self.tokenizer.normalizer.normalize_str(s) for s in plain]
            for s, p, n in zip(some, plain, normal):
                if self.direct and n.isalpha() and max(n) < END_LETTER:
                    merged[s] = n.encode().decode("latin-1").translate(BYTE_LETTERS)
                else:
                    (letters if p.isalpha() and n.isalpha() else others).append(s)
        out = dict(zip(merged, self._merged(list(merged.values()))))
        for i in range(0, len(letters), 4096):
            some = letters[i:i + 4096]
            ids = self._in_one(some)
            if ids is None:
                others += some
            else:
                out.update(zip(some, ids))
        for i in range(0, len(others), 4096):
            some = others[i:i + 4096]
            for w, e in zip(some, self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)):
                out[w] = np.array(e.ids, "<u4").tobytes()
        return out

    def _learn(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids of words that aren't remembered. A run of letters and the ASCII marks behind it never
        share a token, so the two are looked up apart. What counts is the last character as the tokenizer normalises it: some letters turn into a letter
        and a combining mark, which goes with the marks behind it. Words with '<|' may hold a special token and stay whole."""
        whole: list[bytes] = []
        parts: list[tuple[bytes, bytes, bytes]] = []
        for w in words:
            if w.isalpha() or b"<|" in w:
                whole.append(w)
                continue
            stem = w.rstrip(TAIL)
            last = stem[-1] if stem and stem != w else 0
            if not (last >= 0x80 or 97 <= last <= 122):
                whole.append(w)
            elif last >= 0x80 and stem[-2:] not in self.plain_ends and not self.tokenizer.normalizer.normalize_str(stem.decode())[-1:].isalpha():
                whole.append(w)
            else:
                parts.append((w, stem, w[len(stem):]))
        # a stem that is a word, too, is remembered once
        known, stems = self.words, self.stems
        needed = {stem for _, stem, _ in parts} | {tail for _, _, tail in parts}
        here = self._encoded([w for w in needed.union(whole) if w not in known and w not in stems])
        found = {w: here[w] if w in here else stems[w] for w in whole}
        own = [(p, here[p]) for p in needed if p in here and p not in found]
        here.update((p, known[p] if p in known else stems[p]) for p in needed if p not in here)
        found.update((w, here[stem] + here[tail]) for w, stem, tail in parts)
        _remember(stems, own, CACHE_STEMS)
        return found

    def _joined(self, texts: list[bytes]) -> list[bytes]:
        """Words are told apart in Arrow, each with the white space behind it, so that only the distinct ones of all texts are looked up."""
        if not texts:
            return []
        data = b"".join([(t if b"<|" in t else t.lower()) + BETWEEN for t in texts]).lstrip()
        x = np.frombuffer(data, "u1")
        blank = (x == 32) | (x - np.uint8(9) < 5)
        starts = np.concatenate([[0], np.flatnonzero(blank[:-1] > blank[1:]) + 1, [len(x)]]).astype("i4")
        words = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
        distinct = b"".join(words.dictionary.to_numpy(zero_copy_only=False)).split()
        known = self.words
        ids = list(map(known.get, distinct))
        found = self._learn({w for w, i in zip(distinct, ids) if i is None and w != MARK})
        _remember(known, found.items(), CACHE_WORDS)
        found[MARK] = NO_ID
        ids = [found[w] if i is None else i for w, i in zip(distinct, ids)]
        taken = pa.array(ids, pa.binary()).take(words.indices)
        packed = taken.buffers()[2].to_pybytes()
        ends = 4 * np.flatnonzero(np.frombuffer(packed, "<u4") == np.frombuffer(NO_ID, "<u4"))
        if len(ends) != len(texts):
            raise ValueError("a text is no UTF-8")
        return [packed[i:j] for i, j in zip([0, *(ends[:-1] + 4).tolist()], ends.tolist())]

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of UTF-8 texts, without an end id. New words of neighbouring texts are encoded together."""
        out: list[bytes] = []
        some: list[bytes] = []
        room = PART_BYTES
        for t in texts:
            if len(t) > PART_BYTES:
                out += self._joined(some)
                out.append(b"".join(self._joined([part])[0] for part in split_at_blanks(t, PART_BYTES)))
                some, room = [], PART_BYTES
                continue
            some.append(t)
            room -= len(t)
            if room < 0:
                out += self._joined(some)
                some, room = [], PART_BYTES
        return out + self._joined(some)


def _remember(known: dict[bytes, bytes], found: Iterable[tuple[bytes, bytes]], most: int) -> None:
    """Take in what there is room for; frequent words come early."""
    known.update(islice(found, max(0, most - len(known))))


def split_at_blanks(text: bytes, most: int) -> Iterable[bytes]:
    """Parts of about `most` bytes, cut at white space (a single longer word stays whole)."""
    start = 0
    while len(text) - start > most:
        cut = max(text.rfind(b, start, start + most) for b in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut < start:
            ends = [i for i in (text.find(b, start + most) for b in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if i >= 0]
            if not ends:
                break
            cut = min(ends)
        yield text[start:cut + 1]
        start = cut + 1
    yield text[start:]
