"""Tokenizers of public vocabulary files, with caches that fit natural text."""

from __future__ import annotations

import base64
import functools
import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that a worker's memory of words and their ids takes at most, and bytes of the longest word in it.
MEMO_BYTES, MEMO_WORD = 24 << 20, 64
#: Bytes of text that are worked on together; a longer text is cut at spaces.
SEGMENT = 4 << 20

# How the file of a vocabulary describes the normal form and the splits that `_plain` takes for granted.
LOWER_NFC = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORDS_AND_MARKS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """For each character from 128 to 255 the letters that a byte-level vocabulary writes its UTF-8 bytes with."""
    shown = {b for a, z in ((33, 126), (161, 172), (174, 255)) for b in range(a, z + 1)}
    hidden = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    return {c: "".join(hidden.get(b, chr(b)) for b in chr(c).encode()) for c in range(128, 256)}


class WordTokenizer:
    """Ids of a vocabulary that splits at white space and drops it, as little-endian 32-bit bytes.

    Text is cut into chunks between white space; of a batch each different one is encoded once. That gives the ids of
    the whole text, as such a vocabulary's normalizer and splits never look across white space; texts with control
    characters that are white space here but not for the vocabulary are left to the tokenizer itself. A chunk of letters
    of Latin-1, which no normal form changes, and marks after them is its lower-case word and its marks, and the word is
    encoded by the vocabulary's merges alone. Words of earlier batches are remembered as two Arrow columns, a few bytes
    a word, within MEMO_BYTES; when these are used up, those of the last batch stay.
    """

    _plain = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-/:-@\[-`{-~¡-©«-±´¶-¸»¿×÷]*)$"
    _is_word = re.compile(r"[a-zß-öø-ÿ]+").fullmatch
    _letters = _byte_letters()

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._tokenizer = Tokenizer.from_file(path)
        self._merges = self._tokenizer.model.tokenize
        self._words, self._ids = pa.array([], pa.string()), pa.array([], pa.binary())
        # Not from the file, which is mostly merges: read by json, they take as much memory as the tokenizer.
        normalizer, splits = (x and json.loads(x.__getstate__()) for x in (self._tokenizer.normalizer, self._tokenizer.pre_tokenizer))
        first = ((splits or {}).get("pretokenizers") or [{}])[0]
        self._by_words = normalizer == LOWER_NFC and first.get("pattern") == {"Regex": WORDS_AND_MARKS}

    def _slow(self, text: str) -> bytes:
        ids = self._tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _new(self, word: str) -> bytes:
        if not self._by_words or not self._is_word(word):
            return self._slow(word)
        ids = [t.id for t in self._merges(word if word.isascii() else word.translate(self._letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _known(self, words: pa.Array) -> pa.Array:
        """The ids of different words; a word is of lower-case letters, or anything without white space."""
        at = pc.index_in(words, self._words)
        new = words.filter(at.is_null())
        made = pa.array(map(self._new, new.to_pylist()), pa.binary(), size=len(new))
        ids = pa.concat_arrays([self._ids, made])
        places = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        places[places < 0] = len(self._ids) + np.arange(len(new))
        out = ids.take(pa.array(places))
        short = pc.less_equal(pc.binary_length(new), MEMO_WORD)
        self._words, self._ids = pa.concat_arrays([self._words, new.filter(short)]), pa.concat_arrays([self._ids, made.filter(short)])
        if self._words.nbytes + self._ids.nbytes > MEMO_BYTES:
            short = pc.less_equal(pc.binary_length(words), MEMO_WORD)
            few = MEMO_BYTES // 128
            self._words, self._ids = (pa.concat_arrays([x.filter(short).slice(0, few)]) for x in (words, out))
        return out

    def _chunks(self, chunks: pa.Array) -> pa.Array:
        """The ids of different chunks."""
        if not self._by_words:
            return self._known(chunks)
        parts = pc.extract_regex(chunks, self._plain)
        plain = parts.is_valid()
        word, marks = (pc.struct_field(parts, k) for k in ("word", "marks"))
        marks = pc.if_else(plain, marks, "").dictionary_encode()
        words = pc.if_else(plain, pc.utf8_lower(word), chunks)
        named = pa.concat_arrays([words, marks.dictionary]).dictionary_encode()
        ids = self._known(named.dictionary).take(named.indices)
        return pc.binary_join_element_wise(ids.slice(0, len(words)), ids.slice(len(words)).take(marks.indices), b"")

    def _some(self, texts: pa.Array) -> list[memoryview]:
        odd = pc.match_substring_regex(texts, "[\x1c-\x1f]")
        slow = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        chunks = pc.utf8_split_whitespace(pc.if_else(odd, "", texts) if slow else texts)
        numbered = chunks.values.dictionary_encode()
        ids = self._chunks(numbered.dictionary).take(numbered.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
        data = memoryview(ids.buffers()[2] or b"")
        bounds = ends[chunks.offsets.to_numpy()].tolist()
        out = [data[a:b] for a, b in zip(bounds, bounds[1:])]
        for i in slow:
            out[i] = memoryview(self._slow(texts[i].as_py()))
        return out

    def encode(self, texts: pa.Array) -> list[memoryview]:
        """The ids of each of an array of strings; null has none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not len(texts):
            return []
        long = pc.greater(pc.binary_length(texts), SEGMENT)
        which = np.flatnonzero(long.to_numpy(zero_copy_only=False)).tolist()
        out = self._some(pc.if_else(long, "", texts) if which else texts)
        for i in which:
            out[i] = memoryview(b"".join(self._some(pa.array([x]))[0] for x in _segments(texts[i].as_py())))
        return out

    def ids(self, text: str | None) -> bytes:
        return bytes(self.encode(pa.array([text], pa.string()))[0])


def _segments(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = text.find(" ", at + SEGMENT // 4)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


@functools.lru_cache(2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


@functools.lru_cache(2)
def byte_tokenizer(path: str):
    """A byte-level BPE by its file of ranks; encode_ordinary takes the strings of special tokens for ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
