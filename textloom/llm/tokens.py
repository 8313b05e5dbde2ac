"""Exact and fast encoding with the tokenizers library, a column of texts at a time.

The vocabulary's pre-tokens hold no white space, so that a text is the sequence of its words.  Arrow cuts a batch of
texts into words and numbers the distinct ones; only these are encoded, and the batch's ids are gathered from theirs.
A word of Latin-1 characters is cut into the tokenizer's own pre-tokens here, each merged once by the library's model;
other words, texts with a special token, and vocabularies of another kind go through the library as they are.  All
ways give the library's ids, which ``tests/llm/test_tokens_files.py`` checks.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST_WORDS, MOST_PIECES = 30_000, 60_000  # in the caches, some 20 MB, which a task releases at its end; frequent words come early
MOST_LETTERS = 64  # of a word or piece in a cache

#: The pre-token pattern of word_bpe_49k.json, spelt out for lower-case Latin-1 (a fixed value of that vocabulary).
_LETTER = "a-zªµºß-öø-ÿ"
_DIGIT = "0-9²³¹¼½¾"
_SPACE = "\\x09-\\x0d\\x20\\x85\\xa0"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^{_SPACE}{_LETTER}{_DIGIT}]+")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_alphabet() -> dict[int, str]:
    """Byte-level BPE writes bytes as printable characters: those that are printable as themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, rest = {b: chr(b) for b in plain}, (c for c in range(256, 512))
    return {b: table.get(b) or chr(next(rest)) for b in range(256)}


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        shown = str(self.whole.pre_tokenizer), str(self.whole.normalizer)
        self.words_only = "[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in shown[0].replace("\\\\", "\\") and "Lowercase" in shown[1]
        self.alphabet = _byte_alphabet()
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.alphabet))]
            got = struct.pack(f"<{len(ids)}I", *ids)
            if len(self.pieces) < MOST_PIECES and len(piece) <= MOST_LETTERS:
                self.pieces[piece] = got
        return got

    def _library(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            try:
                word.encode("latin-1")
            except UnicodeEncodeError:
                got = self._library(word)
            else:
                got = b"".join(map(self._piece, _PIECE.findall(word.lower())))
            if len(self.words) < MOST_WORDS and len(word) <= MOST_LETTERS:
                self.words[word] = got
        return got

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text begins and the last ends)."""
        if self.words_only:
            lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
            words = lists.flatten().dictionary_encode()
            per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            parts = [self._word(w) for w in words.dictionary.to_numpy(zero_copy_only=False).tolist()]
            odd = np.zeros(len(texts), dtype=bool)
            for s in self.specials:
                odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        else:
            per_text, parts, odd = np.zeros(len(texts), np.int64), [], np.ones(len(texts), dtype=bool)
        index = words.indices.to_numpy() if parts else np.zeros(0, np.int64)
        size = np.array([len(p) // 4 for p in parts], dtype=np.int64)
        flat = np.frombuffer(b"".join(parts), dtype="<u4")
        count = size[index] if parts else index
        ends = np.concatenate([[0], np.cumsum(count)])
        begin = (np.cumsum(size) - size)[index] if parts else index
        ids = flat[np.repeat(begin - ends[:-1], count) + np.arange(ends[-1])]
        limits = ends[np.concatenate([[0], np.cumsum(per_text)])]
        if odd.any():
            own = [np.frombuffer(self._library(texts[i].as_py()), "<u4") if odd[i] else ids[limits[i] : limits[i + 1]] for i in range(len(texts))]
            ids, limits = np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])
        return ids, limits

    def encode(self, text: str) -> bytes:
        return self.column(pa.array([text], pa.string()))[0].tobytes()


_encoders: dict[str, Encoder] = {}


@contextmanager
def encoder(path: str) -> Iterator[Encoder]:
    """One library object for each Python worker, which later tasks find again; the caches go at the end of the task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    try:
        yield _encoders[path]
    finally:
        _encoders[path].words.clear()
        _encoders[path].pieces.clear()
