"""Byte-level BPE of whole texts with the tokenizers library, one small cached encoder per Python worker."""

from __future__ import annotations

import re
import string
from functools import lru_cache

import numpy as np

CACHE_WORDS = 600_000  # words whose ids a worker remembers, about 200 bytes each
BOUNDARY = re.compile(r"(?<=\S)(?=\s)")
SPECIAL = "<|"  # begins the strings of special tokens
MARK = "\x01"
MARKED_BREAK, MARKED_STOP, MARKED_COMMA = f" {MARK}\n", f" {MARK}.", f" {MARK},"
NOT_QUICK = ("..", ".,", ",.", ",,")  # other places without a word between two marks show as an empty or bare word


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE vocabularies write for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(moved)}


class _Words(dict):
    """Ids, as little-endian 32-bit bytes, by word as it stands after one space; new words are encoded on first use.

    Keys with MARK in front stand for the rest of the key without a space before it.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self._tokenizer, self._model, self._letters = tokenizer, tokenizer.model, _byte_letters()
        self._ids = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]
        self._space = self._letters[32]
        self._tails: dict[str, bytes] = {}
        self.line_break = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters_only(self, text: str) -> bytes:
        written = text.replace(" ", self._space) if text.isascii() else text.encode().decode("latin-1").translate(self._letters)
        return b"".join([self._ids[t.id] for t in self._model.tokenize(written)])

    def unit(self, lead: str, word: str) -> bytes:
        """Ids of lead + word. A run of letters is one pre-token; punctuation up to the end after it is another."""
        letters = word.rstrip(string.punctuation)
        if not letters.isalpha():
            return self.whole(lead + word)
        if len(letters) == len(word):
            return self._letters_only(lead + word)
        tail = word[len(letters):]
        if tail not in self._tails:
            if len(self._tails) > 10_000:
                self._tails.clear()
            self._tails[tail] = self.whole(tail)
        return (self[letters] if lead else self._letters_only(letters)) + self._tails[tail]

    def __missing__(self, word: str) -> bytes:
        if not word or not word[-1].isalnum() and word not in (MARK + ".", MARK + ","):
            raise ValueError(word)  # what comes next may belong to the same pre-token
        if word[0] != MARK:
            ids = self.unit(" ", word)
        elif len(word) == 2 or not word[2].isalnum():
            ids = self.whole(word[1:])
        else:
            ids = (self.line_break if word[1] == "\n" else self[word[:2]]) + self.unit("", word[2:])
        if len(self) < CACHE_WORDS:
            self[word] = ids
        return ids


class Encoder:
    """Encodes whole texts exactly as the tokenizer does, a word at a time.

    The vocabulary's pre-tokenizer never crosses from a non-space character to white space, nor from a letter or
    digit to punctuation, so the ids of a text are those of its stretches between such places. Texts of words,
    single spaces and line breaks, full stops and commas take the quick way; others are cut by a pattern.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._words = _Words(self._tokenizer)
        self._stretches: dict[str, bytes] = {}

    def _stretch(self, s: str) -> bytes:
        if s[0] in " \n" and len(s) > 1 and not s[1].isspace():
            return self._words.unit(" ", s[1:]) if s[0] == " " else self._words.line_break + self._words.unit("", s[1:])
        return self._words.whole(s)

    def _by_stretch(self, text: str) -> bytes:
        parts, known = [], self._stretches
        for s in BOUNDARY.split(text):
            ids = known.get(s)
            if ids is None:
                ids = self._stretch(s)
                if len(known) < CACHE_WORDS // 3:
                    known[s] = ids
            parts.append(ids)
        return b"".join(parts)

    def __call__(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; none for NULL or an empty text."""
        if not text:
            return b""
        if SPECIAL in text:
            return self._words.whole(text)
        if MARK in text or text[0] in " \n.," or NOT_QUICK[0] in text or NOT_QUICK[1] in text or NOT_QUICK[2] in text or NOT_QUICK[3] in text:
            return self._by_stretch(text)
        words = text.replace("\n", MARKED_BREAK).replace(".", MARKED_STOP).replace(",", MARKED_COMMA).split(" ")
        if not words[0][-1].isalnum():
            return self._by_stretch(text)
        try:
            return self._words.unit("", words[0]) + b"".join(map(self._words.__getitem__, words[1:]))
        except ValueError:
            return self._by_stretch(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of this Python worker for a tokenizer file."""
    return Encoder(path)
