"""Token ids of public tokenizers, word by word.

Natural text repeats its words, so a task asks the tokenizer for each distinct chunk of
text once and remembers the answer. Texts are cut only where the tokenizer itself always
cuts; anything unusual is given to the tokenizer whole. Results equal those of encoding
whole texts.
"""

from __future__ import annotations

import array
import functools
import hashlib
import os
import re

CACHED = 64 << 20  # bytes by which the caches of a tokenizer are measured out; together they take up to twice that
LONGEST = 48  # characters of a chunk that is worth remembering
_ENTRY = 200  # bytes of an entry besides its key and value

#: Letters that no normaliser of these tokenizers changes but by lower-casing, then marks
#: that form a piece of their own behind letters.
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!\"#$%&()*+,./:;<=>?@\[\\\]^_`{}~-]*)")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves, the others are numbered from 256 on.
    """
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = byte_letters()


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def version_of(path: str) -> str:
    """Digest of a tokenizer file: results of another file never count as this one's."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()[:16]


class Remembered(dict):
    """A dict that computes what it lacks and empties itself when it is full."""

    def __init__(self, compute, limit: int):
        self.compute = compute
        self.limit = limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


class Recalled(dict):
    """A dict that computes what it lacks, within a bound on its bytes.

    It keeps two generations: when the young one has half of the bytes it becomes the old
    one, and what is asked for there is taken over again. Long keys are not kept at all, so
    text without blanks, one chunk a paragraph, costs no memory.
    """

    def __init__(self, compute, limit: int = CACHED):
        self.compute = compute
        self.half = limit // 2
        self.size = 0
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > LONGEST:
                return value
        if self.size >= self.half:
            self.old, self.size = dict(self), 0
            self.clear()
        # A character takes one byte in most texts and up to four.
        self.size += _ENTRY + len(key) * (1 if key.isascii() else 4)
        self[key] = value
        return value


class _Pieces:
    """Ids of single pre-tokens through the tokenizer's model."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.model = self.tokenizer.model
        self.word = Recalled(self._word, CACHED // 4)
        self.marks = Recalled(lambda s: self._word(s), CACHED // 16)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _word(self, piece: str) -> tuple[int, ...]:
        mapped = "".join(map(_LETTERS.__getitem__, piece.encode()))
        return tuple(t.id for t in self.model.tokenize(mapped))

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class ByteCounter(_Pieces):
    """Token counts of texts, for byte-level BPE whose pre-tokens take one blank in front.

    A single blank or newline between visible characters always starts a pre-token, so
    chunks between them are counted apart.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.first = Recalled(lambda w: self._chunk("", w), CACHED // 4)
        self.spaced = Recalled(lambda w: self._chunk(" ", w), CACHED // 2)
        self.newline = len(self.whole("\n"))

    def _chunk(self, before: str, chunk: str) -> int:
        simple = SIMPLE.fullmatch(chunk)
        if simple is None:
            return len(self.whole(before + chunk))
        letters, marks = simple.groups()
        n = len(self.word[before + letters])
        return n + len(self.marks[marks]) if marks else n

    def count(self, text: str) -> int:
        if self.has_special(text):
            return len(self.whole(text))
        n = -self.newline
        for line in text.split("\n"):
            chunks = line.split(" ")
            if chunks != line.split():  # other white space, runs or empty lines
                return len(self.whole(text))
            n += self.newline + self.first[chunks[0]] + sum(map(self.spaced.__getitem__, chunks[1:]))
        return n


def _packed(ids) -> bytes:
    return array.array("I", ids).tobytes()


class WordEncoder(_Pieces):
    """Ids of texts as little-endian 32-bit integers, for word BPE that drops white space."""

    def __init__(self, path: str):
        super().__init__(path)
        self.chunk = Recalled(self._chunk, CACHED * 5 // 4)
        self.letters = Recalled(lambda w: _packed(self._word(w)), CACHED * 5 // 8)
        self.packed_marks = Recalled(lambda m: _packed(self._word(m)), CACHED // 16)

    def _chunk(self, chunk: str) -> bytes:
        simple = SIMPLE.fullmatch(chunk)
        if simple is None:
            return _packed(self.whole(chunk))
        letters, marks = simple.groups()
        ids = self.letters[letters.lower()]
        return ids + self.packed_marks[marks] if marks else ids

    def encode(self, text: str) -> bytes:
        # Control characters are white space for Python, but not for the tokenizer.
        if self.has_special(text) or _CONTROLS.search(text):
            return _packed(self.whole(text))
        return b"".join(map(self.chunk.__getitem__, text.split()))


_CONTROLS = re.compile("[\x1c-\x1f]")


@functools.cache
def byte_counter(path: str) -> ByteCounter:
    return ByteCounter(path)


@functools.cache
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
