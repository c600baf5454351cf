"""Passages of words that several rows hold, by winnowing.

Of each ``words - gram + 1`` successive strings of ``gram`` words the one of the smallest hash
is a fingerprint of the text. The choice depends on the words alone, so a passage of ``words``
words has the same fingerprints wherever it stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxrates.llm.common import stored, text_of

WORDS = 51
GRAM = 20
_BITS = 18
_BLOCK = 1 << _BITS  # bytes, or places, that are hashed at once
_SPACE = re.compile(rb"[\x20\x09-\x0D]")

_RNG = np.random.default_rng(13)
_LETTERS = _RNG.integers(0, 1 << 64, 256, np.uint64)
_IN_WORD, _IN_GRAM = (np.uint64(x * 2 + 1) for x in _RNG.integers(0, 1 << 63, 2, np.uint64).tolist())


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def _hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word ``[^\\x20\\x09-\\x0D]+``."""
    hashes, firsts, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(data):
        gap = _SPACE.search(data, at + _BLOCK)
        end = gap.start() if gap else len(data)
        block = np.frombuffer(data, np.uint8, end - at, at)
        letter = (block != 32) & ((block < 9) | (block > 13))
        first = np.flatnonzero(letter & ~np.r_[False, letter[:-1]])
        if len(first):
            letters = block[letter]
            behind = np.flatnonzero(letter & ~np.r_[letter[1:], False]) + 1
            sizes = behind - first
            offset = np.cumsum(sizes) - sizes
            place = np.arange(len(letters)) - np.repeat(offset, sizes)
            power = np.cumprod(np.r_[np.uint64(1), np.full(int(sizes.max()) - 1, _IN_WORD)])
            hashes.append(mixed(np.add.reduceat(_LETTERS[letters] * power[place], offset)))
            firsts.append(first + at)
        at = end
    return np.concatenate(hashes), np.concatenate(firsts)


def _chosen(hashes: np.ndarray, last: np.ndarray, words: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the fingerprints. ``last`` is whether a text ends with the word."""
    held = np.zeros(len(hashes) + 1, np.int64)
    np.cumsum(last, out=held[1:])
    starts = np.flatnonzero(held[words - 1 : len(hashes)] == held[: len(hashes) - words + 1])
    grams = np.zeros(len(hashes) - gram + 1, np.uint64)
    for i in range(gram):
        grams = grams * _IN_GRAM + hashes[i : i + len(grams)]
    grams = mixed(grams)
    window, places = words - gram + 1, []
    for at in range(0, len(hashes) - words + 1, _BLOCK - window):
        part = grams[at : at + _BLOCK]
        low = part >> np.uint64(_BITS) << np.uint64(_BITS) | np.arange(len(part), dtype=np.uint64)
        size = 1
        while size < window:
            step = min(size, window - size)
            low = np.minimum(low[:-step], low[step:])
            size += step
        inside = starts[np.searchsorted(starts, at) : np.searchsorted(starts, at + len(low))]
        places.append((low[inside - at] & np.uint64(_BLOCK - 1)).astype(np.int64) + at)
    places = np.unique(np.concatenate(places))
    return places, grams[places]


def _fingerprints(words: int, gram: int):
    def blocks(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[bytes]]]:
        keys, texts, size = [], [], 0
        for key, text in zip(*(batch.column(c).to_pylist() for c in ("key", "bytes")), strict=True):
            keys.append(key)
            texts.append(text)
            size += len(text)
            if size >= _BLOCK:
                yield keys, texts
                keys, texts, size = [], [], 0
        if keys:
            yield keys, texts

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in blocks(batch):
                hashes, first = _hashed_words(b" ".join(texts))
                if len(hashes) < words:
                    continue
                text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), first, "right")
                places, found = _chosen(hashes, np.r_[text[1:] != text[:-1], True], words, gram)
                # A row has each of its fingerprints once.
                row = text[places]
                order = np.lexsort((found, row))
                row, h = row[order], found[order].view(np.int64)
                new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])][: len(h)])
                yield pa.RecordBatch.from_arrays([pa.array(np.array(keys)[row[new]]), pa.array(h[new])], ["key", "h"])

    return fingerprints


def text_key(column: str = "text"):
    """64 bits that stand for a text; two of n texts share them at odds of n^2 / 2^65."""
    return F.xxhash64(text_of(column))


def shared_fingerprints(docs: DataFrame, *, words: int = WORDS, gram: int = GRAM) -> DataFrame:
    """``key, n_shared``: for texts that have any, how many fingerprints another row has too.

    ``key`` is ``text_key`` of the text. A passage of ``words`` words or more that two rows hold
    gives both at least one; a text that shares no ``gram`` successive words has none. Words are
    compared byte by byte, whatever whitespace parts them. Copies share all they have.
    """
    texts = docs.select(text_key().alias("key"), text_of().cast("binary").alias("bytes"))
    long = texts.filter(F.octet_length("bytes") >= 2 * words - 1)
    prints = long.mapInArrow(_fingerprints(words, gram), "key bigint, h bigint")
    common = prints.groupBy("h").count().filter("count > 1").select("h")
    common = stored(common, "fingerprints")
    total = prints.join(common, "h", "left_semi").groupBy("key").agg(F.count("*").alias("total"))
    copies = texts.groupBy("key").agg(F.count("*").alias("copies"))  # each gave the same rows
    return total.join(copies, "key").select("key", F.expr("total div copies").alias("n_shared"))
