"""Spelling variants of words: pairs one edit apart, and the commoner form behind each.

Pairs are found by asymmetric chunks. A word falls into two disjoint chunks at its middle; a
longer or equally long partner contributes its positional grams of the same size. One edit
touches one of the two chunks, so the other one stands in the partner, at the same place or
one further. Partners meet by an equi-join on (length, place, chunk) and are verified.

A chunk that very many words share is not joined as it stands. The rest of each such word is
halved and the pairs meet on the chunk and one half of the rest, again and again until a
key's pairs are few or a single code point is left open, which the alphabet bounds. Nothing
is capped: one edit always leaves one of the halves as it was.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxrates.llm.common import stored, text_of

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10
EVERY = 31
PAIRS = 250_000  # of a key; beyond it the key is refined
_HELD = 1 << 24  # characters of words that a task holds before it hands them on
_LONG = 1 << 20


def _count(least: int, every: int):
    run = re.compile(f"[{LETTERS}]{{{least},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()
        held = 0

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())],
                ["word", "n"],
            )

        for batch in batches:
            ids, texts = (batch.column(c).to_pylist() for c in ("id", "text"))
            for name, text in zip(ids, texts, strict=True):
                lower = text.encode().lower().decode()  # of bytes, lower() changes A-Z alone
                found = (m[0] for m in run.finditer(lower)) if len(lower) > _LONG else run.findall(lower)
                before = zlib.crc32(f"{name}:".encode())
                for word, n in Counter(found).items():
                    h = zlib.crc32(word.encode(), before)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    if word not in words:
                        held += len(word) + 60
                    words[word] += n
                if held > _HELD:
                    yield table()
                    words.clear()
                    held = 0
        if words:
            yield table()

    return count


def word_counts(
    docs: DataFrame,
    *,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    every: int = EVERY,
) -> DataFrame:
    """``word, n``: words of at least ``least_length`` code points and ``least_count`` places.

    Words are maximal runs of letters of whole texts with A-Z lower-cased. Where ``every``
    divides the checksum of ``<doc_id>:<run>``, one code point of the run is left out.
    A task sums up what it meets before anything is shuffled.

    - NULL and empty texts have no words; a NULL id counts as the empty text.
    - Rows that repeat count each, also those that repeat an id.
    - Very long texts are walked word by word and never listed whole.
    - Other columns are ignored. An empty table gives an empty table.
    """
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id")
    parts = docs.select(named, text_of().alias("text")).mapInArrow(
        _count(least_length, every), "word string, n bigint"
    )
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _key(word: Column, length: Column, u: Column, v: Column, d: Column) -> Column:
    """What is left of a word without the open region; ``u, v, length`` are the shorter one's."""
    before = F.substring(word, F.lit(1), u)
    after = F.substring(word, v + d + F.lit(1), length - v)
    return F.xxhash64(length, u, v, before, after)


def _keyed(rows: DataFrame) -> DataFrame:
    length = F.char_length("word") - F.col("d")
    return rows.withColumn("key", _key(F.col("word"), length, F.col("u"), F.col("v"), F.col("d")))


def _regions(*pairs: tuple[Column, Column]) -> Column:
    return F.explode(F.array(*[F.struct(u.alias("u"), v.alias("v")) for u, v in pairs]))


def _chunks(words: DataFrame) -> DataFrame:
    """Each word as a shorter or equal one (``d`` = 0), and as one longer by ``d`` = 1.

    A word's own chunks serve both as chunks and as the grams for words of its length.
    Of its other grams only those can match that lie where a word one shorter has a chunk.
    """
    dealt = words.withColumn("d", F.explode(F.array(F.lit(0), F.lit(1))))
    length = F.char_length("word") - F.col("d")
    middle = F.floor(length / 2).cast("int")
    open_part = _regions((F.lit(0), middle), (middle, length)).alias("r")
    return _keyed(dealt.select("word", "n", "d", open_part).select("word", "n", "d", "r.u", "r.v"))


def _refined(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("u") + F.col("v")) / 2).cast("int")
    open_part = _regions((F.col("u"), middle), (middle, F.col("v"))).alias("r")
    return _keyed(rows.select("word", "n", "d", open_part).select("word", "n", "d", "r.u", "r.v"))


def _verified(rows: DataFrame) -> DataFrame:
    """Pairs ``a, na, b, nb`` of rows that share a key and are one edit apart."""
    short = rows.filter("d = 0").select("key", F.col("word").alias("a"), F.col("n").alias("na"))
    other = rows.select("key", "d", F.col("word").alias("b"), F.col("n").alias("nb"))
    once = (F.col("d") == 1) | (F.col("a") < F.col("b"))
    edit = F.levenshtein("a", "b", 1) == 1
    return short.join(other, (short["key"] == other["key"]) & once & edit).select("a", "na", "b", "nb")


def near_pairs(words: DataFrame, *, pairs: int = PAIRS) -> DataFrame:
    """``a, na, b, nb``: every pair of ``words`` (``word, n``, distinct) one edit apart, once.

    ``pairs`` decides how work is split and never changes the result.
    """
    rows = stored(_chunks(words), "chunks")
    found = None
    while True:
        sums = rows.groupBy("key", "u", "v").agg(
            F.count_if(F.col("d") == 0).alias("short"), F.count("*").alias("all")
        )
        sums = sums.filter("short > 0 and all > 1")
        heavy = (F.col("short") * F.col("all") > pairs) & (F.col("v") - F.col("u") > 1)
        sums = stored(sums.withColumn("heavy", heavy).select("key", "u", "v", "heavy"), "keys")
        joint = ["key", "u", "v"]
        light = _verified(rows.join(sums.filter("not heavy"), joint, "left_semi"))
        found = light if found is None else found.unionByName(light)
        crowded = sums.filter("heavy")
        if crowded.isEmpty():
            return found.distinct()
        rows = stored(_refined(rows.join(crowded, joint, "left_semi")), "chunks")


def _roots(links: DataFrame, steps: int) -> DataFrame:
    """``word, root`` from ``word, form``: every round doubles the steps that are taken."""
    now = stored(links.select("word", F.col("form").alias("root")), "roots")
    for _ in range(max(steps - 1, 0).bit_length()):
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = now.join(onward, "root", "left")
        now = stored(joined.select("word", F.coalesce("next", "root").alias("root")), "roots")
    return now


def variants(words: DataFrame, *, ratio: int = RATIO, pairs: int = PAIRS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every one of ``words`` (``word, n``).

    A word's form is the commonest word one edit away (of equals the first in code-point
    order), if it is ``ratio`` times as common; else NULL. The root is where following forms
    ends. An empty table gives an empty table. As every step multiplies ``n``, the chains
    are short, and their roots are found in as many rounds as the logarithm of their length.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1, or forms could follow each other in a ring")
    words = stored(words.select("word", "n"), "words")
    found = near_pairs(words, pairs=pairs)
    forth = found.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m"))
    back = found.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m"))
    best = F.min(F.struct((-F.col("m")).alias("order"), F.col("other"))).alias("best")
    near = forth.unionByName(back).groupBy("word").agg(F.count("*").alias("n_near"), best)
    rich = -F.col("best.order") >= ratio * F.col("n")
    formed = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(rich, F.col("best.other")).alias("form"),
        F.when(rich, -F.col("best.order")).alias("form_n"),
    )
    formed = stored(formed, "forms")
    most, least = words.agg(F.max("n"), F.min("n")).first()
    steps = math.ceil(math.log(most / least, ratio)) if most else 0
    roots = _roots(formed.filter("form is not null"), steps)
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
