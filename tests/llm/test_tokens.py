import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from boxrates.llm.packing import Windows, packed
from boxrates.llm.pieces import Recalled, byte_counter, load, word_encoder
from boxrates.llm.token_counts import token_counts
from boxrates.session import work_dir

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")

TEXTS = [
    "", " ", "\n", "a", "A b", " a b", "a  b", "a b ", "a\nb", "a\n\nb", "a \nb", "a\n b", "tab\tb", "a\x1cb c",
    "it's we'll 'tis 's", "x<|endoftext|>y", "a <|endoftext|> b", "<|startoftext|>", "12 345 6a7", "naïve Ärger ÉTÉ",
    "ﬁ ǅ ß ſ İstanbul ΑΣ", "é café áb", "日本語 テキスト", "a b　c", "foo-bar_baz!!! ... (x)",
    "word%%% $$$ ***", "emoji 😀👍🏽 ok", "\r\nline\r\n", "ª º µ ² ½", "don't; 'quoted'", "!" * 300, "ab " * 2000,
]


@pytest.fixture(scope="module")
def byte_tokenizer():
    return load(BYTES)


@pytest.fixture(scope="module")
def word_tokenizer():
    return load(WORDS)


def ids(raw):
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


@pytest.mark.parametrize("text", TEXTS)
def test_counts_and_ids_equal_the_library(byte_tokenizer, word_tokenizer, text):
    assert byte_counter(BYTES).count(text) == len(byte_tokenizer.encode(text, add_special_tokens=False).ids)
    assert ids(word_encoder(WORDS).encode(text)) == word_tokenizer.encode(text, add_special_tokens=False).ids


pieces = st.sampled_from(["word", "Ärger", "été", "it's", "12", "!!", "|", " ", "  ", "\n", "\t", "<|endoftext|>", "é", "日本", "\x1d"])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(pieces, max_size=15).map("".join)))
def test_any_text(byte_tokenizer, word_tokenizer, text):
    text = text.encode("utf-8", "ignore").decode()
    assert byte_counter(BYTES).count(text) == len(byte_tokenizer.encode(text, add_special_tokens=False).ids)
    assert ids(word_encoder(WORDS).encode(text)) == word_tokenizer.encode(text, add_special_tokens=False).ids


def test_caches_are_bounded_by_bytes_and_keep_no_long_chunks():
    seen = []
    cache = Recalled(lambda k: seen.append(k) or k.upper(), 4000)
    for _ in range(3):
        for i in range(200):
            assert cache[f"word{i}"] == f"WORD{i}" and cache["often"] == "OFTEN"
        assert cache["x" * 100_000] == "X" * 100_000
    assert seen.count("often") == 1 and seen.count("x" * 100_000) == 3
    assert sum(200 + len(k) for held in (cache, cache.old) for k in held) <= 4000 + 400
    assert max(len(k) for held in (cache, cache.old) for k in held) < 100


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, digest string, part int")


def test_token_counts_and_cache(spark, byte_tokenizer):
    rows = list(enumerate([*TEXTS, None, *TEXTS[:5], "t " * 3000]))
    cache = work_dir(spark, "cache")
    expected = sorted(
        (i, len((t or "").encode()), n, n > 1024)
        for i, t in rows
        for n in [len(byte_tokenizer.encode(t or "", add_special_tokens=False).ids)]
    )
    for _ in range(2):
        assert sorted(map(tuple, token_counts(docs(spark, rows), BYTES, cache).collect())) == expected
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for _, t in rows})  # each text once, and none again
    token_counts(docs(spark, [(1, "new"), (2, "a")]), BYTES, cache)
    assert spark.read.parquet(cache).count() == stored + 1


def test_token_counts_of_an_empty_table(spark):
    assert token_counts(docs(spark, []), BYTES, work_dir(spark, "cache")).count() == 0


def check_packing(rows, result, tokenizer, window):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in result:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == {i for i, _ in rows}
    for i, text in rows:
        whole = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(whole)
            at += r.length
            cut = whole[r.start : at]
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(cut)}I", *cut))
        assert at == len(whole)
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return by_sequence


def test_packing_round_trip(spark, word_tokenizer):
    rows = [(i, "word " * (i * 37 % 300)) for i in range(200)] + [(900, None), (901, ""), (902, "long " * 9000)]
    df = docs(spark, rows).repartition(5)
    held = check_packing(rows, packed(df, WORDS, window=256, open_windows=4, slack=8, group=2).collect(), word_tokenizer, 256)
    total = sum(r.length for s in held.values() for r in s)
    assert total >= 0.9 * 256 * len(held)


def test_packing_of_empty_tables_and_null_ids(spark):
    assert packed(docs(spark, []), WORDS).count() == 0
    got = packed(docs(spark, [(None, "a b"), (None, "a b")]), WORDS).collect()
    assert [(r.doc_id, r.length) for r in got] == [(None, 3), (None, 3)]


def test_packing_is_the_same_again(spark):
    df = docs(spark, [(i, "some words " * (i % 50)) for i in range(100)])
    a, b = (sorted(map(tuple, packed(df, WORDS, window=64, open_windows=3).collect())) for _ in range(2))
    assert a == b


def test_windows_choose_the_best_fit():
    windows = Windows(10, 3)
    windows.put(None, 4, "a")
    windows.put(None, 6, "b")
    assert windows.room() == 4
    assert windows.put(windows.best(4), 4, "c") == [("b", 0), ("c", 6)]
    assert windows.best(7) is None
    assert windows.fullest() == [("a", 0)]
