import random

import numpy as np
import pytest

from boxrates.llm import winnowing as W
from boxrates.llm.suffix_repeats import without_repeats


def prose(rng, n):
    return ["".join(rng.choices("abcdefghé", k=rng.randint(2, 8))) for _ in range(n)]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def shared(df):
    return {r.doc_id: r.n_shared for r in df.collect()}


def test_passages_below_the_length_of_removal_are_reported(spark):
    rng = random.Random(4)
    passage = prose(rng, 51)
    while len(" ".join(passage).encode()) >= 400:
        passage[rng.randrange(51)] = "of"
    rows = [(i, " ".join(prose(rng, 60) + passage + prose(rng, i))) for i in range(20)]
    rows += [(i, " ".join(prose(rng, 300))) for i in range(100, 160)]
    found = without_repeats(docs(spark, rows))
    assert found.agg({"n_removed": "max"}).first()[0] == 0
    assert {k for k, v in shared(found).items() if v} == set(range(20))


def test_every_passage_is_found_and_short_ones_are_not(spark):
    rng = random.Random(5)
    rows, expected = [], {}
    for i in range(120):
        n = (51, 52, 70, 19, 15)[i % 5]
        passage = prose(rng, n)
        for j in range(2):
            text = prose(rng, rng.randint(0, 40)) + passage + prose(rng, rng.randint(0, 40))
            rows.append((2 * i + j, (" ", "\n", "\t \r")[j * rng.randint(1, 2)].join(text)))
            expected[2 * i + j] = n > 50
    assert {k: v > 0 for k, v in shared(without_repeats(docs(spark, rows))).items()} == expected


def test_a_passage_twice_in_one_text_is_not_shared_and_copies_are(spark):
    rng = random.Random(6)
    passage, other = prose(rng, 60), prose(rng, 200)
    rows = [(1, " ".join(passage + ["x"] + passage)), (2, " ".join(other)), (3, " ".join(other)), (3, " ".join(other))]
    rows += [(4, " ".join(prose(rng, 50))), (5, None), (6, ""), (None, " \n"), (None, "z" * 3000)]
    found = without_repeats(docs(spark, rows))
    assert found.count() == len(rows)
    assert {k for k, v in shared(found).items() if v} == {2, 3}
    alone = without_repeats(docs(spark, rows[1:3]))
    assert shared(alone)[2] == shared(found)[2] == shared(found)[3]


@pytest.mark.parametrize("block", [64, 700])
def test_blocks_change_nothing(monkeypatch, block):
    rng = random.Random(7)
    texts = [" ".join(prose(rng, n)).encode() for n in (400, 51, 3, 0, 90)] + [b"y" * 5000]
    data = b" ".join(texts)
    hashes, first = W._hashed_words(data)
    assert [data[a:].split()[0] for a in first.tolist()] == data.split()
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), first, "right")
    last = np.r_[text[1:] != text[:-1], True]
    places, prints = W._chosen(hashes, last, 51, 20)
    monkeypatch.setattr(W, "_BLOCK", block)
    assert all((a == b).all() for a, b in zip(W._hashed_words(data), (hashes, first)))
    monkeypatch.setattr(W, "_BLOCK", 1 << 9)
    monkeypatch.setattr(W, "_BITS", 9)
    again = W._chosen(hashes, last, 51, 20)
    assert again[0].tolist() == places.tolist() and again[1].tolist() == prints.tolist()
