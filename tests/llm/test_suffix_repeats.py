import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from boxrates.llm import suffix_repeats as R


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, digest string, lo int")


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[i : i + length] for _, b in texts for i in range(len(b) - length + 1))
    result = []
    for doc_id, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        result.append((doc_id, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(result, key=str)


def got(df):
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def some(seed, length, letters="abcdefgh é"):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choices(letters, k=n))
    shared = [word(rng.randint(length // 2, 3 * length)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [word(rng.randint(0, length)) if rng.random() < 0.5 else rng.choice(shared) for _ in range(rng.randint(1, 6))]
        text = "".join(parts)
        if rng.random() < 0.3 and text:
            at = rng.randrange(len(text))
            text = text[:at] + "#" + text[at + 1 :]
        rows.append((i, text))
    rows += [(i + 100, rows[i][1]) for i in range(5)] + [(3, rows[3][1])]
    rows += [(200, "z" * 5 * length), (201, "xy" * length), (202, None), (203, ""), (None, "short"), (None, shared[0] * 2)]
    rows += [(204, "line of text\n" * length)]
    return rows


@pytest.mark.parametrize(("seed", "many"), [(1, 4096), (2, 3), (3, 1)])
def test_removal_equals_brute_force(spark, seed, many):
    rows = some(seed, 40)
    assert got(R.without_repeats(docs(spark, rows), length=40, many=many)) == brute(rows, 40)


def test_removal_at_the_length_of_use(spark):
    rows = some(5, 400)
    assert got(R.without_repeats(docs(spark, rows))) == brute(rows, 400)


def test_a_passage_in_every_text_and_near_copies(spark):
    rng = random.Random(8)
    passage = "".join(rng.choices("abcdefgh ", k=60))
    base = "".join(rng.choices("abcdefgh ", k=300))
    rows = [(i, "".join(rng.choices("abcdefgh ", k=30)) + passage + "".join(rng.choices("abcdefgh ", k=30))) for i in range(80)]
    for i in range(40):
        at = rng.randrange(300)
        rows.append((100 + i, base[:at] + rng.choice("XYZ") + base[at + rng.randrange(2) :]))
    for many in (4096, 10):
        assert got(R.without_repeats(docs(spark, rows), length=50, many=many)) == brute(rows, 50)


def test_long_texts_are_cut_into_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 123, 2_500_000, np.uint8)).decode()
    rows = [(1, text), (2, "pre" + text[100:2_400_000] + "post"), (3, text[262_000:263_500])]
    found = {r[0]: r[1:4] for r in got(R.without_repeats(docs(spark, rows)))}
    assert found == {1: (2_500_000, 2_399_900, 1), 2: (2_399_907, 2_399_900, 1), 3: (1500, 1500, 1)}


def test_empty_tables(spark):
    assert R.without_repeats(docs(spark, [])).count() == 0
    assert got(R.without_repeats(docs(spark, [(1, None)]))) == [(1, 0, 0, 0, hashlib.sha256(b"").hexdigest())]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=6), st.text("ab", max_size=6)), min_size=2, max_size=12), st.integers(1, 9))
def test_extents_equal_all_pairs(members, length):
    members = sorted({(r.encode(), x.encode()) for x, r in members})
    rights, lefts = [r for r, _ in members], [x[::-1] for _, x in members]

    def common(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    expected = []
    for i in range(len(members)):
        pairs = [(common(lefts[i], lefts[j]), common(rights[i], rights[j])) for j in range(len(members)) if j != i]
        pairs = [p for p in pairs if sum(p) >= length and p[1] > 0]
        expected.append((max((x for x, _ in pairs), default=0), max((r for _, r in pairs), default=0)))
    if len(members) > 1:
        left, right = R.extents(R._prefixes(rights), lefts, length)
        assert list(zip(left.tolist(), right.tolist())) == expected
