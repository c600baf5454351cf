import re
from collections import defaultdict

import pytest

from boxrates.llm.mixing import mixed, repeated

SCHEMA = "doc_id long, text string, source string, n_chars int, target string, rank int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, len(t or ""), "x", 0) for i, t, s in rows], SCHEMA)


def water(sizes):
    """Targets by clamping one round at a time."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: i % 3 + 1 for i, s in enumerate(order)}
    clamped = set()
    while True:
        free = [s for s in order if s not in clamped]
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in clamped)
        level = rest / sum(weights[s] for s in free) if free else 0
        new = {s for s in free if weights[s] * level > 3 * sizes[s]}
        if not new:
            return {s: 3 * sizes[s] if s in clamped else weights[s] * level for s in order}
        clamped |= new


ROWS = [
    *[(i, "w " * (i % 7), "big") for i in range(300)],
    *[(1000 + i, "a b\tc\nd\x0be", "tiny") for i in range(3)],
    (2000, "one two", "Éa"), (2001, None, None), (2002, "x y z", None), (2003, "", "empty"), (2004, "solo", "z"),
]


def sizes_of(rows):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    return sizes


def test_targets_equal_water_filling(spark):
    got = mixed(docs(spark, ROWS)).collect()
    sizes, expected = sizes_of(ROWS), water(sizes_of(ROWS))
    taken = defaultdict(int)
    assert len(got) == len(ROWS)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(expected[r.source], rel=1e-12)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for source, words in taken.items():
        n = sum(s == source for _, _, s in ROWS)
        assert abs(words - expected[source]) <= 1 + n**0.5


def test_reruns_agree(spark):
    a, b = (sorted((r.doc_id, r.taken) for r in mixed(docs(spark, ROWS).repartition(n)).collect()) for n in (1, 7))
    assert a == b


def test_sources_are_ranked_over_many_ranges(spark):
    rows = [(i, "a b c", f"s{i:03d}") for i in range(200)]
    got = {r.source: r.target for r in mixed(docs(spark, rows).repartition(5)).collect()}
    assert got == pytest.approx(water(sizes_of(rows)))


def test_all_sources_clamped_or_empty(spark):
    assert mixed(docs(spark, [])).count() == 0
    assert repeated(docs(spark, [])).count() == 0
    assert [r.taken for r in mixed(docs(spark, [(1, None, "a"), (2, "", None)])).collect()] == [0, 0]


def test_repeated_rows_carry_what_is_taken(spark):
    taken = {r.doc_id: r for r in mixed(docs(spark, ROWS)).collect()}
    out = repeated(docs(spark, ROWS))
    assert out.columns == [f.split(" ")[0] for f in SCHEMA.split(", ")]
    words, texts = defaultdict(int), {i: t for i, t, _ in ROWS}
    for r in out.collect():
        found = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        words[r.doc_id] += len(found)
        assert " ".join(found) in " ".join(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id]))
        assert r.n_chars == len(r.text)
    assert dict(words) == {i: r.taken for i, r in taken.items() if r.taken}
