import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boxrates.llm.exact_dedup import copies, drop_copies

SCHEMA = "doc_id long, text string, keep_id string, kept int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


def lowered(text):
    return (text or "").encode().lower()


def found(df):
    return sorted((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest)) for r in df.collect())


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    return sorted(
        (i, max(g), len(g), i == max(g), hashlib.sha256(lowered(t)).digest())
        for i, t in rows
        for g in [groups[lowered(t)]]
    )


ROWS = [
    (1, "One text"), (2, "one TEXT"), (3, "one text "), (4, None), (5, ""), (6, "Ärger"), (7, "ärger"),
    (8, "ÄRGER"), (9, "Ärger"), (10, "x" * 200_000), (11, "X" * 200_000), (12, "İ"), (13, "ſ"), (14, "S"),
]


def test_copies_equal_brute_force(spark):
    assert found(copies(docs(spark, ROWS))) == brute(ROWS)


def test_hot_group_and_salts(spark):
    rows = [(i, "Hot" if i % 3 else f"text {i}") for i in range(600)]
    assert found(copies(docs(spark, rows), salts=5)) == brute(rows)


def test_texts_are_compared_where_digests_collide(spark):
    rows = [(i, f"text {i % 7}") for i in range(50)]
    weak = lambda text: F.unhex(F.lit("00"))
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in copies(docs(spark, rows), digest=weak).collect()]
    assert sorted(got) == [r[:4] for r in brute(rows)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.sampled_from(["a", "A", "b", "", None, "é", "É"]), max_size=20))
def test_any_texts(spark, texts):
    rows = list(enumerate(texts))
    assert found(copies(docs(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert copies(docs(spark, [])).count() == 0
    assert drop_copies(docs(spark, [])).count() == 0


def test_null_ids_come_last(spark):
    rows = docs(spark, [(None, "a"), (3, "a"), (None, "b"), (None, "b")])
    got = sorted(copies(rows).select("doc_id", "keep_id", "kept").collect(), key=str)
    assert [tuple(r) for r in got] == [(3, 3, True), (None, 3, False), (None, None, True), (None, None, True)]


def test_drop_keeps_one_row_and_all_columns(spark):
    rows = [(1, "a"), (2, "A"), (2, "A"), (5, "b"), (None, "c"), (None, "c"), (7, None), (8, "")]
    kept = drop_copies(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "keep_id", "kept"]
    assert sorted([tuple(r)[:2] for r in kept.collect()], key=str) == [(2, "A"), (5, "b"), (8, ""), (None, "c")]


def test_plan_is_native(spark):
    plan = copies(docs(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
