import random
import zlib

from pyspark.sql import functions as F

from boxrates.llm.toxicity import (
    Params, counterfactuals, drop_toxic, features_of, fit, score, scored_documents,
)

SMALL = Params(min_rows=2)


def corpus(n=900, seed=3):
    """Insults make a text toxic; a group term is common in toxic texts and does not."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        text = [draw.choice(words) for _ in range(draw.randint(5, 60))]
        if toxic:
            text.insert(draw.randrange(len(text)), draw.choice(["blorg", "snarf", "zeppish", "zeppful", "zeppify"]))
        if draw.random() < (0.6 if toxic else 0.05):
            text.insert(0, "muslim")
        if draw.random() < 0.15:
            text.insert(0, "christian")
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def tables(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in rows], "doc_id long, text string, toxic string, score double")
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in rows], "doc_id long, toxic int, text string")
    return docs, labels


def test_held_out_accuracy(spark):
    rows = corpus()
    docs, labels = tables(spark, rows)
    got = {r.doc_id: r for r in scored_documents(docs, labels, SMALL).collect()}
    assert len(got) == len(rows)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert not any(p and not y for p, y in held)


def test_held_out_labels_are_not_learnt(spark):
    rows = corpus(400)
    docs, labels = tables(spark, rows)
    flipped = labels.withColumn(
        "toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic"))
    )
    a, b = (sorted((r.doc_id, r.score) for r in scored_documents(docs, x, SMALL).collect()) for x in (labels, flipped))
    assert a == b


def gap(spark, model):
    texts = spark.createDataFrame([(f"w1 w2 the {t} people w3",) for t in ("muslim", "christian", "jewish")], "t string")
    scores = [r.s for r in texts.select(score(model, F.col("t")).alias("s")).collect()]
    return max(scores) - min(scores)


def test_swapping_identity_terms_moves_the_score_less(spark):
    docs, labels = tables(spark, corpus())
    plain = fit(docs, labels, Params(min_rows=2, swap_penalty=0.0))
    fair = fit(docs, labels, Params(min_rows=2, swap_penalty=20.0))
    assert gap(spark, fair) < 0.3 * gap(spark, plain)


def test_counterfactuals():
    pairs = counterfactuals("All women are here. None.\nWomenfolk too")
    assert ("all women are here", "all men are here") in pairs and len(pairs) == 3
    assert counterfactuals("nothing of the kind") == []
    assert features_of("zeppish", (4, 5)) == ["zeppish", "zepp-", "zeppi-"]
    assert features_of("zepp", (4, 5)) == ["zepp"]


def test_odd_tables(spark):
    docs, labels = tables(spark, [])
    assert scored_documents(docs, labels).count() == 0
    docs, _ = tables(spark, [(None, "a b", 0), (1, None, 0), (2, "", 0), (2, "", 0), (3, "w " * 100_000, 0)])
    got = scored_documents(docs, labels).collect()
    assert len(got) == 5 and {round(r.score, 6) for r in got} == {0.5} and not any(r.held_out for r in got if r.doc_id is None)
    one_class = spark.createDataFrame([(2, 0), (3, 0), (None, 1), (1, None)], "doc_id long, toxic int")
    assert all(r.predicted == 0 for r in scored_documents(docs, one_class).collect())


def test_drop_toxic_keeps_columns_and_clean_rows(spark):
    rows = corpus()
    docs, labels = tables(spark, rows)
    kept = drop_toxic(docs, labels, SMALL)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    clean = {i for i, _, y in rows if not y}
    assert clean <= ids and len(ids - clean) <= 0.05 * len(rows)
