import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from boxrates.llm import near_dedup as N
from boxrates.llm.components import components
from boxrates.llm.near_dedup import Weights, drop_near, frequencies, near_classes


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", b"") for i, t in rows], "doc_id long, text string, class_id string, node binary")


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(rows, least=0.8):
    """Classes by comparing all pairs, with words as they are."""
    bags, df = [], Counter()
    for _, text in rows:
        w = words_of(text)
        n = min(5, len(w))
        bag = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()
        bags.append(bag)
        df.update(set(bag))

    def weight(s):
        return 1 + min(1, math.log(min(1, max(df[s] / len(rows), 1e-12))) / math.log(N.RARE))

    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = bags[i], bags[j]
            low = sum(min(n, b[s]) * weight(s) for s, n in a.items() if s in b)
            all_a, all_b = (sum(n * weight(s) for s, n in x.items()) for x in (a, b))
            if (not a and not b) or (a and b and low / (all_a + all_b - low) >= least):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return sorted((i, min(g), len(g), i == min(g)) for g in groups.values() for i in g)


def corpus(seed=1):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    rows, passage = [], text(60)
    for _ in range(40):
        base = text(draw.randint(30, 200))
        rows.append(base)
        for _ in range(draw.randint(0, 4)):
            edited = list(base)
            for _ in range(draw.randint(1, 6)):
                edited[draw.randrange(len(edited))] = draw.choice(vocabulary)
            rows.append(edited)
    hot = text(120)
    for _ in range(80):
        edited = list(hot)
        for _ in range(draw.randint(0, 5)):
            edited[draw.randrange(120)] = draw.choice(vocabulary)
        rows.append(edited)
    rows += [[*text(50), *passage, *text(50)] for _ in range(30)]  # share a passage only
    texts = [" ".join(r) for r in rows]
    texts += [texts[0].upper() + " !!", "", None, "...", "a b", "A, b.", "a b c", "long " * 20_000, "long " * 20_001]
    order = list(range(len(texts)))
    draw.shuffle(order)
    return [(i, texts[j]) for i, j in enumerate(order)]


def found(df):
    return sorted((r.doc_id, r.class_id, r.class_size, r.kept) for r in df.collect())


def test_classes_equal_brute_force(spark):
    rows = corpus()
    assert found(near_classes(docs(spark, rows).repartition(5))) == brute(rows)


def test_drop_keeps_one_of_each_class(spark):
    rows = [*corpus()[:60], (None, "lonely text of its own with words"), (None, "lonely text of its own with words")]
    rows += [rows[0]]
    kept = drop_near(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "class_id", "node"]
    ids = [r.doc_id for r in kept.collect()]
    expected = [i for i, _, _, k in brute([r for r in rows[:-3]]) if k]
    assert sorted(i for i in ids if i is not None) == expected and ids.count(None) == 1


def test_drop_keeps_one_of_each_class_with_the_same_id(spark):
    draw = random.Random(4)
    texts = [" ".join(draw.choice("abcdefgh") + str(draw.randrange(900)) for _ in range(60)) for _ in range(5)]
    # Unrelated texts without an id and with one id; a near copy with an id of its own.
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1] + " end"), (None, ""), (7, texts[2]), (7, texts[3])]
    rows += [(9, texts[3] + " end"), (8, texts[4])]
    kept = sorted((r.doc_id or 0, r.text.removesuffix(" end")) for r in drop_near(docs(spark, rows)).collect())
    assert kept == sorted([(0, texts[0]), (0, texts[1]), (0, ""), (7, texts[2]), (7, texts[3]), (8, texts[4])])


def test_empty_table(spark):
    assert near_classes(docs(spark, [])).count() == 0
    assert drop_near(docs(spark, [])).count() == 0


def test_samples_agree_as_often_as_the_similarity_says():
    draw = np.random.default_rng(5)
    agreed, expected = [], []
    for _ in range(60):
        keys = np.unique(N.mix(draw.integers(0, 2**62, 300).astype(np.uint64)))
        weights = draw.uniform(1, 2, len(keys)) * draw.integers(1, 3, len(keys))
        weights[::3] = 2.0
        other = np.where(draw.random(len(keys)) < 0.2, weights * draw.uniform(0.5, 1.5, len(keys)), weights)
        a, b = (keys[:250], weights[:250]), (keys[40:], other[40:])
        expected.append(N.similarity(a, b))
        agreed.append((N.samples(*a) == N.samples(*b)).mean())
    assert abs(np.mean(agreed) - np.mean(expected)) < 0.03


def test_own_weights_are_of_shingles_no_other_text_has(spark):
    words = [f"w{i}" for i in range(40)]
    edited = [*words[:20], "x", *words[21:]]
    texts = {b"a": words, b"b": edited, b"c": words[:39], b"d": []}
    rows = [(node, " ".join(text)) for node, text in texts.items()]
    members = spark.createDataFrame([(n,) for n, _ in rows] * 2, "node binary")
    got = N._own_weights(members, spark.createDataFrame(rows, "node binary, text string"), Weights({}))
    ids = {r.id: bytes(r.node) for r in members.select("node", F.xxhash64("node").alias("id")).collect()}
    # Only b has the five shingles with x, only a and b end in w39.
    assert {ids[r.id]: r.own for r in got.collect()} == {b"b": 10.0}


def test_frequencies_count_all_documents(spark):
    rows = [(i, f"the same words everywhere here and more of u{i} v{i} x{i} y{i} z{i}") for i in range(400)]
    weights = frequencies(docs(spark, rows).repartition(7))
    keys, times = N.shingles(N.word_codes("the same words everywhere here", N.new_memo()))
    assert weights.of(keys, times)[0] == 1.0
    keys, times = N.shingles(N.word_codes("u3 v3 x3 y3 z3", N.new_memo()))
    assert weights.of(keys, times)[0] == 2.0
    assert Weights({}).of(keys, times * 3)[0] == 6.0


def test_components(spark):
    draw = random.Random(2)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)]
    pairs += [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        if a != b:
            root[max(x, y)] = min(x, y)
    nodes = {n for a, b in pairs if a != b for n in (a, b)}
    assert got == {n: find(n) for n in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_samples_do_not_depend_on_blocks(monkeypatch):
    draw = np.random.default_rng(6)
    keys = np.unique(N.mix(draw.integers(0, 2**62, 500).astype(np.uint64)))
    weights = np.where(draw.random(len(keys)) < 0.5, 2.0, draw.uniform(1, 4, len(keys)))
    whole = N.samples(keys, weights)
    monkeypatch.setattr(N, "BLOCK", 64)
    assert (N.samples(keys, weights) == whole).all()
