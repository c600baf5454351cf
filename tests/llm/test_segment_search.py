import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxrates.llm import segment_search
from boxrates.llm.segment_search import Block, best_of_block, statistics, top_k

SCHEMA = "vec_id long, embedding array<float>, rank string, score int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)


def brute(rows, k=5):
    kept = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = tuple(max(-(1 << 27), min(1 << 27, math.floor(256 * float(np.float32(x))))) for x in v)
        key = (i, len(q))
        kept[key] = min(kept.get(key, q), q)
    out = []
    for (i, n), q in kept.items():
        if i % 50 == 0:
            scores = [(-sum(a * b for a, b in zip(q, p, strict=True)), j) for (j, m), p in kept.items() if m == n and j != i]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def found(spark, rows, **params):
    return sorted(map(tuple, top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0, **params).collect()))


def random_rows(n, dims, seed=1):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(8, dims))
    return [(i, [float(x) for x in (centres[i % 8] + draw.normal(size=dims) * 0.4).astype(np.float32)]) for i in range(n)]


@pytest.mark.parametrize("dims", [1, 7, 64])
def test_equals_brute_force(spark, dims):
    rows = random_rows(400, dims)
    assert found(spark, rows, candidate_block=64, query_block=3) == brute(rows)


def test_ties_repeats_and_odd_vectors(spark):
    rows = random_rows(120, 6)
    rows += [(i, [1.0] * 6) for i in range(200, 330)]  # a hot vector
    rows += [(400, None), (401, []), (402, [1.0, None] * 3), (403, [float("nan")] * 6), (404, [float("inf")] * 6)]
    rows += [(None, [1.0] * 6), (450, [1.0, 2.0]), (451, [2.0, 2.0]), (200, [1.0] * 6), (50, [0.5] * 6), (500, [3e38] * 6)]
    assert found(spark, rows, candidate_block=50, query_block=2) == brute(rows)


def test_few_candidates_and_empty_table(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0])]) == []
    assert found(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 256 * 512)]


def test_bounds_hold_and_prune():
    draw = np.random.default_rng(3)
    x = draw.integers(-200, 200, (500, 64))
    for segments in (1, 4, 16):
        stats = np.hstack(statistics(x, segments))
        apart = ((stats[:100, None] - stats[None, 100:200]) ** 2).sum(-1)
        real = ((x[:100, None] - x[None, 100:200]) ** 2).sum(-1)
        assert (apart <= real + 1e-6 * real).all()
    q, c = Block(np.arange(3), x[:3]), Block(np.arange(10, 500), x[10:])
    place, ids, scores = best_of_block(q, c, 5, tile=32)
    for i in range(3):
        exact = x[10:] @ x[i]
        order = np.lexsort((np.arange(10, 500), -exact))[:5]
        assert list(ids[place == i]) == list(order + 10) and list(scores[place == i]) == list(exact[order])


@pytest.mark.parametrize("sparse", [0.0, 1 / 32, 2.0])
@pytest.mark.parametrize("largest", [3, 300, 1 << 27])
def test_whole_tiles_and_pairs_give_the_same(monkeypatch, sparse, largest):
    monkeypatch.setattr(segment_search, "SPARSE", sparse)
    draw = np.random.default_rng(largest)
    x = draw.integers(-largest, largest + 1, (300, 9))
    x[200:240] = x[7]
    ids = draw.permutation(300)
    asked = ids % 10 == 0
    q = Block(ids[asked], x[asked])
    place, found_ids, scores = best_of_block(q, Block(ids, x), 5, tile=64)
    for i, (own, vector) in enumerate(zip(q.ids, q.vectors, strict=True)):
        best = sorted((-sum(map(int.__mul__, map(int, vector), map(int, y))), j) for y, j in zip(x, ids, strict=True) if j != own)[:5]
        assert list(zip(-scores[place == i], found_ids[place == i], strict=True)) == best


def test_pairs_that_no_bound_discards_are_not_taken_one_by_one(monkeypatch):
    taken = []

    def counted(q, x, rows, cols, products=segment_search._products):
        taken.append(len(rows))
        return products(q, x, rows, cols)

    monkeypatch.setattr(segment_search, "_products", counted)
    draw = np.random.default_rng(4)
    x = draw.integers(-200, 200, (2000, 64))
    best_of_block(Block(np.arange(100), x[:100]), Block(np.arange(2000), x), 5, tile=500)
    assert sum(taken) < 100 * 2000 / 10
