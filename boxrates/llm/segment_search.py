"""Exact top-k search with multi-resolution segment statistics.

Vectors are cut into segments, and of each segment the mean and the deviation (the norm of
what is left when the mean is taken away) are kept, at several resolutions. For segments of
length L with means m, n and deviations d, e, the squared distance of two vectors is at least
the sum of L (m - n)^2 + (d - e)^2; with the norms this bounds the inner product from above.
Coarse bounds discard most candidates, finer ones most of the rest, and exact products are
computed for survivors only.

Queries and candidates are dealt into blocks by a hash of their ids; each pair of a query block
and a candidate block is a task's work and leaves at most k rows per query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 5
SCALE = 256
SEGMENTS = (2, 8, 16)
CANDIDATE_BLOCK = 4096
QUERY_BLOCK = 1024
TILE = 1024
#: Below this share of a tile's pairs, steps take them one by one.
SPARSE = 1 / 32
#: Scaled components are clamped to this, so that products of 128 components fit 64 bits.
LARGEST = 1 << 27


def scaled(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, as whole numbers."""
    most = F.lit(float(LARGEST))

    def whole(x: Column) -> Column:
        return F.floor(F.greatest(-most, F.least(most, x.cast("double") * scale))).cast("bigint")

    return F.transform(embedding, whole)


def usable(embedding: Column) -> Column:
    """Not NULL, not empty, and every component a finite number."""
    infinite = F.lit(float("inf"))
    bad = F.exists(
        embedding,
        lambda x: x.isNull() | F.isnan(x) | (x == infinite) | (x == -infinite),
    )
    return embedding.isNotNull() & (F.size(embedding) > 0) & ~bad


def statistics(vectors: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means times the root of the segment's length, and deviations, of each row's segments."""
    parts = np.array_split(vectors.astype(np.float64), min(segments, vectors.shape[1]), axis=1)
    means = np.stack([p.mean(axis=1) for p in parts], axis=1)
    spread = [((p - p.mean(axis=1, keepdims=True)) ** 2).sum(axis=1) for p in parts]
    return means * np.sqrt([p.shape[1] for p in parts]), np.sqrt(np.stack(spread, axis=1))


class Block:
    """Vectors by ascending id, with their statistics at each resolution."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, segments=SEGMENTS):
        order = np.argsort(ids, kind="stable")
        if len(np.unique(ids)) < len(ids):
            order = np.lexsort((*vectors.T[::-1], ids))
        ids, vectors = ids[order], vectors[order]
        once = np.append(True, ids[1:] != ids[:-1])  # a repeated id counts once
        self.ids, self.vectors = ids[once], vectors[once]
        self.real = self.vectors.astype(np.float64)
        self.largest = float(np.abs(self.real).max(initial=0))
        norms = (self.real**2).sum(axis=1)
        self.levels = [np.hstack(statistics(self.vectors, s)) for s in segments]
        # Of the bound, what a vector adds by itself, with room for rounding.
        self.rests = [(norms - (x**2).sum(axis=1)) / 2 + 1e-9 * norms + 5e-7 for x in self.levels]


def best_of_block(queries: Block, candidates: Block, k: int = K, tile: int = TILE):
    """Query place, candidate id and score of each query's ``k`` best candidates.

    Candidates come by ascending id, so a later one replaces an earlier one only with a
    higher score; one whose bound does not exceed the k-th score so far is out. While many pairs
    of a tile are left, a step takes the whole tile by a matrix product; else it takes pairs.
    """
    n = len(queries.ids)
    least = -(1 << 62)  # below every product
    scores = np.full((n, k), least)
    ids = np.full((n, k), np.iinfo(np.int64).max)
    # Sums of whole numbers up to 2^53 are exact in a matrix product.
    exact_tiles = queries.largest * candidates.largest * queries.vectors.shape[1] < 1 << 53
    for start in range(0, len(candidates.ids), tile):
        part = slice(start, start + tile)
        kth = scores[:, -1]
        # |q - x|^2 >= |Q - X|^2 for the statistics Q, X, so qx <= QX + (|q|^2 - |Q|^2 + |x|^2 - |X|^2) / 2.
        above = kth.astype(np.float64) + 1
        left = queries.ids[:, None] != candidates.ids[None, part]
        rows = cols = None
        for q, x, q_rest, x_rest in zip(queries.levels, candidates.levels, queries.rests, candidates.rests, strict=True):
            if rows is None:
                bound = q @ x[part].T
                bound += x_rest[part]
                left &= bound >= (above - q_rest)[:, None]
                if np.count_nonzero(left) < left.size * SPARSE:
                    rows, cols = np.nonzero(left)
            else:
                bound = _products(q, x[part], rows, cols) + x_rest[part][cols]
                keep = bound >= (above - q_rest)[rows]
                rows, cols = rows[keep], cols[keep]
        if rows is None and exact_tiles:
            product = queries.real @ candidates.real[part].T
            product[~left] = -np.inf
            # Of a tile a query needs no more than its k best, and those that equal the last of them.
            most = min(k, product.shape[1])
            lowest = np.partition(product, -most, axis=1)[:, -most]
            rows, cols = np.nonzero((product > kth[:, None]) & (product >= lowest[:, None]))
            exact = product[rows, cols].astype(np.int64)
        else:
            if rows is None:
                rows, cols = np.nonzero(left)
            exact = _products(queries.vectors, candidates.vectors[part], rows, cols)
        if not len(rows):
            continue
        # Survivors and the k so far, by query, falling score and id.
        row = np.concatenate([rows, np.repeat(np.arange(n), k)])
        score = np.concatenate([exact, scores.ravel()])
        vec = np.concatenate([candidates.ids[part][cols], ids.ravel()])
        order = np.lexsort((vec, -score, row))
        row, score, vec = row[order], score[order], vec[order]
        first = np.searchsorted(row, np.arange(n))
        rank = np.arange(len(row)) - first[row]
        top = rank < k
        scores[row[top], rank[top]] = score[top]
        ids[row[top], rank[top]] = vec[top]
    place, rank = np.nonzero(scores > least)
    return place, ids[place, rank], scores[place, rank]


def _products(q: np.ndarray, x: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Inner products of the pairs ``rows, cols``."""
    step = 1 << 16
    parts = [
        np.einsum("ij,ij->i", q[rows[i : i + step]], x[cols[i : i + step]]) for i in range(0, len(rows), step)
    ]
    return np.concatenate(parts) if parts else np.zeros(0, q.dtype)


def _block(rows: pa.Table) -> Block:
    vectors = rows.column("vector").combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return Block(rows.column("vec_id").to_numpy(), flat.reshape(len(vectors), -1))


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _search(k: int):
    def search(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not len(queries) or not len(candidates):
            return _FOUND.empty_table()
        q = _block(queries)
        place, vec, score = best_of_block(q, _block(candidates), k)
        return pa.table([q.ids[place], vec, score], schema=_FOUND)

    return search


def top_k(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = K,
    scale: int = SCALE,
    candidate_block: int = CANDIDATE_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest integer inner products.

    ``vectors`` has ``vec_id`` and ``embedding``; other columns are ignored. Ties go to the
    smaller ``vec_id``.

    - Vectors that are NULL or empty, or hold NULLs or non-finite components, take no part, nor
      do rows without an id.
    - Vectors are compared with those of as many components only.
    - Of rows that repeat an id with as many components, the smallest vector by component
      counts; a query is never its own candidate.
    - Scaled components are clamped to +-2^27. Fewer than ``k`` candidates give fewer rows, an
      empty table none.
    """
    plain = vectors.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        scaled(F.col("embedding"), scale).alias("vector"),
        is_query.alias("is_query"),
    )
    n = plain.agg(F.count("*").alias("all"), F.count_if(F.col("is_query")).alias("queries")).first()
    columns = max(1, math.ceil(n["all"] / candidate_block))
    rows = max(1, math.ceil(n["queries"] / query_block))
    deal = F.xxhash64("vec_id")
    width = F.size("vector").alias("width")
    pairs = [F.col(c) for c in ("width", "row", "column")]
    candidates = plain.select(
        "vec_id", "vector", width, F.pmod(deal, F.lit(columns)).alias("column")
    ).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    queries = plain.filter("is_query").select(
        "vec_id", "vector", width, F.pmod(deal, F.lit(rows)).cast("int").alias("row")
    ).withColumn("column", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(columns - 1).cast("bigint"))))
    found = (
        queries.groupBy(*pairs)
        .cogroup(candidates.groupBy(*pairs))
        .applyInArrow(_search(k), "query_id bigint, vec_id bigint, score bigint")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
