"""Strike pairs: the self-join of a chain on ``kl < ks`` within a gap range."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxrates.operators.hot import heaviest
from boxrates.schema import CHAIN

# Strike rows on one side of a join cell; larger groups are cut into several cells.
CELL_ROWS = 4096


def _bucket_width(max_gap: float | None) -> float | None:
    if max_gap is None or math.isinf(max_gap):
        return None
    # A little wider than the gap, so that rounding in strike / width can never put
    # two strikes within the gap more than one bucket apart.
    return max_gap * 1.001 if max_gap > 0 else 1.0


def _bucket(ratio: Column) -> Column:
    """Floor as a double; numbers from 2^52 on are whole already and don't fit a bigint."""
    small = F.abs(ratio) < float(1 << 52)
    return F.when(small, F.floor(ratio).cast("double")).otherwise(ratio)


def strike_pairs(
    strikes: DataFrame,
    keys: Sequence[str] = tuple(CHAIN),
    *,
    min_gap: float = 0.0,
    max_gap: float | None = None,
    shared: Sequence[str] = (),
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Every pair of strikes of a chain with ``min_gap <= ks - kl <= max_gap`` and ``kl < ks``.

    Columns other than ``keys`` come out twice, suffixed ``_kl`` and ``_ks``; those in
    ``shared`` are equal within a chain and come out once.

    A finite ``max_gap`` turns the range condition into an equality on strike buckets:
    a pair lies in the same or in neighbouring buckets, so each lower strike visits
    two buckets and each upper strike one. Heavy groups (chain, bucket) are cut further,
    both sides by a hash, into a square of cells of about ``cell_rows`` rows a side
    that together hold each pair exactly once; no task meets a whole heavy chain.
    """
    width = _bucket_width(max_gap)
    zero = F.lit(0.0)
    bucket = zero if width is None else F.coalesce(_bucket(F.col("strike") / width), zero)
    legs = [c for c in strikes.columns if c not in keys and c not in shared]
    group = [*keys, "_bucket"]
    slot = F.when(F.col("strike").isNotNull(), F.xxhash64(*legs, *shared))
    rows = strikes.withColumns({"_bucket": bucket, "_slot": slot})
    # Both sides and the counts below start from the same rows. They read the same
    # columns (the slot covers them all) under the same filters (hence the explicit
    # ones, which the join would otherwise infer for its two sides only), so that Spark
    # computes the shuffle beneath once and reuses it.
    rows = rows.filter(" AND ".join(f"{column} IS NOT NULL" for column in [*keys, "strike"]))

    upper = lower = rows
    # For very large strikes the next bucket is the same one, which is visited once.
    near = F.explode(F.array_distinct(F.array(F.col("_bucket"), F.col("_bucket") + 1)))
    if width is not None:
        lower = rows.withColumn("_bucket", near)

    sizes = rows.groupBy(*group).agg(F.count("_slot").alias("_size"))
    hot = heaviest(sizes, group, "_size", cell_rows // 2)
    if width is not None:
        # A bucket also meets the lower strikes of the bucket below; these are few rows.
        hot = hot.withColumn("_bucket", near).groupBy(*group).agg(F.sum("_size").alias("_size"))
    side = F.ceil(2 * F.col("_size") / cell_rows).cast("int")
    hot = hot.select(*group, side.alias("_side"))

    def into_cells(side: DataFrame, own: str, other: str) -> DataFrame:
        cut = side.join(hot, group, "left").withColumn("_side", F.coalesce("_side", F.lit(1)))
        return cut.withColumns(
            {
                own: F.pmod(F.col("_slot"), F.col("_side")).cast("int"),
                other: F.explode(F.sequence(F.lit(0), F.col("_side") - 1)),
            }
        ).drop("_side", "_slot")

    lower = into_cells(lower, "_row", "_column")
    upper = into_cells(upper, "_column", "_row").drop(*shared)
    lower = lower.withColumnsRenamed({leg: f"{leg}_kl" for leg in legs})
    upper = upper.withColumnsRenamed({leg: f"{leg}_ks" for leg in legs})

    pairs = lower.join(upper, [*group, "_row", "_column"])
    gap = F.col("strike_ks") - F.col("strike_kl")
    within = (gap > 0) & (gap >= min_gap)
    if width is not None:
        within = within & (gap <= max_gap)
    return pairs.filter(within).drop("_bucket", "_row", "_column")


def pairs_between(
    lower: DataFrame,
    upper: DataFrame,
    keys: Sequence[str] = tuple(CHAIN),
    *,
    min_gap: float = 0.0,
    max_gap: float | None = None,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """As ``strike_pairs``, but the lower strikes come from one table and the upper from another.

    The two have the same columns, all of which but ``keys`` come out twice. The work follows
    the pairs of the two tables: with few rows on one side it is linear in the other. A group
    heavy on either side is cut into a rectangle of cells of at most about ``cell_rows / 2``
    by ``cell_rows / 2`` rows.
    """
    width = _bucket_width(max_gap)
    zero = F.lit(0.0)
    bucket = zero if width is None else F.coalesce(_bucket(F.col("strike") / width), zero)
    legs = [c for c in lower.columns if c not in keys]
    group = [*keys, "_bucket"]
    known = " AND ".join(f"{column} IS NOT NULL" for column in [*keys, "strike"])
    slot = F.xxhash64(*legs)
    lower = lower.filter(known).withColumns({"_bucket": bucket, "_slot": slot})
    upper = upper.filter(known).withColumns({"_bucket": bucket, "_slot": slot})
    if width is not None:
        near = F.array_distinct(F.array(F.col("_bucket"), F.col("_bucket") + 1))
        lower = lower.withColumn("_bucket", F.explode(near))

    def cells(side: DataFrame, name: str) -> DataFrame:
        sizes = side.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
        return heaviest(sizes, group, "_size", cell_rows // 2).select(
            *group, F.ceil(2 * F.col("_size") / cell_rows).cast("int").alias(name)
        )

    hot = cells(lower, "_rows").join(cells(upper, "_columns"), group, "full")
    hot = hot.select(*group, *[F.coalesce(c, F.lit(1)).alias(c) for c in ("_rows", "_columns")])

    def into_cells(side: DataFrame, own: str, many: str, other: str, others: str) -> DataFrame:
        cut = side.join(hot, group, "left")
        own_cell = F.pmod(F.col("_slot"), F.coalesce(many, F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(others, F.lit(1)) - 1))
        return cut.withColumn(own, own_cell).withColumn(other, every).drop("_rows", "_columns", "_slot")

    lower = into_cells(lower, "_row", "_rows", "_column", "_columns")
    upper = into_cells(upper, "_column", "_columns", "_row", "_rows")
    lower = lower.withColumnsRenamed({leg: f"{leg}_kl" for leg in legs})
    upper = upper.withColumnsRenamed({leg: f"{leg}_ks" for leg in legs})
    gap = F.col("strike_ks") - F.col("strike_kl")
    within = (gap > 0) & (gap >= min_gap)
    if width is not None:
        within = within & (gap <= max_gap)
    return lower.join(upper, [*group, "_row", "_column"]).filter(within).drop("_bucket", "_row", "_column")
