"""Exact quantiles per group that never sort a heavy group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxrates.operators.hot import heaviest

# Groups up to this many rows are ranked directly.
DIRECT_ROWS = 100_000
# percentile_approx errs by at most 1 / ACCURACY of the rows; brackets allow twice that.
ACCURACY = 10_000


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    *,
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """Count, mean, median and nearest-rank ``quantiles`` of ``value`` per group.

    Output: keys, ``n``, ``mean``, ``median`` and one column per quantile, which is
    the value at 0-based rank ``floor((n - 1) * q + 0.5)``. Values must not be NULL.

    Ranking needs the running count over the distinct values of a group. In groups
    above ``direct_rows`` the values that cannot be an answer are first folded
    together: approximate percentiles with a known error bracket each wanted rank,
    and all values between two brackets become one row holding their count and sum.
    That leaves a small fraction of the group to sort and keeps every result exact.

    Reads ``df`` twice, and a third time for the rows of heavy groups if there are any:
    pass stored data rather than a long computation.
    """
    points = sorted({0.5, *quantiles.values()})
    slack = 2.0 / ACCURACY
    marks = [min(max(p + s, 0.0), 1.0) for p in points for s in (-slack, slack)]

    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hot = heaviest(sizes, keys, "n", direct_rows).select(*keys)
    brackets = (
        df.join(hot, list(keys), "left_semi")
        .groupBy(*keys)
        .agg(F.percentile_approx(value, marks, ACCURACY).alias("_edges"))
    )

    def edge(number: int) -> Column:
        return F.col("_edges")[number]

    # Outside all brackets a value is replaced by the nearest bracket edge below it
    # (or by "below everything"), which preserves the order and the counts.
    inside = F.lit(False)
    below = F.lit(float("-inf"))
    for i in range(len(points)):
        low, high = edge(2 * i), edge(2 * i + 1)
        inside = inside | F.col(value).between(low, high)
        below = F.when(F.col(value) > high, high).otherwise(below)
    folded = F.when(F.col("_edges").isNull() | inside, F.col(value)).otherwise(below)

    counted = (
        df.select(*keys, value)
        .join(brackets, list(keys), "left")
        .withColumn("_value", folded)
        .groupBy(*keys, "_value")
        .agg(F.count(F.lit(1)).alias("_count"), F.sum(value).alias("_sum"))
    )
    running = Window.partitionBy(*keys).orderBy("_value")
    ranked = counted.withColumns(
        {
            "_upto": F.sum("_count").over(running.rowsBetween(Window.unboundedPreceding, 0)),
            "_total": F.sum("_count").over(Window.partitionBy(*keys)),
        }
    )

    total = F.col("_total")
    ranks = {name: F.floor((total - 1) * q + 0.5) for name, q in quantiles.items()}
    ranks["_low"] = F.floor((total - 1) / 2)
    ranks["_high"] = F.ceil((total - 1) / 2)
    picked = ranked.groupBy(*keys).agg(
        F.sum("_count").alias("n"),
        (F.sum("_sum") / F.sum("_count")).alias("mean"),
        *[
            F.min(F.when(F.col("_upto") > rank, F.col("_value"))).alias(name)
            for name, rank in ranks.items()
        ],
    )
    median = (F.col("_low") + F.col("_high")) / 2.0
    return picked.select(*keys, "n", "mean", median.alias("median"), *quantiles)
