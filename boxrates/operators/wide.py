"""Boxes from wide rows that already hold the four leg prices of a strike pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxrates.functions.pricing import direction_code, direction_label, leg_cost, signed_rate


def box_from_legs(wide: DataFrame, tte: float | Column) -> DataFrame:
    """Add net cost, implied rate and direction to each wide row.

    Input: ``kl, ks, call_kl, call_ks, put_kl, put_ks``; ``tte`` is one time to
    expiry in years for all rows, or a column.
    """
    years = tte if isinstance(tte, Column) else F.lit(float(tte))
    cost = leg_cost(*[F.col(c) for c in ("call_kl", "call_ks", "put_kl", "put_ks")])
    costed = wide.withColumn("net_cost", cost)
    payoff = F.abs(F.col("ks") - F.col("kl"))
    return costed.withColumns(
        {
            "implied_rate": signed_rate(payoff, F.col("net_cost"), years),
            "direction": direction_code(F.col("net_cost")),
            "lend_borrow": direction_label(F.col("net_cost")),
        }
    )


def box_records(boxes: DataFrame) -> DataFrame:
    """The public columns of ``box_from_legs``."""
    return boxes.select(
        "ticker", "expiry", "kl", "ks", "net_cost", "implied_rate", "lend_borrow"
    )
