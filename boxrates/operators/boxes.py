"""Box spreads with annualised lend, borrow and mid rates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxrates.functions.pricing import (
    borrow_rate,
    expiry_time,
    lend_rate,
    moneyness,
    years_to_expiry,
)
from boxrates.operators.pairs import strike_pairs
from boxrates.operators.quotes import with_mid, with_spot
from boxrates.operators.strikes import (
    latest_strikes,
    liquid_strikes,
    pivot_calls_puts,
    pivot_unique,
    synthetic_forwards,
)
from boxrates.params import RateParams
from boxrates.schema import BOXES, CHAIN, conform

LEG_COUNTS = ["call_volume", "put_volume", "call_open_interest", "put_open_interest"]


def box_prices(pairs: DataFrame) -> DataFrame:
    """Add width, payoff, mid strike and the three prices of each strike pair."""
    gap = F.col("strike_ks") - F.col("strike_kl")
    return pairs.withColumns(
        {
            "kl": F.col("strike_kl"),
            "ks": F.col("strike_ks"),
            "width": gap,
            "payoff": gap,
            "mid_strike": (F.col("strike_kl") + F.col("strike_ks")) / 2.0,
            "lend_cost": F.col("sfl_kl") - F.col("sfs_ks"),
            "borrow_proceeds": F.col("sfs_kl") - F.col("sfl_ks"),
            "mid_cost": F.col("sf_mid_kl") - F.col("sf_mid_ks"),
        }
    )


def box_rates(priced: DataFrame, max_abs_rate: float = math.inf) -> DataFrame:
    """Add the three rates.

    A box without a mid rate, or with one above ``max_abs_rate``, is dropped; a lend
    or borrow rate beyond it is blanked.
    """
    payoff, years = F.col("payoff"), F.col("tte_years")
    rated = priced.withColumn("mid_rate", lend_rate(payoff, F.col("mid_cost"), years))
    rated = rated.filter(F.col("mid_rate") <= max_abs_rate)
    lend = lend_rate(payoff, F.col("lend_cost"), years)
    borrow = borrow_rate(payoff, F.col("borrow_proceeds"), years)
    return rated.withColumns(
        {
            "lend_rate": F.when(lend <= max_abs_rate, lend),
            "borrow_rate": F.when(borrow >= -max_abs_rate, borrow),
        }
    )


def box_moneyness(boxes: DataFrame) -> DataFrame:
    """Add strike / spot for both strikes and their middle; NULL without a spot."""
    spot = F.col("spot_price")
    return boxes.withColumns(
        {
            "spot_price": F.nullif(spot, F.lit(0.0)),
            "moneyness_kl": moneyness(F.col("kl"), spot),
            "moneyness_ks": moneyness(F.col("ks"), spot),
            "moneyness_mid": moneyness(F.col("mid_strike"), spot),
        }
    )


def box_leg_volumes(boxes: DataFrame) -> DataFrame:
    """Add the per-leg counts and their row-wise minimum and total volume."""
    legs = [
        f"{side}_{count}_{strike} AS {side}_{strike}_{count}"
        for count in ("volume", "open_interest")
        for side in ("call", "put")
        for strike in ("kl", "ks")
    ]
    volumes = ["call_volume_kl", "call_volume_ks", "put_volume_kl", "put_volume_ks"]
    return boxes.selectExpr(
        "*",
        *legs,
        f"least({', '.join(volumes)}) AS min_leg_volume",
        # NULL if the sum does not fit.
        f"try_add(try_add({volumes[0]}, {volumes[1]}), try_add({volumes[2]}, {volumes[3]}))"
        " AS total_leg_volume",
    )


def build_boxes_from_strikes(
    strikes: DataFrame,
    params: RateParams = RateParams(),
    *,
    feed: DataFrame | None = None,
    parity: DataFrame | None = None,
) -> DataFrame:
    """Strike rows of any number of chains to boxes.

    Everything that depends on one strike (liquidity, forwards, time to expiry, spot)
    is done before pairing, on the small side of the quadratic step.
    """
    liquid = liquid_strikes(strikes, params.min_volume, params.min_open_interest)
    legs = synthetic_forwards(liquid).select(
        *CHAIN, "strike", "sfl", "sfs", "sf_mid", *LEG_COUNTS
    )
    # A chain whose expiry is no date has no time to expiry, hence no rates and no boxes.
    expiry_at = expiry_time(F.col("expiry"))
    timed = legs.withColumn(
        "tte_years",
        F.when(expiry_at.isNotNull(), years_to_expiry(expiry_at, F.col("snapshot_time"))),
    )
    spotted = with_spot(timed, feed, parity)
    pairs = strike_pairs(
        spotted,
        CHAIN,
        min_gap=params.min_strike_gap,
        max_gap=params.max_strike_gap,
        shared=["tte_years", "spot_price"],
    )
    boxes = box_leg_volumes(box_moneyness(box_rates(box_prices(pairs), params.max_abs_rate)))
    dated = boxes.withColumn("expiry", F.date_format(expiry_time(F.col("expiry")), "yyyy-MM-dd"))
    return conform(dated, BOXES)


def build_boxes(
    quotes: DataFrame,
    params: RateParams = RateParams(),
    *,
    feed: DataFrame | None = None,
    parity: DataFrame | None = None,
    unique_contracts: bool = False,
) -> DataFrame:
    """Quotes of any number of chains to boxes.

    With ``unique_contracts`` the caller states that no contract occurs twice in a
    chain, which saves a scan and a shuffle.
    """
    pivot = pivot_unique if unique_contracts else pivot_calls_puts
    strikes = pivot(with_mid(quotes))
    return build_boxes_from_strikes(strikes, params, feed=feed, parity=parity)


def build_boxes_from_updates(
    updates: DataFrame,
    params: RateParams = RateParams(),
    *,
    feed: DataFrame | None = None,
    parity: DataFrame | None = None,
) -> DataFrame:
    """Raw quote updates to boxes of the current quotes, merging and pivoting in one pass."""
    return build_boxes_from_strikes(latest_strikes(updates), params, feed=feed, parity=parity)
