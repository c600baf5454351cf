"""One row per strike: the call and the put of a chain side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxrates.functions.pricing import two_sided_mid
from boxrates.operators.quotes import last_nonzero
from boxrates.schema import CHAIN

SIDES = ("call", "put")
LEG_FIELDS = ["bid", "ask", "mid", "volume", "open_interest"]


def pivot_calls_puts(quotes: DataFrame, keys: Sequence[str] = tuple(CHAIN)) -> DataFrame:
    """Calls joined to puts of the same strike.

    Works on quotes with ``mid``. A contract present several times yields every
    combination; merge first when only its current quote matters.
    """

    def leg(side: str) -> DataFrame:
        fields = [F.col(field).alias(f"{side}_{field}") for field in LEG_FIELDS]
        return quotes.filter(F.col("option_type") == side).select(*keys, "strike", *fields)

    return leg("call").join(leg("put"), [*keys, "strike"])


def pivot_unique(quotes: DataFrame, keys: Sequence[str] = tuple(CHAIN)) -> DataFrame:
    """As ``pivot_calls_puts`` for quotes in which each contract occurs once.

    One aggregation, so one scan and one shuffle instead of two of each.
    """

    def leg(side: str):
        is_side = F.col("option_type") == side
        return [
            F.max(F.when(is_side, F.col(field))).alias(f"{side}_{field}") for field in LEG_FIELDS
        ] + [F.count(F.when(is_side, True)).alias(f"_{side}s")]

    pivoted = quotes.groupBy(*keys, "strike").agg(*leg("call"), *leg("put"))
    return pivoted.filter((F.col("_calls") > 0) & (F.col("_puts") > 0)).drop("_calls", "_puts")


def latest_strikes(updates: DataFrame, keys: Sequence[str] = tuple(CHAIN)) -> DataFrame:
    """Quote updates straight to strike rows.

    Equals ``merge_updates`` by contract, ``with_mid`` and ``pivot_unique``, but merges
    and pivots in a single aggregation: updates combine before the only shuffle.
    """

    def leg(side: str):
        is_side = f"lower(option_type) = '{side}'"
        return [
            last_nonzero("bid", "double", is_side).alias(f"{side}_bid"),
            last_nonzero("ask", "double", is_side).alias(f"{side}_ask"),
            last_nonzero("mark", "double", is_side).alias(f"_{side}_mark"),
            last_nonzero("volume", "bigint", is_side).alias(f"{side}_volume"),
            last_nonzero("open_interest", "bigint", is_side).alias(f"{side}_open_interest"),
            F.expr(f"count_if({is_side})").alias(f"_{side}s"),
        ]

    merged = updates.groupBy(*keys, "strike").agg(*leg("call"), *leg("put"))
    merged = merged.filter((F.col("_calls") > 0) & (F.col("_puts") > 0))
    # After merging, mark is always a number (0 at worst), so last is never consulted.
    mids = {
        f"{side}_mid": F.coalesce(
            two_sided_mid(F.col(f"{side}_bid"), F.col(f"{side}_ask")), F.col(f"_{side}_mark")
        )
        for side in SIDES
    }
    merged = merged.withColumns(mids)
    legs = [f"{side}_{field}" for side in SIDES for field in LEG_FIELDS]
    return merged.select(*keys, "strike", *legs)


def liquid_strikes(strikes: DataFrame, min_volume: int = 0, min_open_interest: int = 0) -> DataFrame:
    """Strikes whose call and put both reach the volume and open-interest minimum."""
    enough = [f"{side}_volume >= {min_volume}" for side in SIDES]
    enough += [f"{side}_open_interest >= {min_open_interest}" for side in SIDES]
    return strikes.filter(" AND ".join(enough))


def synthetic_forwards(strikes: DataFrame) -> DataFrame:
    """Add the synthetic forward bought (``sfl``), sold (``sfs``) and at mid (``sf_mid``)."""
    return strikes.withColumns(
        {
            "sfl": F.col("call_ask") - F.col("put_bid"),
            "sfs": F.col("call_bid") - F.col("put_ask"),
            "sf_mid": F.col("call_mid") - F.col("put_mid"),
        }
    )
