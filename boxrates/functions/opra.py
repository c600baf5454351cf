"""OPRA option symbols: root, yymmdd expiry, C/P, strike in thousandths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the published symbol format.
OPRA_SYMBOL = r"^[A-Z0-9]{1,6}\d{6}[CP]\d{8}$"
# Characters after the root: date, C or P, strike.
_DATE, _SIDE, _STRIKE = -15, -9, -8


def parse_opra(symbol: Column) -> Column:
    """Struct (root, expiry, strike, option_type), NULL for anything else.

    Spaces and case do not matter. A symbol of the right shape with an impossible date
    is NULL as a whole.
    """
    text = F.upper(F.replace(symbol, F.lit(" "), F.lit("")))
    # All parts but the root have a fixed length, so one match and offsets suffice.
    # "20" is prepended because a two-digit year lets the parser choose the century.
    expiry = F.when(
        text.rlike(OPRA_SYMBOL),
        F.try_to_date(F.concat(F.lit("20"), F.substring(text, _DATE, 6)), "yyyyMMdd"),
    )
    parsed = F.struct(
        F.left(text, F.length(text) + _DATE).alias("root"),
        F.date_format(expiry, "yyyy-MM-dd").alias("expiry"),
        (F.substring(text, _STRIKE, 8).cast("bigint") / F.lit(1000.0)).alias("strike"),
        F.when(F.substring(text, _SIDE, 1) == "C", "call").otherwise("put").alias("option_type"),
    )
    return F.when(expiry.isNotNull(), parsed)


def underlying(symbol: Column) -> Column:
    """Root of an OPRA symbol; any other symbol is returned as it came."""
    return F.coalesce(parse_opra(symbol)["root"], symbol)
