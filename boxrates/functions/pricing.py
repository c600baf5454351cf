"""Box-spread arithmetic as column expressions.

All conditions are guarded with ``when`` so that no division by zero is evaluated
under ANSI mode, and an overflow to infinity becomes NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds in a Julian year, and the floor on time to expiry in years.
YEAR_SECONDS = 31_557_600.0
MIN_YEARS = 0.0001

_INFINITY = float("inf")


def _finite(value: Column) -> Column:
    return F.nullif(value, F.lit(_INFINITY))


def two_sided_mid(bid: Column, ask: Column) -> Column:
    return F.when((bid > 0) & (ask > 0), (bid + ask) / 2.0)


def quote_mid(bid: Column, ask: Column, mark: Column, last: Column) -> Column:
    """Two-sided mid, else mark, else last. A mark of 0 is a price and is kept."""
    return F.coalesce(two_sided_mid(bid, ask), mark, last)


def parity_mid(bid: Column, ask: Column, mark: Column, last: Column) -> Column:
    """Mid used for parity: here a mark of 0 is missing, and the result must be positive."""
    mid = F.coalesce(two_sided_mid(bid, ask), F.nullif(mark, F.lit(0.0)), last)
    return F.when(mid > 0, mid)


def expiry_time(expiry: Column) -> Column:
    """Expiry text, which must hold a whole date, to a UTC time.

    A written offset is dropped, not converted.
    """
    whole = F.when(expiry.rlike(r"^\s*\d{4}-\d{2}-\d{2}"), expiry)
    compact = F.when(expiry.rlike(r"^\d{8}$"), F.try_to_date(expiry, "yyyyMMdd"))
    return F.coalesce(whole.try_cast("timestamp_ntz"), compact.cast("timestamp_ntz"))


def years_to_expiry(expiry_at: Column, snapshot_time: Column) -> Column:
    """Julian years from snapshot to expiry, at least ``MIN_YEARS``."""
    gap = (expiry_at - snapshot_time).cast("interval second").cast("decimal(20,6)")
    return F.greatest(gap.cast("double") / YEAR_SECONDS, F.lit(MIN_YEARS))


def lend_rate(payoff: Column, cost: Column, years: Column) -> Column:
    """Annual return of paying ``cost`` now for ``payoff`` at expiry."""
    valid = (cost > 0) & (cost < payoff) & (years > 0)
    return F.when(valid, _finite(F.pow(payoff / cost, 1.0 / years) - 1.0))


def borrow_rate(payoff: Column, proceeds: Column, years: Column) -> Column:
    """Annual cost, as a negative rate, of taking ``proceeds`` now and owing ``payoff``."""
    valid = (proceeds > 0) & (proceeds < payoff) & (years > 0)
    return F.when(valid, -_finite(F.pow(payoff / proceeds, 1.0 / years) - 1.0))


def moneyness(strike: Column, spot: Column) -> Column:
    return strike / F.nullif(spot, F.lit(0.0))


def leg_cost(call_kl: Column, call_ks: Column, put_kl: Column, put_ks: Column) -> Column:
    """Net cost of a box from its four leg prices; positive is a debit."""
    return (call_kl + put_ks) - (put_kl + call_ks)


def signed_rate(payoff: Column, cost: Column, years: Column) -> Column:
    """Annual rate of a box carrying the sign of its cost; 0 where undefined."""
    defined = (cost != 0) & (payoff != 0) & (years > 0)
    size = F.abs(_finite(F.pow(payoff / F.abs(cost), 1.0 / years) - 1.0))
    return F.when(defined, F.coalesce(size * F.signum(cost), F.lit(0.0))).otherwise(F.lit(0.0))


def direction_code(cost: Column) -> Column:
    """1 lend (debit), -1 borrow (credit), 0 flat."""
    return F.signum(cost).cast("int")


def direction_label(cost: Column) -> Column:
    return F.when(cost > 0, "lend").when(cost < 0, "borrow").otherwise("flat")


def percent(rate: Column) -> Column:
    return rate * 100


def percent_text(rate: Column) -> Column:
    """Rate as percent text with at most two decimals, e.g. ``4.5%``."""
    return F.concat(F.round(percent(rate), 2).cast("string"), F.lit("%"))
