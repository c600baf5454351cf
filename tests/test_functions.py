from datetime import datetime

import pytest
from pyspark.sql import functions as F

from boxrates.functions import pricing
from boxrates.functions.opra import parse_opra, underlying


@pytest.mark.parametrize(
    "symbol, expected",
    [
        ("SPX260118C04000000", ("SPX", "2026-01-18", 4000.0, "call")),
        ("AAPL260215P00100000", ("AAPL", "2026-02-15", 100.0, "put")),
        ("spx  260118c04000000", ("SPX", "2026-01-18", 4000.0, "call")),
        ("A260118P00000500", ("A", "2026-01-18", 0.5, "put")),
        ("SPX260230C04000000", None),
        ("SPX990118C04000000", ("SPX", "2099-01-18", 4000.0, "call")),
        ("TOOLONG260118C04000000", None),
        ("INVALID", None),
        ("", None),
    ],
)
def test_opra(spark, symbol, expected):
    row = spark.createDataFrame([(symbol,)], "s string").select(
        parse_opra(F.col("s")).alias("p"), underlying(F.col("s")).alias("u")
    ).first()
    assert (tuple(row.p) if row.p else None) == expected
    assert row.u == (expected[0] if expected else symbol)


def _value(spark, **columns):
    return tuple(spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first())


def test_mid_keeps_a_zero_mark_but_parity_does_not(spark):
    args = [F.lit(0.0), F.lit(5.0), F.lit(0.0), F.lit(3.0)]
    assert _value(spark, a=pricing.quote_mid(*args), b=pricing.parity_mid(*args)) == (0.0, 3.0)


def test_rates(spark):
    payoff, years = F.lit(100.0), F.lit(0.5)
    mid, lend, borrow, none, over = _value(
        spark,
        mid=pricing.lend_rate(payoff, F.lit(97.6), years),
        lend=pricing.lend_rate(payoff, F.lit(98.4), years),
        borrow=pricing.borrow_rate(payoff, F.lit(96.8), years),
        none=pricing.lend_rate(payoff, F.lit(100.0), years),
        over=pricing.lend_rate(F.lit(1e9), F.lit(1e-9), F.lit(0.0001)),
    )
    assert (round(mid, 6), round(lend, 6), round(borrow, 6)) == (0.049785, 0.032785, -0.067209)
    assert none is None and over is None


def test_signed_rate_is_zero_where_undefined(spark):
    rate = pricing.signed_rate
    assert _value(
        spark,
        a=rate(F.lit(10.0), F.lit(8.0), F.lit(1.0)),
        b=rate(F.lit(10.0), F.lit(0.0), F.lit(1.0)),
        c=rate(F.lit(0.0), F.lit(5.0), F.lit(1.0)),
        d=rate(F.lit(10.0), F.lit(5.0), F.lit(0.0)),
        e=rate(F.lit(10.0), F.lit(-8.0), F.lit(1.0)),
        f=rate(F.lit(1e9), F.lit(1e-9), F.lit(0.0001)),
    ) == (0.25, 0.0, 0.0, 0.0, -0.25, 0.0)
    assert _value(spark, c=pricing.leg_cost(*[F.lit(x) for x in (5.0, 1.0, 1.0, 5.0)])) == (8.0,)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2026-01-18", datetime(2026, 1, 18)),
        ("20260118", datetime(2026, 1, 18)),
        ("2026-01-18T16:00:00-05:00", datetime(2026, 1, 18, 16)),
        ("soon", None),
        (None, None),
    ],
)
def test_expiry_time(spark, text, expected):
    df = spark.createDataFrame([(text,)], "e string")
    assert df.select(pricing.expiry_time(F.col("e"))).first()[0] == expected


def test_years_have_a_floor(spark):
    at = F.lit("2026-01-18").cast("timestamp_ntz")
    later = F.lit("2026-02-01").cast("timestamp_ntz")
    year = F.lit("2027-01-18 06:00:00").cast("timestamp_ntz")
    assert _value(
        spark, a=pricing.years_to_expiry(at, later), b=pricing.years_to_expiry(year, at)
    ) == (0.0001, 1.0)


def test_times_do_not_depend_on_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        start = F.lit("2026-03-08").cast("timestamp_ntz")
        years = pricing.years_to_expiry(pricing.expiry_time(F.lit("2026-03-09")), start)
        assert _value(spark, y=years) == (86400 / 31557600,)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_percent_text(spark):
    assert _value(
        spark, a=pricing.percent_text(F.lit(0.045)), b=pricing.percent_text(F.lit(-0.05))
    ) == ("4.5%", "-5.0%")
