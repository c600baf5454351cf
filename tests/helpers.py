"""Small inputs for the tests."""

from datetime import datetime

from boxrates.schema import QUOTES

AT = datetime(2026, 1, 1)


def quote(ticker, expiry, strike, kind, bid, ask, last, mark, volume, oi, *, symbol=None, seq=0, at=AT):
    return (ticker, expiry, float(strike), kind, float(bid), float(ask), float(last), float(mark),
            volume, oi, None, None, symbol, seq, at)


def quotes(spark, rows):
    numbered = [row if row[13] else (*row[:13], i + 1, row[14]) for i, row in enumerate(rows)]
    return spark.createDataFrame(numbered, QUOTES)


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
