"""Option quotes derived from general-purpose tables, for tests, benchmarks and demos.

The tables at hand hold no option chains. These projections turn each row of
``events`` or ``lineitem`` into one quote update by integer arithmetic in cents, so
that every engine computes bit-identical prices. Around a known forward and discount
factor the quotes obey put-call parity up to small noise, hence boxes imply
plausible rates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from boxrates.schema import QUOTES, conform

# Fixed values of the derivation.
TICKERS = ["SPX", "VIX", "DJX"]
EXPIRIES = ["2024-06-21", "2024-07-19", "2024-08-16", "2024-09-20"]
EVENT_SNAPSHOT = "2024-02-01 00:00:00"
LINEITEM_EXPIRY_DAYS = 182


def _case(column: str, values: list[str]) -> str:
    return f"element_at(array({', '.join(repr(v) for v in values)}), CAST({column} + 1 AS INT))"


def _once(rows: DataFrame, name: str, expression: str) -> DataFrame:
    # A generator is a boundary to the optimizer: without it, filters on prices would
    # carry these expressions along, several times over.
    return rows.selectExpr("*", f"explode(array({expression})) AS {name}")


def _with_middle(rows: DataFrame, forward_less_strike: str, noise: str) -> DataFrame:
    """Add the leg's middle price in cents."""
    parity = f"CAST({forward_less_strike} AS DOUBLE) / 100.0D"
    side = f"greatest(CASE WHEN _call THEN {parity} ELSE -({parity}) END, 0.0D)"
    return _once(rows, "_middle", f"{side} + ({noise})")


_SPREAD = "(5 + 5 * (_v % 4))"
_PRICES = [
    f"CASE WHEN _v % 17 = 0 THEN 0.0D ELSE (_middle - {_SPREAD}) / 100.0D END AS bid",
    f"CASE WHEN _v % 19 = 0 THEN 0.0D ELSE (_middle + {_SPREAD}) / 100.0D END AS ask",
    "CASE WHEN _v % 23 = 0 THEN 0.0D ELSE (_middle - 1) / 100.0D END AS last",
    "_middle / 100.0D AS mark",
]
_OPTION_TYPE = "CASE WHEN _call THEN 'call' ELSE 'put' END AS option_type"
_SYMBOL = (
    "concat(ticker, replace(substring(expiry, 3, 8), '-', ''), CASE WHEN _call THEN 'C' ELSE 'P'"
    " END, lpad(CAST(CAST(strike * 1000 AS BIGINT) AS STRING), 8, '0')) AS symbol"
)


def quotes_from_events(events: DataFrame, *, daily: bool = False) -> DataFrame:
    """Quote updates of three tickers, four expiries and 41 strikes.

    All belong to one snapshot, or with ``daily`` to one per day of ``ts``.
    """
    rows = _once(events, "_v", "CAST(round(value * 100) AS BIGINT)").selectExpr(
        "event_id AS seq",
        "ts",
        "_v",
        "_v % 2 = 0 AS _call",
        "event_id % 4 AS _e",
        "(event_id * 31 + user_id) % 41 AS _s",
        "user_id % 3 AS _tk",
    )
    rows = _with_middle(
        rows,
        "((500 + 10 * _tk - 25 * _s) * (9800 - 40 * _e))",
        "2000 + 50 * (40 - abs(_s - 20)) + (_v % 21) - 10",
    )
    snapshot = "date_trunc('day', ts)" if daily else f"'{EVENT_SNAPSHOT}'"
    quotes = rows.selectExpr(
        "seq",
        "_call",
        f"{_case('_tk', TICKERS)} AS ticker",
        f"{_case('_e', EXPIRIES)} AS expiry",
        "CAST(4000 + 25 * _s AS DOUBLE) AS strike",
        _OPTION_TYPE,
        *_PRICES,
        "_v % 200 AS volume",
        "_v % 1000 AS open_interest",
        f"CAST({snapshot} AS TIMESTAMP_NTZ) AS snapshot_time",
    )
    return conform(quotes.selectExpr("*", _SYMBOL), QUOTES)


def _lineitem_quotes(
    lineitem: DataFrame, *, ticker: str, snapshot: str, slot: str, is_call: str, strikes: int
) -> DataFrame:
    # The arrival number is equal only for rows with equal quotes: the key of lineitem is
    # not unique in this data, so the price takes part as well.
    priced = _once(lineitem, "_v", "CAST(round(l_extendedprice * 100) AS BIGINT)")
    rows = priced.selectExpr(
        f"{ticker} AS ticker",
        f"CAST({snapshot} AS TIMESTAMP_NTZ) AS snapshot_time",
        "(l_orderkey * 8 + l_linenumber) * 100000000 + _v AS seq",
        "_v",
        f"{slot} AS _s",
        f"{is_call} AS _call",
        "CAST(l_quantity AS BIGINT) AS volume",
    )
    middle = strikes // 2
    rows = _with_middle(
        rows,
        f"((500 - 25 * (_s + 20 - {middle})) * 9800)",
        f"2000 + 50 * (40 - abs(_s - {middle})) + (_v % 21) - 10",
    )
    expiry = f"date_add(to_date(snapshot_time), {LINEITEM_EXPIRY_DAYS})"
    quotes = rows.selectExpr(
        "ticker",
        "snapshot_time",
        "seq",
        f"date_format({expiry}, 'yyyy-MM-dd') AS expiry",
        f"CAST(4000 + 25 * (_s + 20 - {middle}) AS DOUBLE) AS strike",
        _OPTION_TYPE,
        *_PRICES,
        "volume",
        "volume * 10 AS open_interest",
    )
    return conform(quotes, QUOTES)


def quotes_by_day(lineitem: DataFrame) -> DataFrame:
    """One chain of 41 strikes per ship date: many chains, each dense at scale."""
    return _lineitem_quotes(
        lineitem,
        ticker="'LIN'",
        snapshot="l_shipdate",
        slot="(l_partkey * 31 + l_suppkey) % 41",
        is_call="l_suppkey % 2 = 0",
        strikes=41,
    )


def quotes_by_supplier(lineitem: DataFrame) -> DataFrame:
    """One chain of 9 strikes per supplier and quarter: chains grow in number with the data."""
    return _lineitem_quotes(
        lineitem,
        ticker="concat('S', CAST(l_suppkey AS STRING))",
        snapshot="date_trunc('quarter', l_shipdate)",
        slot="(l_partkey + l_linenumber) % 9",
        is_call="_v % 2 = 0",
        strikes=9,
    )
