"""Queries over time series beside the boxes: spot histories, curves, tenors; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxrates.conformance import queries as base
from boxrates.conformance.oracles import (
    BOXES,
    BY_SUPPLIER,
    BY_TICKER,
    CHAIN,
    EVENTS_DAILY,
    MERGED,
    NO_SPOT,
    ROUND_MONEYNESS,
    STRIKES,
    _boxes,
    _sql,
)
from boxrates.operators import boxes as box
from boxrates.operators import views
from boxrates.operators.asof import as_of, spot_as_of
from boxrates.operators.curves import carry_by_tenor, curve_spread
from boxrates.session import staged
from boxrates.conformance.derived import TICKERS, quotes_from_events

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
GRID_DAYS = list(range(60, 271, 15))


def _ticker() -> F.Column:
    return F.element_at(F.array(*map(F.lit, TICKERS)), (F.col("user_id") % 3 + 1).cast("int"))


def _spots(events: DataFrame) -> DataFrame:
    """Purchases as trades of the underlyings."""
    return events.filter("event_type = 'purchase'").select(
        _ticker().alias("ticker"),
        F.col("ts").cast("timestamp_ntz").alias("spot_time"),
        F.round(F.col("value") + 4000, 2).alias("spot_price"),
        F.col("event_id").alias("seq"),
    )


def spot_as_of_query(spark, sf_dir):
    """Every event with the last trade of its ticker."""
    events = base._events(spark, sf_dir)
    rows = events.select(
        F.col("event_id").alias("seq"), _ticker().alias("ticker"), F.col("ts").cast("timestamp_ntz").alias("at")
    )
    values = ["spot_price", "spot_time"]
    spots = _spots(events).withColumn("_time", F.col("spot_time"))
    return as_of(rows, spots, on=["ticker"], time="at", history_time="_time", values=values, order=["seq"])


def box_moneyness_as_of(spark, sf_dir):
    """Daily boxes whose spot is the last trade before their snapshot."""
    events = base._events(spark, sf_dir)
    updates = quotes_from_events(events, daily=True)
    feed = spot_as_of(updates, _spots(events))
    boxes = box.build_boxes_from_updates(updates, base.PARAMS, feed=feed)
    shown = boxes.select(*base.CHAIN, "kl", "ks", "spot_price", *base.MONEYNESS)
    return base._rounded(shown, "spot_price", *base.MONEYNESS)


def _curve(events: DataFrame) -> DataFrame:
    """A curve a week: the five kinds of event as tenors, with their mean value as rate."""
    tenor = F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type"))
    cents = F.round(F.col("value") * 100).cast("bigint")
    return (
        events.groupBy(F.date_trunc("week", "ts").cast("timestamp_ntz").alias("curve_time"), tenor.alias("_tenor"))
        .agg((F.sum(cents) / F.count(cents) / 1e5).alias("rate"))
        .select("curve_time", (F.col("_tenor") * 0.125).alias("tenor_years"), "rate")
    )


def curve_spread_query(spark, sf_dir):
    """Daily boxes over the curve of their week."""
    events = base._events(spark, sf_dir)
    boxes = box.build_boxes_from_updates(quotes_from_events(events, daily=True), base.PARAMS)
    found = curve_spread(boxes, _curve(events), bucket=0.1)
    shown = found.select(*base.CHAIN, "kl", "ks", "curve_time", "curve_rate", "spread")
    return base._rounded(shown, "curve_rate", "spread")


def _mean_rates(events: DataFrame) -> DataFrame:
    """The tickers stand for currencies, their mean rate per expiry for points of a curve."""
    boxes = box.build_boxes_from_updates(quotes_from_events(events, daily=True), base.PARAMS)
    days = F.datediff(F.to_date("expiry"), F.to_date("snapshot_time"))
    grouped = boxes.groupBy(F.col("ticker").alias("currency"), "snapshot_time", "expiry")
    return grouped.agg(F.round(F.avg("mid_rate"), 9).alias("rate")).withColumn("tenor_days", days)


def carry_by_tenor_query(spark, sf_dir):
    curves = _mean_rates(base._events(spark, sf_dir))
    found = carry_by_tenor(curves, GRID_DAYS, base="SPX", x="tenor_days")
    return base._rounded(found, "rate", "base_rate", "carry")


def term_structure_sketch(spark, sf_dir):
    """Term structure pooled over tickers, from sketches of each snapshot, beside the error made.

    The ranks of the sketched rates are counted in the boxes, to hold them to their bound.
    """
    boxes = base._stored(spark, sf_dir)
    sketches = staged(views.rate_sketches(boxes), "sketches")
    term = views.term_structure_of_sketches(sketches, ("expiry",))
    names = {"median_pct": 0.5, "q25_pct": 0.25, "q75_pct": 0.75}
    rate = F.col("mid_rate") * 100
    ranks = []
    for name in names:
        ranks += [F.count_if(rate < F.col(name) - 1e-9).alias(f"_{name}_below"), F.count_if(rate <= F.col(name) + 1e-9).alias(f"_{name}_upto")]
    counted = boxes.join(term, "expiry").groupBy("expiry", "n", "mean_pct", "rank_error").agg(*ranks)
    n, error = F.col("n"), F.col("rank_error")
    within = [
        ((F.col(f"_{c}_below") / n - error <= q) & (F.col(f"_{c}_upto") / n + error >= q)).alias(c.replace("pct", "within"))
        for c, q in names.items()
    ]
    return counted.select("expiry", "n", F.round("mean_pct", 6).alias("mean_pct"), *within)


QUERIES = {
    "curve_spread": curve_spread_query,
    "carry_by_tenor": carry_by_tenor_query,
    "term_structure_sketch": term_structure_sketch,
    "spot_as_of": spot_as_of_query,
    "box_moneyness_as_of": box_moneyness_as_of,
}

_SPOTS = """
spots AS (
  SELECT ticker, ts AS spot_time, arg_max(price, event_id) AS spot_price FROM (
    SELECT CASE user_id % 3 WHEN 0 THEN 'SPX' WHEN 1 THEN 'VIX' ELSE 'DJX' END AS ticker,
           ts, round(value + 4000, 2) AS price, event_id
    FROM events WHERE event_type = 'purchase'
  ) GROUP BY ticker, ts
)"""

_DAILY = (EVENTS_DAILY, MERGED.format(source="q"), STRIKES, NO_SPOT, BOXES.format(spot_keys=BY_TICKER))

# Points {x}, {y} of curves {c} by {key}, as segments; a row at ``pos`` lies in one after clamping.
_SEGMENTS = """
segments AS (
  SELECT *, coalesce(lead(x) OVER w, x) AS next_x, coalesce(lead(y) OVER w, y) AS next_y,
         min(x) OVER (PARTITION BY {key}) AS first_x, max(x) OVER (PARTITION BY {key}) AS last_x
  FROM points WINDOW w AS (PARTITION BY {key} ORDER BY x)
)"""

_LINE = "y + CASE WHEN next_x > x THEN (pos - x) / (next_x - x) ELSE 0 END * (next_y - y)"
_BRACKET = "pos >= x AND (pos < next_x OR x = next_x)"

ORACLES = {
    "curve_spread": _sql(
        *_DAILY,
        """
points AS (
  SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS curve_time,
         0.125E0 * list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS x,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(value) / 1e5 AS y
  FROM events GROUP BY ALL
)""",
        _SEGMENTS.format(key="curve_time"),
        """
dated AS (
  SELECT b.*, c.curve_time FROM b ASOF LEFT JOIN (SELECT DISTINCT curve_time FROM points) c
    ON b.snapshot_time >= c.curve_time
),
clamped AS (
  SELECT d.*, greatest(least(d.tte_years, last_x), first_x) AS pos
  FROM dated d LEFT JOIN (SELECT DISTINCT curve_time, first_x, last_x FROM segments) USING (curve_time)
)""",
        select=f"""
SELECT {CHAIN}, kl, ks, c.curve_time, round({_LINE}, 6) AS curve_rate,
       round(mid_rate - ({_LINE}), 6) AS spread
FROM clamped c LEFT JOIN segments s ON c.curve_time = s.curve_time AND {_BRACKET}""",
    ),
    "carry_by_tenor": _sql(
        *_DAILY,
        """
points AS (
  SELECT ticker AS currency, snapshot_time, round(avg(mid_rate), 9) AS y,
         CAST(date_diff('day', CAST(snapshot_time AS DATE), CAST(expiry AS DATE)) AS DOUBLE) AS x
  FROM b GROUP BY ticker, snapshot_time, expiry
)""",
        _SEGMENTS.format(key="currency, snapshot_time"),
        f"""
grid AS (
  SELECT currency, snapshot_time, tenor, {_LINE} AS rate
  FROM (
    SELECT *, greatest(least(tenor, last_x), first_x) AS pos
    FROM segments, (SELECT CAST(unnest(range(60, 271, 15)) AS DOUBLE) AS tenor)
  ) WHERE {_BRACKET}
)""",
        select="""
SELECT o.snapshot_time, o.currency, o.tenor, round(o.rate, 6) AS rate,
       round(u.rate, 6) AS base_rate, round(o.rate - u.rate, 6) AS carry
FROM grid o JOIN grid u USING (snapshot_time, tenor)
WHERE o.currency <> 'SPX' AND u.currency = 'SPX'""",
    ),
    "term_structure_sketch": _boxes(
        BY_SUPPLIER,
        """
SELECT expiry, count(*) AS n, round(avg(mid_rate) * 100, 6) AS mean_pct,
       true AS median_within, true AS q25_within, true AS q75_within
FROM b GROUP BY expiry""",
    ),
    "spot_as_of": f"""
WITH {_SPOTS}, asked AS (
  SELECT event_id AS seq, ts AS at,
         CASE user_id % 3 WHEN 0 THEN 'SPX' WHEN 1 THEN 'VIX' ELSE 'DJX' END AS ticker
  FROM events
)
SELECT a.seq, a.ticker, a.at, s.spot_price, s.spot_time
FROM asked a ASOF LEFT JOIN spots s ON a.ticker = s.ticker AND a.at >= s.spot_time""",
    "box_moneyness_as_of": _sql(
        EVENTS_DAILY,
        MERGED.format(source="q"),
        STRIKES,
        _SPOTS,
        """
spot AS (
  SELECT c.ticker, c.snapshot_time, s.spot_price
  FROM (SELECT DISTINCT ticker, snapshot_time FROM q) c
  ASOF LEFT JOIN spots s ON c.ticker = s.ticker AND c.snapshot_time >= s.spot_time
)""",
        BOXES.format(spot_keys=BY_TICKER),
        select=f"SELECT {CHAIN}, kl, ks, round(spot_price, 6) AS spot_price, {ROUND_MONEYNESS} FROM b",
    ),
}
