"""Operators on the quote table: prices, merging, universe, spot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxrates.functions.pricing import parity_mid, quote_mid
from boxrates.schema import CHAIN, CONTRACT

PRICE_FIELDS = ["bid", "ask", "last", "mark"]
COUNT_FIELDS = ["volume", "open_interest"]
SIZE_FIELDS = ["bid_size", "ask_size"]


def with_mid(quotes: DataFrame) -> DataFrame:
    """Add ``mid`` and lower-case the option type."""
    return quotes.withColumns(
        {
            "option_type": F.lower("option_type"),
            "mid": quote_mid(F.col("bid"), F.col("ask"), F.col("mark"), F.col("last")),
        }
    )


def _last_where(field: str, condition: str) -> Column:
    return F.expr(f"max_by({field}, CASE WHEN {condition} THEN seq END)")


def last_nonzero(field: str, data_type: str, where: str = "true") -> Column:
    """Aggregate: latest value of ``field`` that is not 0, or 0 if there is none."""
    latest = f"max_by({field}, CASE WHEN {field} <> 0 AND {where} THEN seq END)"
    return F.expr(f"CAST(coalesce({latest}, 0) AS {data_type})")


def merge_updates(updates: DataFrame, keys: Sequence[str] = tuple(CONTRACT)) -> DataFrame:
    """Fold the updates of each contract, in ``seq`` order, into its current quote.

    A price or count of 0 means "no news" and leaves the earlier value; sizes are
    kept while missing. ``n_updates`` counts the folded rows. All of it is built-in
    aggregation, so it combines before the shuffle - a contract with a third of all
    updates costs one row per task - and runs unchanged on a stream.

    The last symbol is text, which no hash aggregation can hold as a value. A table is
    therefore folded by contract and symbol first, where it is part of the key, and only the
    rows that leaves, one for each symbol of a contract, are sorted.
    """
    timed = "snapshot_time" not in keys
    if not updates.isStreaming:
        updates = _folded(updates, [*keys, "symbol"], timed)
        last = {f: F.max_by(f, f"_{f}") for f in [*PRICE_FIELDS, *COUNT_FIELDS, *SIZE_FIELDS]}
        kinds = {**dict.fromkeys(PRICE_FIELDS, "double"), **dict.fromkeys(COUNT_FIELDS, "bigint")}
        aggregates = {
            **{f: F.coalesce(last[f], F.lit(0)).cast(kind) for f, kind in kinds.items()},
            **{f: last[f] for f in SIZE_FIELDS},
            "symbol": _last_where("symbol", "symbol <> ''"),
            "n_updates": F.sum("n_updates"),
            "seq": F.max("seq"),
        }
        if timed:
            aggregates["last_update"] = F.max("last_update")
    else:
        aggregates = {
            **{f: last_nonzero(f, "double") for f in PRICE_FIELDS},
            **{f: last_nonzero(f, "bigint") for f in COUNT_FIELDS},
            **{f: _last_where(f, f"{f} IS NOT NULL") for f in SIZE_FIELDS},
            "symbol": _last_where("symbol", "symbol <> ''"),
            "n_updates": F.count(F.lit(1)),
            "seq": F.max("seq"),
        }
        if timed:
            aggregates["last_update"] = F.max("snapshot_time")
    return updates.groupBy(*keys).agg(*[agg.alias(name) for name, agg in aggregates.items()])


def _folded(updates: DataFrame, keys: list[str], timed: bool) -> DataFrame:
    """Each field's last value and, under its name with ``_`` in front, the ``seq`` that set it."""
    aggregates = []
    for field in [*PRICE_FIELDS, *COUNT_FIELDS, *SIZE_FIELDS]:
        news = f"{field} IS NOT NULL" if field in SIZE_FIELDS else f"{field} <> 0"
        aggregates.append(_last_where(field, news).alias(field))
        aggregates.append(F.expr(f"max(CASE WHEN {news} THEN seq END)").alias(f"_{field}"))
    aggregates += [F.count(F.lit(1)).alias("n_updates"), F.max("seq").alias("seq")]
    if timed:
        aggregates.append(F.max("snapshot_time").alias("last_update"))
    return updates.groupBy(*keys).agg(*aggregates)


def tracked_only(quotes: DataFrame, tracked: DataFrame) -> DataFrame:
    """Quotes of the tracked (ticker, expiry) pairs."""
    return quotes.join(tracked.select("ticker", "expiry"), ["ticker", "expiry"], "left_semi")


def expiries_per_ticker(
    quotes: DataFrame, max_expiries: int | None = None, by: Sequence[str] = ("ticker",)
) -> DataFrame:
    """Earliest ``max_expiries`` distinct expiries of each ticker; all if None or 0."""
    expiries = quotes.filter(F.col("expiry") != "").select(*by, "expiry").distinct()
    if not max_expiries:
        return expiries
    # The window runs over listed expiries, a handful per ticker, not over quotes.
    order = Window.partitionBy(*by).orderBy("expiry")
    ranked = expiries.withColumn("_rank", F.row_number().over(order))
    return ranked.filter(F.col("_rank") <= max_expiries).drop("_rank")


def quotes_for_expiries(quotes: DataFrame, expiries: DataFrame) -> DataFrame:
    """Quotes of the wanted (ticker, expiry) pairs, per snapshot if ``expiries`` tells them.

    A quote without expiry takes part in every wanted expiry of its ticker.
    """
    keys = [key for key in ("ticker", "snapshot_time") if key in expiries.columns]
    wanted = expiries.select(*keys, "expiry").distinct()
    dated = quotes.filter(F.col("expiry") != "").join(wanted, [*keys, "expiry"], "left_semi")
    blank = quotes.filter(F.col("expiry") == "").drop("expiry").join(wanted, keys)
    return dated.unionByName(blank)


def universe_symbols(quotes: DataFrame) -> DataFrame:
    """Distinct option symbols to subscribe to, in order."""
    named = quotes.filter(F.coalesce(F.col("symbol"), F.lit("")) != "")
    return named.select("symbol").distinct().orderBy("symbol")


def parity_spot(quotes: DataFrame, scope: str = "chain") -> DataFrame:
    """Spot implied by put-call parity, ``strike + call - put``, where call and put differ least.

    ``scope='chain'`` pools all expiries of a ticker by strike alone, the last quote
    of a side winning; ``scope='expiry'`` keeps expiries apart. Ties go to the strike
    seen first. A group whose best strike gives no positive spot has no row.
    """
    if scope not in ("chain", "expiry"):
        raise ValueError(f"unknown scope: {scope}")
    group = ["ticker", "snapshot_time"] + (["expiry"] if scope == "expiry" else [])
    mid = parity_mid(F.col("bid"), F.col("ask"), F.col("mark"), F.col("last"))
    priced = quotes.withColumn("_mid", mid).filter(F.col("_mid").isNotNull())

    def latest(side: str) -> Column:
        return F.max_by("_mid", F.when(F.col("option_type") == side, F.col("seq")))

    strikes = priced.groupBy(*group, "strike").agg(
        latest("call").alias("_call"), latest("put").alias("_put"), F.min("seq").alias("_first")
    )
    gap = F.abs(F.col("_call") - F.col("_put"))
    forward = F.col("strike") + F.col("_call") - F.col("_put")
    best = (
        strikes.filter(F.col("_call").isNotNull() & F.col("_put").isNotNull())
        .groupBy(*group)
        .agg(F.min_by(forward, F.struct(gap, F.col("_first"))).alias("spot_price"))
    )
    return best.filter(F.col("spot_price") > 0)


def with_spot(
    rows: DataFrame, feed: DataFrame | None = None, parity: DataFrame | None = None
) -> DataFrame:
    """Attach ``spot_price``: the feed's price, else the parity price, else NULL.

    Each side holds one row per (ticker, and whichever of snapshot_time and expiry it
    carries). No broadcast is forced, as both grow with the number of snapshots;
    Spark broadcasts them when their measured size allows.
    """
    found = []
    for number, spot in enumerate(s for s in (feed, parity) if s is not None):
        keys = [key for key in CHAIN if key in spot.columns]
        name = f"_spot{number}"
        rows = rows.join(spot.select(*keys, F.col("spot_price").alias(name)), keys, "left")
        found.append(name)
    price = F.coalesce(*found) if found else F.lit(None)
    return rows.withColumn("spot_price", price.cast("double")).drop(*found)
