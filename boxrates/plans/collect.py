"""One collection: landed chain pages to stored boxes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxrates.operators.asof import spot_as_of
from boxrates.operators.boxes import build_boxes
from boxrates.operators.normalise import quotes_from_items
from boxrates.operators.quotes import expiries_per_ticker, parity_spot, quotes_for_expiries
from boxrates.params import ALL, RateParams
from boxrates.schema import utc
from boxrates.session import staged
from boxrates.sources.chain_pages import chain_items, underlying_price
from boxrates.sources.snapshots import (
    clear_snapshots,
    prune_snapshots,
    snapshot_listing,
    write_snapshot,
)


def collect_snapshot(
    pages: DataFrame,
    params: RateParams = ALL,
    *,
    as_of: datetime | None = None,
    price_documents: DataFrame | None = None,
    spots: DataFrame | None = None,
    parity_scope: str | None = "chain",
    stage: bool = True,
) -> DataFrame:
    """Boxes of the collected chains.

    ``pages`` holds ``ticker, page_no, document`` and, when it spans many snapshots,
    ``snapshot_time``; pages without one are of time ``as_of`` (UTC, naive), and an error
    where that is not given. Of each
    chain the earliest ``params.expiries_per_ticker`` expiries are used; without ``params``,
    all expiries of all tickers. The spot
    comes from ``price_documents``, or else is the last price at the snapshot's time of the
    history ``spots`` (as ``spot_as_of`` takes it); where neither knows the ticker, it comes
    from put-call parity over the whole chain (``parity_scope=None`` turns that off).

    The documents are parsed once: ``stage`` writes the quotes to the work folder,
    because expiries, parity and boxes each read them.
    """
    if "snapshot_time" not in pages.columns:
        if as_of is None:
            raise ValueError("as_of is needed for pages without snapshot_time")
        pages = pages.withColumn("snapshot_time", utc(as_of))
    else:
        # A page without a time would vanish in the joins below.
        otherwise = utc(as_of) if as_of else F.raise_error(F.lit("a page has no snapshot_time")).cast("timestamp_ntz")
        pages = pages.withColumn("snapshot_time", F.coalesce("snapshot_time", otherwise))
    if params.tickers:
        pages = pages.filter(F.col("ticker").isin(*params.tickers))

    quotes = quotes_from_items(chain_items(pages))
    if stage:
        quotes = staged(quotes, "quotes")
    chains = expiries_per_ticker(
        quotes, params.expiries_per_ticker, by=("ticker", "snapshot_time")
    )
    feed = None
    if price_documents is not None:
        feed = underlying_price(price_documents)
    elif spots is not None:
        feed = spot_as_of(quotes, spots)
    parity = None
    if parity_scope is not None:
        parity = parity_spot(quotes.filter(F.col("expiry") != ""), parity_scope)
    return build_boxes(quotes_for_expiries(quotes, chains), params, feed=feed, parity=parity)


def run_collection(
    spark: SparkSession,
    pages: DataFrame,
    path: str,
    params: RateParams = ALL,
    *,
    fmt: str = "parquet",
    prune: bool = False,
    as_of: datetime | None = None,
    **options,
) -> None:
    """Collect and store below ``path``; ``prune`` deletes all but the configured number of snapshots.

    Stored snapshots of which ``pages`` are collected anew and come out without boxes are
    deleted too.
    """
    boxes = staged(collect_snapshot(pages, params, as_of=as_of, **options), "collected")
    write_snapshot(boxes, path, fmt)
    time = F.col("snapshot_time") if "snapshot_time" in pages.columns else F.lit(None).cast("timestamp_ntz")
    if as_of is not None:
        time = F.coalesce(time, utc(as_of))
    collected = pages.select(time.alias("snapshot_time")).distinct()
    stored = snapshot_listing(spark, path, fmt, missing_ok=True).select("snapshot_time")
    emptied = stored.join(collected, "snapshot_time", "left_semi").join(
        boxes.select("snapshot_time").distinct(), "snapshot_time", "left_anti"
    )
    clear_snapshots(spark, path, {row[0] for row in emptied.collect()})
    if prune:
        prune_snapshots(spark, path, params.max_snapshots_retained)
