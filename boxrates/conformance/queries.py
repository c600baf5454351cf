"""Queries over the test tables, one per operator; see ``oracles`` for their SQL.

Prices are compared bit for bit; rates involve ``pow`` and averages and are rounded to
six decimals on both sides.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxrates.functions.opra import parse_opra, underlying
from boxrates.functions.pricing import expiry_time
from boxrates.operators import boxes as box
from boxrates.operators import filters, quotes, strikes, views, wide
from boxrates.operators.normalise import (
    messages_from_objects,
    quotes_from_chain,
    quotes_from_items,
    quotes_from_messages,
)
from boxrates.operators.pairs import strike_pairs
from boxrates.params import RateParams
from boxrates.plans.collect import collect_snapshot, staged
from boxrates.schema import CHAIN
from boxrates.session import work_dir
from boxrates.sources import snapshots
from boxrates.sources.chain_pages import chain_items, read_chain_pages, underlying_price
from boxrates.conformance.derived import (
    EVENT_SNAPSHOT,
    TICKERS,
    quotes_by_day,
    quotes_by_supplier,
    quotes_from_events,
)
from boxrates.streaming import event_time, live, status

Query = Callable[[SparkSession, str], DataFrame]

PARAMS = RateParams(
    tickers=tuple(TICKERS),
    expiries_per_ticker=3,
    min_strike_gap=5.0,
    max_strike_gap=400.0,
    max_abs_rate=1.0,
    max_snapshots_retained=6,
)
MIN_VOLUME = 20
VIEW_EXPIRY = "2024-07-19"
AS_OF = datetime(2000, 11, 15)
HISTORY_MINUTES = 60 * 24 * 365

# Items of a landed page, and pages of a stream of items.
PAGE_EVENTS = 200

HALF_CENTS = 200
# Pages from this number on hold what a page of objects cannot.
LIST_PAGES = 4_000_000

CONTRACT_IN_CHAIN = [*CHAIN, "strike", "option_type"]


# --- inputs -------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes_from_events(_events(spark, sf_dir))


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = quotes.merge_updates(_updates(spark, sf_dir), CONTRACT_IN_CHAIN)
    return quotes.with_mid(merged)


def _event_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the merged event quotes with parity spot per chain of a ticker."""
    updates = _updates(spark, sf_dir)
    current = quotes.merge_updates(updates, CONTRACT_IN_CHAIN)
    parity = quotes.parity_spot(current, "chain")
    return box.build_boxes_from_updates(updates, PARAMS, parity=parity)


def _day_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box.build_boxes_from_updates(quotes_by_day(_lineitem(spark, sf_dir)), PARAMS)


def _supplier_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box.build_boxes_from_updates(quotes_by_supplier(_lineitem(spark, sf_dir)), PARAMS)


def _rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({name: F.round(name, places) for name in names})


RATES = ("mid_rate", "lend_rate", "borrow_rate")
MONEYNESS = ("moneyness_kl", "moneyness_ks", "moneyness_mid")


# --- quotes -------------------------------------------------------------------


def quote_mid(spark, sf_dir):
    mids = quotes.with_mid(_updates(spark, sf_dir))
    return mids.select("seq", "ticker", "expiry", "strike", "option_type", "bid", "ask", "mid")


def quote_merge_latest(spark, sf_dir):
    merged = quotes.merge_updates(_updates(spark, sf_dir))
    return merged.select(
        "ticker",
        "expiry",
        "strike",
        "option_type",
        *quotes.PRICE_FIELDS,
        *quotes.COUNT_FIELDS,
        "symbol",
        "n_updates",
    )


def expiries_per_ticker(spark, sf_dir):
    return quotes.expiries_per_ticker(_updates(spark, sf_dir), 2)


def parity_spot_chain(spark, sf_dir):
    return quotes.parity_spot(_updates(spark, sf_dir), "chain")


def parity_spot_expiry(spark, sf_dir):
    return quotes.parity_spot(_updates(spark, sf_dir), "expiry")


def parity_spot_daily(spark, sf_dir):
    return quotes.parity_spot(quotes_from_events(_events(spark, sf_dir), daily=True), "chain")


def _tracked(updates: DataFrame) -> DataFrame:
    return quotes.expiries_per_ticker(updates, 2).filter(F.col("ticker") != "VIX")


def tracked_quotes(spark, sf_dir):
    updates = _updates(spark, sf_dir)
    tracked = quotes.tracked_only(updates, _tracked(updates))
    return tracked.select("seq", "ticker", "expiry", "strike", "option_type", "bid", "ask")


def universe_symbols(spark, sf_dir):
    return quotes.universe_symbols(_updates(spark, sf_dir))


# --- strikes and boxes ----------------------------------------------------------


def call_put_pivot(spark, sf_dir):
    return strikes.pivot_calls_puts(_current(spark, sf_dir))


def call_put_pivot_fused(spark, sf_dir):
    return strikes.latest_strikes(_updates(spark, sf_dir))


def liquid_strikes(spark, sf_dir):
    pivoted = strikes.pivot_unique(_current(spark, sf_dir))
    liquid = strikes.liquid_strikes(pivoted, MIN_VOLUME, MIN_VOLUME)
    return liquid.select(
        *CHAIN,
        "strike",
        "call_volume",
        "put_volume",
        "call_open_interest",
        "put_open_interest",
    )


def synthetic_forwards(spark, sf_dir):
    forwards = strikes.synthetic_forwards(strikes.latest_strikes(_updates(spark, sf_dir)))
    return forwards.select(*CHAIN, "strike", "sfl", "sfs", "sf_mid")


def strike_pairs_in_gap(spark, sf_dir):
    chain = strikes.latest_strikes(_updates(spark, sf_dir)).select(*CHAIN, "strike")
    pairs = strike_pairs(chain, CHAIN, min_gap=5.0, max_gap=400.0)
    kl, ks = F.col("strike_kl"), F.col("strike_ks")
    return pairs.select(
        *CHAIN,
        kl.alias("kl"),
        ks.alias("ks"),
        (ks - kl).alias("width"),
        ((kl + ks) / 2.0).alias("mid_strike"),
    )


def strike_pairs_unbounded(spark, sf_dir):
    chain = strikes.latest_strikes(quotes_by_supplier(_lineitem(spark, sf_dir)))
    pairs = strike_pairs(chain.select(*CHAIN, "strike"), CHAIN)
    return pairs.select(
        *CHAIN, F.col("strike_kl").alias("kl"), F.col("strike_ks").alias("ks")
    )


def box_rates(spark, sf_dir):
    boxes = _event_boxes(spark, sf_dir)
    shown = boxes.select(
        *CHAIN,
        "kl",
        "ks",
        F.round("tte_years", 9).alias("tte_years"),
        "payoff",
        F.round("mid_cost", 6).alias("mid_cost"),
        F.round("lend_cost", 6).alias("lend_cost"),
        F.round("borrow_proceeds", 6).alias("borrow_proceeds"),
        *RATES,
    )
    return _rounded(shown, *RATES)


def box_moneyness(spark, sf_dir):
    boxes = _event_boxes(spark, sf_dir).select(*CHAIN, "kl", "ks", "spot_price", *MONEYNESS)
    return _rounded(boxes, "spot_price", *MONEYNESS)


def box_moneyness_feed(spark, sf_dir):
    """The feed knows one ticker only; parity of each expiry serves the others."""
    updates = _updates(spark, sf_dir)
    feed = _events(spark, sf_dir).agg(F.round(F.max("value"), 2).alias("spot_price"))
    feed = feed.withColumn("ticker", F.lit("SPX"))
    parity = quotes.parity_spot(updates, "expiry")
    boxes = box.build_boxes_from_updates(updates, PARAMS, feed=feed, parity=parity)
    shown = boxes.select(*CHAIN, "kl", "ks", "spot_price", "moneyness_mid")
    return _rounded(shown, "spot_price", "moneyness_mid")


def box_leg_volumes(spark, sf_dir):
    legs = [
        f"{side}_{strike}_{count}"
        for count in ("volume", "open_interest")
        for side in ("call", "put")
        for strike in ("kl", "ks")
    ]
    return _event_boxes(spark, sf_dir).select(
        *CHAIN, "kl", "ks", *legs, "min_leg_volume", "total_leg_volume"
    )


def _full(boxes: DataFrame) -> DataFrame:
    prices = ("mid_cost", "lend_cost", "borrow_proceeds", "spot_price")
    return _rounded(_rounded(boxes, *prices, *RATES, *MONEYNESS), "tte_years", places=9)


def boxes_full(spark, sf_dir):
    return _full(_event_boxes(spark, sf_dir))


def boxes_from_current(spark, sf_dir):
    """The same boxes by the general path: merge, mid, call-put join, pairs."""
    current = quotes.merge_updates(_updates(spark, sf_dir), CONTRACT_IN_CHAIN)
    return _full(box.build_boxes(current, PARAMS, parity=quotes.parity_spot(current)))


def _scale(boxes: DataFrame) -> DataFrame:
    return _rounded(boxes.select(*CHAIN, "kl", "ks", *RATES, "min_leg_volume"), *RATES)


def boxes_scale(spark, sf_dir):
    return _scale(_day_boxes(spark, sf_dir))


def boxes_by_supplier(spark, sf_dir):
    return _scale(_supplier_boxes(spark, sf_dir))


def boxes_daily(spark, sf_dir):
    updates = quotes_from_events(_events(spark, sf_dir), daily=True)
    return _scale(box.build_boxes_from_updates(updates, PARAMS))


def legacy_box(spark, sf_dir):
    """Wide rows: all pairs of a chain's strikes with the mids of their four legs.

    Everything is counted in half cents, so that costs are whole numbers and a box that
    costs nothing costs exactly nothing.
    """
    chain = strikes.latest_strikes(_updates(spark, sf_dir))
    legs = chain.select(*CHAIN, "strike", *[F.round(F.col(f"{s}_mid") * HALF_CENTS).alias(f"{s}_mid") for s in ("call", "put")])
    pairs = strike_pairs(legs, CHAIN, max_gap=400.0).select(
        "ticker",
        "expiry",
        (F.col("strike_kl") * HALF_CENTS).alias("kl"),
        (F.col("strike_ks") * HALF_CENTS).alias("ks"),
        F.col("call_mid_kl").alias("call_kl"),
        F.col("call_mid_ks").alias("call_ks"),
        F.col("put_mid_kl").alias("put_kl"),
        F.col("put_mid_ks").alias("put_ks"),
    )
    boxes = wide.box_records(wide.box_from_legs(pairs, tte=0.5))
    rate = F.col("implied_rate")
    # Of a box that costs next to nothing, fewer decimals are significant.
    shown = F.when(F.abs(rate) < 1000, F.round(rate, 6)).otherwise(F.round(rate, 1))
    return boxes.withColumn("implied_rate", shown)


# --- views --------------------------------------------------------------------


def view_filtered(spark, sf_dir):
    view = filters.view_filter(
        _event_boxes(spark, sf_dir),
        ticker="SPX",
        min_volume=10,
        width_range=(25.0, 250.0),
        moneyness_band=5.0,
    )
    return _rounded(view.select(*CHAIN, "kl", "ks", "width", "min_leg_volume", "mid_rate"), "mid_rate")


def rate_curve(spark, sf_dir):
    return _rounded(views.rate_curve(_event_boxes(spark, sf_dir), VIEW_EXPIRY), "rate_pct")


def _term(df: DataFrame) -> DataFrame:
    return _rounded(df, "median_pct", "mean_pct", "q25_pct", "q75_pct")


def term_structure(spark, sf_dir):
    return _term(views.term_structure(_event_boxes(spark, sf_dir)))


def term_structure_pooled(spark, sf_dir):
    return _term(views.term_structure(_event_boxes(spark, sf_dir), by=("expiry",)))


def term_structure_scale(spark, sf_dir):
    return _term(views.term_structure(_stored(spark, sf_dir)))


def rate_heatmap(spark, sf_dir):
    return _rounded(views.rate_heatmap(_event_boxes(spark, sf_dir), VIEW_EXPIRY), "rate_pct")


def rate_heatmap_scale(spark, sf_dir):
    return _rounded(views.heatmap_cells(_day_boxes(spark, sf_dir)), "rate")


def heatmap_sample(spark, sf_dir):
    cells = views.heatmap_cells(_day_boxes(spark, sf_dir))
    return _rounded(views.heatmap_sample(cells, 200), "rate")


def lend_borrow(spark, sf_dir):
    view = views.lend_borrow(_event_boxes(spark, sf_dir), VIEW_EXPIRY)
    return _rounded(view, "lend_pct", "borrow_pct", "gap_pct")


def _top(boxes: DataFrame, n: int) -> DataFrame:
    # Rates are rounded before ranking so that both engines break the same ties.
    return views.top_opportunities(_rounded(boxes, *RATES), n)


def top_opportunities(spark, sf_dir):
    return _top(_event_boxes(spark, sf_dir), 10)


def top_opportunities_scale(spark, sf_dir):
    return _top(_stored(spark, sf_dir), 100)


def view_expiries(spark, sf_dir):
    return views.view_expiries(_event_boxes(spark, sf_dir))


# --- parsing ------------------------------------------------------------------


def _symbols(spark, sf_dir) -> DataFrame:
    """Symbols of the event quotes, some spaced, lower-cased or damaged."""
    symbol = F.col("symbol")
    kind = F.col("seq") % 7
    damaged = (
        F.when(kind == 0, F.lower(symbol))
        .when(kind == 1, F.concat(F.col("ticker"), F.lit("   "), F.substring(symbol, 4, 30)))
        .when(kind == 2, F.concat(F.col("ticker"), F.lit("240230C04000000")))
        .when(kind == 3, F.concat(F.lit("x"), F.col("seq").cast("string")))
        .otherwise(symbol)
    )
    return _updates(spark, sf_dir).select("seq", damaged.alias("symbol"))


def opra_parse(spark, sf_dir):
    parsed = _symbols(spark, sf_dir).withColumn("_p", parse_opra(F.col("symbol")))
    return parsed.select("seq", "symbol", "_p.*")


def underlying_of(spark, sf_dir):
    return _symbols(spark, sf_dir).withColumn("underlying", underlying(F.col("symbol")))


def expiry_timestamp(spark, sf_dir):
    """Expiries written as date, compact date, local time and time with an offset."""
    expiry = F.col("expiry")
    kind = F.col("seq") % 5
    written = (
        F.when(kind == 0, F.replace(expiry, F.lit("-"), F.lit("")))
        .when(kind == 1, F.concat(expiry, F.lit("T16:00:00")))
        .when(kind == 2, F.concat(expiry, F.lit("T16:00:00-05:00")))
        .when(kind == 3, F.concat(F.lit("2024-13-"), F.substring(expiry, 9, 2)))
        .otherwise(expiry)
    )
    rows = _updates(spark, sf_dir).select("seq", written.alias("written"))
    return rows.withColumn("expiry_at", expiry_time(F.col("written")))


def _page_items(spark, sf_dir) -> DataFrame:
    """Event quotes as raw chain items, in four notations.

    One in 29 is a blank: an item that tells neither symbol nor expiry. On pages that are
    objects a symbol can occur once and a blank not at all, so repeats and blanks of
    theirs lie on pages of their own, which are lists.
    """
    page = F.floor(F.col("seq") / PAGE_EVENTS)
    rows = _updates(spark, sf_dir).withColumns({"page_no": page, "blank": F.col("seq") % 29 == 0})
    again = Window.partitionBy("ticker", "page_no", "symbol", "blank").orderBy(F.col("seq").desc())
    rows = rows.withColumn("_n", F.row_number().over(again))
    other = (F.col("page_no") % 4 < 2) & (F.col("blank") | (F.col("_n") > 1))
    list_page = F.lit(LIST_PAGES) + F.col("page_no") * 4 + 3
    rows = rows.withColumn("page_no", F.when(other, list_page).otherwise(F.col("page_no")))

    def text(column: Column) -> Column:
        return column.cast("string")

    c = F.col
    flat = F.to_json(
        F.struct(
            "symbol",
            c("expiry").alias("expiration_date"),
            "strike",
            "option_type",
            *quotes.PRICE_FIELDS,
            *quotes.COUNT_FIELDS,
        )
    )
    nested = F.to_json(
        F.struct(
            "symbol",
            F.lit("").alias("bid"),
            F.struct(c("bid").alias("bp"), c("ask").alias("ap"), c("seq").alias("bs")).alias(
                "latestQuote"
            ),
            F.struct(c("last").alias("p"), F.lit("n/a").alias("v")).alias("latestTrade"),
            F.struct(c("volume").alias("v"), F.lit(-1).alias("p")).alias("dailyBar"),
            c("mark").alias("midpoint"),
            c("open_interest").alias("oi"),
        )
    )
    texts = F.to_json(
        F.struct(
            c("symbol").alias("option_symbol"),
            c("expiry").alias("exp_date"),
            text(c("strike")).alias("strike_price"),
            F.when(c("option_type") == "call", "C").otherwise("P").alias("right"),
            text(c("bid")).alias("best_bid"),
            text(c("ask")).alias("ask_price"),
            text(c("last")).alias("trade_price"),
            text(c("mark")).alias("mid"),
            text(c("volume")).alias("dv"),
            text(c("open_interest")).alias("openInterest"),
            text(c("seq")).alias("askSize"),
        )
    )
    by_symbol = F.to_json(
        F.struct(
            c("symbol").alias("id"),
            F.lit(5).alias("expiry"),
            F.struct(
                c("bid").alias("bid_price"),
                c("ask").alias("best_ask"),
                c("last").alias("last_price"),
                c("mark").alias("mark"),
                c("volume").alias("trade_volume"),
                c("open_interest").alias("open_interest"),
            ).alias("snapshot"),
        )
    )
    blank = F.to_json(
        F.struct(
            "strike",
            F.concat(F.upper("option_type"), F.lit("S")).alias("type"),
            *quotes.PRICE_FIELDS,
            *quotes.COUNT_FIELDS,
        )
    )
    kind = c("seq") % 4
    item = (
        F.when(c("blank"), blank)
        .when(kind == 0, flat)
        .when(kind == 1, nested)
        .when(kind == 2, texts)
        .otherwise(by_symbol)
    )
    return rows.withColumn("item", item)


def _pages(spark, sf_dir) -> DataFrame:
    """Landed documents of at most ``PAGE_EVENTS`` items, in four kinds of envelope."""
    items = _page_items(spark, sf_dir)
    pages = items.groupBy("ticker", "page_no", "snapshot_time").agg(
        F.sort_array(F.collect_list(F.struct("seq", "symbol", "item"))).alias("_items")
    )
    named = F.transform(
        "_items", lambda i: F.concat(F.lit('"'), i["symbol"], F.lit('":'), i["item"])
    )
    as_map = F.concat(F.lit("{"), F.array_join(named, ","), F.lit(',"note":7}'))
    plain = F.transform("_items", lambda i: i["item"])
    as_list = F.concat(F.lit("["), F.array_join(plain, ","), F.lit(",7,null]"))
    kind = F.col("page_no") % 4
    document = (
        F.when(kind == 0, F.concat(F.lit('{"snapshots":'), as_map, F.lit(',"items":[{"id":1}]}')))
        .when(kind == 1, F.concat(F.lit('{"data":{"snapshots":'), as_map, F.lit("}}")))
        .when(kind == 2, F.concat(F.lit('{"items":7,"results":'), as_list, F.lit("}")))
        .otherwise(as_list)
    )
    return pages.select("ticker", "page_no", "snapshot_time", document.alias("document"))


def chain_items_of_pages(spark, sf_dir):
    items = chain_items(_pages(spark, sf_dir))
    return items.select("ticker", "page_no", "seq", "default_symbol")


def chain_quotes(spark, sf_dir):
    return quotes_from_chain(chain_items(_pages(spark, sf_dir))).drop("snapshot_time")


def quotes_for_expiry(spark, sf_dir):
    chain = quotes_from_items(chain_items(_pages(spark, sf_dir)))
    wanted = quotes.expiries_per_ticker(chain, 2)
    chosen = quotes.quotes_for_expiries(chain, wanted)
    return chosen.select("ticker", "expiry", "strike", "option_type", "bid", "ask", "symbol", "seq")


def underlying_price_docs(spark, sf_dir):
    """Price documents per ticker and day, most of them without a usable price."""
    rows = _events(spark, sf_dir).select(
        F.element_at(
            F.array(*[F.lit(t) for t in TICKERS]), (F.col("user_id") % 3 + 1).cast("int")
        ).alias("ticker"),
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("snapshot_time"),
        F.col("event_id").alias("priority"),
        "value",
    )
    kind = F.col("priority") % 6
    price = F.col("value").cast("string")
    document = (
        F.when(kind == 0, F.lit('{"data":{"price":null,"last":""}}'))
        .when(kind == 1, F.concat(F.lit('{"data":{"trade":{"close":"'), price, F.lit('"}}}')))
        .when(kind == 2, F.concat(F.lit('{"ap":'), price, F.lit(',"bp":1.5}')))
        .when(kind == 3, F.lit('{"data":[1,2]}'))
        .when(kind == 4, F.lit("no json"))
        .otherwise(F.concat(F.lit('{"data":{"price":"n/a","latestQuote":{"bp":'), price, F.lit("}}}")))
    )
    return underlying_price(rows.withColumn("document", document))


def collected_snapshot(spark, sf_dir):
    """One snapshot a day, all of them collected together."""
    updates = quotes_from_events(_events(spark, sf_dir), daily=True)
    return _scale(collect_snapshot(_unique_pages(updates), PARAMS))


def _unique_pages(updates: DataFrame) -> DataFrame:
    """As ``_pages``, of merged quotes: each contract on one page of its snapshot only."""
    merged = quotes.merge_updates(updates, CONTRACT_IN_CHAIN)
    item = F.to_json(
        F.struct(
            F.struct(F.col("bid").alias("bp"), F.col("ask").alias("ap")).alias("latestQuote"),
            "mark",
            "last",
            *quotes.COUNT_FIELDS,
        )
    )
    page = F.floor(F.col("seq") / PAGE_EVENTS)
    pages = (
        merged.withColumns({"page_no": page, "item": item})
        .groupBy("ticker", "page_no", "snapshot_time")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "symbol", "item"))).alias("_items"))
    )
    named = F.transform(
        "_items", lambda i: F.concat(F.lit('"'), i["symbol"], F.lit('":'), i["item"])
    )
    document = F.concat(F.lit('{"snapshots":{'), F.array_join(named, ","), F.lit("}}"))
    return pages.select("ticker", "page_no", "snapshot_time", document.alias("document"))


def collect_scheduled(spark, sf_dir):
    """Pages without a time, landed in three files that are collected one after the other."""
    pages = _unique_pages(_updates(spark, sf_dir)).drop("snapshot_time")
    landed, path = work_dir(spark, "landed"), work_dir(spark, "collected")
    pages.repartitionByRange(3, "page_no").write.json(landed)
    query = live.collect_on_schedule(
        spark, landed, path, PARAMS, as_of=datetime.fromisoformat(EVENT_SNAPSHOT), max_files=1,
        trigger={"availableNow": True},
    )
    query.awaitTermination()
    return _scale(snapshots.scan_snapshots(spark, path, missing_ok=True))


# --- snapshots ----------------------------------------------------------------


def _stored_path(spark, sf_dir) -> str:
    path = work_dir(spark, "snapshots")
    snapshots.write_snapshot(_supplier_boxes(spark, sf_dir), path)
    return path


def _stored(spark, sf_dir) -> DataFrame:
    return snapshots.scan_snapshots(spark, _stored_path(spark, sf_dir), missing_ok=True)


def snapshot_roundtrip(spark, sf_dir):
    return _full(_stored(spark, sf_dir))


def snapshot_history(spark, sf_dir):
    path = _stored_path(spark, sf_dir)
    recent = snapshots.recent_history(spark, path, as_of=AS_OF, minutes=HISTORY_MINUTES)
    return recent.select(*CHAIN, "kl", "ks")


def snapshot_retained(spark, sf_dir):
    path = _stored_path(spark, sf_dir)
    kept = snapshots.retained_history(spark, path, PARAMS.max_snapshots_retained)
    return kept.select(*CHAIN, "kl", "ks")


def snapshot_status(spark, sf_dir):
    return snapshots.history_status(spark, _stored_path(spark, sf_dir))


def collector_status(spark, sf_dir):
    return snapshots.collector_progress(spark, _stored_path(spark, sf_dir))


FOREIGN_FILES = 5


def _foreign_path(spark, sf_dir, fmt: str) -> str:
    """Boxes as another program would write them: no moneyness, NaN for what is missing, time as text."""
    boxes = _supplier_boxes(spark, sf_dir).drop(*MONEYNESS, "snapshot_date")
    nan = F.lit(float("nan"))
    missing = {c: F.coalesce(c, nan) for c in ("lend_rate", "borrow_rate", "spot_price")}
    foreign = boxes.withColumns({**missing, "snapshot_time": F.date_format("snapshot_time", "yyyy-MM-dd'T'HH:mm:ss")})
    path = work_dir(spark, "foreign")
    files = foreign.select(*reversed(foreign.columns)).repartition(FOREIGN_FILES, "ticker")
    files.write.option("header", True).option("nanValue", "NaN").format(fmt).save(path)
    return path


def _foreign(spark, sf_dir, fmt: str) -> DataFrame:
    path = _foreign_path(spark, sf_dir, fmt)
    now = datetime.now(UTC) + timedelta(days=1)
    return _full(snapshots.read_snapshot_files(spark, path, as_of=now, minutes=60 * 48, name="part-*"))


def snapshot_files_parquet(spark, sf_dir):
    return _foreign(spark, sf_dir, "parquet")


def snapshot_files_csv(spark, sf_dir):
    return _foreign(spark, sf_dir, "csv")


def snapshot_file_status(spark, sf_dir):
    path = _foreign_path(spark, sf_dir, "parquet")
    status = snapshots.snapshot_file_status(spark, path, name="part-*")
    return status.select("file_count", F.col("latest_mtime").isNotNull().alias("dated"))


# --- streams ------------------------------------------------------------------


def _message(updates: DataFrame) -> DataFrame:
    """Event quotes as stream messages, in three notations."""
    c = F.col
    wire = F.to_json(
        F.struct(
            F.lit("q").alias("T"),
            c("symbol").alias("S"),
            c("bid").alias("bp"),
            c("ask").alias("ap"),
            c("last").alias("p"),
            c("mark").alias("mid"),
            c("volume").alias("v"),
            c("open_interest").alias("oi"),
            c("seq").alias("bs"),
        )
    )
    named = F.to_json(
        F.struct(
            "symbol",
            "expiry",
            c("strike").cast("string").alias("strike_price"),
            F.upper("option_type").alias("cp"),
            *quotes.PRICE_FIELDS,
            *quotes.COUNT_FIELDS,
            c("seq").alias("ask_size"),
        )
    )
    nameless = F.to_json(F.struct("bid", "ask"))
    kind = c("seq") % 11
    value = F.when(kind == 0, nameless).when(kind % 2 == 0, named).otherwise(wire)
    return updates.select(value.alias("value"), "seq", F.col("snapshot_time").alias("ts"))


def stream_quotes(spark, sf_dir):
    parsed = quotes_from_messages(_message(_updates(spark, sf_dir)))
    return parsed.drop("snapshot_time")


STREAM_BATCHES = 4
# Events of a landed file; a micro-batch takes as many files as its share of them fills.
LANDED_EVENTS = 50_000
LANDED_PAGES = 40


def _files_per_batch(events: DataFrame) -> int:
    """So many that the files of a batch, and with them its tasks, grow in number and not in size."""
    return max(1, math.ceil(events.count() / (STREAM_BATCHES * LANDED_EVENTS)))


def _landed(spark, schema, path: str, per_batch: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def _live_quotes(spark, sf_dir) -> DataFrame:
    """The events table as a stream of several micro-batches: messages parsed as they arrive."""
    events = _events(spark, sf_dir)
    landed, per_batch = work_dir(spark, "events"), _files_per_batch(events)
    events.repartitionByRange(STREAM_BATCHES * per_batch, "event_id").write.parquet(landed)
    return quotes_from_messages(_message(quotes_from_events(_landed(spark, events.schema, landed, per_batch))))


def _merged_stream(spark, live_quotes: DataFrame) -> DataFrame:
    checkpoint = work_dir(spark, "merge")
    live.stream_merge(live_quotes, checkpoint).awaitTermination()
    return live.current_quotes(spark, checkpoint).select(
        "ticker",
        "expiry",
        "strike",
        "option_type",
        *quotes.PRICE_FIELDS,
        *quotes.COUNT_FIELDS,
        *quotes.SIZE_FIELDS,
        "n_updates",
    )


def stream_merge(spark, sf_dir):
    return _merged_stream(spark, _live_quotes(spark, sf_dir))


def stream_seeded(spark, sf_dir):
    """Quotes of the viewed events are the chain that the stream starts from."""
    seed = work_dir(spark, "seed")
    live.seed_quotes(quotes_from_events(_events(spark, sf_dir).filter("event_type = 'view'")), seed)
    return _merged_stream(spark, live.with_seed(_live_quotes(spark, sf_dir), seed))


def _run_stream(spark, sf_dir) -> str:
    path = work_dir(spark, "live")
    tracked = staged(_tracked(_updates(spark, sf_dir)), "tracked")
    query = live.stream_boxes(
        _live_quotes(spark, sf_dir),
        path,
        PARAMS,
        tracked=tracked,
        as_of=datetime.fromisoformat(EVENT_SNAPSHOT),
        availableNow=True,
    )
    query.awaitTermination()
    return path


def stream_boxes(spark, sf_dir):
    boxes = live.latest_boxes(spark, _run_stream(spark, sf_dir))
    shown = boxes.select(*CHAIN, "kl", "ks", "spot_price", *RATES, "total_leg_volume")
    return _rounded(shown, "spot_price", *RATES)


def _bootstrap_pages(spark, sf_dir) -> DataFrame:
    """The chain pages of a start at which VIX can't be read and DJX is empty."""
    ticker = F.col("ticker")
    document = F.when(ticker == "VIX", "no json").when(ticker == "DJX", '{"snapshots":{}}').otherwise(F.col("document"))
    return _unique_pages(_updates(spark, sf_dir)).withColumn("document", document)


def stream_status(spark, sf_dir):
    log = work_dir(spark, "status")
    listener = status.StatusLog(spark, log)
    spark.streams.addListener(listener)
    try:
        path = _run_stream(spark, sf_dir)
        for _ in range(120):  # the listener writes after the query has ended
            if listener.ended:
                break
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(listener)
    bootstrap = status.bootstrap_states(_bootstrap_pages(spark, sf_dir), PARAMS.tickers)
    current = live.current_quotes(spark, f"{path}/checkpoint")
    states = status.stream_states(spark, log)
    return live.stream_status(current, PARAMS, states=states, bootstrap=bootstrap).drop("last_progress")


def stream_merge_by_time(spark, sf_dir):
    """Every message twice and out of order, merged by the day that it bears."""
    events = _events(spark, sf_dir)
    twice = events.unionByName(events)
    landed, per_batch = work_dir(spark, "events"), _files_per_batch(twice)
    # Files beyond one for each batch are dealt by the whole id: 64 values don't fill many.
    dealt = [F.col("event_id") * 7 % 64, *(["event_id"] if per_batch > 1 else [])]
    twice.repartition(STREAM_BATCHES * per_batch, *dealt).write.parquet(landed)
    reader = _landed(spark, events.schema, landed, per_batch)
    messages = quotes_from_messages(_message(quotes_from_events(reader, daily=True)))
    path, provider = work_dir(spark, "by-time"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    event_time.use_rocksdb(spark)
    try:
        event_time.stream_merge_by_time(messages, path, delay=timedelta(days=400)).awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return event_time.latest_by_time(spark, path).drop("ended", "symbol")


# --- landed objects -----------------------------------------------------------------


def landed_pages(spark, sf_dir):
    """Pages as one file each, of which the first ``LANDED_PAGES`` of a ticker are taken."""
    path = work_dir(spark, "pages")
    _unique_pages(_updates(spark, sf_dir)).drop("snapshot_time").write.partitionBy("ticker", "page_no").text(path)
    pages = read_chain_pages(spark, path, layout="files", max_pages=LANDED_PAGES)
    return chain_items(pages).select("ticker", "page_no", "seq", "default_symbol")


def object_messages(spark, sf_dir):
    """Typed quote objects through the message format and back."""
    updates = _updates(spark, sf_dir)
    objects = updates.select(
        F.when(F.col("seq") % 13 > 0, F.col("symbol")).alias("symbol"),
        F.col("bid").alias("bid_price"),
        F.col("ask").alias("ask_price"),
        F.col("volume").alias("bid_size"),
        F.col("open_interest").alias("ask_size"),
        F.col("snapshot_time").alias("timestamp"),
        "seq",
    )
    parsed = quotes_from_messages(messages_from_objects(objects))
    return parsed.select("ticker", "expiry", "strike", "option_type", "bid", "ask", "bid_size", "ask_size", "seq")


def heatmap_wide(spark, sf_dir):
    """The matrix of lower and upper strikes, unpivoted again for comparison."""
    heatmap = views.rate_heatmap(_event_boxes(spark, sf_dir), VIEW_EXPIRY)
    wide_form = views.heatmap_matrix(heatmap, lows=[float(k) for k in range(4000, 5001, 25)])
    lows = [f"k{float(c):.0f}" for c in wide_form.columns if c != "ks"]
    long = wide_form.toDF("ks", *lows).unpivot("ks", lows, "kl", "rate_pct").filter("rate_pct IS NOT NULL")
    return _rounded(long.withColumn("kl", F.substring("kl", 2, 20).cast("double")), "rate_pct")


def percent_texts(spark, sf_dir):
    """Rates as text, compared as the number that the text shows."""
    top = views.top_opportunities(_rounded(_event_boxes(spark, sf_dir), *RATES, places=4), 50, as_text=True)
    number = F.regexp_extract("lend_rate", r"^(-?\d+\.?\d*)%$", 1).try_cast("double")
    return top.filter("side = 'lend'").select("rank", F.round(number, 2).alias("lend_pct"))


def view_of_few_columns(spark, sf_dir):
    """Filters and the top table over boxes that lack the columns some of them need."""
    few = _event_boxes(spark, sf_dir).select(*CHAIN, "kl", "ks", "lend_rate", "borrow_rate")
    view = filters.view_filter(few, ticker="SPX", min_volume=10, width_range=(25.0, 250.0), moneyness_band=5.0)
    return views.top_opportunities(_rounded(view, "lend_rate", "borrow_rate"), 20)


QUERIES: dict[str, Query] = {
    "quote_mid": quote_mid,
    "quote_merge_latest": quote_merge_latest,
    "call_put_pivot": call_put_pivot,
    "call_put_pivot_fused": call_put_pivot_fused,
    "liquid_strikes": liquid_strikes,
    "synthetic_forwards": synthetic_forwards,
    "strike_pairs": strike_pairs_in_gap,
    "strike_pairs_unbounded": strike_pairs_unbounded,
    "box_rates": box_rates,
    "box_moneyness": box_moneyness,
    "box_moneyness_feed": box_moneyness_feed,
    "box_leg_volumes": box_leg_volumes,
    "boxes_full": boxes_full,
    "boxes_from_current": boxes_from_current,
    "boxes_scale": boxes_scale,
    "boxes_by_supplier": boxes_by_supplier,
    "boxes_daily": boxes_daily,
    "legacy_box": legacy_box,
    "chain_items": chain_items_of_pages,
    "chain_quotes": chain_quotes,
    "quotes_for_expiry": quotes_for_expiry,
    "snapshot_roundtrip": snapshot_roundtrip,
    "snapshot_history": snapshot_history,
    "snapshot_retained": snapshot_retained,
    "snapshot_status": snapshot_status,
    "collector_status": collector_status,
    "snapshot_files_parquet": snapshot_files_parquet,
    "snapshot_files_csv": snapshot_files_csv,
    "snapshot_file_status": snapshot_file_status,
    "stream_merge": stream_merge,
    "stream_seeded": stream_seeded,
    "stream_merge_by_time": stream_merge_by_time,
    "landed_pages": landed_pages,
    "object_messages": object_messages,
    "heatmap_wide": heatmap_wide,
    "percent_texts": percent_texts,
    "view_of_few_columns": view_of_few_columns,
    "stream_boxes": stream_boxes,
    "stream_status": stream_status,
    "collect_snapshot": collected_snapshot,
    "collect_scheduled": collect_scheduled,
    "rate_curve": rate_curve,
    "term_structure": term_structure,
    "term_structure_pooled": term_structure_pooled,
    "term_structure_scale": term_structure_scale,
    "rate_heatmap": rate_heatmap,
    "rate_heatmap_scale": rate_heatmap_scale,
    "heatmap_sample": heatmap_sample,
    "lend_borrow": lend_borrow,
    "top_opportunities": top_opportunities,
    "top_opportunities_scale": top_opportunities_scale,
    "view_filtered": view_filtered,
    "expiries_per_ticker": expiries_per_ticker,
    "view_expiries": view_expiries,
    "parity_spot_chain": parity_spot_chain,
    "parity_spot_expiry": parity_spot_expiry,
    "parity_spot_daily": parity_spot_daily,
    "tracked_quotes": tracked_quotes,
    "universe_symbols": universe_symbols,
    "opra_parse": opra_parse,
    "underlying": underlying_of,
    "stream_quotes": stream_quotes,
    "underlying_price": underlying_price_docs,
    "expiry_timestamp": expiry_timestamp,
}
