"""Raw chain items and stream messages to typed quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxrates.functions.opra import parse_opra
from boxrates.functions.payload import (
    computed,
    flat_source,
    found,
    names_of,
    nested_sources,
    search,
    whole,
)
from boxrates.schema import QUOTES, conform, with_order_of

# Field names accepted in chain items, in order of preference.
ITEM_SYMBOL = ["symbol", "S", "option_symbol", "contract_symbol", "id"]
ITEM_EXPIRY = ["expiration_date", "expiration-date", "expiry", "exp_date", "expiration"]
ITEM_TYPE = ["option_type", "type", "right", "put_call", "call_put", "side"]
ITEM_STRIKE = ["strike", "strike_price", "strike-price"]
ITEM_PRICES = {
    "bid": ["bid", "bid_price", "bp", "best_bid"],
    "ask": ["ask", "ask_price", "ap", "best_ask"],
    "last": ["last", "last_price", "trade_price", "p"],
    "mark": ["mark", "mid", "midpoint"],
}
ITEM_COUNTS = {
    "volume": ["volume", "trade_volume", "v", "dv"],
    "open_interest": ["open_interest", "openInterest", "oi"],
}
ITEM_SIZES = {
    "bid_size": ["bid_size", "bidSize", "bs"],
    "ask_size": ["ask_size", "askSize", "as"],
}

# Field names accepted in stream messages; they differ from the above.
MESSAGE_SYMBOL = ["symbol", "S", "sym"]
MESSAGE_EXPIRY = ["expiration_date", "expiry", "exp", "exp_date"]
MESSAGE_TYPE = ["option_type", "right", "side", "cp", "put_call"]
MESSAGE_STRIKE = ["strike", "strike_price", "k"]
MESSAGE_PRICES = {
    "bid": ["bp", "bid", "bid_price"],
    "ask": ["ap", "ask", "ask_price"],
    "last": ["p", "last", "last_price"],
    "mark": ["mid", "mark"],
}
MESSAGE_COUNTS = {"volume": ["v", "volume"], "open_interest": ["oi", "open_interest"]}
MESSAGE_SIZES = {"bid_size": ["bs", "bid_size"], "ask_size": ["as", "ask_size"]}

ITEM_NAMES = names_of(ITEM_SYMBOL, ITEM_EXPIRY, ITEM_TYPE, ITEM_STRIKE, ITEM_PRICES, ITEM_COUNTS, ITEM_SIZES)
MESSAGE_NAMES = names_of(
    MESSAGE_SYMBOL, MESSAGE_EXPIRY, MESSAGE_TYPE, MESSAGE_STRIKE, MESSAGE_PRICES, MESSAGE_COUNTS, MESSAGE_SIZES
)


def _typed_fields(searched, prices, counts, sizes):
    return {
        **{name: F.coalesce(found(searched, name), F.lit(0.0)) for name in prices},
        **{
            name: F.coalesce(whole(found(searched, name)), F.lit(0).cast("bigint"))
            for name in counts
        },
        **{name: whole(found(searched, name)) for name in sizes},
    }


def _call_or_put(text):
    side = F.when(F.lower(text).startswith("c"), "call").otherwise("put")
    return F.when(text.isNotNull(), side)


def quotes_from_items(items: DataFrame) -> DataFrame:
    """One quote per chain item; ``expiry`` is '' where the item tells none.

    Input: ``ticker``, ``item`` (VARIANT), ``default_symbol``, ``seq`` and optionally
    ``snapshot_time``. The ticker is the queried one, not the root of the symbol.
    """
    # The container's own key stands in for "symbol" only when the item has no such member.
    inherited = F.when(
        F.get("_sources", 0)["symbol"].isNull(),
        F.nullif("default_symbol", F.lit("")),
    )
    searched = F.col("_searched")
    read = computed(
        items.withColumn("_sources", nested_sources(F.col("item"), ITEM_NAMES)).withColumn(
            "_searched",
            search(
                F.col("_sources"),
                {"_strike": ITEM_STRIKE, **ITEM_PRICES, **ITEM_COUNTS, **ITEM_SIZES},
                {"symbol": ITEM_SYMBOL, "_expiry": ITEM_EXPIRY, "_type": ITEM_TYPE},
            ),
        ),
        {
            "symbol": F.coalesce(inherited, found(searched, "symbol")),
            "_expiry": found(searched, "_expiry"),
            "_type": found(searched, "_type"),
            "_strike": F.nullif(found(searched, "_strike"), F.lit(0.0)),
            **_typed_fields(searched, ITEM_PRICES, ITEM_COUNTS, ITEM_SIZES),
        },
    )
    opra = F.col("_opra")
    quotes = computed(read, {"_opra": parse_opra(F.col("symbol"))}).withColumns(
        {
            "expiry": F.coalesce("_expiry", opra["expiry"], F.lit("")),
            "strike": F.coalesce("_strike", opra["strike"], F.lit(0.0)),
            "option_type": F.coalesce(
                _call_or_put(F.col("_type")), opra["option_type"], F.lit("put")
            ),
        }
    )
    return conform(quotes, QUOTES)


def quotes_from_chain(items: DataFrame) -> DataFrame:
    """Quotes of all items that tell an expiry."""
    return quotes_from_items(items).filter(F.col("expiry") != "")


def messages_from_objects(objects: DataFrame) -> DataFrame:
    """Typed quote objects to stream messages; objects without a symbol are dropped.

    Input: ``symbol, bid_price, ask_price, bid_size, ask_size, timestamp, seq``.
    """
    message = F.to_json(
        F.struct(
            F.col("symbol").alias("S"),
            F.col("bid_price").alias("bp"),
            F.col("ask_price").alias("ap"),
            F.col("bid_size").alias("bs"),
            F.col("ask_size").alias("as"),
            F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("t"),
        )
    )
    return objects.filter(F.coalesce(F.col("symbol"), F.lit("")) != "").select(
        message.alias("value"), "seq"
    )


def quotes_from_messages(messages: DataFrame) -> DataFrame:
    """One quote per stream message (JSON text in ``value``, arrival order in ``seq``).

    The time of arrival, if the messages carry one in ``ts``, becomes ``snapshot_time``.

    The symbol supplies whatever of expiry, strike and type the message lacks; a
    message that still lacks one of them is dropped.
    """
    if "ts" in messages.columns:
        messages = messages.withColumnRenamed("ts", "snapshot_time")
    searched = F.col("_searched")
    read = computed(
        messages.withColumn(
            "_searched",
            search(
                flat_source(F.try_parse_json("value"), MESSAGE_NAMES),
                {"_strike": MESSAGE_STRIKE, **MESSAGE_PRICES, **MESSAGE_COUNTS, **MESSAGE_SIZES},
                {"symbol": MESSAGE_SYMBOL, "_expiry": MESSAGE_EXPIRY, "_type": MESSAGE_TYPE},
            ),
        ),
        {
            "symbol": found(searched, "symbol"),
            "_expiry": found(searched, "_expiry"),
            "_strike": F.nullif(found(searched, "_strike"), F.lit(0.0)),
            "_type": found(searched, "_type"),
            **_typed_fields(searched, MESSAGE_PRICES, MESSAGE_COUNTS, MESSAGE_SIZES),
        },
    )
    opra = F.col("_opra")
    named = read.filter(F.col("symbol").isNotNull())
    quotes = computed(named, {"_opra": parse_opra(F.col("symbol"))}).withColumns(
        {
            "ticker": F.coalesce(opra["root"], "symbol"),
            "expiry": F.coalesce("_expiry", opra["expiry"]),
            "strike": F.coalesce("_strike", F.nullif(opra["strike"], F.lit(0.0))),
            "option_type": _call_or_put(F.coalesce("_type", opra["option_type"])),
        }
    )
    complete = quotes.dropna(subset=["expiry", "strike", "option_type"])
    return conform(complete, with_order_of(QUOTES, messages))
