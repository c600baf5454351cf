"""Landed option-chain documents: pages of items, and price documents of underlyings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxrates.functions.payload import computed, found, is_object, nested_sources, search

# Members that may hold the item list of a page, in order of preference.
ITEM_LISTS = ["items", "options", "contracts", "option_contracts", "results"]
# Members that may hold a price, in order of preference.
PRICE_KEYS = ["price", "last", "last_price", "close", "close_price", "ap", "bp"]

_LISTS = ", ".join(f"{name} array<variant>" for name in ITEM_LISTS)
_PAYLOAD = f"snapshots map<string,variant>, {_LISTS}"
_PAGE = f"{_PAYLOAD}, data string"

# Positions of items within a page; a page with more is refused.
PAGE_STRIDE = 1 << 20


def read_chain_pages(
    spark: SparkSession, path: str, *, layout: str = "lines", max_pages: int | None = None
) -> DataFrame:
    """Landed pages as ``ticker, page_no, document``.

    ``layout='lines'``: JSON lines ``{"ticker", "page_no", "document"}``, the form for
    volume; ``'parquet'``: the same columns as a table; ``'files'``: one document per
    file below ``ticker=.../page_no=.../``. ``max_pages`` keeps the first pages of
    each chain, as a paged download would.
    """
    schema = "ticker string, page_no bigint, document string"
    if layout == "lines":
        pages = spark.read.schema(schema).json(path)
    elif layout == "parquet":
        pages = spark.read.schema(schema).parquet(path)
    elif layout == "files":
        files = spark.read.schema("value string, ticker string, page_no bigint")
        pages = files.text(path, wholetext=True).withColumnRenamed("value", "document")
    else:
        raise ValueError(f"unknown layout: {layout}")
    if max_pages is not None:
        pages = pages.filter(F.col("page_no") < max_pages)
    return pages.select("ticker", "page_no", "document")


def _as_entries(values: Column) -> Column:
    """List members as (default_symbol, item) pairs without a symbol."""
    no_symbol = F.lit(None).cast("string").alias("default_symbol")
    return F.transform(values, lambda item: F.struct(no_symbol, item.alias("item")))


def _map_entries(values: Column) -> Column:
    return F.transform(
        F.map_entries(values),
        lambda e: F.struct(e["key"].alias("default_symbol"), e["value"].alias("item")),
    )


def chain_items(pages: DataFrame) -> DataFrame:
    """Items of landed pages: one row per JSON object in the page's item container.

    The container is, in this order: ``snapshots`` (an object keyed by symbol) of the
    page; of its ``data`` member; the first list among ``ITEM_LISTS`` in ``data`` if
    there is such a member, else in the page; or the list that ``data`` or the page
    is. Members that are no objects are dropped. ``default_symbol`` is the key in
    ``snapshots``; ``seq`` orders items by page and position.
    """
    document = F.col("document")
    top, data = F.col("_page"), F.col("_data")
    parsed = pages.withColumn("_page", F.from_json(document, _PAGE))
    # A present but null "data" still hides the lists beside it.
    present = F.array_contains(F.json_object_keys(document), "data")
    parsed = parsed.withColumn(
        "_data", F.coalesce(top["data"], F.when(present, F.lit("null")))
    ).withColumns(
        {
            "_inner": F.from_json(data, _PAYLOAD),
            "_list": F.from_json(F.coalesce(data, document), "array<variant>"),
        }
    )

    inner = F.col("_inner")
    in_data = [_as_entries(inner[name]) for name in ITEM_LISTS]
    in_page = [F.when(data.isNull(), _as_entries(top[name])) for name in ITEM_LISTS]
    entries = F.coalesce(
        _map_entries(top["snapshots"]),
        _map_entries(inner["snapshots"]),
        *in_data,
        *in_page,
        _as_entries(F.col("_list")),
    )
    carried = [c for c in pages.columns if c != "document"]
    items = parsed.select(*carried, F.posexplode(entries).alias("_position", "_entry"))
    too_many = F.raise_error(F.lit(f"a page holds more than {PAGE_STRIDE} items"))
    place = F.when(F.col("_position") < PAGE_STRIDE, F.col("_position")).otherwise(too_many)
    seq = F.col("page_no") * PAGE_STRIDE + place
    return items.select(
        *carried, seq.alias("seq"), F.col("_entry.default_symbol"), F.col("_entry.item")
    ).filter(is_object(F.col("item")))


def underlying_price(documents: DataFrame, *, strict: bool = False) -> DataFrame:
    """Spot per ticker from landed price documents ``ticker, priority, document``.

    The lowest priority number with a usable price wins (latest trade, latest quote,
    stock snapshot, option snapshot). A price is looked up in the ``data`` member;
    unless ``strict``, a document without that member is searched itself. Groups by
    ``snapshot_time`` too when the documents carry it.
    """
    document = F.try_parse_json("document")
    data = F.try_variant_get(document, "$.data", "variant")
    payload = data if strict else F.coalesce(data, document)
    group = [key for key in ("ticker", "snapshot_time") if key in documents.columns]
    searched = search(nested_sources(F.col("_payload"), PRICE_KEYS), {"price": PRICE_KEYS}, {})
    priced = computed(
        documents.withColumn("_payload", payload),
        {"_price": F.when(is_object(F.col("_payload")), found(searched, "price"))},
    )
    usable = priced.filter(F.col("_price").isNotNull())
    return usable.groupBy(*group).agg(F.min_by("_price", "priority").alias("spot_price"))
