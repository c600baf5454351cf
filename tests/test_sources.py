import json
import os
from datetime import UTC, datetime, timedelta

import pytest
from helpers import AT, rows
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from boxrates import RateParams, collect_snapshot
from boxrates.operators import quotes as q
from boxrates.operators.normalise import (
    messages_from_objects,
    quotes_from_chain,
    quotes_from_items,
    quotes_from_messages,
)
from boxrates.plans.collect import run_collection
from boxrates.schema import BOXES, conform
from boxrates.sources import snapshots
from boxrates.sources.chain_pages import chain_items, read_chain_pages, underlying_price

JANUARY = "AAPL260118C00100000"
FEBRUARY = "AAPL260215P00100000"


def _pages(spark, *documents):
    texts = [d if isinstance(d, str) else json.dumps(d) for d in documents]
    return spark.createDataFrame(
        [("AAPL", i, t) for i, t in enumerate(texts)],
        "ticker string, page_no bigint, document string",
    )


def _items(spark, *items):
    return chain_items(_pages(spark, list(items)))


@pytest.mark.parametrize(
    "document, expected",
    [
        ({"snapshots": {"zz": {"a": 1}, "aa": {"b": 2}, "n": 3}}, ["zz", "aa"]),
        ({"snapshots": {}}, []),
        ({"snapshots": {"s": {}}, "data": [{}, {}]}, ["s"]),
        ({"snapshots": [1], "data": {"snapshots": {"d": {}}}}, ["d"]),
        ({"data": [{"a": 1}, 5, None]}, [None]),
        ({"data": {"contracts": [{}, {}]}, "items": [{}]}, [None, None]),
        ({"data": None, "items": [{}]}, []),
        ({"data": {"x": 1}, "items": [{}]}, []),
        ({"items": {"a": 1}, "options": [{}], "results": [{}, {}]}, [None]),
        ({"items": [], "results": [{}]}, []),
        ([{"a": 1}, "x", {"b": 1}], [None, None]),
        ({"other": [{}]}, []),
        ("no json", []),
        (7, []),
    ],
)
def test_envelopes(spark, document, expected):
    found = chain_items(_pages(spark, document)).orderBy("seq")
    assert [r[0] for r in found.select("default_symbol").collect()] == expected


def test_items_are_numbered_by_page_and_position(spark):
    items = chain_items(_pages(spark, [{}, 1, {}], [{}]))
    assert sorted(rows(items, "page_no", "seq")) == [(0, 0), (0, 2), (1, 1 << 20)]


def test_expiries(spark):
    quotes = quotes_from_items(_items(spark, {"symbol": JANUARY}, {"symbol": FEBRUARY}, {"x": 1}))
    expected = [("AAPL", "2026-01-18"), ("AAPL", "2026-02-15")]
    assert sorted(rows(q.expiries_per_ticker(quotes))) == expected
    assert sorted(rows(q.expiries_per_ticker(quotes, 0))) == expected
    assert rows(q.expiries_per_ticker(quotes, 1)) == expected[:1]


def test_quotes_for_expiry_with_a_blank_item(spark):
    quotes = quotes_from_items(
        _items(spark, {"symbol": JANUARY}, {"symbol": FEBRUARY}, {"strike": 5})
    )
    one = spark.createDataFrame([("AAPL", "2026-01-18")], "ticker string, expiry string")
    found = rows(q.quotes_for_expiries(quotes, one), "symbol", "expiry", "strike")
    assert sorted(found, key=str) == [
        (JANUARY, "2026-01-18", 100.0), (None, "2026-01-18", 5.0)
    ]
    both = q.quotes_for_expiries(quotes, q.expiries_per_ticker(quotes))
    assert both.filter("strike = 5").count() == 2
    assert quotes_from_chain(_items(spark, {"strike": 5})).count() == 0


def _normalised(spark, item, *columns):
    return rows(quotes_from_items(_items(spark, item)), *columns)[0]


def test_search_is_source_major(spark):
    item = {"symbol": JANUARY, "bid": "", "bp": None, "trade": {"bid": 1, "ask": 8},
            "latestQuote": {"best_bid": "2.5", "ap": "x"}, "greeks": {"bid": 9}}
    assert _normalised(spark, item, "bid", "ask") == (2.5, 8.0)


def test_types_of_members(spark):
    item = {"symbol": 7, "S": "", "id": FEBRUARY, "volume": 12.9, "oi": -3.7, "bs": "NaN",
            "as": 4.2, "bid": True, "ask": {"x": 1}, "ask_price": 3}
    columns = ["symbol", "volume", "open_interest", "bid_size", "ask_size", "bid", "ask"]
    assert _normalised(spark, item, *columns) == (FEBRUARY, 12, -3, None, 4, 1.0, 3.0)


@pytest.mark.parametrize(
    "item, expected",
    [
        ({"symbol": JANUARY}, ("2026-01-18", 100.0, "call")),
        ({"symbol": JANUARY, "type": "Put", "strike": 0}, ("2026-01-18", 100.0, "put")),
        ({"symbol": JANUARY, "right": "P", "strike": 7, "expiry": "e"}, ("e", 7.0, "put")),
        ({"symbol": "x"}, ("", 0.0, "put")),
        ({"side": "CALLS"}, ("", 0.0, "call")),
        ({"expiration-date": "d", "strike-price": "3"}, ("d", 3.0, "put")),
    ],
)
def test_contract_of_an_item(spark, item, expected):
    assert _normalised(spark, item, "expiry", "strike", "option_type") == expected


def test_container_key_stands_in_for_an_absent_symbol_only(spark):
    pages = _pages(spark, {"snapshots": {JANUARY: {}, "b": {"symbol": None, "id": "i"},
                                         "c": {"symbol": "s"}, "d": {"symbol": ""}}})
    found = rows(quotes_from_items(chain_items(pages)).orderBy("seq"), "symbol")
    assert found == [(JANUARY,), ("i",), ("s",), (None,)]


def _messages(spark, *messages):
    return spark.createDataFrame(
        [(m if isinstance(m, str) else json.dumps(m), i) for i, m in enumerate(messages)],
        "value string, seq bigint",
    )


def test_message(spark):
    message = {"T": "q", "S": "SPX260118C04000000", "bp": 1.0, "ap": 1.2, "p": 1.1, "v": 10}
    quote = quotes_from_messages(_messages(spark, message)).first()
    assert (quote.ticker, quote.option_type, quote.strike) == ("SPX", "call", 4000.0)
    assert (quote.expiry, quote.bid, quote.ask, quote.last) == ("2026-01-18", 1.0, 1.2, 1.1)
    assert (quote.mark, quote.volume, quote.open_interest, quote.bid_size) == (0.0, 10, 0, None)


@pytest.mark.parametrize(
    "message, expected",
    [
        ({"bp": 1}, None),
        ("broken", None),
        ({"S": "plain"}, None),
        ({"S": "plain", "exp": "e", "k": 0, "cp": "C"}, None),
        ({"S": "plain", "exp": "e", "k": "5", "cp": "C"}, ("plain", "e", 5.0, "call")),
        ({"sym": FEBRUARY, "strike": 0, "side": "c"}, ("AAPL", "2026-02-15", 100.0, "call")),
        ({"symbol": FEBRUARY, "expiry": "e"}, ("AAPL", "e", 100.0, "put")),
    ],
)
def test_contract_of_a_message(spark, message, expected):
    found = rows(
        quotes_from_messages(_messages(spark, message)), "ticker", "expiry", "strike", "option_type"
    )
    assert found == ([expected] if expected else [])


def test_messages_from_objects(spark):
    objects = spark.createDataFrame(
        [("SPX260118C04000000", 1.0, 1.2, 3, 4, AT, 1), (None, 1.0, 1.0, 1, 1, AT, 2),
         ("", 1.0, 1.0, 1, 1, AT, 3)],
        "symbol string, bid_price double, ask_price double, bid_size bigint, ask_size bigint,"
        " timestamp timestamp_ntz, seq bigint",
    )
    messages = messages_from_objects(objects)
    assert json.loads(messages.first().value)["t"] == "2026-01-01T00:00:00.000000"
    found = rows(quotes_from_messages(messages), "symbol", "bid", "ask", "bid_size", "ask_size")
    assert found == [("SPX260118C04000000", 1.0, 1.2, 3, 4)]


def test_underlying_price(spark):
    documents = spark.createDataFrame(
        [
            ("A", 1, '{"data":{"price":null}}'), ("A", 2, '{"data":{"latestTrade":{"last":"7"}}}'),
            ("A", 3, '{"data":{"price":9}}'), ("B", 1, '{"price":5}'), ("C", 1, "{}"),
        ],
        "ticker string, priority int, document string",
    )
    assert sorted(rows(underlying_price(documents))) == [("A", 7.0), ("B", 5.0)]
    assert rows(underlying_price(documents, strict=True)) == [("A", 7.0)]


def test_page_layouts(spark, tmp_path):
    pages = _pages(spark, [{"a": 1}], [{"b": 1}])
    pages.write.json(str(tmp_path / "lines"))
    pages.write.parquet(str(tmp_path / "table"))
    for page_no, ticker, _ in [(r.page_no, r.ticker, r) for r in pages.collect()]:
        folder = tmp_path / "files" / f"ticker={ticker}" / f"page_no={page_no}"
        folder.mkdir(parents=True)
        (folder / "page.json").write_text('[\n{"a": 1}\n]')
    for name, layout in (("lines", "lines"), ("table", "parquet"), ("files", "files")):
        read = read_chain_pages(spark, str(tmp_path / name), layout=layout)
        assert chain_items(read).count() == 2
        first = read_chain_pages(spark, str(tmp_path / name), layout=layout, max_pages=1)
        assert rows(first, "page_no") == [(0,)]
    with pytest.raises(ValueError):
        read_chain_pages(spark, str(tmp_path), layout="other")


def _chain_document(shift=0.0):
    def item(kind, strike, bid, ask):
        return {"option_type": kind, "strike": strike, "expiry": "2026-07-02",
                "bid": bid + shift, "ask": ask + shift}

    return {"items": [item("call", 4000, 110.0, 110.4), item("put", 4000, 60.0, 60.4),
                      item("call", 4100, 50.0, 50.4), item("put", 4100, 97.6, 98.0)]}


def test_collect_and_prune(spark, tmp_path):
    pages = _pages(spark, _chain_document())
    params = RateParams(tickers=("AAPL",), max_snapshots_retained=1)
    boxes = collect_snapshot(pages, params, as_of=AT)
    [box] = boxes.collect()
    assert (box.ticker, box.kl, box.ks, box.snapshot_time) == ("AAPL", 4000.0, 4100.0, AT)
    assert box.spot_price == pytest.approx(4050.0, abs=3)
    assert collect_snapshot(pages, RateParams(), as_of=AT).count() == 0
    feed = spark.createDataFrame(
        [("AAPL", 1, '{"price": 4050}')], "ticker string, priority int, document string"
    )
    fed = collect_snapshot(pages, params, as_of=AT, price_documents=feed, stage=False).first()
    assert (fed.spot_price, fed.moneyness_mid) == (4050.0, 1.0)
    with pytest.raises(ValueError):
        collect_snapshot(pages, params)

    path = str(tmp_path / "table")
    for day in range(2):
        run_collection(spark, pages, path, params, as_of=AT + timedelta(days=day))
    assert len(rows(snapshots.scan_snapshots(spark, path), "snapshot_time")) == 2
    run_collection(spark, pages, path, params, as_of=AT + timedelta(days=1), prune=True)
    stored = snapshots.scan_snapshots(spark, path)
    assert sorted(r[0].day for r in rows(stored, "snapshot_time")) == [2]
    # Collected again and empty now: its boxes go.
    run_collection(spark, _pages(spark, "[]"), path, params, as_of=AT + timedelta(days=1))
    assert rows(snapshots.scan_snapshots(spark, path), "snapshot_time") == []


def test_pages_without_a_time_take_that_of_the_collection_or_fail(spark):
    undated = _pages(spark, _chain_document()).withColumn("snapshot_time", F.lit(None).cast("timestamp_ntz"))
    params = RateParams(tickers=("AAPL",))
    assert rows(collect_snapshot(undated, params, as_of=AT), "snapshot_time") == [(AT,)]
    with pytest.raises(Exception, match="a page has no snapshot_time"):
        collect_snapshot(undated, params).collect()


def _boxes(spark, *times):
    df = spark.createDataFrame(
        [("SPX", t, 4000.0 + i) for i, t in enumerate(times)],
        "ticker string, snapshot_time timestamp_ntz, kl double",
    )
    return conform(df, BOXES)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_snapshot_table(spark, tmp_path, fmt):
    path = str(tmp_path / "t")
    assert snapshots.scan_snapshots(spark, path, fmt, missing_ok=True).count() == 0
    times = [AT + timedelta(minutes=m, seconds=30) for m in range(6)]
    snapshots.write_snapshot(_boxes(spark, *times), path, fmt)
    snapshots.write_snapshot(_boxes(spark, times[2], times[2]), path, fmt)
    stored = snapshots.scan_snapshots(spark, path, fmt)
    assert stored.schema.names == BOXES.names
    assert stored.count() == 7
    assert stored.filter(F.col("snapshot_time") == times[2]).count() == 2

    def seen(as_of, minutes):
        recent = snapshots.recent_snapshots(stored, as_of=as_of, minutes=minutes)
        return sorted({r[0] for r in rows(recent, "snapshot_time")})

    assert seen(times[5], 1) == times[4:]
    assert seen(AT + timedelta(days=1), 30) == times[5:]
    kept = snapshots.retained_snapshots(stored, 4)
    assert {r[0] for r in rows(kept, "snapshot_time")} == set(times[2:])
    assert rows(snapshots.table_status(stored)) == [(6, times[5])]
    assert rows(snapshots.collector_status(stored)) == [(1, times[5])]
    assert snapshots.prune_snapshots(spark, path, 10) == 0
    assert snapshots.prune_snapshots(spark, path, 4) == 2
    left = snapshots.scan_snapshots(spark, path, fmt)
    assert {r[0] for r in rows(left, "snapshot_time")} == set(times[2:])


def test_history_reads_wanted_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.write_snapshot(_boxes(spark, AT, AT + timedelta(hours=1)), path)
    stored = snapshots.scan_snapshots(spark, path)
    recent = snapshots.recent_snapshots(stored, as_of=AT + timedelta(hours=1))
    recent.collect()
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan.split("Subquery")[0]


def _foreign(spark, folder, name, ticker, age, now, fmt="parquet"):
    import pyarrow as pa
    import pyarrow.csv as pc
    import pyarrow.parquet as pq

    table = pa.table(
        {
            "ticker": [ticker],
            "expiry": ["2026-01-01"],
            "snapshot_time": [(now - age).isoformat()],
            "mid_rate": [0.02],
            "bid_rate": [0.019],
            "borrow_rate": [float("nan")],
            "kl": [4000.0],
            "min_leg_volume": [100],
        }
    )
    path = folder / f"snapshot_{name}.{fmt}"
    pq.write_table(table, path) if fmt == "parquet" else pc.write_csv(table, path)
    os.utime(path, ((now - age).timestamp(),) * 2)


def test_foreign_files(spark, tmp_path):
    now = datetime.now(UTC)
    status = snapshots.snapshot_file_status
    assert rows(status(spark, str(tmp_path / "absent"))) == [(0, None)]
    absent = str(tmp_path / "absent")
    assert snapshots.read_snapshot_files(spark, absent, as_of=now, missing_ok=True).count() == 0
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        snapshots.read_snapshot_files(spark, absent, as_of=now)
    folder = tmp_path / "s"
    folder.mkdir()
    assert rows(status(spark, str(folder))) == [(0, None)]
    _foreign(spark, folder, "csv_only", "CSV", timedelta(hours=5), now, "csv")

    def tickers():
        read = snapshots.read_snapshot_files(spark, str(folder), as_of=now, minutes=30)
        assert read.schema.names == BOXES.names
        return sorted(rows(read, "ticker", "lend_rate", "borrow_rate", "mid_rate"))

    assert tickers() == [("CSV", None, None, 0.02)]
    _foreign(spark, folder, "old", "NDX", timedelta(hours=2), now)
    assert tickers() == [("NDX", None, None, 0.02)]
    _foreign(spark, folder, "new", "SPX", timedelta(0), now)
    assert tickers() == [("SPX", None, None, 0.02)]
    [(count, latest)] = rows(status(spark, str(folder)))
    assert count == 2 and abs(latest.timestamp() - now.timestamp()) < 2


def test_universe_and_tracked(spark):
    quotes = quotes_from_items(
        _items(spark, {"symbol": FEBRUARY}, {"symbol": JANUARY}, {"symbol": JANUARY}, {"k": 1})
    )
    assert rows(q.universe_symbols(quotes)) == [(JANUARY,), (FEBRUARY,)]
    tracked = spark.createDataFrame([("AAPL", "2026-01-18")], "ticker string, expiry string")
    assert q.tracked_only(quotes, tracked).count() == 2


def test_snapshot_times_do_not_depend_on_the_session_zone(spark, tmp_path):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        pages = _pages(spark, _chain_document())
        boxes = collect_snapshot(pages, RateParams(tickers=("AAPL",)), as_of=AT)
        path = str(tmp_path / "t")
        snapshots.write_snapshot(boxes, path)
        stored = snapshots.scan_snapshots(spark, path)
        assert rows(stored, "snapshot_time") == [(AT,)]
        recent = snapshots.recent_snapshots(stored, as_of=AT + timedelta(minutes=1), minutes=2)
        assert rows(recent, "snapshot_time") == [(AT,)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_collection_without_parameters_takes_all_chains(spark):
    def item(expiry, kind, strike, bid):
        return {"option_type": kind, "strike": strike, "expiry": expiry, "bid": bid, "ask": bid + 0.4}

    expiries = ["2026-07-02", "2026-08-06", "2026-09-03"]
    legs = [("call", 4000, 110.0), ("put", 4000, 60.0), ("call", 4100, 50.0), ("put", 4100, 97.6)]
    document = json.dumps([item(e, *leg) for e in expiries for leg in legs])
    pages = spark.createDataFrame([(t, 0, document) for t in ("SPX", "NDX")], "ticker string, page_no bigint, document string")
    found = rows(collect_snapshot(pages, as_of=AT), "ticker", "expiry")
    assert sorted(found) == [(t, e) for t in ("NDX", "SPX") for e in expiries]
