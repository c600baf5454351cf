import json
import os
from datetime import timedelta

import pytest
from helpers import AT, quote, quotes, rows
from pyspark.errors import StreamingQueryException

from boxrates import RateParams, build_boxes, latest_boxes, stream_boxes
from boxrates.operators.normalise import quotes_from_messages
from boxrates.operators.quotes import merge_updates, parity_spot
from boxrates.schema import CONTRACT
from boxrates.sources import snapshots
from boxrates.streaming import live

PARAMS = RateParams(min_strike_gap=5.0, max_strike_gap=400.0, max_abs_rate=1.0)
COMPARED = ["bid", "ask", "mark", "volume", "n_updates", "seq"]


def _symbol(expiry, kind, strike):
    return f"SPX{expiry}{kind}{strike * 1000:08d}"


def _message(seq, expiry, kind, strike, bid, ask, volume=1):
    value = {"S": _symbol(expiry, kind, strike), "bp": bid, "ap": ask, "v": volume}
    return {"value": json.dumps(value), "seq": seq, "ts": "2026-01-01T10:00:00"}


# Three micro-batches; the second touches only July, the third changes nothing priced.
BATCHES = [
    [_message(i, e, k, s, b, a) for i, (e, k, s, b, a) in enumerate([
        ("260702", "C", 4000, 110.0, 110.4), ("260702", "P", 4000, 60.0, 60.4),
        ("260702", "C", 4100, 50.0, 50.4), ("260702", "P", 4100, 97.6, 98.0),
        ("261001", "C", 4000, 120.0, 120.4), ("261001", "P", 4000, 60.0, 60.4),
        ("261001", "C", 4100, 60.0, 60.4), ("261001", "P", 4100, 97.0, 97.4)])],
    [_message(10, "260702", "P", 4100, 97.4, 0.0, 7), _message(11, "260702", "C", 4100, 0.0, 50.6)],
    [_message(12, "260702", "C", 4100, 0.0, 0.0, 0)],
]


def _land(folder, batches):
    folder.mkdir(exist_ok=True)
    for number, batch in enumerate(batches):
        text = "\n".join(json.dumps(message) for message in batch)
        landed = len(list(folder.iterdir()))
        file = folder / f"{number}-{landed}.json"
        file.write_text(text)
        os.utime(file, (1_767_000_000 + landed,) * 2)  # files are taken by their time
    return str(folder)


def _stream(spark, folder):
    messages = live.read_messages(spark, folder, maxFilesPerTrigger="1")
    return quotes_from_messages(messages)


def _batch_state(spark, batches):
    flat = [m for batch in batches for m in batch]
    messages = spark.createDataFrame(
        [(m["value"], m["seq"]) for m in flat], "value string, seq bigint"
    )
    return merge_updates(quotes_from_messages(messages))


def _state(spark, batches):
    state = _batch_state(spark, batches)
    return sorted(rows(state, *CONTRACT, *COMPARED, "symbol", "bid_size"))


def test_current_quotes_equal_the_batch_merge_after_every_batch(spark, tmp_path):
    batches = [*BATCHES, [_message(15, "261001", "C", 4000, 121.0, 0.0)]]
    folder = _land(tmp_path / "in", batches)
    checkpoint = str(tmp_path / "checkpoint")
    live.stream_merge(_stream(spark, folder), checkpoint).awaitTermination()
    for n in range(4):
        found = live.current_quotes(spark, checkpoint, n)
        assert sorted(rows(found, *CONTRACT, *COMPARED, "symbol", "bid_size")) == _state(spark, batches[: n + 1])
    status = live.stream_status(live.current_quotes(spark, checkpoint), PARAMS).first()
    assert (status.version, status.contracts, status.symbols) == (12, 8, 8)
    assert (status.tickers_done, status.tickers_total) == (1, 1)
    assert status.last_update.hour == 10


def _expected(spark, batches, scope, params=PARAMS, feed=None):
    at = _batch_state(spark, batches).selectExpr("*", f"timestamp_ntz'{AT}' AS snapshot_time")
    parity = parity_spot(at, scope) if scope else None
    return sorted(rows(build_boxes(at, params, parity=parity, feed=feed)), key=str)


@pytest.mark.parametrize("scope, base_every", [("chain", 1), ("expiry", 2)])
def test_stream_boxes_equal_batch_boxes(spark, tmp_path, scope, base_every):
    folder = _land(tmp_path / "in", BATCHES)
    out = str(tmp_path / "out")

    def run():
        stream_boxes(
            _stream(spark, folder), out, PARAMS, parity_scope=scope, as_of=AT,
            base_every=base_every, availableNow=True,
        ).awaitTermination()

    run()
    assert sorted(rows(latest_boxes(spark, out)), key=str) == _expected(spark, BATCHES, scope)
    assert len(_expected(spark, BATCHES, scope)) == 2
    # A restart goes on where the run ended.
    more = [[_message(20, "261001", "C", 4100, 61.0, 61.4)]]
    _land(tmp_path / "in", more)
    run()
    assert sorted(rows(latest_boxes(spark, out)), key=str) == _expected(spark, BATCHES + more, scope)


def _ladder(seq, strikes, shift=0.0):
    """Quotes of one expiry in strict parity, 25 apart."""
    messages = []
    for i, strike in enumerate(strikes):
        call = 2000.0 + shift - (strike - 4000) * 0.49
        messages += [
            _message(seq + 2 * i, "260702", "C", strike, call, call + 0.4),
            _message(seq + 2 * i + 1, "260702", "P", strike, 1500.0 + (strike - 4000) * 0.5, 1500.4 + (strike - 4000) * 0.5),
        ]
    return messages


def test_work_of_a_batch_follows_the_changed_strikes(spark, tmp_path):
    strikes = [4000 + 25 * i for i in range(20)]
    params = RateParams(max_strike_gap=1e9, max_abs_rate=1e9, min_volume=1)
    batches = [
        _ladder(0, strikes),
        _ladder(100, strikes[3:4], shift=0.1),
        [_message(200, "260702", "C", 4200, 0.0, 0.0, volume=3)],
        _ladder(300, [strikes[0], strikes[-1]], shift=-0.1),
        [_message(400 + i, "260702", "C", 4100, 0.0, 0.0, volume=-1) for i in range(1)],  # no longer liquid
    ]
    folder = _land(tmp_path / "in", batches)
    out = str(tmp_path / "out")
    stream_boxes(_stream(spark, folder), out, params, as_of=AT, availableNow=True).awaitTermination()
    for n in (1, 3, 4):
        expected = _expected(spark, batches[: n + 1], "chain", params)
        assert sorted(rows(latest_boxes(spark, out, n)), key=str) == expected
    sizes = [spark.read.parquet(f"{out}/pairs/batch_id={n}").count() for n in range(len(batches))]
    assert sizes == [190, 19, 19, 37, 0]
    assert len(expected) == 171


def test_older_folders_go_once_a_base_has_replaced_them(spark, tmp_path):
    batches = [_ladder(10 * n, [4000, 4025 + 25 * n]) for n in range(5)]
    folder = _land(tmp_path / "in", batches)
    out = str(tmp_path / "out")
    params = RateParams(max_abs_rate=1e9)
    stream_boxes(_stream(spark, folder), out, params, as_of=AT, base_every=2, availableNow=True).awaitTermination()
    assert sorted(rows(latest_boxes(spark, out)), key=str) == _expected(spark, batches, "chain", params)
    for kind in ("pairs", "strikes", "parity", "stamps"):
        assert {p.name for p in (tmp_path / "out" / kind).iterdir()} == {f"batch_id={n}" for n in (2, 3, 4)}
    assert {p.name for p in (tmp_path / "out" / "base").iterdir()} == {"batch_id=1", "batch_id=3"}


def test_spot_follows_the_market_between_batches(spark, tmp_path):
    folder = _land(tmp_path / "in", BATCHES[:2])
    out, landed = str(tmp_path / "out"), str(tmp_path / "spots")
    schema = "ticker string, spot_time timestamp_ntz, spot_price double, seq bigint"
    prices = [(AT, 4000.0), (AT + timedelta(minutes=1), 4100.0)]

    def read():
        # The feeder lands the second price after the first batch.
        n = len(list((tmp_path / "spots").iterdir())) if (tmp_path / "spots").exists() else 0
        row = [("SPX", *prices[n], n), ("SPX", AT + timedelta(days=9), 1.0, 9)]
        spark.createDataFrame(row, schema).write.parquet(f"{landed}/{n}")
        return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(landed)

    stream_boxes(
        _stream(spark, folder), out, PARAMS, spots=read, as_of=lambda n: AT + timedelta(minutes=n), availableNow=True
    ).awaitTermination()
    for n in (0, 1):
        found = latest_boxes(spark, out, n)
        assert set(rows(found, "snapshot_time", "spot_price")) == {(AT + timedelta(minutes=n), prices[n][1])}
    # October did not change in the second batch; its boxes carry the new time and spot too.
    assert {r[0] for r in rows(found, "expiry")} == {"2026-07-02", "2026-10-01"}


def test_chain_without_boxes_replaces_its_earlier_boxes(spark, tmp_path):
    dear = [[_message(30, "260702", "P", 4100, 197.0, 198.0)]]
    folder = _land(tmp_path / "in", [BATCHES[0]] + dear)
    out = str(tmp_path / "out")
    stream_boxes(
        _stream(spark, folder), out, PARAMS, parity_scope=None, as_of=AT, availableNow=True
    ).awaitTermination()
    assert rows(latest_boxes(spark, out), "expiry") == [("2026-10-01",)]


def test_seed_and_tracked(spark, tmp_path):
    chain = quotes(spark, [
        quote("SPX", "2026-07-02", 4000, "call", 1, 2, 3, 4, 5, 6,
              symbol=_symbol("260702", "C", 4000)),
        quote("SPX", "2026-07-02", 4000, "put", 1, 2, 3, 4, 5, 6),
    ])
    live.seed_quotes(chain, str(tmp_path / "seed"))
    folder = _land(tmp_path / "in", BATCHES[:1])
    seeded = live.with_seed(_stream(spark, folder), str(tmp_path / "seed"))
    tracked = spark.createDataFrame([("SPX", "2026-07-02")], "ticker string, expiry string")
    out = str(tmp_path / "out")
    stream_boxes(
        seeded, out, PARAMS, tracked=tracked, as_of=AT, availableNow=True
    ).awaitTermination()
    current = live.current_quotes(spark, f"{out}/checkpoint")
    assert {r[0] for r in rows(current, "expiry")} == {"2026-07-02"}
    [call] = current.filter("strike = 4000 and option_type = 'call'").collect()
    # The live message has no open interest or mark: those stay as seeded.
    assert (call.bid, call.volume, call.mark, call.open_interest) == (110.0, 1, 4.0, 6)
    assert call.n_updates == 2


def test_scheduled_collection_survives_a_failure(spark, tmp_path):
    def page(document, at):
        return json.dumps(
            {"ticker": "SPX", "page_no": 0, "document": document, "snapshot_time": at.isoformat()}
        )

    def item(kind, strike, bid, ask):
        return {"option_type": kind, "strike": strike, "expiry": "2026-07-02", "bid": bid, "ask": ask}

    document = json.dumps([item("call", 4000, 110.0, 110.4), item("put", 4000, 60.0, 60.4),
                           item("call", 4100, 50.0, 50.4), item("put", 4100, 97.6, 98.0)])
    folder = tmp_path / "pages"
    folder.mkdir()
    (folder / "0.json").write_text(page("broken", AT))
    (folder / "1.json").write_text(page(document, AT + timedelta(minutes=1)))
    out = str(tmp_path / "table")
    live.collect_on_schedule(
        spark, str(folder), out, PARAMS, trigger={"availableNow": True}
    ).awaitTermination()
    assert rows(snapshots.scan_snapshots(spark, out), "snapshot_time") == [
        (AT + timedelta(minutes=1),)
    ]
    again = str(tmp_path / "again")
    known = {"checkpoint": str(tmp_path / "checkpoint"), "trigger": {"availableNow": True}}
    with pytest.raises(StreamingQueryException):
        live.collect_on_schedule(
            spark, str(folder), again, PARAMS, **known, parity_scope="other"
        ).awaitTermination()
    # The failed batch was not committed: its pages are collected by the next start.
    live.collect_on_schedule(spark, str(folder), again, PARAMS, **known).awaitTermination()
    assert len(rows(snapshots.scan_snapshots(spark, again), "snapshot_time")) == 1


def test_scheduled_collection_of_a_snapshot_in_parts(spark, tmp_path):
    def item(kind, strike, bid):
        return {"option_type": kind, "strike": strike, "expiry": "2026-07-02", "bid": bid, "ask": bid + 0.4}

    parts = [[item("call", 4000, 110.0), item("put", 4000, 60.0)], [item("call", 4100, 50.0), item("put", 4100, 97.6)]]
    folder, out = tmp_path / "pages", str(tmp_path / "table")
    folder.mkdir()
    known = {"checkpoint": str(tmp_path / "checkpoint"), "trigger": {"availableNow": True}}

    def land(name, page_no, items):
        page = {"ticker": "SPX", "page_no": page_no, "document": json.dumps(items), "snapshot_time": AT.isoformat()}
        (folder / name).write_text(json.dumps(page))
        live.collect_on_schedule(spark, str(folder), out, PARAMS, **known).awaitTermination()
        return rows(snapshots.scan_snapshots(spark, out), "kl", "ks")

    assert land("0.json", 0, parts[0]) == []
    assert land("1.json", 1, parts[1]) == [(4000.0, 4100.0)]
    # The snapshot is collected again, without items on one page.
    assert land("2.json", 0, []) == []
