import json
import os
import random
from datetime import timedelta
from decimal import Decimal

import pytest
from helpers import AT, rows
from test_streaming import _message, _stream

from boxrates.operators.normalise import quotes_from_messages
from boxrates.operators.quotes import merge_updates, parity_spot
from boxrates.schema import CONTRACT
from boxrates.streaming import event_time, live

COMPARED = [*CONTRACT, "bid", "ask", "last", "volume", "symbol", "bid_size", "n_updates", "last_update"]


@pytest.fixture
def rocksdb(spark):
    event_time.use_rocksdb(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def timed(seq, minute, expiry, kind, strike, bid, ask, volume=1):
    message = _message(seq, expiry, kind, strike, bid, ask, volume)
    return {**message, "ts": (AT + timedelta(minutes=minute)).isoformat()}


def land(folder, batches):
    folder.mkdir(exist_ok=True)
    for n, batch in enumerate(batches):
        file = folder / f"{n}.json"
        file.write_text("\n".join(map(json.dumps, batch)))
        os.utime(file, (1_767_000_000 + n,) * 2)  # files are taken by their time
    return str(folder)


def test_late_and_repeated_messages_give_the_batch_result(spark, tmp_path, rocksdb):
    rng = random.Random(2)
    messages = [
        timed(i, i % 9, "260702", rng.choice("CP"), rng.choice([4000, 4100]), rng.choice([0.0, 1.0 + i]), 2.0 + i, rng.choice([0, i]))
        for i in range(40)
    ]
    dealt = messages + messages[::3]
    rng.shuffle(dealt)
    folder = land(tmp_path / "in", [dealt[i::4] for i in range(4)])
    out = str(tmp_path / "out")
    event_time.stream_merge_by_time(_stream(spark, folder), out).awaitTermination()
    batch = spark.createDataFrame([(m["value"], m["seq"], m["ts"]) for m in dealt], "value string, seq bigint, ts string")
    batch = quotes_from_messages(batch.selectExpr("value", "seq", "CAST(ts AS timestamp_ntz) AS ts"))
    expected = sorted(rows(event_time.merge_by_time(batch), *COMPARED))
    assert sorted(rows(event_time.latest_by_time(spark, out), *COMPARED)) == expected
    assert sum(r[-2] for r in expected) == 40


def test_state_of_expired_contracts_goes(spark, tmp_path, rocksdb):
    day = 24 * 60
    batches = [
        [timed(1, 0, "260102", "C", 4000, 1.0, 2.0), timed(2, 0, "260702", "C", 4000, 1.0, 2.0)],
        [timed(3, 5 * day, "260702", "C", 4000, 3.0, 4.0)],  # the watermark passes 2 January
        [timed(4, 1, "260702", "C", 4000, 9.0, 9.0), timed(5, 5 * day + 1, "260702", "P", 4000, 5.0, 6.0)],  # 4 comes too late
    ]
    folder, out = land(tmp_path / "in", batches), str(tmp_path / "out")
    event_time.stream_merge_by_time(_stream(spark, folder), out).awaitTermination()
    shown = ["expiry", "option_type", "bid", "n_updates"]
    assert sorted(rows(event_time.latest_by_time(spark, out), *shown)) == [
        ("2026-07-02", "call", 3.0, 2), ("2026-07-02", "put", 5.0, 1)
    ]
    ended = event_time.latest_by_time(spark, out, ended=True).filter("ended")
    assert rows(ended, *shown) == [("2026-01-02", "call", 1.0, 1)]
    state = spark.read.format("statestore").option("stateVarName", "quote").load(f"{out}/checkpoint")
    assert state.count() == 2


def test_messages_of_several_partitions_have_one_order(spark):
    legs = [("C", 4000, 110.0), ("P", 4000, 60.0), ("C", 4100, 50.0), ("P", 4100, 97.6), ("C", 4000, 111.0), ("P", 4000, 59.0)]
    sent = [
        (json.loads(json.dumps(_message(0, "260702", k, s, bid, bid + 0.4)))["value"], 1_767_225_600_000 + i // 3, i % 3, 1000 * (3 - i % 3) + i)
        for i, (k, s, bid) in enumerate(legs * 3)
    ]
    found = set()
    for seed, zone in ((1, "UTC"), (2, "America/New_York"), (3, "Asia/Tokyo")):
        random.Random(seed).shuffle(sent)
        spark.conf.set("spark.sql.session.timeZone", zone)
        topic = spark.createDataFrame(sent, "value string, ms bigint, partition int, offset bigint").repartition(3)
        topic = topic.selectExpr("value", "timestamp_millis(ms) AS timestamp", "partition", "offset")
        messages = topic.select(
            "value", live.total_order("timestamp", "partition", "offset").alias("seq"), live.utc_of("timestamp").alias("ts")
        )
        quotes = quotes_from_messages(messages)
        spot = parity_spot(quotes.withColumn("snapshot_time", live.utc(AT)))
        merged = merge_updates(quotes)
        found.add((rows(spot, "spot_price")[0], tuple(sorted(rows(merged, "strike", "option_type", "bid", "last_update")))))
        assert quotes.select("seq").distinct().count() == len(sent)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert len(found) == 1
    [(_, merged)] = found
    assert {r[3].year for r in merged} == {2026} and {r[3].hour for r in merged} == {0}


def test_a_batch_rewrites_no_state_of_earlier_messages(spark, tmp_path, rocksdb):
    first = [timed(i, i % 9, "260702", "C", 4000, 1.0 + i, 2.0 + i) for i in range(300)]
    batches = [first, [timed(300, 9, "260702", "C", 4000, 5.0, 6.0), first[7]], [first[8], timed(301, 9, "260702", "C", 4000, 7.0, 8.0)]]
    folder, out = land(tmp_path / "in", batches), str(tmp_path / "out")
    query = event_time.stream_merge_by_time(_stream(spark, folder), out)
    query.awaitTermination()
    rewritten = [sum(op.numRowsUpdated for op in p.stateOperators) for p in query.recentProgress if p.numInputRows]
    assert len(rewritten) == 3 and rewritten[0] >= 300 and max(rewritten[1:]) < 10
    assert rows(event_time.latest_by_time(spark, out), "bid", "n_updates") == [(7.0, 302)]


def test_missing_zero_and_odd_values_are_no_news(spark, tmp_path, rocksdb):
    schema = "ticker string, expiry string, strike double, option_type string, bid double, ask double, last double, mark double, " \
        "volume bigint, open_interest bigint, bid_size bigint, ask_size bigint, symbol string, seq decimal(38,0), snapshot_time timestamp_ntz"  # fmt: skip
    big, wide, later, nan = (1 << 53) + 1, Decimal(10**37), Decimal(10**37 + 1), float("nan")
    contract = ("SPX", "2026-07-02", 4000.0, "call")
    updates = [
        (*contract, 1.5, -0.0, nan, 1e300, big, 0, 0, None, 'a"\\é', wide, AT),
        (*contract, None, 0.0, 0.0, None, None, None, None, None, "", later, AT),
        ("SPX", None, float("nan"), None, 0.1 + 0.2, 1e-7, None, 5.0, -1, 2, None, big, None, wide, AT),
    ]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(updates, schema).write.parquet(path)
    event_time.stream_merge_by_time(spark.readStream.schema(schema).parquet(path), out).awaitTermination()
    shown = ["ticker", "expiry", "bid", "ask", "last", "mark", "volume", "open_interest", "bid_size", "ask_size", "symbol", "n_updates"]
    assert sorted(map(str, rows(event_time.latest_by_time(spark, out), *shown))) == sorted(
        map(str, [
            ("SPX", "2026-07-02", 1.5, 0.0, nan, 1e300, big, 0, 0, None, 'a"\\é', 2),
            ("SPX", None, 0.1 + 0.2, 1e-7, 0.0, 5.0, -1, 2, None, big, None, 1),
        ])
    )
