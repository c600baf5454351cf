import json
import time
from datetime import timedelta

import pytest
from helpers import AT, rows
from pyspark.errors import StreamingQueryException
from test_streaming import BATCHES, PARAMS, _land, _stream

from boxrates import stream_boxes
from boxrates.streaming import status

PAGES = "ticker string, page_no bigint, document string, snapshot_time timestamp_ntz"


def settled(spark, path, states):
    """The states, once the listener has written them."""
    for _ in range(60):
        try:
            found = {r.name: r for r in status.stream_states(spark, path).collect()}
        except Exception:
            found = {}
        if {n: r.state for n, r in found.items()} == states:
            return found
        time.sleep(0.5)
    raise AssertionError(found)


def test_a_failing_batch_shows_its_error_and_a_restart_clears_it(spark, tmp_path):
    folder, log = _land(tmp_path / "in", BATCHES[:2]), str(tmp_path / "log")
    listener = status.StatusLog(spark, log, names=["boxes"])
    spark.streams.addListener(listener)

    def run(spots):
        stream_boxes(
            _stream(spark, folder), str(tmp_path / "out"), PARAMS, spots=spots, as_of=AT, name="boxes", availableNow=True
        ).awaitTermination()

    calls = []

    def broken():
        calls.append(1)
        if len(calls) == 2:
            raise ValueError("no spot feed")
        return prices()

    def prices():
        return spark.createDataFrame([("SPX", AT - timedelta(hours=1), 4000.0)], "ticker string, spot_time timestamp_ntz, spot_price double")

    try:
        with pytest.raises(StreamingQueryException):
            run(broken)
        found = settled(spark, log, {"boxes": "failed"})["boxes"]
        assert "no spot feed" in found.error and found.last_batch == 0 and found.input_rows == 8
        run(prices)
        found = settled(spark, log, {"boxes": "stopped"})["boxes"]
        assert (found.error, found.last_batch, found.batches, found.state_rows) == (None, 1, 1, 8)
    finally:
        spark.streams.removeListener(listener)


def test_bootstrap_tells_failed_empty_and_pending_tickers(spark):
    item = {"symbol": "SPX260702C04000000", "bid": 1.0}
    pages = spark.createDataFrame(
        [
            ("SPX", 0, json.dumps([item, {"bid": 2.0}]), AT), ("SPX", 1, "broken", AT), ("VIX", 0, "{", AT), ("VIX", 1, None, AT),
            ("DJX", 0, json.dumps({"snapshots": {}}), AT), ("OTH", 0, json.dumps([item]), AT),
        ],
        PAGES,
    )
    states = status.bootstrap_states(pages, ["SPX", "VIX", "DJX", "NDX"])
    assert sorted(rows(states, "ticker", "state", "items", "symbols")) == [
        ("DJX", "empty", 0, 0), ("NDX", "pending", 0, 0), ("SPX", "done", 2, 1), ("VIX", "failed", 0, 0)
    ]
    assert rows(status.bootstrap_progress(states)) == [(3, 4, "VIX", "DJX", 1)]
    none = status.bootstrap_progress(status.bootstrap_states(pages.limit(0), []))
    assert rows(none) == [(0, 0, "", "", 0)]
