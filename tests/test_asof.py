import random
from datetime import timedelta

import pytest
from helpers import AT, quote, quotes, rows

from boxrates import RateParams, build_boxes
from boxrates.operators.asof import as_of, spot_as_of

STAMPS = "ticker string, at timestamp_ntz, note string"
SPOTS = "ticker string, spot_time timestamp_ntz, spot_price double, seq bigint"


def minute(n):
    return None if n is None else AT + timedelta(minutes=n)


def brute(stamps, spots, within=None):
    result = []
    for ticker, at, note in stamps:
        found = [
            (t, seq, price) for k, t, price, seq in spots
            if k == ticker and k is not None and None not in (t, at) and t <= at and (within is None or at - t <= within)
        ]
        result.append((ticker, at, note, max(found)[2] if found else None))
    return sorted(result, key=str)


def joined(spark, stamps, spots, **options):
    df = as_of(
        spark.createDataFrame(stamps, STAMPS), spark.createDataFrame(spots, SPOTS),
        on=["ticker"], time="at", history_time="spot_time", values=["spot_price"], order=["seq"], **options,
    )
    return sorted(rows(df), key=str)


@pytest.mark.parametrize("within", [None, timedelta(minutes=7)])
@pytest.mark.parametrize("partitions", [1, 13])
def test_as_of_equals_all_pairs_with_a_hot_ticker(spark, within, partitions):
    rng = random.Random(4)
    tickers = ["HOT"] * 8 + ["SPX", "VIX", None]
    stamps = [(rng.choice(tickers), minute(rng.randrange(300)), str(i % 3)) for i in range(200)]
    stamps += stamps[:5] + [("SPX", None, "x"), ("NEW", minute(5), "x"), ("HOT", minute(-9), "x")]
    spots = [(rng.choice(tickers), minute(rng.randrange(0, 280, 3)), float(i), i) for i in range(150)]
    spots += [("SPX", None, 9.0, 1), ("VIX", minute(100), 1.0, 10_000), ("VIX", minute(100), 2.0, 10_000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        assert joined(spark, stamps, spots, within=within) == brute(stamps, spots, within)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_value_set_long_ago_crosses_partitions_without_history(spark):
    stamps = [("SPX", minute(i), "x") for i in range(200)]
    spots = [("SPX", minute(0), 7.0, 1)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    assert {r[3] for r in joined(spark, stamps, spots)} == {7.0}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_sides_and_hidden_columns(spark):
    assert joined(spark, [], [("SPX", minute(0), 7.0, 1)]) == []
    assert joined(spark, [("SPX", minute(0), "x")], []) == [("SPX", minute(0), "x", None)]
    stamps = spark.createDataFrame([], STAMPS + ", spot_price double")
    with pytest.raises(ValueError, match="spot_price"):
        as_of(stamps, spark.createDataFrame([], SPOTS), on=["ticker"], time="at", history_time="spot_time", values=["spot_price"])


def test_spot_as_of_serves_as_feed_of_boxes(spark):
    later = AT + timedelta(days=1)
    legs = [(4000, "call", 110.0), (4000, "put", 60.0), (4100, "call", 50.0), (4100, "put", 97.6)]
    chain = quotes(spark, [
        quote("SPX", "2026-07-02", strike, kind, bid, bid + 0.4, 0, 0, 1, 1, at=at)
        for at in (AT, later) for strike, kind, bid in legs
    ])
    spots = spark.createDataFrame(
        [("SPX", AT - timedelta(hours=1), 4000.0, 1), ("SPX", later, 4200.0, 2), ("SPX", later, 0.0, 3), ("SPX", later, float("nan"), 4)],
        SPOTS,
    )
    boxes = build_boxes(chain, RateParams(), feed=spot_as_of(chain, spots))
    assert sorted(rows(boxes, "snapshot_time", "spot_price")) == [(AT, 4000.0), (later, 4200.0)]
