import itertools
from datetime import datetime, timedelta

import pytest
from helpers import AT, quote, quotes, rows
from pyspark.sql import functions as F

from boxrates import RateParams, build_boxes, build_boxes_from_updates
from boxrates.operators.pairs import strike_pairs
from boxrates.operators.quotes import merge_updates, parity_spot, with_mid
from boxrates.operators.strikes import latest_strikes, pivot_calls_puts, pivot_unique
from boxrates.operators.wide import box_from_legs, box_records
from boxrates.schema import BOXES, CHAIN

# Half a year before this expiry, to the second.
EXPIRY = "2026-07-02"
HALF_YEAR = datetime(2026, 7, 2) - timedelta(seconds=31557600 / 2)


def _chain():
    return [
        quote("SPX", "2026-01-18", 4000, "call", 10, 12, 11, 11, 100, 500),
        quote("SPX", "2026-01-18", 4000, "put", 8, 10, 9, 9, 80, 400),
        quote("SPX", "2026-01-18", 4050, "call", 5, 7, 6, 6, 60, 300),
        quote("SPX", "2026-01-18", 4050, "put", 12, 14, 13, 13, 70, 350),
    ]


def test_mid_and_pivot(spark):
    df = with_mid(quotes(spark, _chain()))
    assert df.filter("strike = 4000 and option_type = 'call'").first().mid == 11.0
    strikes = sorted(rows(pivot_calls_puts(df), "strike", "call_mid", "put_mid"))
    assert strikes == [(4000.0, 11.0, 9.0), (4050.0, 6.0, 13.0)]
    assert sorted(rows(pivot_unique(df), "strike", "call_mid", "put_mid")) == strikes


def test_pivot_multiplies_repeated_contracts(spark):
    chain = _chain()[:2] + [quote("SPX", "2026-01-18", 4000, "CALL", 11, 13, 0, 0, 1, 1)]
    mids = rows(pivot_calls_puts(with_mid(quotes(spark, chain))), "call_mid", "put_mid")
    assert sorted(mids) == [(11.0, 9.0), (12.0, 9.0)]


def test_parity_spot(spark):
    assert rows(parity_spot(quotes(spark, _chain())), "spot_price") == [(4002.0,)]
    assert parity_spot(quotes(spark, [])).count() == 0


def test_parity_tie_goes_to_the_strike_seen_first(spark):
    chain = [
        quote("X", "2026-01-18", 20, "put", 1, 1, 0, 0, 0, 0),
        quote("X", "2026-01-18", 10, "call", 2, 2, 0, 0, 0, 0),
        quote("X", "2026-01-18", 10, "put", 1, 1, 0, 0, 0, 0),
        quote("X", "2026-01-18", 20, "call", 2, 2, 0, 0, 0, 0),
    ]
    assert rows(parity_spot(quotes(spark, chain)), "spot_price") == [(21.0,)]


def test_parity_scope(spark):
    """A call of one expiry meets the put of another unless expiries are kept apart."""
    chain = [
        quote("X", "2026-01-18", 10, "call", 2, 2, 0, 0, 0, 0),
        quote("X", "2026-02-18", 10, "put", 1, 1, 0, 0, 0, 0),
    ]
    df = quotes(spark, chain)
    assert rows(parity_spot(df, "chain"), "spot_price") == [(11.0,)]
    assert rows(parity_spot(df, "expiry"), "spot_price") == []
    with pytest.raises(ValueError):
        parity_spot(df, "other")


def test_parity_that_is_not_positive_gives_no_spot(spark):
    chain = [
        quote("X", "2026-01-18", 1, "call", 1, 1, 0, 0, 0, 0),
        quote("X", "2026-01-18", 1, "put", 3, 3, 0, 0, 0, 0),
        quote("X", "2026-01-18", 50, "call", 9, 9, 0, 0, 0, 0),
        quote("X", "2026-01-18", 50, "put", 1, 1, 0, 0, 0, 0),
    ]
    assert rows(parity_spot(quotes(spark, chain)), "spot_price") == []


def _two_strikes(vol=100):
    return [
        quote("SPX", EXPIRY, 4000, "call", 10, 11, 10.5, 10.5, vol, 100, at=HALF_YEAR),
        quote("SPX", EXPIRY, 4000, "put", 9.5, 10.5, 10, 10, 100, 100, at=HALF_YEAR),
        quote("SPX", EXPIRY, 4005, "call", 8, 9, 8.5, 8.5, 100, 100, at=HALF_YEAR),
        quote("SPX", EXPIRY, 4005, "put", 11, 12, 11.5, 11.5, 100, 100, at=HALF_YEAR),
    ]


def _spot(spark, price):
    return spark.createDataFrame([("SPX", price)], "ticker string, spot_price double")


def test_box_with_extreme_rates(spark):
    params = RateParams(min_strike_gap=1.0, max_strike_gap=100.0, max_abs_rate=2.0)
    boxes = build_boxes(quotes(spark, _two_strikes()), params, feed=_spot(spark, 4000.0))
    assert boxes.schema.names == BOXES.names
    [box] = boxes.collect()
    assert (box.width, box.mid_cost, box.lend_cost, box.borrow_proceeds) == (5.0, 3.5, 5.5, 1.5)
    assert round(box.mid_rate, 6) == 1.040816
    assert box.lend_rate is None and box.borrow_rate is None
    assert (box.moneyness_kl, box.min_leg_volume, box.total_leg_volume) == (1.0, 100, 400)
    assert (box.expiry, box.snapshot_time, box.tte_years) == (EXPIRY, HALF_YEAR, 0.5)


@pytest.mark.parametrize(
    "changes",
    [
        {"max_abs_rate": 1.0},
        {"min_strike_gap": 100.0, "max_strike_gap": 200.0},
        {"min_volume": 101},
        {"min_open_interest": 101},
    ],
)
def test_filtered_boxes(spark, changes):
    params = RateParams(**{"min_strike_gap": 1.0, "max_strike_gap": 100.0, **changes})
    assert build_boxes(quotes(spark, _two_strikes()), params).count() == 0


def test_box_rates(spark):
    chain = [
        quote("SPX", EXPIRY, 4000, "call", 110.0, 110.4, 0, 0, 1, 1, at=HALF_YEAR),
        quote("SPX", EXPIRY, 4000, "put", 60.0, 60.4, 0, 0, 2, 1, at=HALF_YEAR),
        quote("SPX", EXPIRY, 4100, "call", 50.0, 50.4, 0, 0, 3, 1, at=HALF_YEAR),
        quote("SPX", EXPIRY, 4100, "put", 97.6, 98.0, 0, 0, 4, 1, at=HALF_YEAR),
    ]
    for boxes in (
        build_boxes(quotes(spark, chain)),
        build_boxes(quotes(spark, chain), unique_contracts=True),
        build_boxes_from_updates(quotes(spark, chain)),
    ):
        [box] = boxes.collect()
        rates = [round(r, 6) for r in (box.mid_rate, box.lend_rate, box.borrow_rate)]
        assert rates == [0.049785, 0.032785, -0.067209]
        assert round(box.lend_cost, 6) == 98.4
        assert box.spot_price is None and box.moneyness_mid is None
        assert (box.min_leg_volume, box.total_leg_volume) == (1, 10)
        assert (box.call_kl_volume, box.call_ks_volume) == (1, 3)
        assert (box.put_kl_volume, box.put_ks_volume) == (2, 4)


def test_no_quotes_and_bad_expiry(spark):
    empty = build_boxes(quotes(spark, []))
    assert empty.count() == 0 and empty.schema.names == BOXES.names
    chain = [(q[0], "never", *q[2:]) for q in _two_strikes()]
    assert build_boxes(quotes(spark, chain)).count() == 0


def test_merge_keeps_the_last_nonzero_value(spark):
    updates = [
        quote("SPX", "2026-01-18", 4000, "call", 1.0, 1.2, 1.1, 1.1, 10, 100, symbol="A"),
        quote("SPX", "2026-01-18", 4000, "call", 1.5, 1.8, 0, 0, 0, 0),
    ]
    [merged] = merge_updates(quotes(spark, updates)).collect()
    assert (merged.bid, merged.ask, merged.last, merged.mark) == (1.5, 1.8, 1.1, 1.1)
    assert (merged.volume, merged.open_interest, merged.symbol) == (10, 100, "A")
    assert merged.n_updates == 2


def test_fused_strikes_equal_the_separate_steps(spark):
    updates = [
        quote("X", "e", strike, kind, (strike * n) % 3, (strike + n) % 4, n, n % 2, n % 5, n)
        for n in range(1, 8)
        for strike in range(5)
        for kind in ("call", "Put")
        if (n + strike) % 3 or kind == "call"
    ]
    df = quotes(spark, updates)
    lower = df.withColumn("option_type", F.lower("option_type"))
    merged = merge_updates(lower, [*CHAIN, "strike", "option_type"])
    separate = pivot_unique(with_mid(merged))
    fused = latest_strikes(df).select(*separate.columns)
    assert sorted(map(tuple, fused.collect())) == sorted(map(tuple, separate.collect()))
    assert fused.count() == 5


def _strikes(spark):
    """One heavy chain and one light one; strikes off the bucket grid."""
    heavy = [("H", "e", AT, i * 0.7) for i in range(300)]
    light = [("L", "e", AT, i * 10.0) for i in range(20)]
    return spark.createDataFrame(
        heavy + light, "ticker string, expiry string, snapshot_time timestamp_ntz, strike double"
    )


@pytest.mark.parametrize("gap", [(0.0, None), (5.0, 70.0), (0.7, 0.7), (10.0, 10.0)])
@pytest.mark.parametrize("cell_rows", [4096, 16])
def test_pairs_equal_brute_force_however_they_are_cut(spark, gap, cell_rows):
    low, high = gap
    df = _strikes(spark)
    pairs = strike_pairs(df, min_gap=low, max_gap=high, cell_rows=cell_rows)
    found = sorted(rows(pairs, "ticker", "strike_kl", "strike_ks"))
    expected = sorted(
        (a[0], min(a[3], b[3]), max(a[3], b[3]))
        for a, b in itertools.combinations(df.collect(), 2)
        if a[0] == b[0] and low <= abs(a[3] - b[3]) <= (high or 1e9) and a[3] != b[3]
    )
    assert found == expected


def test_merge_is_computed_once_for_both_sides_of_the_pairs(spark, tmp_path):
    df = quotes(spark, _two_strikes())
    df.write.parquet(str(tmp_path / "q"))
    boxes = build_boxes_from_updates(spark.read.parquet(str(tmp_path / "q")))
    boxes.collect()
    final = boxes._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("FileScan") == 1


def test_wide_rows(spark):
    wide = spark.createDataFrame(
        [
            ("SPX", "2026-01-01", 4000.0, 4050.0, 10.0, 5.0, 5.0, 10.0),
            ("SPX", "2026-01-01", 4010.0, 4060.0, 11.0, 10.0, 9.0, 8.0),
            ("SPX", "2026-01-01", 4010.0, 4060.0, 1.0, 2.0, 3.0, 4.0),
            ("SPX", "2026-01-01", 4010.0, 4060.0, 1.0, 9.0, 3.0, 4.0),
        ],
        "ticker string, expiry string, kl double, ks double,"
        " call_kl double, call_ks double, put_kl double, put_ks double",
    )
    boxes = box_from_legs(wide, tte=0.5)
    found = rows(boxes, "net_cost", "implied_rate", "direction", "lend_borrow")
    assert found[0] == (10.0, 24.0, 1, "lend")
    assert found[1][2:] == (0, "flat") and found[1][1] == 0.0
    assert found[3][0] == -7.0 and found[3][2:] == (-1, "borrow") and found[3][1] < 0
    assert box_records(box_from_legs(wide, F.lit(0.5))).columns == [
        "ticker", "expiry", "kl", "ks", "net_cost", "implied_rate", "lend_borrow"
    ]


def test_dirty_rows_cost_no_other_chain(spark):
    def chain(strike_a, strike_b, expiry="2026-07-02", volume=1):
        return [quote("SPX", expiry, strike_a, "call", 110.0, 110.4, 0, 0, volume, 1),
                quote("SPX", expiry, strike_a, "put", 60.0, 60.4, 0, 0, volume, 1),
                quote("SPX", expiry, strike_b, "call", 50.0, 50.4, 0, 0, volume, 1),
                quote("SPX", expiry, strike_b, "put", 97.6, 98.0, 0, 0, volume, 1)]

    good = chain(4000, 4100)
    params = RateParams(min_strike_gap=5.0, max_strike_gap=400.0, max_abs_rate=1.0)
    expected = rows(build_boxes(quotes(spark, good), params))
    dirty = [*chain(1e30, 2e30), *chain(float("inf"), -1e300), *chain(4000, 4100, "2024"),
             *chain(4000, 4100, "2026-09")]
    found = rows(build_boxes(quotes(spark, good + dirty), params).filter("kl < 1e9"))
    assert found == expected and len(found) == 1
    loud = build_boxes(quotes(spark, chain(4000, 4100, volume=4 * 10**18)), params).first()
    assert loud.total_leg_volume is None and loud.min_leg_volume == 4 * 10**18


def test_updates_are_folded_by_hash_before_the_first_shuffle(spark, tmp_path):
    rows_in = [quote("SPX", "2026-07-02", 4000 + i % 3, "call", i % 5, i, 0, 1, i % 4, 1, symbol=["A", "B", None, ""][i % 4]) for i in range(200)]
    quotes(spark, rows_in).write.parquet(str(tmp_path / "q"))
    merged = merge_updates(spark.read.parquet(str(tmp_path / "q")))
    merged.collect()
    plan = merged._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    lowest = plan[plan.rindex("Exchange"):]
    assert "HashAggregate" in lowest and "SortAggregate" not in lowest
