import random
from datetime import timedelta

import pytest
from helpers import AT, rows

from boxrates.operators.curves import carry_by_tenor, curve_spread, interpolated, on_grid

CURVE = "currency string, tenor_years double, rate double"


def at(points, x):
    """The curve of the given points at ``x``, flat outside of them."""
    points = sorted({t: sum(r for u, r in points if u == t) / sum(u == t for u, _ in points) for t, _ in points}.items())
    if not points or x is None:
        return None
    if x <= points[0][0]:
        return points[0][1]
    for (a, p), (b, q) in zip(points, points[1:]):
        if x <= b:
            return p + (x - a) / (b - a) * (q - p)
    return points[-1][1]


@pytest.mark.parametrize("bucket", [0.1, 5.0])
def test_interpolation_equals_a_search_by_hand(spark, bucket):
    rng = random.Random(3)
    curve = [(rng.choice(["USD", "EUR"]), rng.choice([0.08, 0.25, 0.5, 1.0, 2.0, 10.0, 30.0]), rng.random()) for _ in range(12)]
    curve += [("JPY", 1.0, 0.5), ("NIL", 1.0, None), ("NIL", None, 1.0), (None, 1.0, 1.0)]
    asked = [(i, c, x) for i, (c, x) in enumerate(
        (c, x) for c in ("USD", "EUR", "JPY", "NIL", "GBP", None) for x in (None, -1.0, 0.08, 0.25, 0.3, 0.5, 1.7, 2.0, 9.0, 30.0, 99.0)
    )]
    df = interpolated(
        spark.createDataFrame(asked, "id int, currency string, x double"), spark.createDataFrame(curve, CURVE),
        on=["currency"], x="x", curve_x="tenor_years", y="rate", name="rate", bucket=bucket,
    )
    found = {r.id: r.rate for r in df.collect()}
    for i, c, x in asked:
        points = [(t, r) for k, t, r in curve if k == c and None not in (k, t, r)]
        assert found[i] == pytest.approx(at(points, x)), (c, x)
    assert len(found) == len(asked)


def test_spread_over_the_curve_published_last(spark):
    day = timedelta(days=1)
    boxes = spark.createDataFrame(
        [("SPX", AT, 0.5, 0.05), ("SPX", AT + 2 * day, 0.75, 0.05), ("SPX", AT - 2 * day, 0.5, 0.05), ("SPX", AT, None, 0.05), ("SPX", AT, 0.5, None)],
        "ticker string, snapshot_time timestamp_ntz, tte_years double, mid_rate double",
    )
    curve = spark.createDataFrame(
        [(AT - day, 0.25, 0.01), (AT - day, 0.75, 0.03), (AT + day, 0.5, 0.04), (AT + day, 1.0, 0.06), (AT + 5 * day, 0.5, 9.0), (AT + 2 * day, 0.5, None)],
        "curve_time timestamp_ntz, tenor_years double, rate double",
    )
    found = rows(curve_spread(boxes, curve), "snapshot_time", "tte_years", "curve_time", "curve_rate", "spread")
    expected = [
        (AT, 0.5, AT - day, 0.02, 0.03), (AT + 2 * day, 0.75, AT + day, 0.05, 0.0), (AT - 2 * day, 0.5, None, None, None),
        (AT, None, AT - day, None, None), (AT, 0.5, AT - day, 0.02, None),
    ]

    def rounded(table):
        return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in table), key=str)

    assert rounded(found) == rounded(expected)
    empty = spark.createDataFrame([], curve.schema)
    assert {r[0] for r in rows(curve_spread(boxes, empty), "spread")} == {None}


def test_grid_is_filled_from_both_sides_and_carry_is_the_difference(spark):
    curves = spark.createDataFrame(
        [(AT, "USD", 0.5, 0.02), (AT, "USD", 1.0, 0.04), (AT, "EUR", 0.25, 0.01), (AT, "GBP", 2.0, None), (AT + timedelta(days=1), "EUR", 1.0, 0.07)],
        "snapshot_time timestamp_ntz, currency string, tenor_years double, rate double",
    )
    tenors = [0.25, 0.75, 1.5]
    grid = {(r.snapshot_time, r.currency, r.tenor): r.rate for r in on_grid(curves, tenors, on=["snapshot_time", "currency"]).collect()}
    assert [round(grid[AT, "USD", t], 9) for t in tenors] == [0.02, 0.03, 0.04]
    assert [grid[AT, "EUR", t] for t in tenors] == [0.01] * 3
    assert [grid[AT, "GBP", t] for t in tenors] == [None] * 3
    carry = rows(carry_by_tenor(curves, tenors, base="USD"), "snapshot_time", "currency", "tenor", "carry")
    found = {(c, t): v if v is None else round(v, 9) for _, c, t, v in carry}
    assert found == {("EUR", 0.25): -0.01, ("EUR", 0.75): -0.02, ("EUR", 1.5): -0.03, **{("GBP", t): None for t in tenors}}
