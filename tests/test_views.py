import random
import statistics

import pytest
from helpers import rows
from pyspark.sql import functions as F

from boxrates.operators import filters, quantiles, views

SAMPLE = [
    ("SPX", "2026-01-01", 4000.0, 4050.0, 50.0, 4000.0, 0.02, 0.019, -0.021, 1.0, 100),
    ("SPX", "2026-01-01", 4025.0, 4075.0, 50.0, 4050.0, 0.025, 0.024, -0.026, 1.01, 100),
    ("SPX", "2026-01-01", 4000.0, 4050.0, 50.0, 4000.0, 0.021, 0.020, -0.022, 1.0, 100),
    ("SPX", "2026-01-01", 4025.0, 4075.0, 50.0, 4050.0, 0.026, 0.025, -0.027, 1.01, 100),
]
SCHEMA = (
    "ticker string, expiry string, kl double, ks double, width double, mid_strike double,"
    " mid_rate double, lend_rate double, borrow_rate double, moneyness_mid double,"
    " min_leg_volume bigint"
)


@pytest.fixture
def boxes(spark):
    return spark.createDataFrame(SAMPLE, SCHEMA)


def _close(row, *expected):
    assert [round(x, 9) if isinstance(x, float) else x for x in row] == list(expected)


def test_rate_curve(boxes):
    assert views.rate_curve(boxes, "2026-01-01").count() == 4
    assert views.rate_curve(boxes, "2027-01-01").count() == 0
    _close(views.rate_curve(boxes).first(), 4000.0, 2.0, 50.0)


def test_term_structure(boxes):
    [row] = views.term_structure(boxes).collect()
    _close(row, "SPX", "2026-01-01", 2.3, 2.3, 2.1, 2.5, 4)
    unrated = boxes.withColumn("mid_rate", F.lit(None).cast("double"))
    assert views.term_structure(unrated).count() == 0
    assert views.term_structure(boxes, by=("expiry",), fast=True).columns == [
        "expiry", "median_pct", "mean_pct", "q25_pct", "q75_pct", "n"
    ]


@pytest.mark.parametrize("direct_rows", [100_000, 50])
def test_quantiles_of_heavy_groups_are_exact(spark, direct_rows):
    rng = random.Random(7)
    groups = {
        "wide": [rng.random() for _ in range(4001)],
        "tied": [rng.choice([0.1, 0.2, 0.2, 0.3]) for _ in range(1000)],
        "even": [rng.gauss(0, 1) for _ in range(2000)],
        "one": [5.0],
    }
    df = spark.createDataFrame(
        [(g, v) for g, values in groups.items() for v in values], "g string, v double"
    )
    out = quantiles.group_quantiles(
        df, ["g"], "v", {"q25": 0.25, "q75": 0.75}, direct_rows=direct_rows
    )
    for row in out.collect():
        values = sorted(groups[row.g])
        n = len(values)
        assert row.n == n
        assert row.median == pytest.approx(statistics.median(values), abs=1e-12)
        assert row.q25 == values[int((n - 1) * 0.25 + 0.5)]
        assert row.q75 == values[int((n - 1) * 0.75 + 0.5)]


def test_heatmap(boxes):
    heatmap = views.rate_heatmap(boxes, "2026-01-01")
    cells = [(kl, ks, round(rate, 9)) for kl, ks, rate in rows(heatmap)]
    assert cells == [(4000.0, 4050.0, 2.05), (4025.0, 4075.0, 2.55)]
    matrix = views.heatmap_matrix(heatmap)
    assert matrix.columns == ["ks", "4000.0", "4025.0"]
    assert matrix.first()["4025.0"] is None
    assert views.rate_heatmap(boxes.filter("kl = 4000")).count() == 0


def test_heatmap_sample_is_exact_and_repeatable(spark):
    cells = spark.range(5000).select(
        F.col("id").cast("double").alias("kl"),
        (F.col("id") + 5).cast("double").alias("ks"),
        F.lit(0.1).alias("rate"),
    )
    first = views.heatmap_sample(cells, 2000)
    again = views.heatmap_sample(cells.repartition(7), 2000)
    assert first.count() == 2000
    assert sorted(rows(first)) == sorted(rows(again))
    assert views.heatmap_sample(cells, 2000, seed=1).exceptAll(first).count() > 0
    assert views.heatmap_sample(cells, 9000).count() == 5000


def test_lend_borrow(boxes):
    some = boxes.withColumn("lend_rate", F.when(F.col("mid_rate") > 0.0205, F.col("lend_rate")))
    view = views.lend_borrow(some, "2026-01-01")
    assert view.count() == 3
    _close(view.orderBy("lend_pct").first(), 4000.0, 2.0, -2.2, 4.2)


def test_top_opportunities(spark):
    df = spark.createDataFrame(
        [
            ("SPX", "2026-01-01", 4000.0, 4050.0, 50.0, 0.045, 0.040, -0.050, 100),
            ("SPX", "2026-01-01", 4010.0, 4060.0, 50.0, 0.042, 0.038, -0.046, 100),
            ("SPX", "2026-01-01", 4020.0, 4060.0, 40.0, 0.042, None, None, 100),
        ],
        "ticker string, expiry string, kl double, ks double, width double, mid_rate double,"
        " lend_rate double, borrow_rate double, min_leg_volume bigint",
    )
    top = views.top_opportunities(df, as_text=True)
    assert rows(top, "side", "rank", "mid_rate", "lend_rate", "borrow_rate") == [
        ("lend", 1, "4.5%", "4.0%", "-5.0%"),
        ("lend", 2, "4.2%", "3.8%", "-4.6%"),
        ("borrow", 1, "4.2%", "3.8%", "-4.6%"),
        ("borrow", 2, "4.5%", "4.0%", "-5.0%"),
    ]
    assert views.top_opportunities(df, 1).count() == 2
    assert "min_leg_volume" not in views.top_opportunities(df.drop("min_leg_volume")).columns
    assert views.top_opportunities(df.limit(0)).count() == 0


def test_view_filter(boxes):
    assert filters.view_filter(boxes).count() == 4
    assert filters.view_filter(boxes, ticker="VIX").count() == 0
    assert filters.view_filter(boxes, min_volume=100).count() == 4
    assert filters.view_filter(boxes, min_volume=101).count() == 0
    assert filters.view_filter(boxes, width_range=(50, 50)).count() == 4
    assert filters.view_filter(boxes, width_range=(51, 60)).count() == 0
    assert filters.view_filter(boxes, moneyness_band=0.5).count() == 2
    unknown = boxes.withColumn("moneyness_mid", F.lit(None).cast("double"))
    assert filters.view_filter(unknown, moneyness_band=30).count() == 0
    assert filters.view_filter(unknown, moneyness_band=0).count() == 4


def test_view_filter_ignores_absent_columns(boxes):
    bare = boxes.drop("min_leg_volume", "width", "moneyness_mid")
    options = {"min_volume": 500, "width_range": (1, 2), "moneyness_band": 1.0}
    assert filters.view_filter(bare, **options).count() == 4


def test_view_expiries(boxes):
    assert rows(views.view_expiries(boxes, "SPX")) == [("SPX", "2026-01-01")]
    assert rows(views.view_expiries(boxes, "VIX")) == []


def test_heatmap_is_complete_unless_asked(spark):
    many = spark.range(5000).select(
        F.lit("2026-01-01").alias("expiry"), F.col("id").cast("double").alias("kl"),
        (F.col("id") + 5).cast("double").alias("ks"), F.lit(0.1).alias("mid_rate"),
    )
    assert views.rate_heatmap(many).count() == 5000
    assert views.rate_heatmap(many, cells=2000).count() == 2000
    matrix = views.heatmap_matrix(views.rate_heatmap(many.limit(3)), [0.0, 1.0])
    assert matrix.columns == ["ks", "0.0", "1.0"]


def test_top_table_reads_its_input_once(spark, tmp_path):
    boxes = spark.range(100).selectExpr(
        "concat('T', id % 7) AS ticker", "'2026-07-02' AS expiry", "CAST(id AS DOUBLE) AS kl", "CAST(id + 1 AS DOUBLE) AS ks",
        "(id - 50) / 100.0D AS lend_rate", "(50 - id) / 100.0D AS borrow_rate",
    )
    boxes.write.parquet(str(tmp_path / "boxes"))
    top = views.top_opportunities(spark.read.parquet(str(tmp_path / "boxes")), 3)
    found = [(r.side, r.rank, r.kl) for r in top.collect()]
    assert found == [("lend", 1, 99.0), ("lend", 2, 98.0), ("lend", 3, 97.0), ("borrow", 1, 51.0), ("borrow", 2, 52.0), ("borrow", 3, 53.0)]
    plan = top._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 1 and "WindowGroupLimit" in plan
