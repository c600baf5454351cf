"""Analytic views over boxes. Rates come out in percent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxrates.functions.pricing import percent, percent_text
from boxrates.operators.filters import at_expiry
from boxrates.operators.quantiles import group_quantiles

# Cells a heatmap shows at most, and the seed of the choice among more.
HEATMAP_CELLS = 2000
HEATMAP_SEED = 42

# Size of a rate sketch; ranks err by about 2.3 / SKETCH_K ** 0.9 of the rows at most.
SKETCH_K = 400

TOP_COLUMNS = [
    "ticker",
    "expiry",
    "kl",
    "ks",
    "width",
    "mid_rate",
    "lend_rate",
    "borrow_rate",
    "min_leg_volume",
]


def rate_curve(boxes: DataFrame, expiry: str | None = None) -> DataFrame:
    """Mid rate against mid strike, with the width."""
    return at_expiry(boxes, expiry).select(
        "mid_strike", percent(F.col("mid_rate")).alias("rate_pct"), "width"
    )


def term_structure(
    boxes: DataFrame, by: Sequence[str] = ("ticker", "expiry"), *, fast: bool = False
) -> DataFrame:
    """Median, mean and quartiles of the mid rate per expiry, with the number of boxes.

    ``by=("expiry",)`` pools the tickers. ``fast`` takes quartiles and median from
    ``percentile_approx`` in one pass instead of exactly.
    """
    rated = boxes.filter(F.col("mid_rate").isNotNull())
    if fast:
        marks = F.percentile_approx("mid_rate", [0.25, 0.5, 0.75])
        stats = (
            rated.groupBy(*by)
            .agg(F.count(F.lit(1)).alias("n"), F.avg("mid_rate").alias("mean"), marks.alias("_m"))
            .withColumns({"q25": F.col("_m")[0], "median": F.col("_m")[1], "q75": F.col("_m")[2]})
        )
    else:
        stats = group_quantiles(rated, by, "mid_rate", {"q25": 0.25, "q75": 0.75})
    rates = [
        percent(F.col(name)).alias(f"{name}_pct") for name in ("median", "mean", "q25", "q75")
    ]
    return stats.select(*by, *rates, "n").orderBy(*by)


def rate_sketches(
    boxes: DataFrame, by: Sequence[str] = ("ticker", "expiry"), *, k: int = SKETCH_K
) -> DataFrame:
    """A mergeable summary of the mid rates per snapshot and ``by``: count, sum and KLL sketch.

    A few kilobytes for any number of boxes. Stored beside each snapshot, they give term
    structures over any part of the history without reading a box again.
    """
    rated = boxes.filter(F.col("mid_rate").isNotNull())
    return rated.groupBy("snapshot_time", *by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("mid_rate").alias("total"),
        F.kll_sketch_agg_double("mid_rate", F.lit(k)).alias("sketch"),
    )


def sketch_error(k: int = SKETCH_K) -> float:
    """Bound on the error of a sketch's rank, as a share of the rows, with 99 % confidence."""
    return 2.296 / k**0.9021


def term_structure_of_sketches(
    sketches: DataFrame, by: Sequence[str] = ("ticker", "expiry"), *, k: int = SKETCH_K
) -> DataFrame:
    """As ``term_structure``, from merged sketches of any snapshots; ``by`` may be coarser than theirs.

    ``n`` and the mean are exact. Median and quartiles are rates that occur, at a rank within
    ``rank_error`` (a share of ``n``) of the exact one.
    """
    merged = sketches.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum("total").alias("_total"),
        F.kll_merge_agg_double("sketch", F.lit(k)).alias("_sketch"),
    )

    def at(rank: float):
        return percent(F.kll_sketch_get_quantile_double("_sketch", F.lit(rank)))

    return merged.select(
        *by,
        at(0.5).alias("median_pct"),
        percent(F.col("_total") / F.col("n")).alias("mean_pct"),
        at(0.25).alias("q25_pct"),
        at(0.75).alias("q75_pct"),
        "n",
        F.lit(sketch_error(k)).alias("rank_error"),
    ).orderBy(*by)


def heatmap_cells(boxes: DataFrame, expiry: str | None = None) -> DataFrame:
    """Mean mid rate of each strike pair, unordered and complete."""
    return at_expiry(boxes, expiry).groupBy("kl", "ks").agg(F.avg("mid_rate").alias("rate"))


def heatmap_sample(cells: DataFrame, n: int = HEATMAP_CELLS, seed: int = HEATMAP_SEED) -> DataFrame:
    """Exactly ``n`` cells chosen by a seeded hash of the pair; all if there are no more.

    The choice depends on the cells alone, so it is the same on every run.
    """
    key = F.md5(
        F.concat_ws(
            "|",
            F.lit(str(seed)),
            F.round(F.col("kl") * 1000).cast("bigint").cast("string"),
            F.round(F.col("ks") * 1000).cast("bigint").cast("string"),
        )
    )
    return cells.orderBy(key, "kl", "ks").limit(n)


def rate_heatmap(
    boxes: DataFrame,
    expiry: str | None = None,
    *,
    cells: int | None = None,
    seed: int = HEATMAP_SEED,
) -> DataFrame:
    """Strike-pair heatmap in long form: ``kl, ks, rate_pct``.

    All cells, unless ``cells`` asks for a seeded sample of that many.

    Empty unless there are two lower and two upper strikes at least, like a drawing
    with a single row or column, which has nothing to compare.
    """
    shown = heatmap_cells(boxes, expiry)
    if cells is not None:
        shown = heatmap_sample(shown, cells, seed)
    two_of_each = (F.min("kl") < F.max("kl")) & (F.min("ks") < F.max("ks"))
    drawn = shown.filter(shown.agg(two_of_each).scalar())
    return drawn.select("kl", "ks", percent(F.col("rate")).alias("rate_pct")).orderBy("kl", "ks")


def heatmap_matrix(heatmap: DataFrame, lows: Sequence[float] | None = None) -> DataFrame:
    """Wide form of a heatmap: one row per upper strike, one column per lower strike.

    Name the lower strikes in ``lows`` to spare Spark looking for them first.
    """
    wide = heatmap.groupBy("ks").pivot("kl", None if lows is None else list(lows))
    return wide.agg(F.first("rate_pct")).orderBy("ks")


def lend_borrow(boxes: DataFrame, expiry: str | None = None) -> DataFrame:
    """Lend and borrow rate against mid strike where both exist, and their gap."""
    both = at_expiry(boxes, expiry).filter(
        F.col("lend_rate").isNotNull() & F.col("borrow_rate").isNotNull()
    )
    rates = both.select(
        "mid_strike",
        percent(F.col("lend_rate")).alias("lend_pct"),
        percent(F.col("borrow_rate")).alias("borrow_pct"),
    )
    return rates.withColumn("gap_pct", F.col("lend_pct") - F.col("borrow_pct"))


def view_expiries(boxes: DataFrame, ticker: str | None = None) -> DataFrame:
    """Distinct expiries on offer per ticker, in order."""
    if ticker:
        boxes = boxes.filter(F.col("ticker") == ticker)
    return boxes.select("ticker", "expiry").distinct().orderBy("ticker", "expiry")


def top_opportunities(boxes: DataFrame, n: int = 10, *, as_text: bool = False) -> DataFrame:
    """The ``n`` highest lend rates, then the ``n`` borrow rates nearest to zero.

    ``side`` and ``rank`` give the order. With ``as_text`` the rates are percent text.
    Only the columns present in ``boxes`` are shown.
    """
    shown = [c for c in TOP_COLUMNS if c in boxes.columns]
    ties = [c for c in ("ticker", "expiry", "kl", "ks", "snapshot_time") if c in boxes.columns]

    # Each box once for each side it stands on; tasks keep n rows of a side before the shuffle.
    lend = F.when(F.col("lend_rate") > 0, F.col("lend_rate"))
    borrow = F.when(F.col("borrow_rate") < 0, F.col("borrow_rate"))
    sides = [F.struct(F.lit(name).alias("side"), rate.alias("rate")) for name, rate in (("lend", lend), ("borrow", borrow))]
    sided = boxes.withColumn("_side", F.explode(F.array(*sides))).filter("_side.rate IS NOT NULL")
    order = [F.col("_side.rate").desc(), *[F.col(tie).asc() for tie in ties]]
    ranked = sided.withColumn("rank", F.row_number().over(Window.partitionBy("_side.side").orderBy(*order)))
    top = ranked.filter(F.col("rank") <= n).select(F.col("_side.side").alias("side"), "rank", *shown)
    top = top.orderBy(F.col("side").desc(), "rank")
    if as_text:
        rates = [c for c in ("mid_rate", "lend_rate", "borrow_rate") if c in shown]
        top = top.withColumns({c: percent_text(F.col(c)) for c in rates})
    return top
