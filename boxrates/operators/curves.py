"""Rate curves over tenors: interpolation, spreads over another curve, carry between currencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxrates.operators.asof import as_of

# Years; segments of a curve are looked up by buckets of this width.
BUCKET = 0.25


def interpolated(
    rows: DataFrame,
    curve: DataFrame,
    *,
    on: Sequence[str],
    x: str,
    curve_x: str,
    y: str,
    name: str,
    bucket: float = BUCKET,
) -> DataFrame:
    """``rows`` with ``name``: the curve of the row's key, linear between neighbouring points.

    Before the first and behind the last point the curve is flat. Each curve is cut into
    segments between neighbours. A segment visits every bucket of ``x`` that it touches
    and a row one, so the bracketing join is an equality on (key, bucket), whose row side
    Spark may split when a key is hot; the curve's side is broadcast only if it measures
    small.

    - Points that repeat an ``x`` count with their mean; points with a NULL are passed over.
    - Rows with a NULL key or ``x``, or without a curve, get NULL. Rows keep their columns.
    """
    keys = list(on)
    points = curve.filter(F.col(curve_x).isNotNull() & F.col(y).isNotNull())
    points = points.groupBy(*keys, F.col(curve_x).cast("double").alias("_lo")).agg(F.avg(y).alias("_y"))
    order = Window.partitionBy(*keys).orderBy("_lo")
    segments = points.withColumns(
        {
            "_hi": F.coalesce(F.lead("_lo").over(order), F.col("_lo")),
            "_next": F.coalesce(F.lead("_y").over(order), F.col("_y")),
        }
    )

    def place(value):
        return F.floor(value / bucket)

    segments = segments.withColumn("_bucket", F.explode(F.sequence(place(F.col("_lo")), place(F.col("_hi")))))
    ends = points.groupBy(*keys).agg(F.min("_lo").alias("_first"), F.max("_lo").alias("_last"))
    inside = F.greatest(F.least(F.col(x).cast("double"), F.col("_last")), F.col("_first"))
    placed = rows.join(ends, keys, "left").withColumn("_x", F.when(F.col(x).isNotNull(), inside))
    placed = placed.withColumn("_bucket", place(F.col("_x")))
    at = F.col("_x")
    within = (at >= F.col("_lo")) & ((at < F.col("_hi")) | (F.col("_lo") == F.col("_hi")))
    same = [placed[k] == segments[k] for k in [*keys, "_bucket"]]
    joined = placed.join(segments, [*same, within], "left")
    part = F.try_divide(at - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    value = F.col("_y") + F.coalesce(part, F.lit(0.0)) * (F.col("_next") - F.col("_y"))
    return joined.select(*[placed[c] for c in rows.columns], value.alias(name))


def curve_spread(
    boxes: DataFrame, curve: DataFrame, *, on: Sequence[str] = (), bucket: float = BUCKET
) -> DataFrame:
    """Boxes with ``curve_rate``, a sovereign curve at their time to expiry, and ``spread``.

    ``curve`` holds ``curve_time, tenor_years, rate``, and the columns ``on`` (a currency, say)
    where there are several curves. A box takes the curve published last at its snapshot
    time; ``spread`` is its mid rate above that curve.
    """
    dates = curve.filter("tenor_years IS NOT NULL AND rate IS NOT NULL")
    one = [*on] or ["_all"]
    if not on:
        boxes, curve, dates = (df.withColumn("_all", F.lit(1)) for df in (boxes, curve, dates))
    # The time itself is the value that a box takes; its points follow by equality.
    dates = dates.select(*one, F.col("curve_time").alias("_published"), "curve_time").distinct()
    dated = as_of(
        boxes, dates, on=one, time="snapshot_time", history_time="_published", values=["curve_time"]
    )
    found = interpolated(
        dated, curve, on=[*one, "curve_time"], x="tte_years", curve_x="tenor_years", y="rate", name="curve_rate", bucket=bucket
    )
    spread = (F.col("mid_rate") - F.col("curve_rate")).alias("spread")
    return found.select(*[c for c in boxes.columns if c != "_all"], "curve_time", "curve_rate", spread)


def on_grid(
    curves: DataFrame, tenors: Sequence[float], *, on: Sequence[str], x: str = "tenor_years", y: str = "rate"
) -> DataFrame:
    """Every curve resampled onto the same ``tenors``: ``on, tenor, rate``.

    Between points the curve is linear; beyond them it is filled from its ends.
    """
    grid = curves.select(*on).distinct().withColumn("tenor", F.explode(F.array(*[F.lit(float(t)) for t in tenors])))
    return interpolated(grid, curves, on=on, x="tenor", curve_x=x, y=y, name="rate")


def carry_by_tenor(
    curves: DataFrame,
    tenors: Sequence[float],
    *,
    base: str,
    currency: str = "currency",
    at: Sequence[str] = ("snapshot_time",),
    x: str = "tenor_years",
    y: str = "rate",
) -> DataFrame:
    """What each currency's rate carries over that of ``base``, tenor by tenor.

    Output: ``at, currency, tenor, rate, base_rate, carry``, for every time at which both the
    currency and the base have a curve.
    """
    grid = on_grid(curves, tenors, on=[*at, currency], x=x, y=y)
    bases = grid.filter(F.col(currency) == base).select(*at, "tenor", F.col("rate").alias("base_rate"))
    others = grid.filter(F.col(currency) != base)
    carry = (F.col("rate") - F.col("base_rate")).alias("carry")
    return others.join(bases, [*at, "tenor"]).select(*at, currency, "tenor", "rate", "base_rate", carry)
