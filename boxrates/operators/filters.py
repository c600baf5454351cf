"""The interactive filters of a view of boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def view_filter(
    boxes: DataFrame,
    *,
    ticker: str | None = None,
    min_volume: int | None = None,
    width_range: Sequence[float] | None = None,
    moneyness_band: float | None = None,
) -> DataFrame:
    """Boxes of one ticker, leg volume, width range and moneyness band (in percent).

    A filter is off when its value is None, empty or 0, or when its column is absent.
    The band keeps ``|moneyness - 1| <= band / 100`` and drops unknown moneyness.
    """
    columns = boxes.columns
    if ticker:
        boxes = boxes.filter(F.col("ticker") == ticker)
    if min_volume and min_volume > 0 and "min_leg_volume" in columns:
        boxes = boxes.filter(F.col("min_leg_volume") >= min_volume)
    if width_range and len(width_range) == 2 and "width" in columns:
        boxes = boxes.filter(F.col("width").between(*width_range))
    if moneyness_band and "moneyness_mid" in columns:
        boxes = boxes.filter(F.abs(F.col("moneyness_mid") - 1.0) <= moneyness_band / 100.0)
    return boxes


def at_expiry(boxes: DataFrame, expiry: str | None) -> DataFrame:
    """Boxes of one expiry; all when ``expiry`` is None or empty."""
    return boxes.filter(F.col("expiry") == expiry) if expiry else boxes
