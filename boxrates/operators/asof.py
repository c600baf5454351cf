"""As-of joins: the last known value at a time, by range partitions that split a hot key."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxrates.session import staged

SPOTS = "ticker string, spot_time timestamp_ntz, spot_price double, seq bigint"


def as_of(
    rows: DataFrame,
    history: DataFrame,
    *,
    on: Sequence[str],
    time: str,
    history_time: str,
    values: Sequence[str],
    order: Sequence[str] = (),
    within: timedelta | None = None,
) -> DataFrame:
    """``rows`` with ``values`` of the last row of ``history`` at or before ``time``, by key ``on``.

    Only distinct (key, time) stamps take part in the search. They are laid out together
    with the history by ranges of (key, time), so a key that holds most rows covers many
    partitions. The last value is carried down within each partition; what a key's earlier
    partitions end with, one row for each of them, is carried into the next. A stamp thus
    costs the same however long ago its value was set.

    - Of history rows with the same key and time the one with the largest ``order`` counts,
      and of equals the one with the largest values.
    - Rows with a NULL key or time, or before the first value, get NULL; history rows with a
      NULL key or time count for nothing. A NULL value is a value and hides earlier ones.
    - ``within`` leaves out values set longer ago than that.
    - Repeated rows stay, each with the value. Other columns of ``rows`` stay as they are.
    """
    keys = list(on)
    clash = set(values) & set(rows.columns)
    if clash:
        raise ValueError(f"columns of rows would be hidden: {sorted(clash)}")
    known = [F.col(k).isNotNull() for k in keys]

    def all_known(df: DataFrame, at: str) -> DataFrame:
        for condition in [*known, F.col(at).isNotNull()]:
            df = df.filter(condition)
        return df

    value = F.struct(F.col(history_time).alias("_set"), *values)
    rank = F.struct(*order, *values)
    points = (
        all_known(history, history_time)
        .groupBy(*keys, F.col(history_time).alias("_at"))
        .agg(F.max_by(value, rank).alias("_value"))
        .withColumn("_asked", F.lit(False))
    )
    stamps = all_known(rows, time).select(*keys, F.col(time).alias("_at")).distinct()
    points = points.unionByName(
        stamps.withColumns({"_asked": F.lit(True), "_value": F.lit(None).cast(points.schema["_value"].dataType)})
    )
    ranged = points.repartitionByRange(*keys, "_at").withColumn("_part", F.spark_partition_id())
    # Stored, as both what is carried and where it is carried to must see the same partitions.
    ranged = staged(ranged, "as-of")

    here = Window.partitionBy("_part", *keys).orderBy("_at", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    found = ranged.withColumn("_found", F.last("_value", ignorenulls=True).over(here)).filter("_asked")
    ends = ranged.groupBy("_part", *keys).agg(F.max_by("_value", F.when(~F.col("_asked"), F.col("_at"))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(before))
    found = found.join(carried.select("_part", *keys, "_carried"), ["_part", *keys])
    last: Column = F.coalesce("_found", "_carried")
    if within is not None:
        fresh = F.col("_at") - last["_set"] <= F.lit(within)
        last = F.when(fresh, last)
    found = found.withColumn("_last", last)
    found = found.select(*keys, F.col("_at").alias(time), *[F.col(f"_last.{v}").alias(v) for v in values])
    return rows.join(found, [*keys, time], "left").select(*rows.columns, *values)


def spot_as_of(
    rows: DataFrame, spots: DataFrame, *, time: str = "snapshot_time", within: timedelta | None = None
) -> DataFrame:
    """The ``spot_price`` each ticker of ``rows`` had at ``time``: one row per (ticker, ``time``).

    ``spots`` holds ``ticker, spot_time, spot_price`` and perhaps ``seq``, by which the last
    of several prices of one time is told. The result serves as ``feed`` of ``build_boxes``; prices that are missing or
    not above 0 are passed over.
    """
    order = ["seq"] if "seq" in spots.columns else []
    priced = spots.filter(F.nanvl(F.col("spot_price"), F.lit(0.0)) > 0)
    stamps = rows.select("ticker", time).distinct()
    return as_of(
        stamps, priced, on=["ticker"], time=time, history_time="spot_time", values=["spot_price"], order=order, within=within
    )


def read_spots(spark: SparkSession, path: str) -> DataFrame:
    """A landed spot history as it is now; call it again to see what has landed since."""
    return spark.read.schema(SPOTS).parquet(path)
