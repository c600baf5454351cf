"""Stored snapshots of boxes: the managed table, foreign files, retention and status."""

from __future__ import annotations

from datetime import datetime, timedelta
from pathlib import PurePosixPath
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxrates.schema import BOXES, conform, utc
from boxrates.sources.paths import delete, matching

PARTITIONS = ["snapshot_date", "snapshot_time"]

_STORED = T.StructType([*BOXES.fields, T.StructField("snapshot_date", T.DateType())])

# Foreign files hold the time as ISO text and may lack the newer columns.
_FOREIGN = T.StructType(
    [
        T.StructField(f.name, T.StringType() if f.name == "snapshot_time" else f.dataType)
        for f in BOXES.fields
    ]
)


def write_snapshot(boxes: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Store boxes partitioned by snapshot; storing a snapshot again replaces it.

    The rebalance hint gathers each snapshot into few files, yet lets Spark split a
    snapshot that outweighs the others.
    """
    dated = boxes.withColumn("snapshot_date", F.to_date("snapshot_time"))
    writer = dated.hint("rebalance", *[F.col(p) for p in PARTITIONS]).write.partitionBy(*PARTITIONS)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).mode("overwrite").option("partitionOverwriteMode", "dynamic").save(path)


def _nothing_there(error: AnalysisException, missing_ok: bool) -> bool:
    return missing_ok and error.getCondition() == "PATH_NOT_FOUND"


def scan_snapshots(
    spark: SparkSession, path: str, fmt: str = "parquet", *, missing_ok: bool = False
) -> DataFrame:
    """All stored boxes. A path that does not exist is an error unless ``missing_ok``."""
    try:
        reader = spark.read.schema(_STORED)
        if fmt == "csv":
            reader = reader.option("header", True)
        return conform(reader.format(fmt).load(path), BOXES)
    except AnalysisException as error:
        if not _nothing_there(error, missing_ok):
            raise
        return spark.createDataFrame([], BOXES)


# --- answers from the listing alone -----------------------------------------------


def snapshot_listing(
    spark: SparkSession, path: str, fmt: str = "parquet", *, missing_ok: bool = False
) -> DataFrame:
    """``snapshot_time, files, bytes, written`` of every stored snapshot; no file is opened.

    The time is read off the folder's name, so it does not depend on the session's zone.
    """
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{fmt}").load(path)
    except AnalysisException as error:
        if not _nothing_there(error, missing_ok):
            raise
        files = spark.createDataFrame([], "path string, length bigint, modificationTime timestamp")
    folder = F.regexp_extract("path", f"/{PARTITIONS[1]}=([^/]+)/[^/]+$", 1)
    time = F.try_url_decode(folder).try_cast("timestamp_ntz").alias("snapshot_time")
    found = files.select(time, "length", "modificationTime").filter("snapshot_time IS NOT NULL")
    return found.groupBy("snapshot_time").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("length").alias("bytes"),
        F.max("modificationTime").alias("written"),
    )


def recent_history(
    spark: SparkSession, path: str, *, as_of: datetime, minutes: int = 30, fmt: str = "parquet"
) -> DataFrame:
    """Stored boxes of the last ``minutes`` before ``as_of`` (UTC, naive), and always the newest.

    The newest time comes from the listing and bounds the partitions that are read.
    """
    newest = snapshot_listing(spark, path, fmt).agg(F.max("snapshot_time"))
    bound = newest.select(F.least(F.lit(utc(as_of - timedelta(minutes=minutes))), newest.columns[0]))
    return scan_snapshots(spark, path, fmt).filter(F.col("snapshot_time") >= bound.scalar())


def retained_history(spark: SparkSession, path: str, keep: int, fmt: str = "parquet") -> DataFrame:
    """Boxes of the newest ``keep`` stored snapshots; the others are not opened."""
    kept = newest_snapshots(snapshot_listing(spark, path, fmt), keep)
    bound = kept.agg(F.min("snapshot_time")).scalar()
    return scan_snapshots(spark, path, fmt).filter(F.col("snapshot_time") >= bound)


def history_status(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """One row: number of stored snapshots and the newest one's time. Opens no file."""
    listing = snapshot_listing(spark, path, fmt, missing_ok=True)
    return listing.agg(
        F.count(F.lit(1)).alias("snapshots"), F.max("snapshot_time").alias("last_snapshot")
    )


def collector_progress(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """One row: boxes in the newest stored snapshot, and its time. Opens that snapshot alone."""
    newest = snapshot_listing(spark, path, fmt, missing_ok=True).agg(F.max("snapshot_time")).scalar()
    boxes = scan_snapshots(spark, path, fmt, missing_ok=True)
    return boxes.filter(F.col("snapshot_time") == newest).agg(
        F.count(F.lit(1)).alias("rows"), F.max("snapshot_time").alias("last_snapshot")
    )


# --- the same on any table of boxes -----------------------------------------------


def recent_snapshots(stored: DataFrame, *, as_of: datetime, minutes: int = 30) -> DataFrame:
    """Boxes of the last ``minutes`` before ``as_of`` (UTC, naive), and always the newest snapshot.

    Both conditions are on the partition column, so only wanted snapshots are read.
    """
    cutoff = utc(as_of - timedelta(minutes=minutes))
    time = F.col("snapshot_time")
    latest = stored.agg(F.max("snapshot_time")).scalar()
    return stored.filter((time >= cutoff) | (time == latest))


def _snapshot_files(spark: SparkSession, path: str, name: str, missing_ok: bool) -> DataFrame:
    """Path and time of each foreign snapshot file; contents are not read."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", f"{name}.{{parquet,csv}}")
        return files.load(path).select("path", "modificationTime")
    except AnalysisException as error:
        if not _nothing_there(error, missing_ok):
            raise
        return spark.createDataFrame([], "path string, modificationTime timestamp")


def _in_use(spark: SparkSession, path: str, name: str, missing_ok: bool) -> tuple[str | None, int, datetime | None]:
    """``parquet`` if there is such a file, else ``csv`` if there is one; their number and newest time."""
    files = _snapshot_files(spark, path, name, missing_ok)
    kinds = files.groupBy(F.substring_index("path", ".", -1).alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.max("modificationTime").alias("newest")
    )
    found = {row.kind: row for row in kinds.collect()}  # two rows at most
    used = found.get("parquet") or found.get("csv")
    return (used.kind, used.n, used.newest) if used else (None, 0, None)


def read_snapshot_files(
    spark: SparkSession,
    path: str,
    *,
    as_of: datetime,
    minutes: int = 30,
    name: str = "snapshot_*",
    missing_ok: bool = False,
) -> DataFrame:
    """Foreign files ``snapshot_*.parquet`` (or ``.csv`` only if there is none) as boxes.

    Reads files modified in the last ``minutes`` before ``as_of`` (time-zone aware),
    and always the newest; the others are not opened. ``name`` is the pattern of their names.
    Absent columns are NULL and NaN becomes NULL.
    """
    kind, _, newest = _in_use(spark, path, name, missing_ok)
    if kind is None:
        return spark.createDataFrame([], BOXES)
    reader = spark.read.option("pathGlobFilter", f"{name}.{kind}")
    if kind == "csv":
        # A given schema would be matched by position; the header matches by name.
        files = reader.option("header", True).csv(path)
    else:
        files = reader.schema(_FOREIGN).parquet(path)
    modified = F.col("_metadata.file_modification_time")
    # A literal bound on file times is applied to the listing.
    bound = min(newest.astimezone(as_of.tzinfo), as_of - timedelta(minutes=minutes))
    files = files.filter(modified >= F.lit(bound))
    boxes = conform(files, _FOREIGN)
    doubles = [f.name for f in BOXES.fields if isinstance(f.dataType, T.DoubleType)]
    clean = {name: F.nanvl(F.col(name), F.lit(None).cast("double")) for name in doubles}
    clean["snapshot_time"] = F.col("snapshot_time").try_cast("timestamp_ntz")
    return conform(boxes.withColumns(clean), BOXES)


def snapshot_file_status(
    spark: SparkSession, path: str, *, name: str = "snapshot_*", missing_ok: bool = True
) -> DataFrame:
    """One row: number of foreign snapshot files in use and their newest time."""
    kind, _, _ = _in_use(spark, path, name, missing_ok)
    files = _snapshot_files(spark, path, name, missing_ok)
    return files.filter(F.col("path").endswith(f".{kind}")).agg(
        F.count(F.lit(1)).alias("file_count"), F.max("modificationTime").alias("latest_mtime")
    )


def table_status(stored: DataFrame) -> DataFrame:
    """One row: number of stored snapshots and the newest one's time."""
    return stored.agg(
        F.count_distinct("snapshot_time").alias("snapshots"),
        F.max("snapshot_time").alias("last_snapshot"),
    )


def collector_status(stored: DataFrame) -> DataFrame:
    """One row: boxes in the newest snapshot, and its time."""
    per_snapshot = stored.groupBy("snapshot_time").agg(F.count(F.lit(1)).alias("_rows"))
    return per_snapshot.agg(
        F.coalesce(F.max_by("_rows", "snapshot_time"), F.lit(0)).alias("rows"),
        F.max("snapshot_time").alias("last_snapshot"),
    )


def newest_snapshots(stored: DataFrame, keep: int) -> DataFrame:
    """Times of the newest ``keep`` snapshots."""
    times = stored.select("snapshot_time").distinct()
    return times.orderBy(F.col("snapshot_time").desc()).limit(keep)


def retained_snapshots(stored: DataFrame, keep: int) -> DataFrame:
    """Boxes of the newest ``keep`` snapshots; ``retained_history`` does so for a stored table
    without reading the others."""
    bound = newest_snapshots(stored, keep).agg(F.min("snapshot_time")).scalar()
    return stored.filter(F.col("snapshot_time") >= bound)


def prune_snapshots(spark: SparkSession, path: str, keep: int) -> int:
    """Delete all but the newest ``keep`` snapshots of the managed table; returns how many.

    Works on partition directories alone and reads no data.
    """
    found = matching(spark, f"{path}/{PARTITIONS[0]}=*/{PARTITIONS[1]}=*")
    found.sort(key=lambda folder: PurePosixPath(folder).name)
    excess = found[: max(len(found) - keep, 0)]
    for folder in excess:
        delete(spark, folder)
    return len(excess)


def clear_snapshots(spark: SparkSession, path: str, times: set[datetime]) -> None:
    """Delete the snapshots of ``times`` from the managed table."""
    for day in {time.date() for time in times}:
        for folder in matching(spark, f"{path}/{PARTITIONS[0]}={day}/{PARTITIONS[1]}=*"):
            written = unquote(PurePosixPath(folder).name.partition("=")[2])
            if datetime.fromisoformat(written) in times:
                delete(spark, folder)
