"""Folders of a Spark file system: listing and deleting. The one place that asks the JVM for it."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def _handle(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern, in order."""
    system, path = _handle(spark, pattern)
    return sorted(status.getPath().toString() for status in system.globStatus(path) or [])


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder with all that it holds; absent ones are no error."""
    system, hadoop = _handle(spark, path)
    system.delete(hadoop, True)


def complete_batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the completely written ``batch_id=`` folders, ascending."""
    found = matching(spark, f"{folder}/batch_id=*/_SUCCESS")
    return sorted(int(re.search(r"batch_id=(\d+)/_SUCCESS$", path).group(1)) for path in found)
