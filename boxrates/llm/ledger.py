"""A growing table of results by content digest, shared by caches and scan ledgers.

The ledger is a Parquet folder partitioned by ``version`` (of a tokenizer, of a rule set). A
run computes results only for (digest, version) pairs that it lacks and appends them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_ledger(spark: SparkSession, path: str, version: str, result: T.DataType) -> DataFrame:
    """``digest, result`` of one version; empty where nothing is stored yet.

    Two runs at the same time may both have stored a digest; one of the (equal) results is
    taken.
    """
    schema = T.StructType().add("digest", "binary").add("result", result).add("version", "string")
    try:
        found = spark.read.schema(schema).parquet(path).filter(F.col("version") == version)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], schema)
    return found.groupBy("digest").agg(F.first("result").alias("result"))


def extend(
    blobs: DataFrame, path: str, version: str, compute: Callable, result: T.DataType
) -> DataFrame:
    """Add what the ledger lacks of ``blobs`` (``digest, text``) and return it as it is then.

    Copies are merged on the map side before texts are shuffled, so a blob that makes up a
    third of the rows moves once per map task. ``compute`` maps a text column to a column
    of type ``result``.
    """
    spark = blobs.sparkSession
    known = read_ledger(spark, path, version, result).select("digest")
    distinct = blobs.groupBy("digest").agg(F.first("text").alias("text"))
    unseen = distinct.join(known, "digest", "left_anti")
    unseen.select("digest", compute(F.col("text")).alias("result")).withColumn(
        "version", F.lit(version)
    ).write.partitionBy("version").mode("append").parquet(path)
    return read_ledger(spark, path, version, result)
