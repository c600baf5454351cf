"""What several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxrates.session import work_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared work folder and read again.

    Later steps then start from files that no lost executor takes along.
    """
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """A text column as string, NULL as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def digest_of(text: Column) -> Column:
    """SHA-256 of a text's UTF-8 bytes, as 32 bytes."""
    return F.unhex(F.sha2(text, 256))
