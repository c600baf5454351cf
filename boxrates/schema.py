"""Column layouts shared by the operators.

Times are TIMESTAMP_NTZ holding UTC wall-clock time, so results do not depend on
the session time zone. A missing value is NULL, never NaN: Spark orders NaN above
every number, and a forgotten NaN test would let rows through a filter.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# One chain: the unit within which strikes are paired.
CHAIN = ["ticker", "expiry", "snapshot_time"]

# One option contract: the key of the live quote state.
CONTRACT = ["ticker", "expiry", "strike", "option_type"]

QUOTES = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("expiry", T.StringType()),
        T.StructField("strike", T.DoubleType()),
        T.StructField("option_type", T.StringType()),
        T.StructField("bid", T.DoubleType()),
        T.StructField("ask", T.DoubleType()),
        T.StructField("last", T.DoubleType()),
        T.StructField("mark", T.DoubleType()),
        T.StructField("volume", T.LongType()),
        T.StructField("open_interest", T.LongType()),
        T.StructField("bid_size", T.LongType()),
        T.StructField("ask_size", T.LongType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("snapshot_time", T.TimestampNTZType()),
    ]
)

BOXES = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("expiry", T.StringType()),
        T.StructField("snapshot_time", T.TimestampNTZType()),
        T.StructField("kl", T.DoubleType()),
        T.StructField("ks", T.DoubleType()),
        T.StructField("width", T.DoubleType()),
        T.StructField("mid_strike", T.DoubleType()),
        T.StructField("tte_years", T.DoubleType()),
        T.StructField("payoff", T.DoubleType()),
        T.StructField("mid_cost", T.DoubleType()),
        T.StructField("lend_cost", T.DoubleType()),
        T.StructField("borrow_proceeds", T.DoubleType()),
        T.StructField("mid_rate", T.DoubleType()),
        T.StructField("lend_rate", T.DoubleType()),
        T.StructField("borrow_rate", T.DoubleType()),
        T.StructField("spot_price", T.DoubleType()),
        T.StructField("moneyness_kl", T.DoubleType()),
        T.StructField("moneyness_ks", T.DoubleType()),
        T.StructField("moneyness_mid", T.DoubleType()),
        T.StructField("call_kl_volume", T.LongType()),
        T.StructField("call_ks_volume", T.LongType()),
        T.StructField("put_kl_volume", T.LongType()),
        T.StructField("put_ks_volume", T.LongType()),
        T.StructField("call_kl_open_interest", T.LongType()),
        T.StructField("call_ks_open_interest", T.LongType()),
        T.StructField("put_kl_open_interest", T.LongType()),
        T.StructField("put_ks_open_interest", T.LongType()),
        T.StructField("min_leg_volume", T.LongType()),
        T.StructField("total_leg_volume", T.LongType()),
    ]
)


def utc(time: datetime) -> Column:
    """Literal of a naive UTC time; as text, for a datetime literal would follow the session zone."""
    return F.lit(time.isoformat(sep=" ")).cast("timestamp_ntz")


def utc_of(time: str) -> Column:
    """UTC wall-clock time of a TIMESTAMP column, whatever the session zone."""
    seconds = f"CAST(CAST(unix_micros({time}) AS DECIMAL(24, 0)) / 1000000 AS DECIMAL(18, 6))"
    return F.expr(f"timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, {seconds})")


def with_order_of(schema: T.StructType, df: DataFrame) -> T.StructType:
    """``schema`` with ``seq`` of the type that it has in ``df``."""
    if "seq" not in df.columns:
        return schema
    kind = df.schema["seq"].dataType
    return T.StructType([T.StructField(f.name, kind) if f.name == "seq" else f for f in schema.fields])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to ``schema`` in its order, adding absent columns as NULL."""
    present = set(df.columns)
    return df.selectExpr(
        *[
            f"CAST({f.name if f.name in present else 'NULL'} AS {f.dataType.simpleString()})"
            f" AS {f.name}"
            for f in schema.fields
        ]
    )
