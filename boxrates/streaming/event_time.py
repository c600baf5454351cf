"""Merging a stream by the time that messages bear, with an end to every contract's state.

``live.stream_merge`` follows the order of arrival and keeps a contract for ever. Here the
last value is the one with the latest event time, late messages find their place as long
as the watermark has not passed them, repeated ones count once, and when the watermark
passes a contract's end its state is dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from boxrates.functions.pricing import expiry_time
from boxrates.operators.quotes import COUNT_FIELDS, PRICE_FIELDS, SIZE_FIELDS, merge_updates
from boxrates.schema import CONTRACT, QUOTES

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A contract's state is kept until this long after 00:00 UTC of its expiry.
GRACE = timedelta(days=1)
# Without an expiry that can be read, a contract ends this long after its last message.
IDLE = timedelta(days=7)

FIELDS = [*PRICE_FIELDS, *COUNT_FIELDS, *SIZE_FIELDS, "symbol"]
_TYPES = {f.name: f.dataType.simpleString() for f in QUOTES.fields}

OUTPUT = ", ".join(
    [f"{c} {_TYPES[c]}" for c in [*CONTRACT, *FIELDS]] + ["n_updates bigint", "last_update timestamp_ntz", "ended boolean"]
)


def merge_by_time(updates: DataFrame) -> DataFrame:
    """The batch form: ``merge_updates`` in the order of (``snapshot_time``, ``seq``), repeats once."""
    once = updates.dropDuplicates([*CONTRACT, "snapshot_time", "seq"])
    return merge_updates(once.withColumn("seq", F.struct("snapshot_time", "seq"))).drop("seq")


def _message(ends: Column) -> Column:
    """What a contract's state needs of a message, as one text: each cell of a row costs its worker time.

    ``news`` holds only the fields whose value replaces an earlier one.
    """
    news = [F.nullif(field, F.lit(0)).alias(field) for field in [*PRICE_FIELDS, *COUNT_FIELDS]]
    news += [*SIZE_FIELDS, F.nullif("symbol", F.lit("")).alias("symbol")]
    place = [F.unix_micros("_event").alias("at"), F.col("seq").cast("string").alias("seq")]
    return F.to_json(F.struct(*place, ends.alias("ends"), F.struct(*news).alias("news")))


class _Merge(StatefulProcessor):
    """One contract: each field's last value with its place in time."""

    def init(self, handle) -> None:
        self.handle = handle
        self.quote = handle.getValueState("quote", "fields string, n bigint, last bigint, ends bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        stored = self.quote.get()
        fields, n, last = (json.loads(stored[0]), stored[1], stored[2]) if stored else ({}, 0, 0)
        ends = stored[3] if stored else None
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        for row in rows:
            message = json.loads(row.message)
            at, place = message["at"], [message["at"], int(message["seq"])]
            if at < passed:
                continue  # too late
            n, last = n + 1, max(last, at)
            for field, value in message["news"].items():
                if field not in fields or place >= fields[field][0]:
                    fields[field] = [place, value]
            if ends is None and "ends" in message:
                ends = message["ends"]
                self.handle.registerTimer(ends)
        if not n:
            return
        if ends is None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last // 1000 + int(IDLE.total_seconds() * 1000))
        self.quote.update((json.dumps(fields), n, last, ends))
        yield self._row(key, fields, n, last, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        fields, n, last, _ = self.quote.get()
        self.quote.clear()
        yield self._row(key, json.loads(fields), n, last, True)

    def close(self) -> None:
        """Nothing is held outside the state."""

    def _row(self, key, fields: dict, n: int, last: int, ended: bool) -> Row:
        zero = {**dict.fromkeys(PRICE_FIELDS, 0.0), **dict.fromkeys(COUNT_FIELDS, 0)}
        values = [fields[f][1] if f in fields else zero.get(f) for f in FIELDS]
        values = [float(v) if f in PRICE_FIELDS else v for f, v in zip(FIELDS, values, strict=True)]  # NaN is text in JSON
        at = datetime(1970, 1, 1) + timedelta(microseconds=last)
        return Row(*[*CONTRACT, *FIELDS, "n_updates", "last_update", "ended"])(*key, *values, n, at, ended)


def merged_by_time(quotes: DataFrame, *, delay: timedelta = timedelta(minutes=10), grace: timedelta = GRACE) -> DataFrame:
    """A stream of the contracts that each batch changed or ended, as they are then.

    ``quotes`` is a stream as ``quotes_from_messages`` gives it, its event time in
    ``snapshot_time``. Messages up to ``delay`` behind the latest one are merged as if they
    had come in order; later ones are dropped. Repeated messages (equal time and ``seq``) count once.
    A contract's state goes when the watermark passes its expiry by ``grace``; its last row
    then comes once more, with ``ended``. Write it in update mode.

    Needs the RocksDB state store (``use_rocksdb``).
    """

    def instant(time: Column) -> Column:
        return F.concat(time.cast("string"), F.lit("Z")).cast("timestamp")

    end = F.unix_millis(F.col("_expires"))
    timed = quotes.filter(F.col("snapshot_time").isNotNull()).withColumns(
        {"_event": instant(F.col("snapshot_time")), "_expires": instant(expiry_time(F.col("expiry")))}
    )
    timed = timed.withWatermark("_event", f"{int(delay.total_seconds() * 1000)} milliseconds")
    # The keys that the watermark hasn't passed are state of their own: a batch adds its keys and
    # rewrites no others, and a contract with many messages is spread. A repeat of an older
    # message is late itself.
    once = timed.dropDuplicates([*CONTRACT, "_event", "seq"])
    rows = once.select(*CONTRACT, "_event", _message(end + int(grace.total_seconds() * 1000)).alias("message"))
    return rows.groupBy(*CONTRACT).transformWithState(
        statefulProcessor=_Merge(), outputStructType=_schema(OUTPUT), outputMode="Update", timeMode="EventTime"
    )


def _schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


def use_rocksdb(spark: SparkSession) -> None:
    """Let streams that start from now on in this session keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def stream_merge_by_time(
    quotes: DataFrame, path: str, *, delay: timedelta = timedelta(minutes=10), grace: timedelta = GRACE, checkpoint: str | None = None, **trigger
) -> StreamingQuery:
    """Write ``merged_by_time`` below ``path``, a folder per batch; read it with ``latest_by_time``."""

    def on_batch(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/quotes/batch_id={batch_id}")

    return (
        merged_by_time(quotes, delay=delay, grace=grace)
        .writeStream.outputMode("update")
        .foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint or f"{path}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def latest_by_time(spark: SparkSession, path: str, *, ended: bool = False) -> DataFrame:
    """The last row of every contract; of those that have ended only if ``ended``."""
    schema = _schema(OUTPUT).add("batch_id", T.LongType())
    rows = spark.read.schema(schema).option("basePath", f"{path}/quotes").parquet(f"{path}/quotes")
    state = [c for c in rows.columns if c not in (*CONTRACT, "batch_id")]
    order = F.struct("batch_id", "ended")
    last = rows.groupBy(*CONTRACT).agg(F.max_by(F.struct(*state), order).alias("q")).select(*CONTRACT, "q.*")
    return last if ended else last.filter("NOT ended")
