"""Life of a stream: how far its bootstrap is, what its batches did, and why it stopped."""

from __future__ import annotations

import json
import threading
from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from boxrates.operators.normalise import quotes_from_items
from boxrates.sources.chain_pages import chain_items

EVENTS = (
    "query_id string, run_id string, name string, kind string, at timestamp_ntz, batch_id bigint, "
    "input_rows bigint, batch_ms bigint, state_rows bigint, observed string, error string"
)


class StatusLog(StreamingQueryListener):
    """Writes a row to ``path`` for each start, batch and end of a query.

    ``spark.streams.addListener(StatusLog(spark, path))``; read it with ``stream_states``.
    ``names`` limits it to queries of those names. Rows of batches are written ``every`` so many,
    those of starts and ends at once. The folder may be shared by several sessions.
    """

    def __init__(self, spark: SparkSession, path: str, *, names: Sequence[str] = (), every: int = 1):
        self.spark = spark
        self.path = path
        self.names = set(names)
        self.every = every
        self.known: dict[str, str | None] = {}
        self.rows: list[tuple] = []
        self.ended = 0  # ends of queries that have been written
        self.lock = threading.Lock()

    def _add(self, query_id, run_id, kind, at, *, flush, batch=(None,) * 5, error=None) -> None:
        name = self.known.get(query_id)
        if self.names and name not in self.names:
            return
        with self.lock:
            self.rows.append((query_id, run_id, name, kind, at, *batch, error))
            rows = []
            if flush or len(self.rows) >= self.every:
                rows, self.rows = self.rows, []
        if rows:
            self.spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryStarted(self, event) -> None:
        self.known[str(event.id)] = event.name
        self._add(str(event.id), str(event.runId), "started", _time(event.timestamp), flush=True)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        state = sum(op.numRowsTotal for op in p.stateOperators)
        observed = {name: row.asDict() for name, row in (p.observedMetrics or {}).items()}
        text = json.dumps(observed, default=str, sort_keys=True) if observed else None
        batch = (p.batchId, p.numInputRows, p.batchDuration, state, text)
        self._add(str(p.id), str(p.runId), "batch", _time(p.timestamp), flush=False, batch=batch)

    def onQueryIdle(self, event) -> None:
        """Nothing arrived; nothing is written."""

    def onQueryTerminated(self, event) -> None:
        error = event.exception
        kind = "failed" if error else "stopped"
        now = datetime.now(UTC).replace(tzinfo=None)
        self._add(str(event.id), str(event.runId), kind, now, flush=True, error=error)
        self.ended += 1


def _time(text: str) -> datetime:
    return datetime.fromisoformat(text).astimezone(UTC).replace(tzinfo=None)


def stream_states(spark: SparkSession, path: str) -> DataFrame:
    """One row per query of a ``StatusLog``, as of its latest run.

    Output: ``query_id, name, state, since, batches, last_batch, last_progress, input_rows,
    state_rows, observed, error``. ``state`` is running, stopped or failed, and ``error`` what
    the latest run failed with.
    """
    events = spark.read.schema(EVENTS).parquet(path)
    started = F.max(F.when(F.col("kind") == "started", F.col("at")))
    runs = events.groupBy("query_id", "run_id").agg(
        F.max("name").alias("name"),
        started.alias("since"),
        F.max(F.when(F.col("kind").isin("failed", "stopped"), F.col("kind"))).alias("ended"),
        F.max("error").alias("error"),
        F.count_if(F.col("kind") == "batch").alias("batches"),
        F.max("batch_id").alias("last_batch"),
        F.max(F.when(F.col("kind") == "batch", F.col("at"))).alias("last_progress"),
        F.coalesce(F.sum("input_rows"), F.lit(0)).alias("input_rows"),
        F.max_by("state_rows", F.when(F.col("kind") == "batch", F.col("batch_id"))).alias("state_rows"),
        F.max_by("observed", F.when(F.col("kind") == "batch", F.col("batch_id"))).alias("observed"),
    )
    fields = [c for c in runs.columns if c not in ("query_id", "since")]
    latest = runs.groupBy("query_id").agg(F.max_by(F.struct("since", *fields), "since").alias("r"))
    shown = latest.select("query_id", "r.*").withColumn("state", F.coalesce("ended", F.lit("running")))
    return shown.select(
        "query_id", "name", "state", "since", "batches", "last_batch", "last_progress", "input_rows", "state_rows", "observed", "error"
    )


def bootstrap_states(pages: DataFrame, tickers: Sequence[str]) -> DataFrame:
    """``ticker, state, pages, items, symbols`` of every one of ``tickers``, from landed chain pages.

    ``state`` is ``pending`` without a page, ``failed`` if no page can be read, ``empty`` if those
    that can hold no item, else ``done``. ``symbols`` counts what a stream can subscribe to.
    """
    wanted = pages.sparkSession.createDataFrame([(t,) for t in tickers], "ticker string")
    readable = F.try_parse_json("document").isNotNull()
    landed = pages.groupBy("ticker").agg(F.count(F.lit(1)).alias("pages"), F.count_if(readable).alias("_readable"))
    found = quotes_from_items(chain_items(pages)).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("items"), F.count_distinct(F.nullif("symbol", F.lit(""))).alias("symbols")
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("pages", "_readable", "items", "symbols")}
    joined = wanted.join(landed, "ticker", "left").join(found, "ticker", "left").withColumns(zero)
    state = (
        F.when(F.col("pages") == 0, "pending")
        .when(F.col("_readable") == 0, "failed")
        .when(F.col("items") == 0, "empty")
        .otherwise("done")
    )
    return joined.select("ticker", state.alias("state"), "pages", "items", "symbols")


def bootstrap_progress(states: DataFrame) -> DataFrame:
    """One row over ``bootstrap_states``: tickers done with (well or not), of how many, which
    went wrong, and how many symbols there are to subscribe to."""

    def names(state: str):
        return F.concat_ws(",", F.array_sort(F.collect_list(F.when(F.col("state") == state, F.col("ticker")))))

    return states.agg(
        F.count_if(F.col("state") != "pending").alias("bootstrap_done"),
        F.count(F.lit(1)).alias("bootstrap_total"),
        names("failed").alias("tickers_failed"),
        names("empty").alias("tickers_empty"),
        F.coalesce(F.sum("symbols"), F.lit(0)).alias("subscribed"),
    )
